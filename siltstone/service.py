"""A thin HTTP service over the engine: /v1/health, /v1/index, /v1/retrieve, /v1/context."""

from __future__ import annotations

import hmac
import json
from dataclasses import replace
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from typing import Any

from siltstone.config import MAX_CANDIDATES, MAX_TOP_K, SettingsError
from siltstone.engine import Engine, ModelMismatch
from siltstone.providers import PROVIDERS


class Refused(Exception):
    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status, self.detail = status, detail


def allowed_path(path: str, roots: tuple[str, ...]) -> Path:
    """The resolved path, if it is within one of the roots (any, if there are none)."""
    found = Path(path).expanduser().resolve()
    if roots and not any(found.is_relative_to(Path(r).expanduser().resolve()) for r in roots):
        raise Refused(403, "path is outside the allowed roots")
    if not found.exists():
        raise Refused(404, "path not found")
    return found


def authorized(headers: Any, key: str | None) -> bool:
    """X-API-Key, or else a bearer token, compared in constant time."""
    if not key:
        return True
    given = headers.get("X-API-Key") or (headers.get("Authorization") or "").removeprefix("Bearer ")
    return hmac.compare_digest(given.encode(), key.encode())


#: Fields of the requests: type, least and most where they are numbers.
_QUERY: dict[str, tuple[type, int | None, int | None]] = {
    "query": (str, 1, None), "mode": (str, None, None), "top_k": (int, 1, MAX_TOP_K), "candidate_k": (int, 1, MAX_CANDIDATES),
    "rrf_k": (int, 1, None), "collection": (str, None, None), "provider": (str, None, None), "rerank": (bool, None, None),
}
SCHEMAS: dict[str, dict[str, tuple[type, int | None, int | None]]] = {
    "/v1/index": {"path": (str, 1, None), "collection": (str, None, None), "provider": (str, None, None), "recursive": (bool, None, None)},
    "/v1/retrieve": _QUERY,
    "/v1/context": _QUERY | {"max_chars": (int, 1, None)},
}
REQUIRED = {"/v1/index": "path", "/v1/retrieve": "query", "/v1/context": "query"}


def checked(path: str, body: Any) -> dict[str, Any]:
    """The request's fields, absent ones being None; unknown fields are passed over."""
    if not isinstance(body, dict):
        raise Refused(422, "the body must be an object")
    out: dict[str, Any] = {}
    for name, (kind, least, most) in SCHEMAS[path].items():
        value = out[name] = body.get(name)
        if value is None:
            if name == REQUIRED[path]:
                raise Refused(422, f"{name} is required")
            continue
        if not isinstance(value, kind) or (kind is int and isinstance(value, bool)):
            raise Refused(422, f"{name} must be of type {kind.__name__}")
        size = len(value.strip()) if kind is str else value
        if least is not None and size < least:
            raise Refused(422, f"{name} must not be blank" if kind is str else f"{name} must be at least {least}")
        if most is not None and size > most:
            raise Refused(422, f"{name} must be at most {most}")
    if out.get("mode") not in (None, "vector", "bm25", "hybrid"):
        raise Refused(422, f"unknown mode {out['mode']!r}")
    if out.get("provider") not in (None, *PROVIDERS):
        raise Refused(422, f"unknown provider {out['provider']!r}")
    return out


_engines: dict[tuple[str, str], Engine] = {}


def engine_of(engine: Engine, provider: str | None) -> Engine:
    """The engine itself, or one of the same index with another provider, made once per process."""
    if provider in (None, engine.provider.name):
        return engine
    key = (engine.folder.root, provider)
    if key not in _engines:
        _engines[key] = Engine(engine.spark, engine.folder.root, replace(engine.settings, embedding_provider=provider), registry=engine.registry, reranker=engine.reranker)
    return _engines[key]


def answer(engine: Engine, method: str, path: str, body: dict[str, Any]) -> dict[str, Any]:
    if (method, path) == ("GET", "/v1/health"):
        return {"status": "ok", "version": engine.version(), "root": engine.folder.root, "collection": engine.settings.collection}
    if method != "POST" or path not in ("/v1/index", "/v1/retrieve", "/v1/context"):
        raise Refused(404, "not found")
    asked = checked(path, body)
    engine = engine_of(engine, asked.pop("provider"))
    if path == "/v1/index":
        target = allowed_path(asked["path"], engine.settings.index_roots)
        walk = {} if asked["recursive"] is None else {"recursive": asked["recursive"]}
        summary, results = engine.index(target, asked["collection"], **walk)
        failed = [r.asDict() for r in results.filter("status = 'failed'").select("path", "error").collect()]
        if target.is_file() and failed:
            raise Refused(415 if "unsupported" in failed[0]["error"] else 422, failed[0]["error"])
        return summary | {"failures": failed, "max_files": engine.settings.max_index_files, "path": str(target), "collection": asked["collection"] or engine.settings.collection}
    query, mode = asked.pop("query"), asked["mode"] or engine.settings.mode
    if path == "/v1/retrieve":
        hits = [json.loads(x) for x in engine.retrieve([query], **asked).orderBy("rank").toJSON().collect()]
        reranked = engine.settings.rerank_enabled if asked["rerank"] is None else asked["rerank"]
        return {"query": query, "mode": mode, "hits": hits, "reranked": reranked}
    return json.loads(engine.context([query], **asked).toJSON().first()) | {"mode": mode}


def handler(engine: Engine, key: str | None) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _reply(self, status: int, payload: dict[str, Any]) -> None:
            data = json.dumps(payload).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _serve(self, method: str) -> None:
            try:
                if self.path != "/v1/health" and not authorized(self.headers, key):
                    raise Refused(401, "missing or wrong key")
                raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                self._reply(200, answer(engine, method, self.path, json.loads(raw) if raw else {}))
            except Refused as error:
                self._reply(error.status, {"detail": error.detail})
            except ModelMismatch as error:
                self._reply(409, {"detail": str(error)})
            except (SettingsError, json.JSONDecodeError) as error:
                self._reply(400, {"detail": str(error)})
            except Exception:
                self._reply(500, {"detail": "internal error"})

        def do_GET(self) -> None:
            self._serve("GET")

        def do_POST(self) -> None:
            self._serve("POST")

        def log_message(self, *args: Any) -> None:
            pass

    return Handler


def serve_forever(engine: Engine, host: str, port: int, key: str | None = None) -> None:
    ThreadingHTTPServer((host, port), handler(engine, key)).serve_forever()
