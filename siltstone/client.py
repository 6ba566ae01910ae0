"""A client of the HTTP service."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from typing import Any


class ServiceError(RuntimeError):
    def __init__(self, status: int, detail: str):
        super().__init__(f"{status}: {detail}")
        self.status, self.detail = status, detail


class Client:
    def __init__(self, url: str = "http://127.0.0.1:8000", key: str | None = None, timeout: float = 600):
        self.url, self.key, self.timeout = url.rstrip("/"), key, timeout

    def _call(self, path: str, body: dict[str, Any] | None = None) -> dict[str, Any]:
        headers = {"Content-Type": "application/json"} | ({"X-API-Key": self.key} if self.key else {})
        data = None if body is None else json.dumps(body).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url + path, data, headers), timeout=self.timeout) as reply:
                return json.load(reply)
        except urllib.error.HTTPError as error:
            raise ServiceError(error.code, json.load(error).get("detail", "")) from None

    def health(self) -> dict[str, Any]:
        return self._call("/v1/health")

    def index(self, path: str, **how: Any) -> dict[str, Any]:
        return self._call("/v1/index", {"path": path} | how)

    def retrieve(self, query: str, **how: Any) -> dict[str, Any]:
        return self._call("/v1/retrieve", {"query": query} | how)

    def context(self, query: str, **how: Any) -> dict[str, Any]:
        return self._call("/v1/context", {"query": query} | how)
