"""Settings, from defaults, a YAML file and the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

MAX_TOP_K, MAX_CANDIDATES = 100, 200


class SettingsError(ValueError):
    """A setting that cannot be used."""


@dataclass(frozen=True)
class Settings:
    embedding_provider: str = "mock"
    embedding_dimensions: int = 8
    collection: str = "default"
    mode: str = "hybrid"
    top_k: int = 5
    candidate_k: int = 20
    rrf_k: int = 60
    rerank_enabled: bool = False
    rerank_top_n: int = 20
    max_chars: int = 4000
    include_parents: bool = True
    min_score_high: float = 0.25
    min_bm25_high: float = 1.0
    min_rrf_high: float = 0.025
    child_max_chars: int = 1000
    child_overlap_chars: int = 150
    parent_max_chars: int = 6000
    min_child_chars: int = 20
    max_index_files: int = 500
    index_roots: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.mode not in ("vector", "bm25", "hybrid"):
            raise SettingsError(f"unknown mode {self.mode!r}")
        if not 1 <= self.top_k <= MAX_TOP_K or not 1 <= self.candidate_k <= MAX_CANDIDATES:
            raise SettingsError(f"top_k must be 1 to {MAX_TOP_K}, candidate_k 1 to {MAX_CANDIDATES}")
        if self.rrf_k < 1 or self.max_chars < 1 or self.embedding_dimensions < 1:
            raise SettingsError("rrf_k, max_chars and embedding_dimensions must be at least 1")


def load_settings(path: str | Path | None = None, prefix: str = "SILTSTONE_") -> Settings:
    """Defaults, then the file (whose sections are flattened; unknown names are ignored), then
    variables such as SILTSTONE_TOP_K. Roots are separated as in PATH."""
    found: dict = {}
    if path is not None and Path(path).is_file():
        import yaml

        for name, value in (yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}).items():
            found |= value if isinstance(value, dict) else {name: value}
    types = {f.name: f.type for f in fields(Settings)}
    for name in types:
        if (value := os.environ.get(prefix + name.upper())) is not None:
            found[name] = value
    kept = {}
    for name, value in found.items():
        kind = types.get(name)
        if kind is None or value is None:
            continue
        if kind == "bool":
            value = value if isinstance(value, bool) else str(value).lower() in ("1", "true", "yes", "on")
        elif kind.startswith("tuple"):
            value = tuple(value) if isinstance(value, (list, tuple)) else tuple(filter(None, str(value).split(os.pathsep)))
        else:
            value = {"int": int, "float": float, "str": str}[kind](value)
        kept[name] = value
    return replace(Settings(), **kept)
