"""Embedding models and cross-encoders as expressions.

A model that is not a JVM expression is an iterator pandas UDF, which loads it once per worker.
Packages are imported there and then; where one is missing, or there is no network, the error
says so. The mock provider needs neither.
"""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.config import SettingsError
from siltstone.functions.vectors import mock_embedding


def require(package: str, what: str) -> Any:
    """The package, or an error that names what needs it."""
    import importlib

    try:
        return importlib.import_module(package)
    except ImportError as missing:
        raise SettingsError(f"{what} needs the package {package}, which is not installed") from missing


def _vectors(load: Callable[[], Callable[[list[str]], np.ndarray]], dimensions: int | None):
    """A UDF of a text column; null texts give null vectors, and a model of another width is refused."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            known = texts[texts.notna()]
            if len(known):
                found = np.asarray(encode(known.tolist()), np.float32)
                if dimensions and found.shape[1] != dimensions:
                    raise ValueError(f"the model gives {found.shape[1]} dimensions, {dimensions} are set")
                for i, vector in zip(known.index, found, strict=True):
                    out[i] = vector
            yield out

    return embed


class Provider:
    """The mock: a vector of the text's hash, inside the JVM. Subclasses give another expression."""

    name, model = "mock", "mock-sha256"

    def __init__(self, dimensions: int = 8, model: str | None = None):
        self.dimensions, self.model = dimensions, model or self.model

    def expression(self, text: str) -> Column:
        return mock_embedding(F.col(text), self.dimensions)


class LocalProvider(Provider):
    """A sentence-transformers model on the workers."""

    name, model = "local", "all-MiniLM-L6-v2"

    def __init__(self, dimensions: int = 384, model: str | None = None):
        super().__init__(dimensions, model)
        require("sentence_transformers", "the embedding provider `local`")

    def expression(self, text: str) -> Column:
        name = self.model

        def load() -> Callable[[list[str]], np.ndarray]:
            loaded = require("sentence_transformers", "the embedding provider `local`").SentenceTransformer(name)
            return lambda texts: loaded.encode(texts, normalize_embeddings=True, show_progress_bar=False)

        return _vectors(load, self.dimensions)(F.col(text))


class RemoteProvider(Provider):
    """A service with an OpenAI-like `/embeddings` address. Its key is in an environment variable."""

    name, model = "openai", "text-embedding-3-small"
    #: Texts of a request.
    BATCH = 128

    def __init__(self, dimensions: int = 1536, model: str | None = None, url: str = "https://api.openai.com/v1/embeddings", key: str = "OPENAI_API_KEY"):
        super().__init__(dimensions, model)
        self.url = url
        self._key = os.environ.get(key, "")
        if not self._key:
            raise SettingsError(f"the embedding provider `openai` needs {key}")

    def request(self, texts: list[str]) -> dict[str, Any]:
        """The body of a request; only models that can be cut to a width are asked for one."""
        body: dict[str, Any] = {"model": self.model, "input": texts}
        return body | {"dimensions": self.dimensions} if "embedding-3" in self.model else body

    def expression(self, text: str) -> Column:
        provider, size = self, self.BATCH

        def load() -> Callable[[list[str]], np.ndarray]:
            def one(texts: list[str]) -> list[list[float]]:
                headers = {"Authorization": f"Bearer {provider._key}", "Content-Type": "application/json"}
                asked = urllib.request.Request(provider.url, json.dumps(provider.request(texts)).encode(), headers)
                with urllib.request.urlopen(asked, timeout=60) as answer:
                    data = json.load(answer)["data"]
                return [d["embedding"] for d in sorted(data, key=lambda d: d["index"])]

            return lambda texts: np.array([v for i in range(0, len(texts), size) for v in one(texts[i : i + size])])

        return _vectors(load, self.dimensions)(F.col(text))


PROVIDERS: dict[str, type[Provider]] = {"mock": Provider, "local": LocalProvider, "openai": RemoteProvider}


class CrossEncoder:
    """Scores pairs of query and passage; `load` gives a function of lists of pairs.

    By default it is a sentence-transformers cross-encoder.
    """

    def __init__(self, model: str = "cross-encoder/ms-marco-MiniLM-L-6-v2", load: Callable[[], Callable[[list[tuple[str, str]]], Any]] | None = None):
        self.model = model
        if load is None:
            require("sentence_transformers", "reranking by a cross-encoder")

            def load() -> Callable[[list[tuple[str, str]]], Any]:
                return require("sentence_transformers", "reranking by a cross-encoder").CrossEncoder(model).predict

        self._load = load

    def expression(self, query: str, passage: str) -> Column:
        load = self._load

        @F.pandas_udf("double")
        def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            predict = load()
            for queries, passages in batches:
                pairs = list(zip(queries.fillna(""), passages.fillna(""), strict=True))
                yield pd.Series(np.asarray(predict(pairs), float)) if pairs else pd.Series([], dtype=float)

        return score(F.col(query), F.col(passage))
