"""Keeping an index current by content hash."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def change_status(incoming: DataFrame, stored: DataFrame, key: str = "source_path", value: str = "content_hash") -> DataFrame:
    """Add status to incoming rows: `skipped` (same hash stored), `changed` or `new`. Decided
    before anything is parsed."""
    held = stored.select(F.col(key).alias("__key"), F.col(value).alias("__value"), F.lit(True).alias("__there"))
    joined = incoming.join(held, F.col(key) == F.col("__key"), "left")
    status = F.when(F.col("__there").isNull(), "new").when(F.col(value).eqNullSafe(F.col("__value")), "skipped").otherwise("changed")
    return joined.withColumn("status", status).drop("__key", "__value", "__there")


def upsert(stored: DataFrame, incoming: DataFrame, key: str = "source_path") -> DataFrame:
    """Stored rows whose key comes in again are replaced as a whole."""
    return stored.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def delete_cascade(tables: dict[str, DataFrame], doc_ids: DataFrame) -> dict[str, DataFrame]:
    """Every table (with doc_id) without the rows of the given documents."""
    gone = doc_ids.select("doc_id").distinct()
    return {name: rows.join(gone, "doc_id", "left_anti") for name, rows in tables.items()}


def _known(text: str | None) -> dict:
    try:
        value = json.loads(text) if text else {}
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


def merged_json(first: str, second: str) -> Column:
    """The union of two JSON objects, the second one's values holding; other JSON counts as empty.
    Where the second is null or blank, the first stays as it is."""

    @F.pandas_udf("string")
    def union(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(_known(a) | _known(b), ensure_ascii=False) for a, b in zip(one, two, strict=True)])

    return F.when(F.coalesce(second, F.lit("")) == "", F.col(first)).otherwise(union(F.col(first), F.col(second)))


def embed_distinct(texts: DataFrame, embed: Column, keys: list[str], cache: DataFrame | None = None) -> DataFrame:
    """Embed (keys, text) once per distinct text: keys, text_hash, vector.

    `embed` is an expression of the column `text`; `cache` (text_hash, vector) holds vectors of
    earlier runs, whose texts are not embedded again.
    """
    rows = texts.withColumn("text_hash", F.sha2("text", 256))
    distinct = rows.filter("text_hash IS NOT NULL").groupBy("text_hash").agg(F.first("text").alias("text"))
    if cache is not None:
        distinct = distinct.join(cache.select("text_hash"), "text_hash", "left_anti")
    vectors = distinct.select("text_hash", embed.alias("vector"))
    if cache is not None:
        vectors = vectors.unionByName(cache.select("text_hash", "vector"))
    return rows.select(*keys, "text_hash").join(vectors, "text_hash", "left")


def index_summary(results: DataFrame) -> DataFrame:
    """status, n."""
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
