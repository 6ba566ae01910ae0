"""Reading the input tables of a folder in the engine's terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import clean_source
from siltstone.functions.vectors import mock_embedding


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """All chunks without repeated rows."""
    columns = ("storage_id", "doc_id", "chunk_id", "role", "text", "parent_chunk_id", "split_index", "block_type", "block_order")
    return table(spark, folder, "chunks").select(*columns).distinct()


def children(spark: SparkSession, folder: str) -> DataFrame:
    """The indexed chunks: doc_id, chunk_id, text.

    Partitioned by item, which later groupings by item and anything else can use: the texts
    move once, and the many rows made of each need not.
    """
    rows = table(spark, folder, "chunks").filter("role = 'child' AND text IS NOT NULL")
    return rows.select("doc_id", "chunk_id", "text").repartition("doc_id", "chunk_id").distinct()


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """The query batch: query_id, query. Of several texts of a query the last counts."""
    return table(spark, folder, "query_evals").groupBy("query_id").agg(F.max("query_text").alias("query")).filter("query IS NOT NULL")


def collections(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, collection, source_path. A document without source is in `default`."""
    rows = table(spark, folder, "documents")
    return rows.select("doc_id", F.coalesce(clean_source(F.col("source")), F.lit("default")).alias("collection"), "source_path")


def embedded(rows: DataFrame, text: str) -> DataFrame:
    """Add `vector` by the mock provider."""
    return rows.withColumn("vector", mock_embedding(F.col(text)))
