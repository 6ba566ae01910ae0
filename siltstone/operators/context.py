"""Packing hits into a context of limited length, as windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import strip

CUT = "…"


def pack_context(hits: DataFrame, max_chars: int = 4000, include_parents: bool = True) -> DataFrame:
    """One row per query: n_blocks, truncated, chars_used, context, citations.

    `hits` has query_id, rank, doc_id, chunk_id, score, text, parent_chunk_id, parent_text and
    source_path. Of hits with the same parent the first counts; empty bodies are passed over. A
    block stands as long as room for more than its header is left; the first that does not fit
    is cut and is the last. Queries without any block have no row.
    """
    if max_chars < 1:
        raise ValueError("max_chars must be at least 1")
    same = Window.partitionBy("query_id", "doc_id", F.coalesce(F.nullif("parent_chunk_id", F.lit("")), "chunk_id")).orderBy("rank")
    rows = hits.withColumn("__first", F.row_number().over(same)).filter("__first = 1")
    own = F.coalesce(strip(F.col("text")), F.lit(""))
    body = F.coalesce(F.nullif(strip(F.col("parent_text")), F.lit("")), own) if include_parents else own
    rows = rows.withColumn("body", body).filter("body <> ''")
    ranked = Window.partitionBy("query_id").orderBy("rank")
    path = F.coalesce(F.nullif("source_path", F.lit("")), F.col("doc_id").cast("string"))
    rows = rows.withColumn("n", F.row_number().over(ranked)).withColumn("header", F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] ("), path, F.lit(")\n")))
    rows = rows.withColumn("full", F.length("header") + F.length("body") + 2)
    before = F.coalesce(F.sum("full").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before).withColumn("room", max_chars - F.col("before") - F.length("header") - 2)
    over = F.max(F.col("before") + F.col("full") > max_chars).over(Window.partitionBy("query_id"))
    rows = rows.withColumn("truncated", over).filter("room > 0")
    kept = F.when(F.length("body") <= F.col("room"), F.col("body")).otherwise(F.concat(F.expr("left(body, room - 1)"), F.lit(CUT)))
    block = F.concat("header", kept, F.lit("\n\n"))
    citation = F.struct("n", "doc_id", "chunk_id", "parent_chunk_id", path.alias("source_path"), "score")
    packed = rows.groupBy("query_id").agg(
        F.count(F.lit(1)).cast("int").alias("n_blocks"), F.max("truncated").alias("truncated"),
        F.array_sort(F.collect_list(F.struct("n", block.alias("block")))).alias("blocks"), F.array_sort(F.collect_list(citation)).alias("citations"),
    )
    text = F.regexp_replace(F.array_join(F.transform("blocks", lambda b: b["block"]), ""), r"(?U)\s+$", "")
    return packed.withColumn("context", text).select("query_id", "n_blocks", "truncated", F.length("context").alias("chars_used"), "context", "citations")


def quality_label(stats: DataFrame, *, high: float = 0.25, high_bm25: float = 1.0, high_rrf: float = 0.025) -> DataFrame:
    """Add `label` to rows with mode, reranked, top_score (null without hits) and chars_used."""
    score = F.col("top_score")
    reached = (
        F.when(F.col("reranked") | (F.col("mode") == "vector"), score >= high)
        .when(F.col("mode") == "bm25", F.abs(score) >= high_bm25)
        .otherwise(score >= high_rrf)
    )
    label = F.when(score.isNull() | (F.coalesce("chars_used", F.lit(0)) == 0), "empty").when(reached, "high").otherwise("low")
    return stats.withColumn("label", label)
