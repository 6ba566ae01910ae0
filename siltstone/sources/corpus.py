"""Evaluation sets: judged queries, a corpus cut to size, and its fingerprint."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.ordering import first_rows

RULE = "struct<source_contains:string,text_contains:string,external_id:string>"
QUERY = f"id string, query string, focus string, expect_empty boolean, relevant array<{RULE}>"


def load_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Judged queries from JSON: a list, or an object with the list under `queries`.

    Columns: id, query, focus, expect_empty, relevant.
    """
    text = spark.read.text(path, wholetext=True)
    listed = F.coalesce(F.get_json_object("value", "$.queries"), F.col("value"))
    items = text.select(F.from_json(listed, f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in QUERY.split(', '))}>>").alias("q"))
    rows = items.select(F.inline("q"))
    return rows.withColumns({"expect_empty": F.coalesce("expect_empty", F.lit(False)), "relevant": F.coalesce("relevant", F.array().cast(f"array<{RULE}>"))})


def sidecar_ids(files: DataFrame) -> DataFrame:
    """(path, external_id) of `{stem}.meta.json` files, for the `.txt` beside each; broken JSON is ignored."""
    found = files.filter(F.col("path").endswith(".meta.json"))
    return found.select(
        F.regexp_replace("path", r"\.meta\.json$", ".txt").alias("path"),
        F.get_json_object(F.col("content").cast("string"), "$.external_id").alias("external_id"),
    ).filter("external_id IS NOT NULL")


def corpus_fingerprint(dataset: str, max_docs: int | None, max_queries: int | None) -> str:
    """What a stored corpus holds: 16 hex digits of the SHA-256 of its settings."""
    settings = json.dumps({"dataset_id": dataset, "max_docs": max_docs, "max_queries": max_queries}, sort_keys=True)
    return hashlib.sha256(settings.encode()).hexdigest()[:16]


def corpus_subset(documents: DataFrame, qrels: DataFrame, max_docs: int | None) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, text) cut to those that are judged relevant, filled up in order of
    doc_id to `max_docs`; and the judgements (query_id, doc_id, relevance) that still have one.

    Judgements of relevance 0 and blank documents count for nothing.
    """
    judged = qrels.filter("relevance > 0")
    needed = judged.select("doc_id").distinct()
    rows = documents.join(needed.withColumn("kind", F.lit("needed")), "doc_id", "left").withColumn("kind", F.coalesce("kind", F.lit("filler")))
    if max_docs is not None:
        room = max(0, max_docs - needed.count())
        # only ids are put in order
        filler = first_rows(rows.filter("kind = 'filler'").select("doc_id"), ["doc_id"], room)
        rows = rows.filter("kind = 'needed'").unionByName(rows.filter("kind = 'filler'").join(filler, "doc_id", "left_semi"))
    rows = rows.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    held = judged.join(rows.select("doc_id"), "doc_id", "left_semi").select("query_id").distinct()
    return rows, judged.join(held, "query_id", "left_semi")


def load_corpus(spark: SparkSession, folder: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """A judged corpus as it is commonly handed on: `corpus.jsonl` (_id, title, text), `queries.jsonl` (_id, text)
    and `qrels/<split>.tsv` (query-id, corpus-id, score).

    Returns documents (doc_id, text: the title, a blank line and the text), queries (query_id, query) that
    have a judgement above 0, and judgements (query_id, doc_id, relevance).
    """
    text = F.concat_ws("\n\n", F.nullif(F.trim("title"), F.lit("")), "text")
    documents = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl").select(F.col("_id").alias("doc_id"), text.alias("text"))
    judged = spark.read.option("header", True).option("sep", "\t").csv(f"{folder}/qrels/{split}.tsv")
    qrels = judged.toDF("query_id", "doc_id", "relevance").withColumn("relevance", F.col("relevance").cast("int"))
    queries = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl").select(F.col("_id").alias("query_id"), F.col("text").alias("query"))
    return documents, queries.join(qrels.filter("relevance > 0").select("query_id").distinct(), "query_id", "left_semi"), qrels


def file_name(doc_id: str) -> str:
    """The name of a document's file: anything but letters and digits as `_`. Distinct ids may share one."""
    return "".join(c if c.isalnum() else "_" for c in doc_id) + ".txt"


def judged_queries(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries and judgements as the engine evaluates them: id, query, focus, expect_empty, relevant."""
    rule = F.struct(F.lit(None).cast("string").alias("source_contains"), F.lit(None).cast("string").alias("text_contains"), F.col("doc_id").alias("external_id"))
    rules = qrels.filter("relevance > 0").groupBy("query_id").agg(F.array_sort(F.collect_set(rule), lambda a, b: F.when(a["external_id"] < b["external_id"], -1).otherwise(1)).alias("relevant"))
    return queries.join(rules, "query_id").select(F.col("query_id").alias("id"), "query", F.lit(None).cast("string").alias("focus"), F.lit(False).alias("expect_empty"), "relevant")
