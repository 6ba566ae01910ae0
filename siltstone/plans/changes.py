"""Queries on new and changed records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import clean_hash
from siltstone.operators.changes import ChangeLog, unprocessed, within_spans
from siltstone.plans.tables import table
from siltstone.session import scratch_path


#: Deliveries that the scans arrive in, by received_at.
DELIVERIES = 4


def _delivery(at: str) -> str:
    """The number, from 0, of the delivery of a row: equal stretches of time; 0 if received_at is null."""
    return f"least({DELIVERIES - 1}, coalesce(floor({DELIVERIES} * ({at} - first) / greatest(1, last - first)), 0))"


def _deliver(spark: SparkSession, folder: str) -> ChangeLog:
    """Deliver the scans in turn and run after each. The second run dies after planning and the third
    after applying; each is replayed by a runner that starts anew."""
    scans = table(spark, folder, "source_scans")
    span = scans.agg(F.unix_micros(F.min("received_at")).alias("first"), F.unix_micros(F.max("received_at")).alias("last")).first()
    at = F.unix_micros("received_at")
    first, last = (F.lit(span[0]), F.lit(span[1])) if span[0] is not None else (F.lit(0), F.lit(0))
    share = F.floor(F.lit(DELIVERIES) * (at - first) / F.greatest(F.lit(1), last - first))
    number = F.least(F.lit(DELIVERIES - 1), F.coalesce(share, F.lit(0)))
    root = scratch_path(spark, "changes")

    def log() -> ChangeLog:
        return ChangeLog(spark, root, "source_path", "scanned_at", ["content_hash"], compact_every=3)

    for delivery in range(DELIVERIES):
        rows = scans.filter(number == delivery)
        log().append(rows, F.col("source_path"), F.col("scanned_at"), {"content_hash": clean_hash(F.col("content_hash"))})
        if delivery == 1:
            log().plan()
        if delivery == 2:
            died = log()
            died.apply(died.plan())
        log().run()
    return log()


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Source paths whose newest content no successful run has put into documents."""
    documents, runs = (table(spark, folder, t) for t in ("documents", "index_runs"))
    log = _deliver(spark, folder)
    documents = documents.select("source_path", clean_hash(F.col("content_hash")).alias("content_hash"), "indexed_at")
    documents = documents.filter("indexed_at IS NOT NULL AND content_hash IS NOT NULL")
    done = within_spans(documents, "indexed_at", runs.filter("status = 'success'"), "started_at", "finished_at")
    return unprocessed(log.state(), done, "source_path", "content_hash").select("source_path")


def p2_runs(spark: SparkSession, folder: str) -> DataFrame:
    """What each run read of the log and how many keys it wrote."""
    log = _deliver(spark, folder)
    out = None
    for run in range(1, DELIVERIES + 1):
        rows = log.planned_rows(run).agg(F.count(F.lit(1)).alias("rows_read"), F.countDistinct("source_path").alias("keys"))
        rows = rows.select(F.lit(run).alias("run"), "rows_read", "keys")
        out = rows if out is None else out.unionByName(rows)
    return out


P2_RUNS_SQL = f"""
WITH span AS (SELECT epoch_us(min(received_at)) AS first, epoch_us(max(received_at)) AS last FROM source_scans),
valid AS (
  SELECT source_path, 1 + {_delivery("epoch_us(received_at)")}::INT AS run FROM source_scans, span
  WHERE source_path IS NOT NULL AND scanned_at IS NOT NULL AND regexp_replace(lower(trim(content_hash)), '^sha256:', '') <> '')
SELECT r.run, count(source_path) AS rows_read, count(DISTINCT source_path) AS keys
FROM (SELECT unnest(range(1, {DELIVERIES + 1}))::INT AS run) r LEFT JOIN valid v ON r.run = v.run GROUP BY 1
"""

P2_SQL = r"""
WITH newest AS (
  SELECT source_path, regexp_replace(lower(trim(content_hash)), '^sha256:', '') AS h,
         row_number() OVER (PARTITION BY source_path ORDER BY scanned_at DESC,
                            regexp_replace(lower(trim(content_hash)), '^sha256:', '') DESC) AS r
  FROM source_scans
  WHERE source_path IS NOT NULL AND scanned_at IS NOT NULL
    AND regexp_replace(lower(trim(content_hash)), '^sha256:', '') <> ''),
done AS (
  SELECT DISTINCT d.source_path, regexp_replace(lower(trim(d.content_hash)), '^sha256:', '') AS h
  FROM documents d JOIN index_runs r
    ON r.status = 'success' AND d.indexed_at BETWEEN r.started_at AND r.finished_at)
SELECT n.source_path FROM newest n
WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM done WHERE done.source_path = n.source_path AND done.h = n.h)
"""

QUERIES = {"p2_found": p2_found, "p2_runs": p2_runs}
SQL = {"p2_found": P2_SQL, "p2_runs": P2_RUNS_SQL}
