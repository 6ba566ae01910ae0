"""Document-level evaluation of ranked results, set by set."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.ordering import at_places
from siltstone.session import SMALL, materialize

METRICS = ("hit", "recall", "reciprocal_rank", "ndcg")
#: Rule strings searched for at once; more are searched in several passes.
RULES_AT_ONCE = 50_000
#: Pairs of a string and a document that are handed on at once, and rows of the result of a task.
PAIRS_AT_ONCE, ROWS_A_TASK = 100_000, 2_000_000


def _find(strings: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, text in enumerate(strings):
            automaton.add_word(text, i)
        automaton.make_automaton()
        names = pa.array(strings, pa.string())

        def pairs(found: list[int], docs: pa.Array, rows: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([names.take(pa.array(found, pa.int64())), docs.take(pa.array(rows, pa.int64()))], names=["t", "doc_id"])

        for batch in batches:
            docs, found, rows = batch.column(0), [], []
            for i, text in enumerate(batch.column(1)):
                own = {value for _, value in automaton.iter(text.as_py().lower())}
                found += own
                rows += [i] * len(own)
                if len(found) >= PAIRS_AT_ONCE:
                    yield pairs(found, docs, rows)
                    found, rows = [], []
            yield pairs(found, docs, rows)

    return run


def rule_strings(rules: DataFrame) -> DataFrame:
    """Distinct (query_id, t): what is looked for. Blank rules match nothing."""
    return rules.select("query_id", F.lower("text_contains").alias("t")).filter("t <> ''").distinct()


def rule_hits(texts: DataFrame, strings: DataFrame) -> DataFrame:
    """Distinct (t, doc_id): texts (doc_id, text; a document's pieces are its rows) that contain a
    string (t, in lower case) in any letter case.

    All strings are looked for in one pass over each text. They are read in runs of
    RULES_AT_ONCE, so that what a task holds is bounded.
    """
    strings = strings.select("t").distinct()
    texts = texts.filter("text IS NOT NULL").select("doc_id", "text")
    schema = f"t string, doc_id {dict(texts.dtypes)['doc_id']}"
    out = None
    runs = max(1, -(-strings.count() // RULES_AT_ONCE))
    for run in range(runs):
        part = [r["t"] for r in strings.filter(F.pmod(F.xxhash64("t"), F.lit(runs)) == run).collect()]
        if part:
            found = texts.mapInArrow(_find(part), schema)
            out = found if out is None else out.unionByName(found)
    return (out if out is not None else texts.limit(0).select(F.col("text").alias("t"), "doc_id")).distinct()


def rule_match(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct (query_id, doc_id): texts (doc_id, text; a document's pieces are its rows) that
    contain a rule string (query_id, text_contains) in any letter case.

    Strings and documents are paired first, whatever number of queries has a string; the pairs are
    then dealt to tasks of about ROWS_A_TASK rows of the result. Only queries with several
    strings can meet a document twice.
    """
    rules = materialize(rule_strings(rules).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("query_id"))), "rules")
    hits = materialize(rule_hits(texts, rules), "hits")
    held, most = rules.agg(F.count(F.lit(1)), F.max("n")).first()
    rows = hits.groupBy("t").agg(F.count(F.lit(1)).alias("docs")).join(rules.groupBy("t").agg(F.count(F.lit(1)).alias("queries")), "t")
    tasks = -(-(rows.agg(F.sum(F.col("docs") * F.col("queries"))).first()[0] or 1) // ROWS_A_TASK)
    hits = hits.repartition(tasks, "t", "doc_id")

    def met(part: DataFrame) -> DataFrame:
        return hits.join(F.broadcast(part) if held <= SMALL else part, "t").select("query_id", "doc_id")

    found = met(rules.filter("n = 1"))
    return found if (most or 1) == 1 else found.unionByName(met(rules.filter("n > 1")).distinct())


def matched(pairs: DataFrame, strings: DataFrame, hits: DataFrame) -> DataFrame:
    """Which of the pairs (query_id, doc_id) rule_match has, by its strings (query_id, t) and their hits
    (t, doc_id), without the rows of all others."""
    asked = pairs.select("query_id", "doc_id").join(strings.select("query_id", "t"), "query_id")
    return asked.join(hits, ["t", "doc_id"], "left_semi").select("query_id", "doc_id").distinct()


def collapse_documents(hits: DataFrame, relevant: DataFrame | Callable[[DataFrame], DataFrame], k: int, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Ranked chunks (by, rank, doc_id) -> ranked documents, cut to k: by, rank, doc_id, relevant. A
    document ranks where its best chunk does and is relevant if it is in `relevant` (query_id,
    doc_id), of which only the rows of ranked documents are looked at further; a function gives these
    rows for the pairs (query_id, doc_id) ranked. `by` is query_id and whatever else tells rankings
    apart, such as the mode."""
    best = hits.groupBy(*by, "doc_id").agg(F.min("rank").alias("best"))
    window = Window.partitionBy(*by).orderBy("best", "doc_id")
    ranked = materialize(best.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k), "ranked")
    met = ranked.select("query_id", "doc_id").distinct()
    met = F.broadcast(met) if ranked.count() <= SMALL else met
    marks = relevant(met) if callable(relevant) else relevant.select("query_id", "doc_id").join(met, ["query_id", "doc_id"], "left_semi").distinct()
    marks = marks.withColumn("relevant", F.lit(1))
    rows = ranked.join(marks, ["query_id", "doc_id"], "left").withColumn("relevant", F.coalesce("relevant", F.lit(0)))
    return rows.select(*by, "rank", "doc_id", "relevant")


def query_metrics(ranked: DataFrame, gold: DataFrame, k: int, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Per query of `gold` (by, gold_count): hit, recall, reciprocal_rank, ndcg, first_relevant_rank,
    relevant_in_top_k. Without gold all four are 1 if nothing relevant was found, else 0."""
    gain = F.col("relevant") / F.log2(F.col("rank") + 1.0)
    sums = ranked.filter(F.col("rank") <= k).groupBy(*by).agg(
        F.sum(F.when(F.col("relevant") > 0, 1).otherwise(0)).alias("found"),
        F.min(F.when(F.col("relevant") > 0, F.col("rank"))).alias("first"),
        F.sum(gain).alias("dcg"),
    )
    rows = gold.select(*by, "gold_count").join(sums, list(by), "left").fillna(0, ["found"]).fillna(0.0, ["dcg"])
    none = F.col("gold_count") <= 0
    clean = F.when(F.col("found") == 0, 1.0).otherwise(0.0)
    places = F.sequence(F.lit(1), F.greatest(F.least(F.col("gold_count").cast("int"), F.lit(k)), F.lit(1)))
    ideal = F.aggregate(places, F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    least = lambda c: F.least(F.lit(1.0), c)
    return rows.select(
        *by, "gold_count",
        F.when(none, clean).otherwise(F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0)).alias("hit"),
        F.when(none, clean).otherwise(least(F.col("found") / F.col("gold_count"))).alias("recall"),
        F.when(none, clean).otherwise(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("reciprocal_rank"),
        F.when(none, clean).otherwise(least(F.col("dcg") / ideal)).alias("ndcg"),
        F.col("first").alias("first_relevant_rank"), F.col("found").cast("int").alias("relevant_in_top_k"),
    )


def mode_summary(metrics: DataFrame) -> DataFrame:
    """Means per mode: queries, hit_at_k, recall_at_k, mrr, ndcg_at_k."""
    names = dict(zip(METRICS, ("hit_at_k", "recall_at_k", "mrr", "ndcg_at_k"), strict=True))
    return metrics.groupBy("mode").agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(m), 9).alias(n) for m, n in names.items()])


def mode_comparison(summary: DataFrame) -> DataFrame:
    """One row: hybrid less bm25 and less vector, for hits and nDCG; a missing mode counts 0."""

    def of(mode: str, column: str):
        return F.coalesce(F.max(F.when(F.col("mode") == mode, F.col(column))), F.lit(0.0))

    return summary.agg(*[
        F.round(of("hybrid", c) - of(other, c), 9).alias(f"hybrid_minus_{other}_{n}")
        for c, n in (("hit_at_k", "hit"), ("ndcg_at_k", "ndcg")) for other in ("bm25", "vector")
    ])


def percentiles(values: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, p50, p95 and max: sorted values at the index fraction * (n - 1), rounded half to even."""
    rows = values.filter(F.col(value).isNotNull()).select(by, value)
    sums = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("max"))
    sums = materialize(sums, "sums")  # a row per key
    names = F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(f).alias("fraction")) for n, f in (("p50", 0.5), ("p95", 0.95))]))
    places = sums.select(by, "n", names).select(by, "name", F.bround(F.col("fraction") * (F.col("n") - 1)).cast("long").alias("place"))
    found = at_places(rows, by, value, places).groupBy(by).agg(*[F.max(F.when(F.col("name") == n, F.col(value))).alias(n) for n in ("p50", "p95")])
    return sums.join(found, by).select(by, "mean", "p50", "p95", "max")


#: Random numbers that are drawn at once.
DRAWN = 1 << 20


def random_rows(n: int, rows: int, seed: int) -> Iterator[np.ndarray]:
    """The first rows of n values each of random.Random(seed).randrange(n), n below 2^32, a bounded number
    of values at a time."""
    _, words, _ = random.Random(seed).getstate()
    source = np.random.MT19937()
    source.state = {"bit_generator": "MT19937", "state": {"key": np.array(words[:-1], np.uint64), "pos": words[-1]}}
    shift = np.uint64(32 - n.bit_length())
    held, left = np.empty(0, np.int64), rows * n
    for _ in range(rows):
        while len(held) < n:
            drawn = source.random_raw(min(left, max(DRAWN, n)) - len(held) + 1024) >> shift
            held = np.concatenate([held, drawn[drawn < n].astype(np.int64)])
        yield held[:n]
        held, left = held[n:], left - n


def random_indices(n: int, count: int, seed: int) -> np.ndarray:
    """The first `count` values of random.Random(seed).randrange(n): n below 2^32."""
    return np.concatenate([*random_rows(n, -(-count // n), seed)])[:count]


def _resample(iterations: int, seed: int, confidence: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("query_id")[list(METRICS)].to_numpy(float)
        n, tail = len(v), (1.0 - confidence) / 2.0
        if n == 1:
            low = high = v[0]
        else:
            # the same indices serve all metrics
            means = np.sort(np.stack([np.cumsum(v[row], axis=0)[-1] / n for row in random_rows(n, iterations, seed)]), axis=0)
            low, high = means[max(0, int(tail * iterations) - 1)], means[min(iterations - 1, int((1.0 - tail) * iterations))]
        return pd.DataFrame({"mode": pdf["mode"].iloc[0], "metric": list(METRICS), "low": low, "high": high})

    return run


def bootstrap_intervals(metrics: DataFrame, *, iterations: int = 1000, seed: int = 20260909, confidence: float = 0.95) -> DataFrame:
    """Percentile bootstrap interval of each mode's means: mode, metric, low, high.

    A mode's scores, one per query of the evaluation set in order of query_id, are one task's.
    """
    rows = metrics.select("mode", "query_id", *METRICS)
    return rows.groupBy("mode").applyInPandas(_resample(iterations, seed, confidence), "mode string, metric string, low double, high double")
