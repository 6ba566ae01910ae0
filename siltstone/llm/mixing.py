"""Mixing sources to target shares of the total size, with capped repetition.

The size of a mix is T, the tokens of all documents of its sources. A source with t tokens
needs share * T of them, that is share * T / t copies of a document on average, at most
max_repeats. The whole part is allocated to every document as certain copies. The rest is
drawn by Pareto order sampling: a document's inclusion probability p is proportional to its
tokens (1 at most), its number is u / (1 - u) divided by p / (1 - p) with u uniform from a
hash of seed, mix and doc_id, and documents are taken in ascending order of that number
while the tokens still needed last.

The cut in that order is found without sorting a source: tokens are summed in BINS bins of
the order, the bin in which the tokens run out is found from the sums, and only that bin's
documents are sorted.

Defined results: sources are compared trimmed and in lower case; documents with source null
and without tokens are never chosen. A target row with a null share or share <= 0 asks for
nothing, one with max_repeats null or < 1 allows no copy. Targets that occur again count once
(the largest share and repeats). The inclusion odds are solved for sizes cut to three leading digits, so
that they sum to the need within one per cent; the tokens drawn do not depend on that, for the cut
in the order is made by the exact sizes. A source without documents reaches 0. A mix reaches a
source's target within the size of one document, or falls short where max_repeats binds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import clean_source, token_count
from siltstone.session import materialize

#: Bins of the sampling order per mix and source; a bin is what is sorted.
BINS = 4096
SEED = 17


def _rate(pdf: pd.DataFrame) -> pd.DataFrame:
    """Solve sum(n * size * min(1, rate * size)) = need over one source's size classes."""
    size, n = pdf["size"].to_numpy(float), pdf["n"].to_numpy(float)
    need = float(pdf["need"].iloc[0])
    order = np.argsort(-size)
    size, n = size[order], n[order]
    certain = np.concatenate([[0.0], np.cumsum(n * size)])[:-1]  # tokens of larger classes, if certain
    squares = np.cumsum((n * size * size)[::-1])[::-1]
    rate = 0.0
    for k in range(len(size)):
        rate = max(0.0, need - certain[k]) / squares[k]
        if rate * size[k] <= 1:
            break
    return pd.DataFrame({"mix_id": [pdf["mix_id"].iloc[0]], "source": [pdf["source"].iloc[0]], "rate": [rate]})


def _class(tokens: F.Column) -> F.Column:
    """Sizes to three leading digits, so that a source has at most 900 classes per power of ten."""
    unit = F.pow(F.lit(10.0), F.greatest(F.lit(0), F.floor(F.log10(tokens)) - 2))
    return (F.floor(tokens / unit) * unit).cast("long")


def allocate(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: tokens t, target tokens, certain copies and tokens still to draw."""
    wanted = (
        targets.select("mix_id", clean_source(F.col("source")).alias("source"),
                       F.greatest(F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("target_share"),
                       F.greatest(F.coalesce(F.col("max_repeats").cast("long"), F.lit(0)), F.lit(0)).alias("max_repeats"))
        .filter("source IS NOT NULL AND mix_id IS NOT NULL")
        .groupBy("mix_id", "source")
        .agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    )
    totals = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("tokens").alias("largest"))
    plan = wanted.join(totals, "source", "left").fillna(0, ["tokens", "documents", "largest"])
    plan = plan.withColumn("mix_tokens", F.sum("tokens").over(Window.partitionBy("mix_id")))
    target = F.col("target_share") * F.col("mix_tokens")
    most = (F.col("max_repeats") * F.col("tokens")).cast("double")
    plan = plan.withColumns({"target_tokens": target, "most_tokens": most, "short": target > most})
    goal = F.least("target_tokens", "most_tokens")
    copies = F.when(F.col("short"), F.col("max_repeats")).when(F.col("tokens") > 0, F.floor(goal / F.col("tokens"))).otherwise(0)
    plan = plan.withColumn("copies", copies.cast("long"))
    need = F.when(F.col("short"), 0.0).otherwise(goal - F.col("copies") * F.col("tokens"))
    return plan.withColumn("need", F.greatest(need, F.lit(0.0)))


def mix(documents: DataFrame, targets: DataFrame, *, seed: int = SEED, bins: int = BINS) -> tuple[DataFrame, DataFrame]:
    """Select documents (doc_id, text, source) for every mix of `targets`.

    Returns the selection (mix_id, source, doc_id, tokens, copies; copies at least 1) and the
    allocation it was drawn by.
    """
    sizes = documents.select(
        "doc_id", clean_source(F.col("source")).alias("source"), token_count(F.col("text")).cast("long").alias("tokens")
    ).filter("source IS NOT NULL AND tokens > 0")
    sizes = materialize(sizes, "sizes")
    # a row per target: as small as the table of targets
    plan = materialize(allocate(sizes, targets), "allocation")
    drawn = plan.filter("need > 0").select("mix_id", "source", "need")
    classes = sizes.groupBy("source", _class(F.col("tokens")).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    rates = classes.join(drawn, "source").groupBy("mix_id", "source").applyInPandas(_rate, "mix_id string, source string, rate double")
    rates = materialize(rates, "rates")
    state = plan.select("mix_id", "source", "copies", "need").join(rates, ["mix_id", "source"], "left")
    # 53 random bits, never 0 nor 1
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "mix_id", "doc_id"), 11).cast("double")
    u = (bits + 0.5) / F.lit(float(2**53))
    p = F.least(F.col("rate") * F.col("tokens"), F.lit(1.0))
    # the number mapped to (0, 1): x / (1 + x) keeps its order; documents with p = 1 come first
    odds = F.when(p >= 1, 0.0).otherwise(u / (1 - u) / (p / (1 - p)))
    rows = sizes.join(state, "source").withColumn("number", F.when(F.col("rate") > 0, odds / (1 + odds)))
    # within a bin by number, then by the hash, then by doc_id
    rows = rows.withColumn("bin", F.least(F.floor(F.col("number") * bins), F.lit(bins - 1)).cast("int"))
    sums = rows.filter("bin IS NOT NULL").groupBy("mix_id", "source", "bin").agg(F.sum("tokens").alias("in_bin"), F.max("need").alias("need"))
    before = Window.partitionBy("mix_id", "source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("in_bin").over(before), F.lit(0)).cast("double"))
    # the first bin whose sum reaches the need; certain documents (number 0) are all in bin 0
    edge = (
        sums.filter("ahead + in_bin >= need").groupBy("mix_id", "source")
        .agg(F.min_by("bin", "bin").alias("edge"), F.min_by("ahead", "bin").alias("ahead"))
    )
    edge = materialize(edge, "edge")
    rows = rows.join(edge, ["mix_id", "source"], "left")
    order = [F.col("number"), F.xxhash64(F.lit(seed), "mix_id", "doc_id"), F.col("doc_id")]
    inside = rows.filter("bin = edge")
    running = Window.partitionBy("mix_id", "source").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = F.col("ahead") + F.sum("tokens").over(running)
    # taken if that brings the total nearer to the need
    extra = (reached - F.col("need") <= F.col("tokens") / 2).cast("long")
    columns = ["mix_id", "source", "doc_id", "tokens"]
    inside = inside.select(*columns, (F.col("copies") + extra).alias("copies"))
    rest = rows.filter("bin IS NULL OR edge IS NULL OR bin <> edge").select(
        *columns, (F.col("copies") + F.when(F.col("bin").isNotNull() & (F.col("edge").isNull() | (F.col("bin") < F.col("edge"))), 1).otherwise(0)).alias("copies")
    )
    return rest.unionByName(inside).filter("copies > 0"), plan


def mix_report(selection: DataFrame, plan: DataFrame) -> DataFrame:
    """Per mix and source: target and reached tokens and shares, and whether max_repeats binds."""
    reached = selection.groupBy("mix_id", "source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("reached_tokens"), F.max("copies").alias("most_copies")
    )
    report = plan.join(reached, ["mix_id", "source"], "left").fillna(0, ["reached_tokens", "most_copies"])
    total = F.sum("reached_tokens").over(Window.partitionBy("mix_id"))
    return report.select(
        "mix_id", "source", "target_share", "max_repeats", "tokens", "documents", "target_tokens", "most_tokens",
        "reached_tokens", "most_copies", "short",
        F.when(total > 0, F.col("reached_tokens") / total).otherwise(0.0).alias("reached_share"),
    )


def invariants(selection: DataFrame, plan: DataFrame) -> DataFrame:
    """What must hold of a selection, per mix and source: tokens of the source and of the mix; capped
    (no document more often than max_repeats); near (within the source's largest document of what is asked for)."""
    drawn = selection.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("reached"), F.max("copies").alias("most"))
    rows = plan.join(drawn, ["mix_id", "source"], "left").fillna(0, ["reached", "most"])
    goal = F.least("target_tokens", "most_tokens")
    return rows.select(
        "mix_id", "source", F.col("tokens").cast("long").alias("tokens"), F.col("mix_tokens").cast("long").alias("mix_tokens"),
        (F.col("most") <= F.col("max_repeats")).alias("capped"), (F.abs(F.col("reached") - goal) <= F.col("largest") + 1e-6).alias("near"),
    )
