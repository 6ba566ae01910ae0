"""Filling fixed-capacity containers with whole documents.

Bin packing per source. Sizes are whole numbers of tokens up to the capacity, so that an
instance of any number of documents is a histogram of at most `capacity` rows: the plan is
made on the histogram, one small task per source, and the documents are then dealt to the
planned places by their number among the documents of equal size.

Reduction by dominance (Martello and Toth): for the largest remaining size, look for the set
with at most three members that dominates any other set holding it; such sets are containers
of some optimal solution and are fixed, as many copies at once as the counts allow. The
reduced instance is filled best fit in order of decreasing size.

A document larger than the capacity is cut: full containers of its own, and the rest of its
tokens is an item like any other. Nothing else is cut.

Defined results: documents with source null, or of a source without a capacity of at least 1,
get no container and no row; of several capacities of a source the largest holds. A document
without tokens is put into container 1 of its source. Documents of equal size are
interchangeable: which one gets which place follows doc_id within the salts of its hash, of which
there are as many as keep the rows of a window few.
Repeated rows of a doc_id are packed once each. Empty tables give an empty result.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import clean_source, token_count
from siltstone.session import materialize, small

#: Rows of one size that a window may number, about; a more common size is numbered in salted parts.
WINDOW_ROWS = 1_000_000

Plan = list[tuple[int, list[tuple[int, int]]]]  # containers, [(size, copies in each)]


def _second_best(sizes: list[int], counts: dict[int, int], room: int) -> int:
    """The largest sum of two remaining items that fits into `room`; 0 if no two fit."""
    best, i, j = 0, 0, len(sizes) - 1  # sizes ascend
    while i <= j:
        total = sizes[i] + sizes[j]
        if total > room:
            j -= 1
        elif i == j:
            if counts[sizes[i]] >= 2 and total > best:
                best = total
            break
        else:
            if total > best:
                best = total
                if best == room:
                    return best
            i += 1
    # two of the same size, passed over where i < j
    for s in reversed(sizes):
        if 2 * s <= room and counts[s] >= 2:
            return max(best, 2 * s)
    return best


def _smallest_sum(sizes: list[int], counts: dict[int, int], n: int) -> int | None:
    total = 0
    for s in sizes:
        take = min(n, counts[s])
        total, n = total + take * s, n - take
        if not n:
            return total
    return None


def _three(sizes: list[int], counts: dict[int, int], room: int, a: int, b: int) -> bool:
    """Whether a, the largest, and b dominate every other two that fit: no two larger than b do."""
    if counts.get(b, 0) < (2 if a == b else 1):
        return False
    larger = _smallest_sum([s for s in sizes if s > b], counts, 2)
    return larger is None or larger > room


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[Plan, dict[int, int]]:
    """Fix dominating sets; the plan of the fixed containers and what remains.

    A set {j, i} dominates every other set with j if no three more items fit with j and no
    two that fit are together larger than i; {j} does if nothing fits with it. {j, a, b}, where
    a and b are the two that fill most, does if no three more fit, a is the largest that fits
    and no two larger than b fit.
    """
    counts = {s: n for s, n in counts.items() if n > 0 and s > 0}
    sizes = sorted(counts)
    plan: Plan = []
    for j in sorted(counts, reverse=True):
        while counts.get(j, 0) > 0:
            counts[j] -= 1  # the item looked at
            live = [s for s in sizes if counts[s] > 0] if not counts[j] else sizes
            room = capacity - j
            fits = [s for s in live if s <= room and counts[s] > 0]
            if not fits:
                plan.append((counts[j] + 1, [(j, 1)]))
                counts[j] = 0
                break
            i = fits[-1]
            if i < room:
                three = _smallest_sum(fits, counts, 3)
                two = _second_best(fits, counts, room)
                if (three is not None and three <= room) or two > i and not _three(fits, counts, room, i, two - i):
                    counts[j] += 1
                    break
                if two > i:
                    content = sorted(Counter((j, i, two - i)).items(), reverse=True)
                    counts[j] += 1
                    n = min(counts[s] // c for s, c in content)
                    plan.append((n, content))
                    for s, c in content:
                        counts[s] -= n * c
                    sizes = [s for s in sizes if counts[s] > 0]
                    continue
            if i == j:
                pairs = (counts[j] + 1) // 2
                plan.append((pairs, [(j, 2)]))
                counts[j] += 1 - 2 * pairs
            else:
                pairs = min(counts[j] + 1, counts[i])
                plan.append((pairs, [(j, 1), (i, 1)]))
                counts[j] += 1 - pairs
                counts[i] -= pairs
            sizes = [s for s in sizes if counts[s] > 0]
    return plan, {s: n for s, n in counts.items() if n > 0}


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best fit decreasing on a histogram: equal containers are kept and filled together."""
    open_: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}  # free space -> containers
    done: Plan = []

    def put(free: int, n: int, content: list[tuple[int, int]]) -> None:
        if n:
            open_.setdefault(free, []).append((n, content)) if free else done.append((n, content))

    def fill(size: int, left: int, free: int, n: int, content: list[tuple[int, int]]) -> int:
        each = free // size
        full = min(n, left // each)
        put(free - each * size, full, [*content, (size, each)])
        left -= full * each
        if full < n:
            some = left if left < each else 0
            if some:
                put(free - some * size, 1, [*content, (size, some)])
                left = 0
                full += 1
            put(free, n - full, content)
        return left

    for size in sorted(counts, reverse=True):
        left = counts[size]
        for free in sorted(f for f in open_ if f >= size):
            for n, content in open_.pop(free):
                if left:
                    left = fill(size, left, free, n, content)
                else:
                    put(free, n, content)
            if not left:
                break
        if left:
            each = capacity // size
            fill(size, left, capacity, -(-left // each), [])
    return done + [p for group in open_.values() for p in group]


def plan_containers(counts: dict[int, int], capacity: int) -> Plan:
    fixed, rest = reduce_instance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def _places(pdf: pd.DataFrame) -> pd.DataFrame:
    """One source's histogram -> per size the runs of places: items `start` to `end` - 1 of
    the size go to the containers from `first` on, `each` to a container."""
    source, capacity = pdf["source"].iloc[0], int(pdf["capacity"].iloc[0])
    counts = dict(zip(pdf["size"].astype(int).tolist(), pdf["n"].astype(int).tolist(), strict=True))
    used: dict[int, int] = {}
    rows, first = [], 1
    for n, content in plan_containers(counts, capacity):
        for size, each in content:
            start = used.get(size, 0)
            used[size] = start + n * each
            rows.append((source, size, start, start + n * each, first, each))
        first += n
    return pd.DataFrame(rows, columns=["source", "size", "start", "end", "first", "each"])


def pack(documents: DataFrame, budgets: DataFrame) -> DataFrame:
    """Assign documents (doc_id, text, source) to containers of their source's capacity_tokens.

    Columns: source, container (1, 2, ... per source), doc_id, part (0: whole, 1.. : pieces of
    a cut document), tokens.
    """
    capacity = (
        budgets.select(clean_source(F.col("source")).alias("source"), F.col("capacity_tokens").cast("long").alias("capacity"))
        .filter("source IS NOT NULL AND capacity >= 1")
        .groupBy("source").agg(F.max("capacity").alias("capacity"))
    )
    docs = documents.select(
        "doc_id", clean_source(F.col("source")).alias("source"), token_count(F.col("text")).cast("long").alias("tokens")
    ).filter("source IS NOT NULL")
    docs = docs.join(capacity, "source").select("source", "doc_id", "tokens", "capacity", (F.col("tokens") % F.col("capacity")).alias("size"))
    docs = materialize(docs, "sizes")
    salts = 1 + docs.count() // WINDOW_ROWS
    docs = docs.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    # by source, size and salt: no more rows than documents, and sources x capacity for each WINDOW_ROWS of them
    cells = docs.filter("size > 0").groupBy("source", "capacity", "size", "salt").agg(F.count(F.lit(1)).alias("n"))
    cells = materialize(cells, "cells")
    histogram = cells.groupBy("source", "capacity", "size").agg(F.sum("n").alias("n"))
    places = histogram.groupBy("source").applyInPandas(
        _places, "source string, size long, start long, end long, first long, each long"
    )
    places = materialize(places, "places")
    before = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("source", "size", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "size", "salt").orderBy("doc_id")
    # merged, not broadcast: the join's partitioning is that of the window
    items = docs.filter("size > 0").join(starts.hint("merge"), ["source", "size", "salt"])
    items = items.withColumn("number", F.col("base") + F.row_number().over(inside) - 1)
    # of each size the runs of places, in which an item looks its own up: a row per source and size
    runs = places.groupBy("source", "size").agg(F.array_sort(F.collect_list(F.struct("start", "end", "first", "each"))).alias("runs"))
    own = F.filter("runs", lambda r: (r["start"] <= F.col("number")) & (F.col("number") < r["end"]))[0]
    fitted = items.join(small(runs, "runs"), ["source", "size"]).withColumn("run", own)
    fitted = fitted.withColumns({c: F.col(f"run.{c}") for c in ("start", "first", "each")})
    fitted = fitted.select(
        "source",
        (F.col("first") + F.floor((F.col("number") - F.col("start")) / F.col("each"))).cast("long").alias("container"),
        "doc_id",
        F.when(F.col("tokens") > F.col("capacity"), F.floor(F.col("tokens") / F.col("capacity")) + 1)
        .otherwise(0).cast("int").alias("part"),
        F.col("size").alias("tokens"),
    )
    # full containers follow the planned ones; their numbers come from counts per source and salt
    last = places.groupBy("source").agg(F.max(F.col("first") + (F.col("end") - F.col("start")) / F.col("each") - 1).cast("long").alias("last"))
    full = docs.filter("tokens >= capacity").withColumn("pieces", F.floor(F.col("tokens") / F.col("capacity")))
    sums = full.groupBy("source", "salt").agg(F.sum("pieces").alias("n"))
    before = Window.partitionBy("source").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("source", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).join(last, "source", "left")
    running = Window.partitionBy("source", "salt").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    full = full.join(bases, ["source", "salt"])
    ahead = F.coalesce(F.col("last"), F.lit(0)) + F.col("base") + F.coalesce(F.sum("pieces").over(running), F.lit(0))
    full = full.withColumn("ahead", ahead)
    full = full.select(
        "source", "doc_id", "tokens", "capacity", "ahead", F.explode(F.sequence(F.lit(1), F.col("pieces").cast("int"))).alias("piece")
    ).select(
        "source", (F.col("ahead") + F.col("piece")).cast("long").alias("container"), "doc_id",
        F.when(F.col("tokens") == F.col("capacity"), 0).otherwise(F.col("piece")).cast("int").alias("part"),
        F.col("capacity").alias("tokens"),
    )
    blank = docs.filter("tokens = 0").select(
        "source", F.lit(1).cast("long").alias("container"), "doc_id", F.lit(0).alias("part"), F.col("tokens")
    )
    return fitted.unionByName(full).unionByName(blank)


def invariants(packed: DataFrame, documents: DataFrame, budgets: DataFrame) -> DataFrame:
    """What must hold of a packing, per source: documents and tokens it holds; fits (no container
    beyond the capacity); whole (a document has one row, or is larger than the capacity)."""
    fill = packed.groupBy("source", "container").agg(F.sum("tokens").alias("held"))
    most = fill.groupBy("source").agg(F.max("held").alias("fullest"))
    docs = packed.groupBy("source", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"), F.max("part").alias("part"))
    capacity = (
        budgets.select(clean_source(F.col("source")).alias("source"), F.col("capacity_tokens").cast("long").alias("capacity"))
        .groupBy("source").agg(F.max("capacity").alias("capacity"))
    )
    cut = (F.col("tokens") > F.col("capacity")) == (F.col("part") > 0)
    docs = docs.join(capacity, "source").groupBy("source", "capacity").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"), F.every(((F.col("rows") == 1) | (F.col("part") > 0)) & cut).alias("whole")
    )
    return docs.join(most, "source").select("source", "documents", "tokens", (F.col("fullest") <= F.col("capacity")).alias("fits"), "whole")


def fill_report(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per source: documents, containers, tokens, the fewest containers that could hold them, fill."""
    capacity = (
        budgets.select(clean_source(F.col("source")).alias("source"), F.col("capacity_tokens").cast("long").alias("capacity"))
        .groupBy("source").agg(F.max("capacity").alias("capacity"))
    )
    sums = packed.groupBy("source").agg(
        F.sum(F.when(F.col("part") <= 1, 1).otherwise(0)).alias("documents"), F.max("container").alias("containers"), F.sum("tokens").alias("tokens")
    )
    return sums.join(capacity, "source").select(
        "source", "capacity", "documents", "containers", "tokens",
        F.ceil(F.col("tokens") / F.col("capacity")).alias("least"),
        F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("fill"),
    )
