"""One ranking from several differently scaled scores, by closeness to an ideal point.

Each channel's values are made comparable per query: winsorised (values beyond the
`tail` order statistics count as those), measured from the lower bound, and divided by
the channel's Euclidean norm. The ideal point holds each channel's best value, the
anti-ideal point the worst, which is 0 and is also where an item stands in a channel that
does not list it. With the weighted distances d+ and d- to these points (of the Minkowski
order `power`), closeness is d- / (d+ + d-), from 0 to 1.

With `reciprocal` the values are 1 / (rrf_k + rank) instead of the scores, and with
`weights=None` a channel weighs as much as its norm; for power 1 the order by closeness is
then that of the summed reciprocal ranks.

Defined results: see `ranking` for repeated, null and NaN scores and for ties in a channel;
equal closeness is ordered by the item columns. A channel whose valid scores are all equal
adds nothing to closeness. Channels not named in `channels` are ignored. Empty input gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.ranking import HOT_ROWS, rank_in_groups, same_keys, with_limits
from siltstone.session import small

#: Share of a channel's values beyond which they are winsorised, at either end.
TAIL = 0.05
#: Items whose summed reciprocal ranks differ by less may change places when these are rounded.
SLACK = 2e-9


def _by_group(rows: DataFrame, keys: list[str], aggs: dict[str, Column], heavy: bool) -> DataFrame:
    """Add aggregates per key: by windows if the rows are partitioned and small per key,
    else by a pre-aggregated table, a row per heavy key and channel."""
    if not heavy:
        window = Window.partitionBy(*keys)
        return rows.withColumns({name: agg.over(window) for name, agg in aggs.items()})
    table = rows.groupBy(*keys).agg(*[agg.alias(name) for name, agg in aggs.items()])
    table = table.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(keys)], *aggs)
    return rows.join(small(table, "sums"), same_keys(keys, "__g")).drop(*[f"__g{i}" for i in range(len(keys))])


def _values(ranked: DataFrame, query: str, channel: str, reciprocal: bool, tail: float, heavy: bool) -> DataFrame:
    """Add `value`, at least 0 and greater for better items, and `exact`, the reciprocal rank."""
    exact = 1.0 / (F.col("rrf_k") + F.col("rank")).cast("double")
    if reciprocal:
        return ranked.withColumns({"exact": exact, "value": exact})
    ranked = _by_group(ranked, [query, channel], {"__n": F.max("rank")}, heavy)
    # the order statistics at the tails: rank 1 is the best, so the upper bound comes first
    cut = F.floor(F.col("__n") * F.lit(float(tail)))
    ranked = ranked.withColumns({"__hi": cut + 1, "__lo": F.col("__n") - cut})
    bounds = {
        "__high": F.max(F.when(F.col("rank") == F.col("__hi"), -F.col("cost"))),
        "__low": F.max(F.when(F.col("rank") == F.col("__lo"), -F.col("cost"))),
    }
    ranked = _by_group(ranked, [query, channel], bounds, heavy)
    limit = 1e150  # squares stay finite
    low, high = (F.greatest(F.least(F.col(c), F.lit(limit)), F.lit(-limit)) for c in ("__low", "__high"))
    value = F.greatest(F.least(-F.col("cost"), high), low) - low
    return ranked.withColumns({"exact": exact, "value": value}).drop("__n", "__hi", "__lo", "__high", "__low")


def ideal_point_ranking(
    hits: DataFrame,
    query: str,
    channel: str,
    items: Sequence[str],
    cost: Column,
    channels: Sequence[str],
    *,
    limits: DataFrame | None = None,
    top_k: int = 5,
    rrf_k: int = 60,
    newest: str | None = None,
    reciprocal: bool = False,
    weights: dict[str, float] | None = None,
    power: int = 2,
    tail: float = TAIL,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The first top_k items of each query by closeness, with `reciprocal` also those whose fused
    score may round to that of one of them.

    `limits` has query, top_k, rrf_k (one row a query) and overrides the defaults.
    Columns: query, items, closeness, fused (the sum of 1 / (rrf_k + rank) over the channels
    that list the item), place (by closeness, then items), top_k.
    """
    items = list(items)
    known = hits.filter(F.col(channel).isin(list(channels)))
    ranked = rank_in_groups(
        known, [query, channel], items, cost,
        newest=newest, partition_by=[query], hot_rows=hot_rows,
    )
    out = None
    for part, heavy in ((ranked.light, False), (ranked.heavy, True)):
        if part is None:
            continue
        part = with_limits(part, limits, [query], {"top_k": top_k, "rrf_k": rrf_k})
        part = _values(part, query, channel, reciprocal, tail, heavy)
        part = _closeness(part, query, channel, items, channels, weights, power, heavy)
        part = _first(part, query, items, heavy, SLACK if reciprocal else None)
        out = part if out is None else out.unionByName(part)
    return out


def _closeness(
    rows: DataFrame, query: str, channel: str, items: list[str], channels: Sequence[str],
    weights: dict[str, float] | None, power: int, heavy: bool,
) -> DataFrame:
    wide = rows.groupBy(query, *items).agg(
        *[F.max(F.when(F.col(channel) == c, F.col("value"))).alias(f"__x{i}") for i, c in enumerate(channels)],
        F.sum("exact").alias("fused"),
        F.max("top_k").alias("top_k"),
    )
    xs = [f"__x{i}" for i in range(len(channels))]
    wide = wide.withColumns({x: F.coalesce(F.col(x), F.lit(0.0)) for x in xs})
    aggs = {f"__square{i}": F.sum(F.col(x) * F.col(x)) for i, x in enumerate(xs)}
    aggs |= {f"__top{i}": F.max(x) for i, x in enumerate(xs)}
    wide = _by_group(wide, [query], aggs, heavy)
    to_ideal = to_worst = F.lit(0.0)
    for i, c in enumerate(channels):
        norm = F.sqrt(F.col(f"__square{i}"))
        if weights is None:
            scale = F.lit(1.0)  # the weight, which is the norm, over the norm
        else:
            scale = F.when(norm > 0, F.lit(float(weights.get(c, 1.0))) / norm).otherwise(0.0)
        near, far = scale * F.col(f"__x{i}"), scale * (F.col(f"__top{i}") - F.col(f"__x{i}"))
        to_worst = to_worst + (near if power == 1 else F.pow(near, F.lit(power)))
        to_ideal = to_ideal + (far if power == 1 else F.pow(far, F.lit(power)))
    if power != 1:
        to_worst, to_ideal = F.pow(to_worst, F.lit(1.0 / power)), F.pow(to_ideal, F.lit(1.0 / power))
    total = to_ideal + to_worst
    return wide.select(query, *items, "fused", "top_k", F.when(total > 0, to_worst / total).otherwise(0.0).alias("closeness"))


def _first(rows: DataFrame, query: str, items: list[str], heavy: bool, slack: float | None) -> DataFrame:
    """The first top_k rows by closeness and any whose fused score is within the slack of theirs."""
    order = [F.desc("closeness"), *[F.col(c).asc() for c in items]]

    def cut(rows: DataFrame, keys: list[str]) -> DataFrame:
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        first = F.col("place") <= F.col("top_k")
        if slack is None:
            return rows.filter(first)
        last = F.min(F.when(first, F.col("fused"))).over(Window.partitionBy(*keys))
        return rows.withColumn("__last", last).filter(first | (F.col("fused") >= F.col("__last") - slack)).drop("__last")

    if heavy:  # the first top_k of each salted part contain the first top_k of all
        salts = max(64, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        rows = rows.withColumn("__salt", F.pmod(F.xxhash64(*items), F.lit(salts)))
        rows = cut(rows, [query, "__salt"]).drop("__salt", "place")
    return cut(rows, [query]).select(query, *items, "closeness", "fused", "place", "top_k")


def first_by_fused(ranking: DataFrame, query: str, items: Sequence[str], decimals: int = 9) -> DataFrame:
    """The exact check: of the rows above, the first top_k by the rounded fused score."""
    rounded = ranking.withColumn("fused", F.round("fused", decimals))
    window = Window.partitionBy(query).orderBy(F.desc("fused"), *[F.col(c).asc() for c in items])
    return rounded.withColumn("rank", F.row_number().over(window)).filter("rank <= top_k")
