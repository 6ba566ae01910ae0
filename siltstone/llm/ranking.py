"""Ranks and the top N inside every group, safe against very large groups.

Hot-cold split: exact counts per partition key find the heavy keys, however many there are;
they stay a table, which is broadcast only if it has few rows. Light keys are
shuffled once and ranked by an ordinary window. Heavy keys are range-partitioned on
(group, score, item) so that each spreads over many tasks; a row's rank is its rank in
its range plus the number of the group's rows in earlier ranges. The two are united.

Defined results:
* an item that occurs again in a group counts once, by its newest row; rows equally new
  count as their best valid score; a null `newest` is older than any other;
* a score that is null or NaN does not count; infinite scores do;
* equal scores are ordered by the item columns, ascending, nulls first;
* a null in a group or item column is a value like any other;
* an empty table gives an empty result; columns not named are ignored, whatever their name.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import materialize, small

#: Keys with at least so many rows are heavy.
HOT_ROWS = 20_000


@dataclass
class Ranked:
    """Ranked rows of the light and, if there are any, the heavy keys.

    Both have the group and item columns, `cost` (ascending, lower is better) and `rank`.
    The rows of `light` are hash-partitioned by the partition key.
    """

    light: DataFrame
    heavy: DataFrame | None


def heavy_keys(rows: DataFrame, by: Sequence[str], hot_rows: int) -> DataFrame | None:
    """The keys with `hot_rows` rows or more; None if there is none."""
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= hot_rows)
    keys = small(counts.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)]), "heavy")
    return None if keys.isEmpty() else keys


def same_keys(by: Sequence[str], prefix: str) -> Column:
    """Equality of the columns with prefix0, prefix1, ..., nulls being equal."""
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"{prefix}{i}"))
    return same


def keep_keys(rows: DataFrame, keys: DataFrame, by: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join with a table of keys."""
    return rows.join(keys, same_keys(by, "__k"), how)


def _newest(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row per key: its newest, with the best valid cost of the rows equally new."""
    best = rows.groupBy(*key, "__new").agg(F.min("cost").alias("cost"))
    return best.groupBy(*key).agg(F.max_by("cost", "__new").alias("cost"))


def rank_in_groups(
    rows: DataFrame,
    group: Sequence[str],
    items: Sequence[str],
    cost: Column,
    *,
    newest: str | None = None,
    partition_by: Sequence[str] | None = None,
    hot_rows: int = HOT_ROWS,
) -> Ranked:
    """Rank the items of every group by `cost` ascending, then by the item columns.

    `partition_by`, a part of `group`, is the key that light rows stay partitioned by,
    so that a later step on that key needs no further shuffle.
    """
    group, items = list(group), list(items)
    by = list(partition_by or group)
    key = group + items
    valid = cost.cast("double")
    old = F.lit(-(2**63)).cast("long")
    new = F.coalesce(F.unix_micros(F.col(newest).cast("timestamp")), old) if newest else old
    base = rows.select(*key, F.when(~F.isnan(valid), valid + F.lit(0.0)).alias("cost"), new.alias("__new"))
    order = [F.col("cost"), *[F.col(c).asc() for c in items]]
    hot = heavy_keys(rows, by, hot_rows)
    light = base if hot is None else keep_keys(base, hot, by, "left_anti")
    light = _newest(light.repartition(*by), key).filter("cost IS NOT NULL")
    light = light.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    if hot is None:
        return Ranked(light, None)
    heavy = _newest(keep_keys(base, hot, by, "left_semi"), key).filter("cost IS NOT NULL")
    ranges = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    heavy = heavy.repartitionByRange(ranges, *[F.col(c) for c in group], *order)
    heavy = materialize(heavy.withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = heavy.groupBy(*group, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *[F.col(c).alias(f"__s{i}") for i, c in enumerate(group)],
        F.col("__range").alias("__r"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"),
    )
    inside = Window.partitionBy(*group, "__range").orderBy(*order)
    heavy = heavy.withColumn("__local", F.row_number().over(inside))
    # a row per range and group in it
    heavy = heavy.join(small(starts, "starts"), (F.col("__range") == F.col("__r")) & same_keys(group, "__s"))
    return Ranked(light, heavy.select(*key, "cost", (F.col("__local") + F.col("__start")).cast("int").alias("rank")))


def with_limits(ranked: DataFrame, limits: DataFrame | None, by: Sequence[str], defaults: dict[str, int]) -> DataFrame:
    """Add the settings of each key, with `defaults` where `limits` has no row or a null."""
    if limits is None:
        return ranked.withColumns({c: F.lit(v) for c, v in defaults.items()})
    right = limits.select(*by, *[F.col(c).alias(f"__{c}") for c in defaults])
    joined = ranked.join(right, list(by), "left")
    return joined.withColumns({c: F.coalesce(F.col(f"__{c}"), F.lit(v)) for c, v in defaults.items()}).drop(
        *[f"__{c}" for c in defaults]
    )


def top_n_per_group(
    rows: DataFrame,
    group: Sequence[str],
    items: Sequence[str],
    cost: Column,
    n: int,
    *,
    limits: DataFrame | None = None,
    newest: str | None = None,
    partition_by: Sequence[str] | None = None,
    max_n: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The first n items of every group: group, items, cost, rank.

    `limits` (the partition key and a column n, one row a key) overrides `n` by key; `max_n`
    then says the largest n in it, which lets most rows go before they meet it.
    """
    by = list(partition_by or group)
    ranked = rank_in_groups(
        rows, group, items, cost, newest=newest, partition_by=by, hot_rows=hot_rows
    )
    out = None
    for part in (ranked.light, ranked.heavy):
        if part is None:
            continue
        if limits is None:
            part = part.filter(F.col("rank") <= n)
        else:
            if max_n is not None:
                part = part.filter(F.col("rank") <= max(n, max_n))
            part = with_limits(part, limits, by, {"n": n}).filter("rank <= n").drop("n")
        part = part.select(*group, *items, "cost", "rank")
        out = part if out is None else out.unionByName(part)
    return out
