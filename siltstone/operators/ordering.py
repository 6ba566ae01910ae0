"""Places in a total order, found by ranges: no task sorts more than its range."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import materialize


def ranged(rows: DataFrame, by: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with `__range`, and of each key `by` and range: `__n` rows, `__before` rows of the key in
    earlier ranges. Ranges follow `by` and then `order`; equal rows may lie in one range only."""
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = materialize(rows.repartitionByRange(parts, *by, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = rows.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__n"))
    ahead = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # a row per range and key in it
    return rows, materialize(sizes.withColumn("__before", F.coalesce(F.sum("__n").over(ahead), F.lit(0))), "starts")


def first_rows(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in the order of the columns, which are distinct: like a limit, but over many tasks."""
    if n <= 0:
        return rows.limit(0)
    rows, starts = ranged(rows, [], order)
    number = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    edge = starts.filter((F.col("__before") < n) & (F.col("__before") + F.col("__n") > n))
    whole = starts.filter(F.col("__before") + F.col("__n") <= n).select("__range")
    cut = rows.join(edge, "__range").withColumn("__r", number).filter(F.col("__r") + F.col("__before") <= n)
    return rows.join(whole, "__range", "left_semi").drop("__range").unionByName(cut.drop("__range", "__r", "__before", "__n"))


def at_places(rows: DataFrame, by: str, value: str, places: DataFrame) -> DataFrame:
    """The values at places (by, name, place from 0) of each key's values in ascending order: by, name, value.

    A place is looked up in the one range that has it."""
    rows, starts = ranged(rows.select(by, value), [by], [value])
    wanted = starts.join(places, by).filter((F.col("place") >= F.col("__before")) & (F.col("place") < F.col("__before") + F.col("__n")))
    wanted = materialize(wanted.select(by, "__range", "name", (F.col("place") - F.col("__before") + 1).alias("__at")), "places")
    number = F.row_number().over(Window.partitionBy(by, "__range").orderBy(value))
    own = rows.join(wanted.select(by, "__range").distinct(), [by, "__range"], "left_semi").withColumn("__r", number)
    return own.join(wanted, [by, "__range"]).filter("__r = __at").select(by, "name", value)
