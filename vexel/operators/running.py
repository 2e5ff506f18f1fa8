"""Running totals over a whole table, without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, order: str, tie: str, value: str, name: str = "running", ranges: int = 256) -> DataFrame:
    """Adds the sum of `value` over all rows up to and including each, by (order, tie); order is numeric.

    Rows are cut into ranges of the order column by its approximate quantiles; the ranges' sums are few, and each range has
    its own window. Rows with one order value share a range.
    """
    bounds = df.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
    steps = F.array(*map(F.lit, sorted(set(bounds)))) if bounds else F.array().cast("array<double>")
    cut = df.withColumn("__range", F.size(F.filter(steps, lambda b: b < F.col(order))))
    sums = cut.groupBy("__range").agg(F.sum(value).alias("__s"))
    before = sums.select("__range", F.coalesce(F.sum("__s").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inner = F.sum(value).over(Window.partitionBy("__range").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, 0))
    return cut.join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + inner).drop("__range", "__before")
