"""Ranks within groups without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sagaspark.session import cut


def running_share(df: DataFrame, group: list[str], order: str, weight: str) -> DataFrame:
    """Adds ``upto``, the sum of ``weight`` over the group's rows up to this value of ``order``, and ``total``.

    ``df`` has one row per (group, order). Rows are spread by ranges of (group, order), summed up within ranges, and
    the sums of the ranges before are added.
    """
    # Written once, as both uses below must see the same ranges.
    parts = cut(df.repartitionByRange(*(F.col(g) for g in group), F.col(order)).withColumn("__range", F.spark_partition_id()))
    within = Window.partitionBy(*group, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("__in", F.sum(weight).over(within))
    ranges = parts.groupBy(*group, "__range").agg(F.sum(weight).alias("__sum"))
    w = Window.partitionBy(*group)
    before = w.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).withColumn("total", F.sum("__sum").over(w)).drop("__sum")
    return parts.join(ranges, [*group, "__range"]).withColumn("upto", F.col("__in") + F.col("__before")).drop("__in", "__before", "__range")
