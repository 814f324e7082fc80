"""Exclusive running sums over small tables of counts, without one task for the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Keys of a group: running sums go over groups, then inside each.
GROUP = 4096


def starts(counts: DataFrame, key: str, n: str, group: int = GROUP) -> DataFrame:
    """``counts`` (one row for each integer key) with the column start: the sum of ``n`` over all smaller keys.

    One task sees a row for each ``group`` keys; the rest is dealt by group.
    """
    rows = counts.withColumn("_w_group", F.floor(F.col(key) / group).cast("long"))
    before = Window.orderBy("_w_group").rowsBetween(Window.unboundedPreceding, -1)
    coarse = rows.groupBy("_w_group").agg(F.sum(n).alias("_w_n")).select(F.col("_w_group").alias("_w_of"), F.coalesce(F.sum("_w_n").over(before), F.lit(0)).alias("_w_start"))
    inside = Window.partitionBy("_w_group").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_w_inside", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    out = rows.join(coarse, F.col("_w_group") == F.col("_w_of"))
    return out.withColumn("start", F.col("_w_start") + F.col("_w_inside")).drop("_w_group", "_w_of", "_w_start", "_w_inside")
