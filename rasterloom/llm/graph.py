"""Connected components by alternating large and small stars.

Each round is a handful of joins and minimum aggregates on (u, v) pairs of longs;
minima combine before the exchange and the joins are inner sort-merge joins, whose
hot sides adaptive execution splits. A round's result is a stored table, so a lost
executor never replays earlier rounds. Nothing is collected but a checksum.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.session import drop_stored, stored


def stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node number that each of n nodes reaches over the edges."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())


def components(spark: SparkSession, edges: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """u, v: every node that is linked and not the least of its component, with that least node. A stored table.

    rows: how many edges there are, about, if known.
    """
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = stored(spark, pairs, "stars", rows=rows)
    mark = _mark(now)
    most = mark[0]  # a round has twice that many pairs at most
    while mark[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(spark, small.union(low).distinct(), "stars", rows=2 * most)
        drop_stored(spark, now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return now
