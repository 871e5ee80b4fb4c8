"""Connected components of an edge table by alternating large-star and small-star rounds; all steps are joins and aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import saved


def _mark(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = saved) -> DataFrame:
    """``node, component`` (the least node reachable) for every node that isn't its component's least; edges: ``a, b`` bigint.

    ``keep`` writes the tables between rounds. A hub's edges are never in one task: minima are partial-aggregated, and adaptive execution splits the join back.
    """
    now = keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("u").alias("n"), F.col("v").alias("x")).union(now.select(F.col("v").alias("n"), F.col("u").alias("x")))
        least = both.groupBy("n").agg(F.min("x").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.filter("x > n").join(least, "n").select(F.col("x").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = keep(down.union(low.select("u", F.col("m").alias("v"))).distinct())
        if (then := _mark(after)) == mark:
            break
        now, mark = after, then
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
