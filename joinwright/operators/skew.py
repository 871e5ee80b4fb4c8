"""Joins that stay balanced when single keys hold much of the probe side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound of the hot keys that are broadcast.
HOT_KEYS = 10_000


def salted_join(r: DataFrame, s: DataFrame, salts: int = 16, hot_rows: int = 10_000) -> DataFrame:
    """Join index like ``join_pairs``; only keys with over ``hot_rows`` probe rows are salted.

    Such keys' build rows are replicated ``salts`` times and their probe rows dealt over the salts, so the
    replication costs |hot keys| x salts rows, not |R| x salts. Counting is one partial-aggregated pass, run at once. The
    hot keys are broadcast, so that marking rows moves none by a hot key; were they more than HOT_KEYS, only keys of ten
    times the rows, a hundred times, and so on would count as hot.
    """
    counts = s.groupBy("key").count()
    while True:
        found = counts.filter(F.col("count") > hot_rows).select("key").limit(HOT_KEYS + 1).collect()
        if len(found) <= HOT_KEYS:
            break
        hot_rows *= 10
    kind = s.schema["key"].dataType.simpleString()
    hot = F.broadcast(s.sparkSession.createDataFrame([(r.key, True) for r in found], f"key {kind}, hot boolean"))
    probe = s.select("key", F.col("row_id").alias("s_row_id")).join(hot, "key", "left")
    probe = probe.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("s_row_id"), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
    build = r.select("key", F.col("row_id").alias("r_row_id")).join(hot, "key", "left")
    build = build.withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return build.drop("hot").hint("shuffle_hash").join(probe.drop("hot"), ["key", "salt"]).select("r_row_id", "s_row_id")


def split_join(r: DataFrame, s: DataFrame) -> DataFrame:
    """A sort-merge join index whose oversized partitions adaptive execution splits, replicating R's part of each."""
    left = r.select("key", F.col("row_id").alias("r_row_id")).hint("merge")
    return left.join(s.select("key", F.col("row_id").alias("s_row_id")), "key").select("r_row_id", "s_row_id")
