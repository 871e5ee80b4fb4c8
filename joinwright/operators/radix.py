"""Radix partitioning: ids, histograms, prefix sums and physical placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import radix_id


def histogram(df: DataFrame, key: str, bits: int, skip: int = 0) -> DataFrame:
    """``pid, n``: rows of each radix partition that has any."""
    return df.groupBy(radix_id(key, bits, skip).alias("pid")).agg(F.count("*").alias("n"))


def prefix_sum(hist: DataFrame) -> DataFrame:
    """Adds ``start_offset`` (rows before the partition) and ``end_offset``.

    The window runs over one row per partition number, at most 2^bits of them, never over the data.
    """
    w = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("n").over(w)
    return hist.withColumn("end_offset", end).withColumn("start_offset", F.col("end_offset") - F.col("n"))


def max_partition(df: DataFrame, key: str, bits: int, skip: int = 0) -> DataFrame:
    """One row: the largest partition's row count."""
    return histogram(df, key, bits, skip).agg(F.max("n").alias("max_n"))


def two_pass_ids(key: str, bits1: int, bits2: int) -> tuple[Column, Column, Column]:
    """Ids of the first pass (low bits), of the second pass (next bits), and of both: pass 1 is the major part."""
    p1, p2 = radix_id(key, bits1), radix_id(key, bits2, bits1)
    return p1, p2, (p1 * (1 << bits2) + p2).cast("int")


def asymmetric_ids(key: str, total_bits: int, first_bits: int) -> tuple[Column, Column, Column]:
    """Two passes of unequal width; first_bits must leave at least one bit for the second."""
    if not 0 < first_bits < total_bits:
        raise ValueError("first_bits must lie between 0 and total_bits")
    return two_pass_ids(key, first_bits, total_bits - first_bits)


def partition_by_radix(df: DataFrame, key: str, bits: int, skip: int = 0) -> DataFrame:
    """Places each row on the Spark partition whose number is its radix id. Null keys go to partition 0.

    Both passes of a two-pass plan become one exchange over bits1 + bits2 bits.
    """
    return df.repartitionById(1 << bits, F.coalesce(radix_id(key, bits, skip), F.lit(0)))
