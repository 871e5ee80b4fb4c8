"""A running join summary over a stream of probe rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import wrap64_sum


def running_summary(r: DataFrame, s_stream: DataFrame) -> DataFrame:
    """matched_cnt and check_sum of all probe rows so far; write it in complete or update mode. State: one row."""
    pairs = s_stream.select("key", F.col("row_id").alias("s_row_id")).join(r.select("key", F.col("row_id").alias("r_row_id")), "key")
    return pairs.agg(F.count("*").alias("matched_cnt"), wrap64_sum("r_row_id", "s_row_id").alias("check_sum"))
