"""``|``-separated .tbl files of part and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The tables' columns and types; .tbl dates are text YYYY-MM-DD.
PART = "p_partkey bigint, p_name string, p_mfgr string, p_brand string, p_type string, p_size int, p_container string, p_retailprice double, p_comment string"
LINEITEM = (
    "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber bigint, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate date, l_commitdate date, l_receiptdate date, l_shipinstruct string, l_shipmode string, l_comment string"
)

# Rows at scale factors 1, 10 and 100.
TBL_ROWS = {1: {"part": 200_000, "lineitem": 6_001_215}, 10: {"part": 2_000_000, "lineitem": 59_986_052}, 100: {"part": 20_000_000, "lineitem": 600_037_902}}


def read_tbl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Reads splittable .tbl text; the trailing separator of each line is ignored, malformed lines raise."""
    return spark.read.csv(path, sep="|", schema=f"{schema}, _end string", mode="FAILFAST", dateFormat="yyyy-MM-dd", quote="").drop("_end")


def write_tbl(df: DataFrame, path: str) -> None:
    """Writes with the trailing separator."""
    df.withColumn("_end", F.lit("")).write.csv(path, sep="|", quote="", emptyValue="", dateFormat="yyyy-MM-dd")
