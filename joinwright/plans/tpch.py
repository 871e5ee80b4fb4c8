"""TPC-H Q14 and Q19 as declarative plans; Catalyst pushes the single-table halves below the join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import is_promo
from ..operators.joins import STRATEGIES

# Q19's three branches as (brand, first quantity, last quantity, largest size, containers), and the shipping conditions of all.
Q19_BRANCHES = (
    ("Brand#12", 1, 11, 5, ("SM CASE", "SM BOX", "SM PACK", "SM PKG")),
    ("Brand#23", 10, 20, 10, ("MED BAG", "MED BOX", "MED PKG", "MED PACK")),
    ("Brand#34", 20, 30, 15, ("LG CASE", "LG BOX", "LG PACK", "LG PKG")),
)
Q19_MODES = ("AIR", "AIR REG")
Q19_INSTRUCT = "DELIVER IN PERSON"

TPCH_STRATEGIES = {"tpch_nphj_sc": "broadcast", "tpch_rdx_bc": "shuffle_hash", "tpch_rdx_bw_reg_bc": "shuffle_hash", "tpch_rdx_hr": "shuffle_hash", "tpch_rdx_bw_reg_hr": "shuffle_hash"}


def _joined(lineitem: DataFrame, part: DataFrame, how: str | None, on: Column) -> DataFrame:
    if how:
        hint = TPCH_STRATEGIES.get(how) or STRATEGIES[how].hint
        # broadcasts stay Catalyst's choice, by its own size limit
        part = part if hint == "broadcast" else part.hint(hint)
    return lineitem.join(part, on)


def q14_lineitem(lineitem: DataFrame, month: str = "1995-09-01") -> DataFrame:
    """Line items shipped in the month that begins on that day."""
    start = F.lit(month).cast("date")
    kind = dict(lineitem.dtypes)["l_shipdate"]  # the bounds take the column's type, else a cast of the column would stop push-down
    return lineitem.filter((F.col("l_shipdate") >= start.cast(kind)) & (F.col("l_shipdate") < F.add_months(start, 1).cast(kind)))


def _revenue() -> Column:
    # exact decimals: sums don't depend on the order of rows
    return F.col("l_extendedprice").cast("decimal(15,2)") * (F.lit(1).cast("decimal(3,2)") - F.col("l_discount").cast("decimal(3,2)"))


def q14(lineitem: DataFrame, part: DataFrame, how: str | None = None, month: str = "1995-09-01") -> DataFrame:
    """One row: matched_cnt, numerator, denominator, promo_revenue (percent of revenue from promoted parts)."""
    joined = _joined(q14_lineitem(lineitem, month), part, how, F.col("l_partkey") == F.col("p_partkey"))
    sums = joined.agg(
        F.count("*").alias("matched_cnt"),
        F.sum(F.when(is_promo("p_type"), _revenue()).otherwise(F.lit(0).cast("decimal(19,4)"))).cast("double").alias("numerator"),
        F.sum(_revenue()).cast("double").alias("denominator"),
    )
    return sums.withColumn("promo_revenue", F.lit(100.0) * F.col("numerator") / F.nullif(F.col("denominator"), F.lit(0.0)))


def q19_condition(branches: tuple = Q19_BRANCHES, modes: tuple = Q19_MODES, instruct: str = Q19_INSTRUCT) -> Column:
    """The whole predicate on a joined row. Catalyst derives each table's own half from it and keeps the rest in the join."""
    either = F.lit(False)
    for brand, low, high, size, containers in branches:
        either |= (F.col("p_brand") == brand) & F.col("p_container").isin(*containers) & F.col("l_quantity").between(low, high) & F.col("p_size").between(1, size)
    return either & F.col("l_shipmode").isin(*modes) & (F.col("l_shipinstruct") == instruct)


def q19_lineitem(lineitem: DataFrame, branches: tuple = Q19_BRANCHES) -> DataFrame:
    """Line items that any branch could take."""
    quantity = F.lit(False)
    for _, low, high, _, _ in branches:
        quantity |= F.col("l_quantity").between(low, high)
    return lineitem.filter(quantity & F.col("l_shipmode").isin(*Q19_MODES) & (F.col("l_shipinstruct") == Q19_INSTRUCT))


def q19_part(part: DataFrame, branches: tuple = Q19_BRANCHES) -> DataFrame:
    """Parts that any branch could take."""
    either = F.lit(False)
    for brand, _, _, size, containers in branches:
        either |= (F.col("p_brand") == brand) & F.col("p_container").isin(*containers) & F.col("p_size").between(1, size)
    return part.filter(either)


def q19(lineitem: DataFrame, part: DataFrame, how: str | None = None, branches: tuple = Q19_BRANCHES) -> DataFrame:
    """One row: matched_cnt and revenue."""
    on = (F.col("l_partkey") == F.col("p_partkey")) & q19_condition(branches)
    return _joined(lineitem, part, how, on).agg(F.count("*").alias("matched_cnt"), F.sum(_revenue()).cast("double").alias("revenue"))
