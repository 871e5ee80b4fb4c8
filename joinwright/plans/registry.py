"""Named queries over a scale-factor folder, each with the SQL that gives the same rows."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import brand_number, descending_places, joined_by, log2_floor, next_pow_2, text_between, wrap64_add, wrap64_sum
from ..operators import asymmetric_ids, histogram, join_summary, late_materialised_join, max_partition, prefix_sum, salted_join, split_join, two_pass_ids
from ..operators.joins import STRATEGIES
from ..sources import read_fixed, read_table, write_fixed
from . import workloads
from .tpch import Q19_BRANCHES, TPCH_STRATEGIES, q14, q14_lineitem, q19, q19_lineitem, q19_part

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _rel(spark: SparkSession, d: str, table: str, key: str, row_id: str, *payload: str) -> DataFrame:
    return read_table(spark, d, table).select(F.col(key).cast("bigint").alias("key"), F.col(row_id).cast("bigint").alias("row_id"), *payload)


def _sum_sql(r: str, s: str, on: str = "r.key = s.key") -> str:
    return (
        f"WITH r AS ({r}), s AS ({s}) SELECT count(*) AS matched_cnt, "
        "CAST(coalesce(sum(CAST(r.row_id AS HUGEINT) + s.row_id), 0) % 18446744073709551616 AS DECIMAL(20,0)) AS check_sum "
        f"FROM r JOIN s ON {on}"
    )


# --- TPC-H ---------------------------------------------------------------------------------------
REVENUE = "CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(3,2)))"
Q14_SQL = f"""SELECT matched_cnt, numerator, denominator, 100.0::DOUBLE * numerator / denominator AS promo_revenue FROM (
  SELECT count(*) AS matched_cnt,
         CAST(sum(CASE WHEN p_type LIKE 'PROMO%' THEN {REVENUE} ELSE 0 END) AS DOUBLE) AS numerator,
         CAST(sum({REVENUE}) AS DOUBLE) AS denominator
  FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE l_shipdate >= TIMESTAMP '1995-09-01' AND l_shipdate < TIMESTAMP '1995-10-01')"""
_add("q14_promo_revenue", lambda sp, d: q14(read_table(sp, d, "lineitem"), read_table(sp, d, "part")), Q14_SQL)
for _name in TPCH_STRATEGIES:
    _add(f"q14_{_name}", lambda sp, d, n=_name: q14(read_table(sp, d, "lineitem"), read_table(sp, d, "part"), n), Q14_SQL)

# The tables lack four of Q19's columns, so both engines derive them by the same expressions; the third branch takes a brand that occurs.
CONTAINERS = [c for b in Q19_BRANCHES for c in b[4]]
MODES = ["REG AIR", "AIR", "RAIL", "SHIP", "AIR REG", "MAIL", "FOB"]
INSTRUCT = ["DELIVER IN PERSON", "COLLECT COD", "NONE", "TAKE BACK RETURN"]
BRANCHES = (*Q19_BRANCHES[:2], ("Brand#14", *Q19_BRANCHES[2][1:]))


def _q19_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    lineitem = read_table(spark, d, "lineitem")
    lineitem = lineitem.withColumn("l_shipmode", pick(MODES, F.col("l_orderkey") + F.col("l_linenumber"))).withColumn("l_shipinstruct", pick(INSTRUCT, F.col("l_orderkey")))
    return lineitem, read_table(spark, d, "part").withColumn("p_container", pick(CONTAINERS, F.col("p_partkey")))


def _pick_sql(values: list[str], i: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[({i}) % {len(values)} + 1]"


L19 = f"SELECT *, {_pick_sql(MODES, 'l_orderkey + l_linenumber')} AS l_shipmode, {_pick_sql(INSTRUCT, 'l_orderkey')} AS l_shipinstruct FROM lineitem"
P19 = f"SELECT *, {_pick_sql(CONTAINERS, 'p_partkey')} AS p_container FROM part"
_SHIP = "l_shipmode IN ('AIR', 'AIR REG') AND l_shipinstruct = 'DELIVER IN PERSON'"
_PARTS = [f"(p_brand = '{b}' AND p_container IN {c} AND p_size BETWEEN 1 AND {z}" for b, _, _, z, c in BRANCHES]
_FULL = " OR ".join(f"{p} AND l_quantity BETWEEN {lo} AND {hi})" for p, (_, lo, hi, _, _) in zip(_PARTS, BRANCHES, strict=True))
_add(
    "q19_adapted",
    lambda sp, d: q19(*_q19_tables(sp, d), branches=BRANCHES),
    f"WITH l AS ({L19}), p AS ({P19}) SELECT count(*) AS matched_cnt, CAST(sum({REVENUE}) AS DOUBLE) AS revenue FROM l JOIN p ON l_partkey = p_partkey WHERE ({_FULL}) AND {_SHIP}",
)
for _name in TPCH_STRATEGIES:
    _add(f"q19_{_name}", lambda sp, d, n=_name: q19(*_q19_tables(sp, d), how=n, branches=BRANCHES), SQL["q19_adapted"])
_add(
    "pushdown_lineitem",
    lambda sp, d: q14_lineitem(read_table(sp, d, "lineitem")).select("l_partkey", "l_extendedprice", "l_discount", "l_shipdate"),
    "SELECT l_partkey, l_extendedprice, l_discount, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-09-01' AND l_shipdate < TIMESTAMP '1995-10-01'",
)
_add(
    "pushdown_lineitem_q19",
    lambda sp, d: q19_lineitem(_q19_tables(sp, d)[0], BRANCHES).select("l_partkey", "l_quantity", "l_shipmode", "l_shipinstruct"),
    f"WITH l AS ({L19}) SELECT l_partkey, l_quantity, l_shipmode, l_shipinstruct FROM l WHERE (l_quantity BETWEEN 1 AND 11 OR l_quantity BETWEEN 10 AND 20 OR l_quantity BETWEEN 20 AND 30) AND {_SHIP}",
)
_add(
    "pushdown_part",
    lambda sp, d: q19_part(_q19_tables(sp, d)[1], BRANCHES).select("p_partkey", "p_brand", "p_size", "p_container"),
    f"WITH p AS ({P19}) SELECT p_partkey, p_brand, p_size, p_container FROM p WHERE {' OR '.join(x + ')' for x in _PARTS)}",
)

# --- joins ---------------------------------------------------------------------------------------
PK = ("SELECT p_partkey AS key, p_partkey AS row_id FROM part", "SELECT l_partkey AS key, l_orderkey AS row_id FROM lineitem")
DUP = "SELECT o_custkey AS key, o_orderkey AS row_id FROM orders"
CUST = "SELECT c_custkey AS key, c_custkey AS row_id FROM customer"


def _pk(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return _rel(spark, d, "part", "p_partkey", "p_partkey"), _rel(spark, d, "lineitem", "l_partkey", "l_orderkey")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return _rel(spark, d, "orders", "o_custkey", "o_orderkey")


def _customer(spark: SparkSession, d: str) -> DataFrame:
    return _rel(spark, d, "customer", "c_custkey", "c_custkey")


for _how, _label in (("broadcast", "broadcast"), ("shuffle_hash", "shuffle_hash"), ("merge", "sort_merge")):
    _add(f"join_pkfk_{_label}", lambda sp, d, h=_how: join_summary(*_pk(sp, d), h), _sum_sql(*PK))
#: Every strategy name: late ones fetch rows by unique ids, so they run on customer and orders.
_FIRST = f"SELECT key, min(row_id) AS row_id FROM ({DUP}) GROUP BY key"
for _name in [n for n in STRATEGIES if n not in ("broadcast", "shuffle_hash", "merge")]:
    _r = _FIRST if STRATEGIES[_name].first else DUP
    _add(f"join_{_name}", lambda sp, d, n=_name: join_summary(_orders(sp, d), _customer(sp, d), n), _sum_sql(_r, CUST))
_add("join_dupfk", lambda sp, d: join_summary(_orders(sp, d), _orders(sp, d)), _sum_sql(DUP, DUP))
_add("join_first_match", lambda sp, d: join_summary(_orders(sp, d), _customer(sp, d), "phj_radix_lp"), _sum_sql(_FIRST, CUST))
for _p in (20, 40, 60, 80):

    def _selective(sp: SparkSession, d: str, p: int = _p) -> DataFrame:
        r, s = _pk(sp, d)
        return join_summary(r, s.withColumn("key", F.when(F.col("row_id") % 100 < p, F.col("key")).otherwise(F.col("key") + 1_000_000_000)))

    _add(f"join_selectivity_{_p}", _selective, _sum_sql(PK[0], f"SELECT CASE WHEN l_orderkey % 100 < {_p} THEN l_partkey ELSE l_partkey + 1000000000 END AS key, l_orderkey AS row_id FROM lineitem"))

    def _dense(sp: SparkSession, d: str, p: int = _p) -> DataFrame:
        return join_summary(*(x.withColumn("key", F.col("key") % (p * 5)) for x in (_customer(sp, d), _orders(sp, d))))

    _n = _p * 5
    _add(f"join_density_{_p}", _dense, _sum_sql(f"SELECT c_custkey % {_n} AS key, c_custkey AS row_id FROM customer", f"SELECT o_custkey % {_n} AS key, o_orderkey AS row_id FROM orders"))
_add(
    "join_sparsity",
    lambda sp, d: join_summary(*(x.withColumn("key", F.col("key") * 4) for x in _pk(sp, d))),
    _sum_sql("SELECT p_partkey * 4 AS key, p_partkey AS row_id FROM part", "SELECT l_partkey * 4 AS key, l_orderkey AS row_id FROM lineitem"),
)
ZIPF_SQL = _sum_sql(PK[0], "SELECT CASE WHEN l_orderkey % 3 = 0 THEN 7 ELSE l_partkey END AS key, l_orderkey AS row_id FROM lineitem")


def _skewed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r, s = _pk(spark, d)
    return r, s.withColumn("key", F.when(F.col("row_id") % 3 == 0, F.lit(7).cast("bigint")).otherwise(F.col("key")))


def _summary(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("matched_cnt"), wrap64_sum("r_row_id", "s_row_id").alias("check_sum"))


_add("join_zipf_skew", lambda sp, d: _summary(split_join(*_skewed(sp, d))), ZIPF_SQL)
_add("skew_salted_join", lambda sp, d: _summary(salted_join(*_skewed(sp, d), hot_rows=1000)), ZIPF_SQL)
BIG = 9223372036854000000
_add(
    "join_wraparound",
    lambda sp, d: join_summary(*(x.withColumn("row_id", wrap64_add(F.col("row_id"), F.lit(BIG).cast("bigint"))) for x in (_customer(sp, d), _orders(sp, d)))),
    _sum_sql(f"SELECT c_custkey AS key, c_custkey + {BIG} AS row_id FROM customer", f"SELECT o_custkey AS key, o_orderkey + {BIG} AS row_id FROM orders"),
)


def _late(sp: SparkSession, d: str) -> DataFrame:
    r = _rel(sp, d, "customer", "c_custkey", "c_custkey", "c_name", "c_acctbal")
    s = _rel(sp, d, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    rows = late_materialised_join(r, s)
    return rows.select(F.col("r.row_id").alias("r_row_id"), F.col("s.row_id").alias("s_row_id"), F.col("r.c_name").alias("c_name"), F.col("r.c_acctbal").alias("c_acctbal"), F.col("s.o_totalprice").alias("o_totalprice"))


_add("join_late_materialised", _late, "SELECT c_custkey AS r_row_id, o_orderkey AS s_row_id, c_name, c_acctbal, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey")


def _payload(sp: SparkSession, d: str) -> DataFrame:
    r = _rel(sp, d, "part", "p_partkey", "p_partkey", "p_name", "p_brand", "p_type")
    s = _rel(sp, d, "lineitem", "l_partkey", "l_orderkey", "l_linenumber")
    return r.join(s.withColumnRenamed("row_id", "s_row_id"), "key").select("key", "s_row_id", "l_linenumber", "p_name", "p_brand", "p_type")


_add("join_payload_wide", _payload, "SELECT p_partkey AS key, l_orderkey AS s_row_id, l_linenumber, p_name, p_brand, p_type FROM part JOIN lineitem ON p_partkey = l_partkey")

# --- radix ---------------------------------------------------------------------------------------
_L = "lineitem"
HIST = "SELECT CAST(l_partkey & 1023 AS INTEGER) AS pid, count(*) AS n FROM lineitem GROUP BY 1"
_add("radix_histogram", lambda sp, d: histogram(read_table(sp, d, _L), "l_partkey", 10), HIST)
_add(
    "radix_prefix_sum",
    lambda sp, d: prefix_sum(histogram(read_table(sp, d, _L), "l_partkey", 10)),
    f"SELECT pid, n, CAST(sum(n) OVER w AS BIGINT) AS end_offset, CAST(sum(n) OVER w - n AS BIGINT) AS start_offset FROM ({HIST}) WINDOW w AS (ORDER BY pid ROWS UNBOUNDED PRECEDING)",
)


def _passes(sp: SparkSession, d: str, ids) -> DataFrame:
    return read_table(sp, d, _L).groupBy(ids[0].alias("p1"), ids[1].alias("p2"), ids[2].alias("pid")).agg(F.count("*").alias("n"))


def _passes_sql(b1: int, b2: int) -> str:
    p1, p2 = f"(l_partkey & {(1 << b1) - 1})", f"((l_partkey >> {b1}) & {(1 << b2) - 1})"
    return f"SELECT CAST({p1} AS INTEGER) AS p1, CAST({p2} AS INTEGER) AS p2, CAST({p1} * {1 << b2} + {p2} AS INTEGER) AS pid, count(*) AS n FROM lineitem GROUP BY 1, 2, 3"


_add("radix_two_pass", lambda sp, d: _passes(sp, d, two_pass_ids("l_partkey", 5, 5)), _passes_sql(5, 5))
_add("radix_asymmetric", lambda sp, d: _passes(sp, d, asymmetric_ids("l_partkey", 10, 7)), _passes_sql(7, 3))
_add("max_partition", lambda sp, d: max_partition(read_table(sp, d, _L), "l_partkey", 10), f"SELECT max(n) AS max_n FROM ({HIST})")

# --- generators ----------------------------------------------------------------------------------
_W = {"r": 1024, "s": 16384}
_RANGE = "SELECT range + 1 AS key, range + 1 AS row_id FROM range({n})"
_R = _RANGE.format(n=1024)


def _gen(name: str, sql: str | None, **more: float) -> None:
    kind = name.removeprefix("gen_").rstrip("_0123456789") if name != "gen_payload" else "uniform"
    _add(name, lambda sp, d: join_summary(*workloads.generate(sp, workloads.Workload(kind, **_W, **more))), sql)


_gen("gen_uniform", _sum_sql(_R, "SELECT range % 1024 + 1 AS key, range % 1024 + 1 AS row_id FROM range(16384)"))
_gen("gen_payload", _sum_sql(_R, "SELECT range % 1024 + 1 AS key, range + 1 AS row_id FROM range(16384)"), width=64)
_gen("gen_selectivity_40", _sum_sql(_R, "SELECT CASE WHEN range % 1024 < 409 THEN range % 1024 + 1 ELSE range % 1024 + 1025 END AS key, range + 1 AS row_id FROM range(16384)"), selectivity=0.4)
_gen("gen_density_40", _sum_sql("SELECT range % 409 + 1 AS key, range + 1 AS row_id FROM range(1024)", "SELECT range % 409 + 1 AS key, range + 1 AS row_id FROM range(16384)"), density=0.4)
_gen("gen_sparsity", _sum_sql("SELECT range * 4 + 1 AS key, range + 1 AS row_id FROM range(1024)", "SELECT range % 1024 * 4 + 1 AS key, range + 1 AS row_id FROM range(16384)"), sparsity=0.25)
_w = workloads.Workload("duplicates", **_W)
_keys = workloads.duplicate_key_sql
_gen("gen_duplicates", _sum_sql(f"SELECT {_keys(_w, 'range', 'duckdb')} AS key, range + 1 AS row_id FROM range(1024)", f"SELECT {_keys(_w, '(range % 1024)', 'duckdb')} AS key, range % 1024 + 1 AS row_id FROM range(16384)"))
_ROWS = "SELECT {key} AS key, range + 1 AS row_id FROM range(16384)"
for _theta in (1.05, 1.25, 1.5, 1.75):
    _w = workloads.Workload("zipf", **_W, theta=_theta)
    _sql_key = workloads.permuted_sql(_w, workloads.zipf_rank_sql(_w, "range", "duckdb"))
    _gen("gen_zipf" if _theta == 1.25 else f"gen_zipf_{round(100 * _theta)}", _sum_sql(_R, _ROWS.format(key=_sql_key)), theta=_theta)
_gen("gen_zipf_gray", _sum_sql(_R, _ROWS.format(key=workloads.gray_key_sql(workloads.Workload("zipf_gray", **_W, theta=0.75), "range", "duckdb"))), theta=0.75)

# --- fixed-width relations -----------------------------------------------------------------------
def _fixed(sp: SparkSession, d: str) -> DataFrame:
    """Customers and orders as fixed-width relations in the shared folder, read back and joined."""
    shared = sp.conf.get("spark.checkpoint.dir", None) or sp.conf.get("spark.sql.warehouse.dir")
    folder = f"{shared.rstrip('/')}/relations-{uuid.uuid4().hex}"
    if "://" in folder and not folder.startswith("file:"):
        raise ValueError(f"{folder}: relations are written into a mounted folder")
    local = re.sub("^file:/+", "/", folder)
    r = _rel(sp, d, "customer", "c_custkey", "c_custkey", F.col("c_name").cast("binary").alias("payload"))
    write_fixed(r, f"{local}/r", 64)
    write_fixed(_orders(sp, d), f"{local}/s")
    r, s = read_fixed(sp, f"file://{local}/r", 64), read_fixed(sp, f"file://{local}/s")
    return r.join(s.withColumnRenamed("row_id", "s_row_id"), "key").select("key", "row_id", "s_row_id", F.rtrim(F.translate(F.col("payload").cast("string"), "\0", " ")).alias("name"))


_add("fixed_width_join", _fixed, "SELECT c_custkey AS key, c_custkey AS row_id, o_orderkey AS s_row_id, c_name AS name FROM customer JOIN orders ON c_custkey = o_custkey")

# --- scalars -------------------------------------------------------------------------------------
_add(
    "scalar_helpers",
    lambda sp, d: read_table(sp, d, "part").select("p_partkey", next_pow_2("p_size").alias("up"), log2_floor("p_size").alias("bits"), text_between("p_name", 2, 7).alias("part_name"), joined_by("-", "p_brand", "p_type", "p_name").alias("label"), brand_number("p_brand").alias("brand")),
    "SELECT p_partkey, CAST(2 ** ceil(log2(p_size)) AS BIGINT) AS up, CAST(floor(log2(p_size)) AS INTEGER) AS bits, substr(p_name, 3, 5) AS part_name, p_brand || '-' || p_type || '-' || p_name AS label, CAST(substr(p_brand, 7) AS INTEGER) AS brand FROM part",
)


def _places(sp: SparkSession, d: str) -> DataFrame:
    rows = read_table(sp, d, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_acctbal"))).alias("s"))
    return rows.select("s_nationkey", F.posexplode(descending_places(F.col("s.s_acctbal"))).alias("rank", "place"))


_add(
    "descending_places",
    _places,
    "SELECT s_nationkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, place) - 1 AS INTEGER) AS rank, CAST(place AS INTEGER) AS place FROM (SELECT s_nationkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey, s_acctbal) - 1 AS place FROM supplier)",
)
