"""Equi-joins of a build relation R and a probe relation S under named strategies.

A strategy is three choices: a physical hint, the multiplicity (every match, or only the first per probe
row) and the time at which rows are fetched (early, or by row id after the join). Relations have the
columns ``key`` and ``row_id``; other columns are payload, which Catalyst prunes unless it is asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import radix_id, wrap64_sum

#: A build side is broadcast if its hash table has this size at most; beyond it the join is shuffled.
BROADCAST_LIMIT = 64 << 20
#: Bytes of a row (a key and a row id) in that table: 24, a link of 8, and up to 64 of slots, in arrays that double as they grow.
TABLE_ROW = 128
#: Beyond this size of all its hash tables together, a build side that isn't broadcast is merged: a hash table of a partition can't spill, a sort can.
HASH_LIMIT = 256 << 20


@dataclass(frozen=True)
class Strategy:
    """hint: broadcast, shuffle_hash or merge. bits: radix passes for an explicitly partitioned form (empty: by key hash)."""

    name: str
    hint: str = "shuffle_hash"
    first: bool = False
    late: bool = False
    bits: tuple[int, ...] = ()


# The families and kernels whose names callers may use.
FAMILIES = {
    "nphj": "sc lp",
    "phj_radix": "bc lp sc hr hro",
    "phj_asymm_radix": "bc sc hr hro",
    "eth": "pro prh prho",
    "ptr_nphj": "sc lp",
    "ptr_phj_radix": "bc lp sc hr",
    "phj_ind": "sc lp hr hro",
    "phj_shr": "sc lp hr hro",
    "phj_ind_uni": "bc sc lp hr hro",
    "phj_shr_uni": "bc sc lp hr hro",
    "phj_radix_bw_reg": "bc lp sc hr hro",
    "phj_asymm_radix_bw_reg": "bc sc hr hro",
    "ptr_phj_radix_bw_reg": "bc sc lp hr",
}


def _strategies() -> dict[str, Strategy]:
    found = {n: Strategy(n, hint=n) for n in ("broadcast", "shuffle_hash", "merge")}
    for family, kernels in FAMILIES.items():
        for kernel in kernels.split():
            bits = (6, 4) if "asymm" in family else (10,) if "radix" in family else ()
            name = f"{family}_{kernel}"
            found[name] = Strategy(name, "broadcast" if "nphj" in family else "shuffle_hash", kernel == "lp", family.startswith("ptr"), bits)
    return found


STRATEGIES = _strategies()


def strategy(name: str | Strategy) -> Strategy:
    """The strategy of that name; ValueError for an unknown one."""
    if isinstance(name, Strategy):
        return name
    if name not in STRATEGIES:
        raise ValueError(f"unknown join strategy {name!r}")
    return STRATEGIES[name]


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a plan: an over-estimate where it has no statistics, an under-estimate of compressed files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def first_per_key(r: DataFrame) -> DataFrame:
    """One row per key: that with the least row_id (the first match made deterministic)."""
    rest = [c for c in r.columns if c != "key"]
    best = F.min_by(F.struct(*rest), "row_id").alias("best")
    return r.groupBy("key").agg(best).select("key", *[F.col(f"best.{c}").alias(c) for c in rest])


def _hinted(r: DataFrame, s: Strategy, limit: int) -> DataFrame:
    if s.hint != "broadcast":
        return r.hint(s.hint)
    size = r.count() * TABLE_ROW  # the estimate is of compressed files, so rows are counted
    if estimated_bytes(r) <= limit and size <= limit:
        return r.hint("broadcast")
    return r.hint("shuffle_hash" if size <= HASH_LIMIT else "merge")


def radix_placed(df: DataFrame, bits: int) -> DataFrame:
    """df with ``pid``, the key's lowest bits, each row on the Spark partition of that number.

    So many of the bits as the session's shuffle partitions need; both sides of a join thus meet without a further exchange.
    """
    wanted = max(1, (int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    bits = min(bits, wanted)
    return df.filter(F.col("key").isNotNull()).withColumn("pid", radix_id("key", bits)).repartitionById(1 << bits, F.col("pid"))


def join_pairs(r: DataFrame, s: DataFrame, how: str | Strategy = "shuffle_hash", broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """The join index: ``r_row_id, s_row_id`` for every match (or for the first per probe row).

    Only keys and row ids travel. Null keys never match. For a strategy with radix bits both sides are placed by
    the key's low bits, with no hash (see ``radix_placed``). One pass then joins each partition by hash; of two unequal
    passes the second is local to the partitions, which are sorted by its bits, then by key, and merged.
    """
    how = strategy(how)
    left = r.select("key", "row_id")
    left = first_per_key(left) if how.first else left
    right = s.select("key", F.col("row_id").alias("s_row_id"))
    left = left.withColumnRenamed("row_id", "r_row_id")
    if not how.bits:
        return _hinted(left, how, broadcast_limit).join(right, "key").select("r_row_id", "s_row_id")
    left, right = (radix_placed(d, how.bits[0]) for d in (left, right))
    if len(how.bits) == 1:
        return left.hint("shuffle_hash").join(right, ["pid", "key"]).select("r_row_id", "s_row_id")
    left, right = (d.withColumn("pid2", radix_id("key", how.bits[1], how.bits[0])) for d in (left, right))
    return left.hint("merge").join(right, ["pid", "pid2", "key"]).select("r_row_id", "s_row_id")


def join_summary(r: DataFrame, s: DataFrame, how: str | Strategy = "shuffle_hash", broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """One row: ``matched_cnt`` and ``check_sum`` = SUM(r.row_id + s.row_id) mod 2^64."""
    how = strategy(how)
    pairs = join_pairs(r, s, how, broadcast_limit)
    if how.late:
        from .late import fetch_rows

        rows = fetch_rows(pairs, r, s)
        return rows.agg(F.count("*").alias("matched_cnt"), wrap64_sum("r.row_id", "s.row_id").alias("check_sum"))
    return pairs.agg(F.count("*").alias("matched_cnt"), wrap64_sum("r_row_id", "s_row_id").alias("check_sum"))
