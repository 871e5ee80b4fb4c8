"""Synthetic relation pairs (R, S), as deterministic expressions over spark.range: no data leaves the executors."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Workload:
    """r and s: rows of each side. width: bytes of a record. The share parameters apply to the kinds named like them."""

    kind: str
    r: int
    s: int
    width: int = 16
    theta: float = 0.0
    selectivity: float = 1.0
    density: float = 1.0
    sparsity: float = 1.0
    seed: int = 12345


# Rows of R for the sizes A, B, C (D, E, F with duplicate keys), and of S.
SIZES = {"A": 1 << 24, "B": 1 << 26, "C": 1 << 28, "D": 1 << 24, "E": 1 << 26, "F": 1 << 28}
PROBE_ROWS = 1 << 28
BILLION = (1 << 30, 1 << 34)
MINI = {k: v >> 14 for k, v in SIZES.items()}


def named(kind: str, size: str = "A", mini: bool = False, **more: float) -> Workload:
    return Workload(kind, (MINI if mini else SIZES)[size], PROBE_ROWS >> (14 if mini else 0), **more)


def _with_payload(df: DataFrame, width: int) -> DataFrame:
    if width == 16:
        return df
    return df.withColumn("payload", F.rpad(F.col("key").cast("string"), width - 16, "x").cast("binary"))


def _ids(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n)


def uniform(spark: SparkSession, w: Workload) -> tuple[DataFrame, DataFrame]:
    """R: keys 1..r, row_id = key. S: R repeated s/r times, row ids copied; with payload, row_id is the position."""
    r = _ids(spark, w.r).select((F.col("id") + 1).alias("key"), (F.col("id") + 1).alias("row_id"))
    key = F.col("id") % w.r + 1
    s = _ids(spark, w.s).select(key.alias("key"), (F.col("id") + 1 if w.width > 16 else key).alias("row_id"))
    return _with_payload(r, w.width), _with_payload(s, w.width)


def _sql(x: float) -> str:
    return f"({x:.17e})"


#: A number in [0, 1) from the md5 of a row's number and a seed, as SQL of Spark and of other engines.
COINS = {
    "spark": "(CAST(conv(substring(md5(concat(CAST({i} AS STRING), ':{seed}')), 1, 13), 16, 10) AS BIGINT) / 4503599627370496e0)",
    "duckdb": "(CAST('0x' || substr(md5(concat(CAST({i} AS VARCHAR), ':{seed}')), 1, 13) AS BIGINT) / 4503599627370496e0)",
}


def coin_sql(i: str, seed: int | str, engine: str = "spark") -> str:
    return COINS[engine].format(i=i, seed=seed)


def duplicate_key_sql(w: Workload, i: str, engine: str = "spark") -> str:
    """A key of 1..r for the row number ``i``, uniform."""
    return f"CAST(floor({coin_sql(i, w.seed, engine)} * {_sql(w.r)}) AS BIGINT) + 1"


def duplicates(spark: SparkSession, w: Workload) -> tuple[DataFrame, DataFrame]:
    """R: keys drawn from 1..r with replacement by a seeded hash, row_id 1..r. S: R repeated."""
    at = F.col("id") % w.r
    r = _ids(spark, w.r).select(F.expr(duplicate_key_sql(w, "id")).alias("key"), (F.col("id") + 1).alias("row_id"))
    return r, _ids(spark, w.s).select(F.expr(duplicate_key_sql(w, f"(id % {w.r})")).alias("key"), (at + 1).alias("row_id"))


#: Draws that a row makes until one is accepted. The last is taken as it is; that happens to fewer than one row in 10^9.
TRIES = 10


def zipf_rank_sql(w: Workload, i: str, engine: str = "spark") -> str:
    """A rank of 1..r for the row number ``i``, with probability in proportion to rank^-theta.

    Rejection-inversion (Hörmann and Derflinger, 1996): a draw from the area under x^-theta is rounded to the nearest
    rank, and kept if it lies in that rank's share of the area. Each row is drawn alone, with no table of weights.
    """
    e = 1 - w.theta
    area = (lambda x: math.log(x)) if e == 0 else (lambda x: (x**e - 1) / e)
    place = (lambda y: math.exp(y)) if e == 0 else (lambda y: (1 + e * y) ** (1 / e))
    area_sql = (lambda x: f"ln({x})") if e == 0 else (lambda x: f"((power({x}, {_sql(e)}) - 1e0) / {_sql(e)})")
    place_sql = (lambda y: f"exp({y})") if e == 0 else (lambda y: f"power(1e0 + {_sql(e)} * ({y}), {_sql(1 / e)})")
    low, high = area(1.5) - 1, area(w.r + 0.5)
    near = 2 - place(area(2.5) - 2**-w.theta)
    tries = []
    for t in range(TRIES):
        u = f"({_sql(high)} + {coin_sql(i, f'{w.seed}:{t}', engine)} * {_sql(low - high)})"
        x = place_sql(u)
        k = f"least(greatest(floor({x} + 5e-1), 1e0), {_sql(w.r)})"
        kept = f"{k} - {x} <= {_sql(near)} OR {u} >= {area_sql(f'({k} + 5e-1)')} - power({k}, {_sql(-w.theta)})"
        tries.append(k if t == TRIES - 1 else f"CASE WHEN {kept} THEN {k} END")
    return f"CAST(coalesce({', '.join(tries)}) AS BIGINT)"


def permuted_sql(w: Workload, rank: str) -> str:
    """The key of a rank, by a seeded affine permutation of 1..r."""
    step = next(k for k in range(w.seed, w.seed + w.r + 2) if math.gcd(k, w.r) == 1)
    return f"({rank} * {step}) % {w.r} + 1"


def zipf(spark: SparkSession, w: Workload) -> tuple[DataFrame, DataFrame]:
    """S keys follow rank^-theta over 1..r, ranks permuted; row_id 1..s."""
    r, _ = uniform(spark, Workload("uniform", w.r, w.r))
    return r, _ids(spark, w.s).select(F.expr(permuted_sql(w, zipf_rank_sql(w, "id"))).alias("key"), (F.col("id") + 1).alias("row_id"))


def zeta(n: int, theta: float) -> float:
    """The sum of k^-theta for k from 1 to n: term by term up to a thousand, by Euler and Maclaurin from there."""
    m = min(n, 1000)
    total = math.fsum(k**-theta for k in range(1, m + 1))
    if n > m:
        area = math.log(n / m) if theta == 1 else (n ** (1 - theta) - m ** (1 - theta)) / (1 - theta)
        total += area + (n**-theta - m**-theta) / 2 - theta * (n ** (-theta - 1) - m ** (-theta - 1)) / 12
    return total


def gray_key_sql(w: Workload, i: str, engine: str = "spark") -> str:
    """A key of 1..r for the row number ``i``: the closed-form approximation of Gray et al. (1994), for theta below 1, the most frequent key first."""
    if not 0 < w.theta < 1:
        raise ValueError("theta must lie between 0 and 1")
    total = zeta(w.r, w.theta)
    eta = (1 - (2 / w.r) ** (1 - w.theta)) / (1 - zeta(2, w.theta) / total)
    u = coin_sql(i, w.seed, engine)
    far = f"CAST(floor({_sql(w.r)} * power({_sql(eta)} * {u} + {_sql(1 - eta)}, {_sql(1 / (1 - w.theta))})) AS BIGINT)"
    return f"CASE WHEN {u} * {_sql(total)} < 1e0 THEN 1 WHEN {u} * {_sql(total)} < {_sql(1 + 0.5**w.theta)} THEN 2 ELSE least(1 + {far}, {w.r}) END"


def zipf_gray(spark: SparkSession, w: Workload) -> tuple[DataFrame, DataFrame]:
    """Like ``zipf`` with the approximation of Gray et al., keys in the order of their frequency."""
    r, _ = uniform(spark, Workload("uniform", w.r, w.r))
    return r, _ids(spark, w.s).select(F.expr(gray_key_sql(w, "id")).cast("bigint").alias("key"), (F.col("id") + 1).alias("row_id"))


def selectivity(spark: SparkSession, w: Workload) -> tuple[DataFrame, DataFrame]:
    """floor(selectivity * r) of every r probe rows match; the others' keys lie above r."""
    r, _ = uniform(spark, Workload("uniform", w.r, w.r))
    at, hit = F.col("id") % w.r, math.floor(w.selectivity * w.r)
    key = F.when(at < hit, at + 1).otherwise(at + 1 + w.r)
    return r, _ids(spark, w.s).select(key.alias("key"), (F.col("id") + 1).alias("row_id"))


def density(spark: SparkSession, w: Workload) -> tuple[DataFrame, DataFrame]:
    """Both sides cycle over floor(density * r) distinct keys."""
    n = max(1, math.floor(w.density * w.r))
    return tuple(_ids(spark, rows).select((F.col("id") % n + 1).alias("key"), (F.col("id") + 1).alias("row_id")) for rows in (w.r, w.s))


def sparsity(spark: SparkSession, w: Workload) -> tuple[DataFrame, DataFrame]:
    """Keys lie 1/sparsity apart."""
    stride = round(1 / w.sparsity)
    r = _ids(spark, w.r).select((F.col("id") * stride + 1).alias("key"), (F.col("id") + 1).alias("row_id"))
    return r, _ids(spark, w.s).select((F.col("id") % w.r * stride + 1).alias("key"), (F.col("id") + 1).alias("row_id"))


KINDS = {"uniform": uniform, "duplicates": duplicates, "zipf": zipf, "zipf_gray": zipf_gray, "selectivity": selectivity, "density": density, "sparsity": sparsity}


def generate(spark: SparkSession, w: Workload) -> tuple[DataFrame, DataFrame]:
    """(R, S) of a workload; ValueError for an unknown kind."""
    if w.kind not in KINDS:
        raise ValueError(f"unknown workload {w.kind!r}")
    return KINDS[w.kind](spark, w)
