"""Exact top-k inner products: vectors in order of length, partial sums under an SVD rotation, Cauchy-Schwarz bounds on the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ship import ship
from .storage import saved

#: Queries in one pass over the candidates, which bounds what is broadcast.
QUERIES = 8192
#: Candidates handled at a time, and the first candidates by length, whose scores give every query its first bound.
ROWS = 256
LEADERS = 2048
#: After these shares of the rotated components, pairs that cannot reach their query's bound are dropped.
STAGES = (1 / 4, 1 / 2, 5 / 8, 3 / 4, 13 / 16, 7 / 8, 15 / 16)
#: Vectors with greater components are never dropped by a bound, as squares of these overflow.
HUGE = 2.0**480


def _vectors(column) -> tuple[np.ndarray, np.ndarray]:
    """(matrix padded with zeros to the longest vector, rows that take part)."""
    rows = column.to_pylist()
    ok = np.array([v is not None and all(x is not None for x in v) for v in rows], bool)
    width = max((len(v) for v, o in zip(rows, ok, strict=True) if o), default=0)
    x = np.zeros((len(rows), width))
    for i in np.flatnonzero(ok):
        x[i, : len(rows[i])] = rows[i]
    return x, ok & np.isfinite(x).all(axis=1)


def _scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """row, id, v (floor(scale * x) as doubles), norm of every vector that takes part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ok = _vectors(batch.column("v"))
            with np.errstate(over="ignore"):
                most = np.finfo("f8").max
                x = np.clip(np.floor(scale * x[ok]), -most, most)
                norm = np.where(np.abs(x).max(axis=1, initial=0) > HUGE, np.inf, np.sqrt((x * x).sum(axis=1)))
            take = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(norm)], names=["id", "v", "norm"])

    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "id bigint, v binary, norm double").withColumn("row", F.monotonically_increasing_id())


def _matrix(blobs, width: int) -> np.ndarray:
    x = np.zeros((len(blobs), width))
    for i, b in enumerate(blobs):
        v = np.frombuffer(b, "f8")
        x[i, : len(v)] = v
    return x


def _gram(width: int):
    """Sums of outer products, scaled to unit length: one row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column("v").to_pylist(), width)
            size = np.abs(x).max(axis=1, keepdims=True, initial=0)
            x = x / np.where(size > 0, size, 1)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(width), width)), pa.array(np.tile(np.arange(width), width)), pa.array(total.ravel())], names=["i", "j", "s"])

    return run


class Searcher:
    """A block of queries, rotated, with each one's bound: a score that its k-th result is known to reach."""

    def __init__(self, ids, rows, x: np.ndarray, turn: np.ndarray, k: int):
        self.ids, self.rows, self.x, self.turn, self.k = ids, rows, x, turn, k
        width = x.shape[1]
        self.stages = sorted({min(max(1, round(s * width)), width) for s in STAGES})
        self.z, self.rest, self.norm = self.rotated(x)
        self.bound = np.full(len(ids), -np.inf)
        #: Pairs that were looked at, and those that no bound dropped.
        self.pairs_met = self.pairs_left = 0

    def rotated(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rotated vectors, the lengths of what each stage leaves of them, and of the whole; infinite where squares overflow."""
        huge = np.abs(x).max(axis=1, initial=0) > HUGE
        z = np.where(huge[:, None], 0, x) @ self.turn
        tail = np.cumsum((z * z)[:, ::-1], axis=1)[:, ::-1]
        rest = np.stack([np.sqrt(tail[:, h]) if h < z.shape[1] else np.zeros(len(z)) for h in self.stages], axis=1)
        norm = np.sqrt(tail[:, 0]) if z.shape[1] else np.zeros(len(z))
        return z, np.where(huge[:, None], np.inf, rest), np.where(huge, np.inf, norm)

    def products(self, q: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Exact integer products of row pairs: in doubles where every partial sum stays below 2^53, else in Python's integers."""
        if len(q) and float(np.log2(max(np.abs(q).max(initial=0), 1)) + np.log2(max(np.abs(y).max(initial=0), 1)) + np.log2(max(q.shape[1], 1))) < 52.9:
            return np.einsum("ij,ij->i", q, y).astype("i8")
        low, high = -(1 << 63), (1 << 63) - 1
        return np.array([min(max(sum(int(a) * int(b) for a, b in zip(r, s, strict=True)), low), high) for r, s in zip(q, y, strict=True)], "i8")

    def left(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, candidate) of the pairs that no bound drops; candidates in descending length.

        A query whose length times the greatest one's is under its bound is done. For the others the sums grow by the components
        of one stage after another; the lengths of what is left bound the rest, by Cauchy and Schwarz.
        """
        z, rest, norm = self.rotated(y)
        top = norm.max(initial=0)
        with np.errstate(invalid="ignore", over="ignore"):
            q = np.flatnonzero(~(self.norm * top * (1 + 1e-9) + 1e-6 < self.bound))
            c = np.arange(len(y))
            self.pairs_met += len(self.ids) * len(y)
            slack = np.nan_to_num(1e-9 * self.norm * top, nan=np.inf) + 1e-6
            sums, alive, at = np.zeros((len(q), len(c))), np.ones((len(q), len(c)), bool), 0
            for s, h in enumerate(self.stages):
                sums += self.z[q, at:h] @ z[c, at:h].T
                at = h
                # not below: an undefined bound (nothing left of one, all too much of the other) drops nothing
                alive &= ~(sums + np.outer(self.rest[q, s], rest[c, s]) < (self.bound[q] - slack[q])[:, None])
                some, any_ = alive.any(axis=1), alive.any(axis=0)
                if some.sum() * any_.sum() < 0.8 * alive.size:
                    q, c = q[some], c[any_]
                    sums, alive = sums[np.ix_(some, any_)], alive[np.ix_(some, any_)]
                if not alive.size:
                    break
        i, j = np.nonzero(alive)
        self.pairs_left += len(i)
        return q[i], c[j]

    def pairs(self, rows, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate, score) of the pairs whose scores reach the queries' bounds."""
        i, j = self.left(y)
        own = self.rows[i] != rows[j]
        i, j = i[own], j[own]
        score = np.concatenate([self.products(self.x[i[a : a + 65536]], y[j[a : a + 65536]]) for a in range(0, len(i), 65536)]) if len(i) else np.zeros(0, "i8")
        keep = score >= self.bound[i]
        return i[keep], j[keep], score[keep]

    def first_bounds(self, rows: np.ndarray, y: np.ndarray) -> None:
        """The k-th best score among these candidates bounds each query's k-th result."""
        if len(y) <= self.k:
            return
        for a in range(0, len(self.ids), 256):
            b = slice(a, a + 256)
            with np.errstate(invalid="ignore", over="ignore"):
                scores = self.x[b] @ y.T
            scores[(self.rows[b][:, None] == rows[None, :]) | ~np.isfinite(scores)] = -np.inf
            kth = np.partition(scores, -self.k, axis=1)[:, -self.k]
            self.bound[b] = np.where(np.isfinite(kth), np.minimum(kth, LARGEST) - 1e-9 * np.abs(kth) - 1e-6, -np.inf)


#: Scores saturate at 64 bits, and so do bounds.
LARGEST = float(1 << 63)


def _best(q, ids, score, k: int) -> np.ndarray:
    """Places of each query's k greatest scores, ties to smaller ids, null ids (the least value) last."""
    order = np.lexsort((np.where(ids == NULL, np.iinfo("i8").max, ids), ~score, q))  # ~ reverses the order as - does, and doesn't overflow
    s = q[order]
    new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, "i8")
    nth = np.arange(len(s)) - np.repeat(new, np.diff(np.append(new, len(s))))
    return order[nth < k]


NULL = np.iinfo("i8").min


def top_inner_products(vectors: DataFrame, k: int = 20, divisor: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k candidates of greatest integer inner product for each query.

    Components become floor(scale * x). Queries are the rows whose id is divisible by ``divisor``; candidates
    are all rows but the query's own. Ties go to the smaller id. Exact: bounds only skip what cannot be among
    the k, and the scores that remain are computed in integers.

    Queries go in blocks of QUERIES, so each broadcast is bounded, and one is live at a time; the candidates are put in
    order of length once. The LEADERS longest vectors give every query of a block a first bound. Then each task takes its
    candidates by descending length, drops pairs in stages (see ``Searcher.left``), computes the rest in integers,
    and raises each query's bound to the k-th score that it has found. Tasks return at most k rows for each query.

    Vectors that are null or hold nulls or non-finite components take no part; shorter vectors are padded with
    zeros. A null id is no query and loses ties. Rows that repeat are candidates of their own. Scaled components saturate
    at the greatest double and scores at 64 bits. Other columns are not read. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    ship(spark)
    held = saved(_scaled(vectors, id_col, vector_col, scale))
    width = int((held.agg(F.max(F.octet_length("v"))).first()[0] or 0) // 8)
    schema = "query_id bigint, qrow bigint, vec_id bigint, row bigint, score bigint"
    if not width:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    gram = np.zeros((width, width))
    sums = held.select("v").mapInArrow(_gram(width), "i bigint, j bigint, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    gram[sums.column("i").to_numpy(), sums.column("j").to_numpy()] = sums.column("s").to_numpy()
    turn = np.linalg.svd(gram)[0]

    def arrays(df: DataFrame):
        got = df.select("id", "row", "v").toArrow()
        ids = np.array([NULL if x is None else x for x in got.column("id").to_pylist()], "i8")
        return ids, got.column("row").to_numpy(), _matrix(got.column("v").to_pylist(), width)

    ordered = saved(held.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.desc("norm"), "row").sortWithinPartitions(F.desc("norm")))
    _, lead_rows, lead = arrays(held.orderBy(F.desc("norm"), "row").limit(LEADERS))
    queries = held.filter(F.col("id") % divisor == 0)
    parts = -(-queries.count() // QUERIES) or 1
    queries = saved(queries.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts))))
    found = None
    for part in range(parts):
        search = Searcher(*arrays(queries.filter(F.col("part") == part)), turn, k)
        search.first_bounds(lead_rows, lead)
        shared = spark.sparkContext.broadcast(search)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            q, c, r, s = (np.zeros(0, "i8") for _ in range(4))
            for batch in batches:
                every = np.array([NULL if v is None else v for v in batch.column("id").to_pylist()], "i8")
                row, blobs = batch.column("row").to_numpy(), batch.column("v")
                for a in range(0, len(row), ROWS):
                    i, j, score = own.pairs(row[a : a + ROWS], _matrix(blobs[a : a + ROWS].to_pylist(), width))
                    if not len(i):
                        continue
                    q, c, r, s = np.concatenate([q, i]), np.concatenate([c, every[a + j]]), np.concatenate([r, row[a + j]]), np.concatenate([s, score])
                    keep = _best(q, c, s, own.k)
                    q, c, r, s = q[keep], c[keep], r[keep], s[keep]
                    full = np.bincount(q, minlength=len(own.ids)) == own.k
                    least = np.full(len(own.ids), LARGEST)
                    np.minimum.at(least, q, s.astype("f8"))
                    own.bound = np.where(full, np.maximum(own.bound, least - 1e-9 * np.abs(least) - 1e-6), own.bound)
            yield pa.RecordBatch.from_arrays([pa.array(own.ids[q]), pa.array(own.rows[q]), pa.array(c, mask=c == NULL), pa.array(r), pa.array(s)], names=["query_id", "qrow", "vec_id", "row", "score"])

        part_found = saved(ordered.select("id", "row", "v").mapInArrow(run, schema))
        shared.unpersist()
        found = part_found if found is None else found.union(part_found)
    rank = F.row_number().over(Window.partitionBy("qrow").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
