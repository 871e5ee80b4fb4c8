"""Quality by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, labelled_sample
from .ship import ship
from .words import blocks, find_words, mix

#: Bound of the labelled sample; hashed features, of runs of three shapes of bytes and of words; latent dimensions.
EXAMPLES = 8192
SHAPES, WORDS = 2048, 2048
FEATURES = SHAPES + WORDS
DIMENSIONS = 64
NEIGHBOURS = 25
#: Documents compared with all examples at a time.
ROWS = 1024

# Bytes by shape: lower case, upper case, digits, non-ASCII, space, line ends and other control bytes, and every mark as itself.
_SHAPE = np.full(256, 5, "i8")
for _c in range(256):
    _ch = chr(_c)
    _SHAPE[_c] = 3 if _c > 127 else 0 if _ch.islower() else 1 if _ch.isupper() else 2 if _ch.isdigit() else 4 if _c == 32 else 5 if _c < 32 or _c == 127 else _c - 27
_CODE = (mix(np.arange(1 << 21, dtype="u8")) % np.uint64(SHAPES)).astype("i4")


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed runs of three shapes, then of hashed words with A-Z folded; one row a document."""
    n = len(offsets) - 1
    w = find_words(data, offsets, fold=True)
    found = [w.doc * FEATURES + SHAPES + (w.hash % np.uint64(WORDS)).astype("i8")]
    if len(data) >= 3:
        s = _SHAPE[data]
        code = _CODE[(s[:-2] << 14) | (s[1:-1] << 7) | s[2:]]
        doc = np.repeat(np.arange(n), np.diff(offsets))
        inside = doc[:-2] == doc[2:]
        found.append((doc[:-2] * FEATURES + code)[inside])
    return np.bincount(np.concatenate(found), minlength=n * FEATURES).reshape(n, FEATURES)


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    y: np.ndarray
    prior: float

    def latent(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts.astype("f4")) * self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        z = x @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Exact cosines with all examples, in blocks; the nearest vote with weights that grow with similarity."""
        out = np.full(len(counts), self.prior)
        k = min(NEIGHBOURS, len(self.y))
        if not k:
            return out
        for at in range(0, len(counts), ROWS):
            part = counts[at : at + ROWS]
            z = self.latent(part)
            cosine = z @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            c = np.take_along_axis(cosine, near, axis=1)
            w = 1 / (1.02 - np.clip(c, 0, 1))
            # the prior counts as a neighbour at no similarity
            vote = ((w * self.y[near]).sum(axis=1) + self.prior) / (w.sum(axis=1) + 1)
            out[at : at + ROWS] = np.where(part.any(axis=1), vote, self.prior)  # without features there is nothing near
        return out


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", modulus: int = 3, remainder: int = 1) -> Model:
    """Latent vectors of at most ``examples`` labelled documents outside the held-out fold, by randomised subspace iteration of their TF-IDF matrix."""
    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, modulus, remainder, examples, id_col, text_col)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in blocks(batch.column("text")):
                rows = features(data, offsets)
                at_ = [np.flatnonzero(r) for r in rows]
                blobs = [pa.array([x.astype(kind).tobytes() for x in part], pa.binary()) for part, kind in ((at_, "<u2"), ([r[i] for r, i in zip(rows, at_, strict=True)], "<u4"))]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, to - at), batch.column("y").slice(at, to - at), *blobs], names=["id", "y", "at", "counts"])

    got = sample.select(F.col("id").cast("bigint").alias("id"), "y", "text").mapInArrow(counted, "id bigint, y int, at binary, counts binary").toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    y = (got.column("y").to_numpy() != 0).astype("f4")
    if not len(y):
        return Model(np.ones(FEATURES, "f4"), np.zeros((FEATURES, 1), "f4"), np.zeros((0, 1), "f4"), y, 0.5)
    x = np.zeros((len(y), FEATURES), "f4")
    for row, at, n in zip(x, got.column("at"), got.column("counts"), strict=True):
        row[np.frombuffer(at.as_buffer(), "<u2")] = np.frombuffer(n.as_buffer(), "<u4")
    del got
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype("f4") + 0.1
    np.log1p(x, out=x)
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    d = min(DIMENSIONS, len(x))
    basis = np.linalg.qr(np.random.default_rng(5).standard_normal((FEATURES, min(d + 16, FEATURES))).astype("f4"))[0]
    for _ in range(4):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    _, _, turn = np.linalg.svd(x @ basis, full_matrices=False)
    basis = np.ascontiguousarray((basis @ turn.T)[:, :d])
    z = x @ basis
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    return Model(idf, basis, z, y, float(y.mean()))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **more) -> DataFrame:
    """``id, held_out, score, predicted`` of every whole text, learned from labels outside the held-out fold.

    One map over the documents with a broadcast model of bounded size. Texts without words (null and empty ones) get the share of label 1. Null ids, repeated rows and other columns pass through; an
    empty table gives an empty one, and without labels every score is 0.5.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col=id_col, text_col=text_col, **more))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in blocks(batch.column(1)):
                score = model.value.scores(features(data, offsets)).clip(0, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(score), pa.array((score >= threshold).astype("i4"))], names=["id", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(run, "id bigint, score double, predicted int")
    return scored.withColumn("held_out", held_out(F.col("id"), more.get("modulus", 3), more.get("remainder", 1)))
