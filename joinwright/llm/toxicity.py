"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, through a block-max inverted index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, labelled, sampled
from .ship import ship
from .storage import saved, task_count
from .words import blocks, distinct, find_words, hash_spans, mix

#: Bounds of the labelled sample: examples, half of either class where there are enough, and terms of all examples together.
EXAMPLES = 4096
POSTINGS = 6_000_000
#: Examples in an index block. A term of more examples than there are blocks has a greatest weight for each block; of such terms at
#: most WIDE, the most frequent, whose weights are then held as a matrix. Shorter lists are read whole.
BLOCK_EXAMPLES = 32
WIDE = 512
#: A term is in the vocabulary if so many examples hold it.
LEAST_DOCS = 2
NEIGHBOURS = 15
#: Documents whose neighbours are looked for at a time.
ROWS = 128
#: Words also count by their beginnings of so many bytes, so that inflected forms of a word share terms.
BEGINNINGS = (4, 6, 8)
#: Steps of the vote at which it is calibrated.
STEPS = 10

# A-Z fold to a-z; other ASCII than letters and digits becomes a space.
_CLEAN = np.arange(256, dtype="u1")
_CLEAN[:128] = 0x20
for _c in range(128):
    if chr(_c).isalnum():
        _CLEAN[_c] = ord(chr(_c).lower())


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, term hash) of every term of a block: runs of letters, digits and non-ASCII bytes, and longer runs' beginnings."""
    clean = _CLEAN[data]
    w = find_words(clean, offsets, fold=False)
    doc, found = [w.doc], [w.hash]
    for n in BEGINNINGS:
        long = np.flatnonzero(w.end - w.start > n)
        doc.append(w.doc[long])
        # a beginning is another term than the word that it spells
        found.append(mix(hash_spans(clean, w.start[long], w.start[long] + n, fold=False) + np.uint64(1)))
    return np.concatenate(doc), np.concatenate(found)


def term_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, occurrences) of the different terms of each row of a block, by row."""
    doc, term = _terms(data, offsets)
    _, first, place = distinct(mix(term) + doc.astype("u8") * np.uint64(0x9E3779B97F4A7C15))
    n = np.bincount(place, minlength=len(first))
    order = np.argsort(doc[first], kind="stable")
    return doc[first][order], term[first][order], n[order]


class Index:
    """Examples as inverted lists over terms, in blocks; the lists of frequent terms know the greatest weight in each block."""

    def __init__(self, ids: np.ndarray, y: np.ndarray, begin: np.ndarray, term: np.ndarray, tf: np.ndarray):
        """Example i has the terms term[begin[i]:begin[i + 1]], tf times each."""
        n = len(ids)
        # arrays over all terms of all examples are kept narrow and few: the driver holds them
        example = np.repeat(np.arange(n, dtype="i4"), np.diff(begin))
        every, place = distinct(term)[0::2]
        place = place.astype("i4")
        seen = np.bincount(place, minlength=len(every))
        bad = np.bincount(place[np.repeat(y != 0, np.diff(begin))], minlength=len(every))
        known = seen >= LEAST_DOCS
        self.terms, df = every[known], seen[known]
        self.new = np.log(1 + n)  # the weight of a term that is not in the vocabulary
        self.weight = np.log(1 + n / df) * np.sqrt(1 + evidence(df, bad[known], n, float((y != 0).sum())))
        at = np.where(known, np.cumsum(known) - 1, -1).astype("i4")[place]
        del every, place
        w = (1 + np.log(tf)).astype("f4")
        w *= np.append(self.weight, self.new).astype("f4")[at]  # -1 is the last
        size = np.array([np.sqrt(np.square(w[i:j], dtype="f8").sum()) for i, j in zip(begin[:-1], begin[1:], strict=True)])
        w /= np.maximum(size, 1e-30).astype("f4")[example]
        # examples with the same heaviest terms side by side make blocks whose bounds tell them apart
        heavy = np.array([at[i + np.argmax(w[i:j])] if j > i else -1 for i, j in zip(begin[:-1], begin[1:], strict=True)])
        order = np.lexsort((ids, heavy, y))
        self.ids, self.y = ids[order], y[order].astype("f8")
        rank = np.empty(n, "i4")
        rank[order] = np.arange(n)
        held = at >= 0
        example, at, w = rank[example[held]], at[held], w[held]
        by = np.argsort(at.astype("i8") * max(n, 1) + example)
        example, at, w = example[by], at[by], w[by]
        del by, held
        self.n, self.blocks = n, -(-n // BLOCK_EXAMPLES)
        self.wide = np.full(len(self.terms), -1, "i4")
        wide = np.flatnonzero(df > self.blocks)
        wide = np.sort(wide[np.lexsort((wide, -df[wide]))[:WIDE]])
        self.wide[wide] = np.arange(len(wide))
        self.matrix = np.zeros((len(wide), self.blocks * BLOCK_EXAMPLES), "f4")
        in_wide = self.wide[at] >= 0
        self.matrix[self.wide[at[in_wide]], example[in_wide]] = w[in_wide]
        self.most = self.matrix.reshape(len(wide), self.blocks, BLOCK_EXAMPLES).max(axis=2) if len(wide) else np.zeros((0, self.blocks), "f4")
        self.example, self.value = example[~in_wide].astype("u2"), w[~in_wide].astype("f4")
        self.begin = np.searchsorted(at[~in_wide], np.arange(len(self.terms) + 1)).astype("i4")
        #: Blocks that the bounds let through, of all blocks looked at.
        self.read = self.looked = 0

    def vectors(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place in the vocabulary, weight) of the known terms; lengths are those of the whole texts' vectors."""
        if not len(self.terms):
            return np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0)
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        hit = self.terms[at] == term
        w = (1 + np.log(tf)) * np.where(hit, self.weight[at], self.new)
        w /= np.sqrt(np.maximum(np.bincount(doc, weights=w * w, minlength=rows), 1e-300))[doc]
        return doc[hit], at[hit], w[hit]

    def nearest(self, doc: np.ndarray, place: np.ndarray, w: np.ndarray, rows: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The NEIGHBOURS examples of greatest cosine of each row, ties to the earlier one: (examples, cosines), rows by neighbours.

        Short lists are summed whole. With the greatest weights of frequent terms that bounds every block; the block of the
        greatest bound gives a row its first k-th cosine, and blocks that cannot reach it are not read.
        """
        width = self.blocks * BLOCK_EXAMPLES
        k = min(NEIGHBOURS, self.n)
        narrow = self.wide[place] < 0
        d, p, x = doc[narrow], place[narrow], w[narrow]
        n = (self.begin[p + 1] - self.begin[p]).astype("i8")
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begin[p], n)
        sums = np.bincount(np.repeat(d * width, n) + self.example[at], weights=np.repeat(x, n) * self.value[at], minlength=rows * width).reshape(rows, width)
        x = np.zeros((rows, len(self.matrix)), "f4")
        x[doc[~narrow], self.wide[place[~narrow]]] = w[~narrow]
        sums[:, self.n :] = -1e12  # beyond the last example
        if without is not None:
            sums[np.arange(rows), without] = -1e9
        bound = sums.reshape(rows, self.blocks, BLOCK_EXAMPLES).max(axis=2) + x @ self.most + 1e-5
        done = np.full((rows, self.blocks), False)
        out = np.full((rows, self.blocks, BLOCK_EXAMPLES), -2.0)

        def read(r: np.ndarray, b: int) -> None:
            if len(r):
                cut = slice(b * BLOCK_EXAMPLES, (b + 1) * BLOCK_EXAMPLES)
                out[r, b] = sums[r, cut] + x[r] @ self.matrix[:, cut]
                done[r, b] = True

        best = bound.argmax(axis=1)
        for b in np.unique(best):
            read(np.flatnonzero(best == b), b)
        first = out[np.arange(rows), best]
        kth = np.partition(first, -k, axis=1)[:, -k] if k <= BLOCK_EXAMPLES else np.full(rows, -2.0)
        for b in np.argsort(-bound.max(axis=0), kind="stable"):
            read(np.flatnonzero((bound[:, b] >= kth) & ~done[:, b]), b)
        self.read += int(done.sum())
        self.looked += done.size
        out = out.reshape(rows, width)
        kth = np.partition(out, -k, axis=1)[:, -k]
        found, score = np.full((rows, k), -1), np.full((rows, k), -2.0)
        r, e = np.nonzero(out >= kth[:, None])
        s = out[r, e]
        by = np.lexsort((e, -s, r))
        r, e, s = r[by], e[by], s[by]
        nth = np.arange(len(r)) - np.searchsorted(r, r)
        r, e, s, nth = (v[nth < k] for v in (r, e, s, nth))
        found[r, nth], score[r, nth] = e, s
        return found, score

    def votes(self, found: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The share of label 1 among neighbours with any term in common, nearer ones weighing more; 0 where there are none."""
        near = np.where(score > 0, 1 / (1.05 - np.clip(score, 0, 1)), 0)
        return (near * self.y[found]).sum(axis=1) / np.maximum(near.sum(axis=1), 1e-300)


def evidence(df: np.ndarray, bad: np.ndarray, total: int, bad_total: float) -> np.ndarray:
    """How strongly terms speak for label 1: the G statistic of their examples' labels against those of all, 0 where label 1 is no more common."""
    share = min(max(bad_total / max(total, 1), 1e-9), 1 - 1e-9)
    part = lambda seen, expected: np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-300) / expected), 0)
    g = 2 * (part(bad, df * share) + part(df - bad, df * (1 - share)))
    return np.where(bad > df * share, np.maximum(g, 0), 0)


class Model:
    """An index with the calibration of its votes: probabilities at STEPS steps of the vote, and without evidence."""

    def __init__(self, index: Index, none: float, steps: np.ndarray):
        self.index, self.none, self.steps = index, none, steps

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """(score, ids of the nearest examples) of the rows of a block."""
        rows = len(offsets) - 1
        score, near = np.full(rows, self.none), [[] for _ in range(rows)]
        if not self.index.n:
            return score, near
        doc, term, tf = term_counts(data, offsets)
        for a in range(0, rows, ROWS):
            i, j = np.searchsorted(doc, [a, min(a + ROWS, rows)])
            n = min(ROWS, rows - a)
            found, cosine = self.index.nearest(*self.index.vectors(doc[i:j] - a, term[i:j], tf[i:j], n), n)
            votes = self.index.votes(found, cosine)
            # a hundredth of the vote keeps the order where calibration is flat
            votes = 0.99 * np.interp(votes, (np.arange(STEPS) + 0.5) / STEPS, self.steps) + 0.01 * votes
            some = cosine[:, 0] > 0
            score[a : a + n] = np.where(some, votes, self.none)
            for r in np.flatnonzero(some):
                near[a + r] = self.index.ids[found[r, :3][cosine[r, :3] > 0]].tolist()
        return score, near


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", modulus: int = 4, remainder: int = 2) -> Model:
    """Learns from at most ``examples`` labelled documents outside the held-out fold, half of either class where there are enough.

    All of them are indexed, with all terms that LEAST_DOCS of them hold. A term's weight is its inverse document
    frequency, times the root of one more than the evidence that it gives for label 1. The examples' own votes, each without
    itself, calibrate the score; the classes count by how many labelled documents they have. Without labels every score is
    0.5; with one class alone, near it.
    """
    spark = docs.sparkSession
    ship(spark)
    known = labelled(labels, label, modulus, remainder, id_col)
    totals = {bool(r.bad): r.n for r in known.groupBy((F.col("y") != 0).alias("bad")).agg(F.count("*").alias("n")).collect()}
    good, bad = totals.get(False, 0), totals.get(True, 0)
    none = (bad + 0.5) / (good + bad + 1)
    empty = Model(Index(np.zeros(0, "i8"), np.zeros(0), np.zeros(1, "i8"), np.zeros(0, "u8"), np.zeros(0)), none, np.full(STEPS, 0.5))
    if not good or not bad:
        return empty
    most_bad = min(bad, max(examples // 2, examples - good))
    first = lambda rows, n: rows.orderBy(F.xxhash64("id"), "id").limit(n)
    chosen = first(known.filter("y <> 0"), most_bad).union(first(known.filter("y = 0"), examples - most_bad))
    sample = sampled(docs, chosen, id_col, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in blocks(batch.column("text")):
                doc, term, tf = term_counts(data, offsets)
                cut = np.searchsorted(doc, np.arange(to - at + 1))
                blobs = lambda x, cut=cut: pa.array([x[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, to - at), batch.column("y").slice(at, to - at), pa.array(np.diff(cut)), blobs(term), blobs(tf.astype("u4"))], names=["id", "y", "n", "term", "tf"])

    held = saved(sample.select(F.col("id").cast("bigint").alias("id"), F.when(F.col("y") != 0, 1).otherwise(0).alias("y"), "text").mapInArrow(count, "id bigint, y int, n bigint, term binary, tf binary"), task_count(docs))
    sizes = held.select("id", "y", "n", F.xxhash64("id").alias("h")).toPandas().sort_values(["h", "id", "y"])
    within = sizes[sizes["n"].cumsum() <= POSTINGS]
    if len(within) < len(sizes):
        held = held.filter(F.xxhash64("id") <= int(within["h"].max())) if len(within) else held.limit(0)
    got = held.toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    y = got.column("y").to_numpy()
    if not len(y) or y.min() == y.max():
        return empty
    join = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in got.column(name).to_pylist()])
    index = Index(got.column("id").to_numpy(), y, np.concatenate([[0], np.cumsum(got.column("n").to_numpy())]), join("term", "u8"), join("tf", "u4"))
    del got
    shared = spark.sparkContext.broadcast(index)

    def own_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        at = {(int(i), int(z)): k for k, (i, z) in enumerate(zip(own.ids, own.y, strict=True))}
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                n = part.column("n").to_numpy()
                term, tf = (np.concatenate([np.frombuffer(x, kind) for x in part.column(c).to_pylist()]) for c, kind in (("term", "u8"), ("tf", "u4")))
                without = np.array([at[i, z] for i, z in zip(part.column("id").to_pylist(), part.column("y").to_pylist(), strict=True)])
                found, cosine = own.nearest(*own.vectors(np.repeat(np.arange(len(n)), n), term, tf.astype("f8"), len(n)), len(n), without)
                step = np.where(cosine[:, 0] > 0, np.minimum((own.votes(found, cosine) * STEPS).astype("i4"), STEPS - 1), -1)
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(step, pa.int32())], names=["y", "step"])

    hits, misses = np.zeros(STEPS), np.zeros(STEPS)
    for r in held.repartition(spark.sparkContext.defaultParallelism).mapInArrow(own_votes, "y int, step int").groupBy("step").agg(F.sum("y").alias("hits"), F.count("*").alias("n")).collect():
        if r.step >= 0:
            hits[r.step], misses[r.step] = r.hits, r.n - r.hits
    shared.unpersist()
    # each step's observed share, the classes as frequent as among all labels, drawn to its own vote by one pseudo-example, and made monotone
    hits, misses = hits * bad / (y != 0).sum(), misses * good / (y == 0).sum()
    steps = np.maximum.accumulate((hits + (np.arange(STEPS) + 0.5) / STEPS) / (hits + misses + 1))
    return Model(index, none, np.minimum(steps, 1.0))


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """``id, score, predicted, evidence`` of every whole text (evidence: ids of the nearest examples), or docs' own columns with ``keep``, of the rows not predicted toxic.

    One map over the documents with a broadcast model of bounded size. Null and empty texts, and texts without
    a term of the vocabulary, get the share of label 1 among the labels. Null ids, repeated rows and other
    columns pass; with ``keep`` names may be anything, as columns go by position. An empty table gives an empty one.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            column = batch.column(text_at if keep is not None else 1)
            for at, to, data, offsets in blocks(column):
                score, near = own.score(data, offsets)
                if keep is not None:
                    yield batch.slice(at, to - at).filter(pa.array(score < threshold))
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(score), pa.array((score >= threshold).astype("i4")), pa.array(near, pa.list_(pa.int64()))], names=["id", "score", "predicted", "evidence"])

    if keep is not None:
        plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names may hold any character
        return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id bigint, score double, predicted int, evidence array<bigint>")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **more) -> DataFrame:
    """Fits on labels and scores docs: ``id, held_out, score, predicted, evidence``."""
    scored = score_toxicity(docs, fit(docs, labels, id_col=id_col, text_col=text_col, **more), id_col, text_col, threshold=threshold)
    return scored.withColumn("held_out", held_out(F.col("id"), more.get("modulus", 4), more.get("remainder", 2)))
