"""Token ids of whole texts from the ids of their pre-tokens, by a public tokenizer library.

For a tokenizer that drops white space and splits at it, and between a letter and a mark, a text's ids are
its pieces' ids in turn. The pieces here are words, divided only between an ASCII letter and an ASCII mark
other than the | of special strings, which the library therefore sees whole. It lower-cases, so A-Z are
folded, except in blocks with special strings. Each worker asks the library once for each different
piece that it meets. Tables and caches are keyed by the pieces' bytes; hashes only group equal pieces of a block, and
the bytes of each group are compared.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ship import ship
from .storage import saved
from .words import LOWER, Words, blocks, distinct_spans, find_words

#: Entries of either half of a worker's cache, and bytes of their pieces. A half that is full becomes the older one, and the older one goes;
#: what is met again is taken over, so pieces in use stay.
CACHE = 300_000
CACHE_BYTES = 32 << 20
#: Entries of the broadcast table of frequent pieces, of fewer than SHORT bytes each; how many candidates each task names, and how many
#: lists of candidates are merged at a time.
FREQUENT = 24_576
SHORT = 64
NAMED = 8192
MERGED = 8


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def find_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """The pieces of a block, and its bytes as the pieces are told apart: with A-Z as a-z, but where special strings may be."""
    fold = b"<|" not in data.tobytes()
    return find_words(data, offsets, fold=fold, cut=True), LOWER[data] if fold else data


_encoders: dict[str, Encoder] = {}


def worker_encoder(path: str | None) -> Encoder:
    """This process's encoder, whose cache outlives tasks."""
    path = path or default_path()
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Half:
    """Stored runs of ids, by the bytes of their pieces."""

    def __init__(self, room: int):
        self.place: dict[bytes, int] = {}
        self.ids, self.start, self.length = np.zeros(1 << 16, "u4"), np.zeros(room, "i8"), np.zeros(room, "i8")
        self.n = self.bytes = 0

    def add(self, pieces: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> range:
        """Where they are now: ids of all pieces in turn, sizes of each."""
        if self.n + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), "u4")])
        self.ids[self.n : self.n + len(ids)] = ids
        at = range(len(self.place), len(self.place) + len(pieces))
        self.start[at.start : at.stop], self.length[at.start : at.stop] = self.n + np.cumsum(sizes) - sizes, sizes
        self.n += len(ids)
        self.place.update(zip(pieces, at, strict=True))
        self.bytes += sum(map(len, pieces))
        return at


def _ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    return np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(start, length)


class Encoder:
    """Ids of pieces through a cache in two halves."""

    def __init__(self, path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path or default_path())
        self.library.no_truncation()
        self.library.no_padding()
        self.young, self.old = Half(CACHE), Half(1)

    def encode(self, texts: list[str]) -> list[list[int]]:
        run = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        return [e.ids for e in run(texts, add_special_tokens=False)]

    def places(self, pieces: list[bytes]) -> np.ndarray:
        """Where each of these different pieces is stored in the younger half."""
        if len(self.young.place) + len(pieces) > len(self.young.start) or self.young.bytes > CACHE_BYTES:
            self.young, self.old = Half(max(CACHE, len(pieces))), self.young
        young, old = self.young, self.old
        got = list(map(young.place.get, pieces))
        lack = [i for i, g in enumerate(got) if g is None]
        if lack:
            before = [old.place.get(pieces[i]) for i in lack]
            again = [(i, g) for i, g in zip(lack, before, strict=True) if g is not None]
            if again:
                at = np.array([g for _, g in again])
                for (i, _), j in zip(again, young.add([pieces[i] for i, _ in again], old.ids[_ragged(old.start[at], old.length[at])], old.length[at]), strict=True):
                    got[i] = j
            lack = [i for i, g in zip(lack, before, strict=True) if g is None]
        if lack:
            names = [pieces[i] for i in lack]
            new = self.encode([x.decode() for x in names])
            sizes = np.fromiter(map(len, new), "i8", len(new))
            for i, j in zip(lack, young.add(names, np.fromiter(chain.from_iterable(new), "u4", int(sizes.sum())), sizes), strict=True):
                got[i] = j
        return np.array(got, "i8")

    def lengths(self, words: Words, data: np.ndarray, known: dict[bytes, int]) -> np.ndarray:
        """Ids in each piece; ``known``, the lengths of frequent pieces, is asked first."""
        first, place = distinct_spans(words, data)
        pieces = spelled(words, data, first)
        out = np.array([known.get(x, -1) for x in pieces], "i8")
        miss = np.flatnonzero(out < 0)
        if len(miss):
            at = self.places([pieces[i] for i in miss])
            out[miss] = self.young.length[at]
        return out[place]

    def all_ids(self, words: Words, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in turn, ids in each piece)."""
        first, place = distinct_spans(words, data)
        at = self.places(spelled(words, data, first))[place]
        n = self.young.length[at]
        return self.young.ids[_ragged(self.young.start[at], n)], n


def spelled(words: Words, data: np.ndarray, at: np.ndarray) -> list[bytes]:
    whole = data.tobytes()
    return [whole[i:j] for i, j in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)]


def _most(counts: Counter, n: int) -> pa.RecordBatch:
    """The n greatest counts, ties by bytes, as one row of pieces and one of counts."""
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:n]
    return pa.RecordBatch.from_arrays([pa.array([[x for x, _ in top]], pa.list_(pa.binary())), pa.array([[k for _, k in top]], pa.list_(pa.int64()))], names=["pieces", "n"])


def _frequent_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a task: the short pieces that it has met most often, with their counts."""
    counts: Counter = Counter()
    for batch in batches:
        for _, _, data, offsets in blocks(batch.column(0)):
            words, data = find_pieces(data, offsets)
            first, place = distinct_spans(words, data)
            n = np.bincount(place, minlength=len(first))
            top = np.argsort(-n, kind="stable")[:NAMED]
            top = top[(words.end - words.start)[first[top]] < SHORT]
            for x, k in zip(spelled(words, data, first[top]), n[top].tolist(), strict=True):
                counts[x] += k
            if len(counts) > 8 * NAMED:
                counts = Counter(dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: 4 * NAMED]))
    out = _most(counts, NAMED)
    yield out.append_column("task", pa.array([TaskContext.get().partitionId()], pa.int64()))


def _merge_candidates(key, pdf):
    import pandas as pd

    counts: Counter = Counter()
    for pieces, n in zip(pdf["pieces"], pdf["n"], strict=True):
        for x, k in zip(pieces, n, strict=True):
            counts[x] += int(k)
    out = _most(counts, FREQUENT).to_pydict()
    return pd.DataFrame({"pieces": out["pieces"], "n": out["n"], "task": [int(key[0])]})


def frequent_pieces(texts: DataFrame) -> list[bytes]:
    """The most frequent short pieces of all texts, FREQUENT at most: lists of candidates, one a task, are merged in a tree, MERGED at a time."""
    schema = "pieces array<binary>, n array<bigint>, task bigint"
    lists = saved(texts.mapInArrow(_frequent_pieces, schema))
    tasks = (lists.agg(F.max("task")).first()[0] or 0) + 1
    while tasks > 1:
        tasks = -(-tasks // MERGED)
        lists = saved(lists.withColumn("task", F.floor(F.col("task") / MERGED)).groupBy("task").applyInPandas(_merge_candidates, schema))
    return [bytes(x) for r in lists.select("pieces").collect() for x in r.pieces]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = 2048) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` of every whole text; tokenizer is the path of a .json file.

    Two tiers, both map-side: a broadcast table of the lengths of frequent pieces, at most FREQUENT entries,
    then each worker's own cache, which asks the library. Texts and pieces are never shuffled; what the tasks
    send is a bounded list of candidates for the table each. The tables affect speed alone.

    A null or empty text has 0 bytes and tokens. Null ids and repeated rows pass through, one row for each
    input row. Other columns are not read. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    ship(spark)
    names = frequent_pieces(docs.select(F.col(text_col).cast("string").alias("text")))
    lengths = map(len, Encoder(tokenizer).encode([x.decode() for x in names]))
    table = spark.sparkContext.broadcast(dict(zip(names, lengths, strict=True)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_encoder(tokenizer)
        for batch in batches:
            for at, to, data, offsets in blocks(batch.column(1)):
                words, folded = find_pieces(data, offsets)
                n = np.bincount(words.doc, weights=own.lengths(words, folded, table.value), minlength=to - at).astype("i8")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(np.diff(offsets)), pa.array(n)], names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "id bigint, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)


def token_pieces(docs: DataFrame, window: int, end_id: int, id_col: str, text_col: str, tokenizer: str | None, with_ids: bool) -> DataFrame:
    """Every document's ids, with end_id after them, cut into pieces of at most ``window``: id, start, length, ids_crc32, doc_tokens, [ids,] task, nth (its number among the task's pieces of that length)."""
    import zlib

    ship(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, met = worker_encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(window + 1, "i8")
        for batch in batches:
            for at, to, data, offsets in blocks(batch.column(1)):
                words, folded = find_pieces(data, offsets)
                ids, n = own.all_ids(words, folded)
                size = np.bincount(words.doc, weights=n, minlength=to - at).astype("i8") + 1
                begin = np.concatenate([[0], np.cumsum(size)])
                full = np.full(begin[-1], end_id, "<u4")
                hole = np.ones(len(full), bool)
                hole[begin[1:] - 1] = False
                full[hole] = ids
                pieces = -(-size // window)
                row = np.repeat(np.arange(to - at), pieces)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
                length = np.minimum(window, size[row] - start)
                first = begin[row] + start
                crc = [zlib.crc32(full[a : a + k]) for a, k in zip(first.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                s = length[order]
                new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, "i8")
                nth = np.empty(len(s), "i8")
                nth[order] = np.arange(len(s)) - np.repeat(new, np.diff(np.append(new, len(s)))) + met[s]
                met += np.bincount(length, minlength=window + 1)
                columns = [batch.column(0).slice(at, to - at).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(size[row]), pa.array(np.full(len(row), task, "i8")), pa.array(nth)]
                names = ["id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(first, len(full)).astype("i4")), pa.array(full.astype("i4"))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, "id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, task bigint, nth bigint" + (", ids array<int>" if with_ids else ""))
