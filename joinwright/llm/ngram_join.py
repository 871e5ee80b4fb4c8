"""N-gram Jaccard join by set relations: index lists are skipped in blocks by position, and a set's answers derive from a similar set's.

A document's set holds its distinct five-word shingles. Two sets link when 100 * |intersection| >= 75 *
|union|. The join is exact over all sets:

1. One scan reduces each document to the size and the 128-bit key of its set (equal sets are one class, so copies
   are never paired), and counts shingles that several sets of a task share, to order those last. The order only
   serves speed; any common order is exact.
2. A second scan emits each set's prefix under that order: two linked sets share a shingle of their prefixes.
   The entry of a shingle at position p of a set of n has a reach, floor((4 n - 7 p) / 3): the largest set that, where
   this is the first shared shingle, can still link. So two entries of a list are a candidate only where each one's size
   is within the other's reach. Lists of at most LIST entries are compared at once; the others are cut into blocks by
   size and reach, and pairs of blocks out of reach are skipped whole (see ``Join.met``).
3. First each class is verified with the leader of its lists, the class that is in most of them, and with whatever it
   meets in short lists. That connects nearly all of what is connected.
4. Lists that lie in one component are done. In the others only blocks of different components meet. A
   pair's answer is derived, where that decides it, from the computed answers of the class's leader: of the overlap of x
   and y, what lies in the leader is between |x & l| + |l & y| - |l| and |l & y|, and at most |x| - |x & l| lies outside.
   Only pairs that this leaves open are verified on their full sets, and of all pairs only those
   whose bitmaps, of a flipped bit a shingle, don't differ in more bits than linked sets can.

Connections come from distributed rounds; no task or driver holds a list, a group or a component whole. What is
broadcast is bounded by constants: FREQUENT shingles, and a filter of FILTER bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .components import components
from .ship import ship
from .storage import bucket_count, discard, saved, small_or_shuffled, task_count
from .words import blocks, constants, distinct, find_words, mix, packed, shingles

#: Lists of so many entries are compared entry by entry where they meet; longer ones go by blocks.
LIST = 8
#: Bound of the broadcast order: the most frequent shingles, sixteen bytes each. It serves speed only.
FREQUENT = 1 << 18
#: Shingles that a task counts at a time; of these, those that more than one set holds are sent.
SPAN = 4_000_000
#: Entries of shingles that so many sets were seen to share go by class, not by shingle, so that no bucket is hot.
HOT = 64
#: Bits of the broadcast filter of classes whose sets are read. What passes by chance is dropped by a join.
FILTER = 1 << 23
#: Least bits of a bitmap of a set; larger sets have at least twice as many bits as shingles.
BITS = 1024
#: Sizes and reaches of a block are within this factor.
BAND = 1.06

ENTRY = np.dtype([("token", "u8"), ("cls", "u8"), ("size", "u4"), ("pos", "u4")])


def _needed(a, b):
    """The least overlap of linked sets of sizes a and b: 100 o >= 75 (a + b - o)."""
    return -(-3 * (a + b) // 7)


def prefix_length(n):
    """Shingles of a set of n of which a linked set shares one."""
    return n - -(-3 * n // 4) + 1


def _sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each block of text: first row, end row, shingles, bounds, class keys as rows of two uint64."""
    k = constants(4, 41)
    for at, to, data, offsets in blocks(column):
        held, bounds = shingles(find_words(data, offsets, fold=True), to - at)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(held ^ k[0]))])
        more = np.concatenate([[np.uint64(0)], np.cumsum(mix(held + k[1]))])
        one, two = sums[bounds[1:]] - sums[bounds[:-1]], more[bounds[1:]] - more[bounds[:-1]]
        yield at, to, held, bounds, np.stack([mix(one ^ mix(two + k[2])), mix(two ^ mix(one + k[3]))], axis=1)


def _keys(keys: np.ndarray) -> list[bytes]:
    whole = np.ascontiguousarray(keys).tobytes()
    return [whole[i : i + 16] for i in range(0, len(whole), 16)]


def _parity(held: np.ndarray) -> bytes:
    """A bitmap in which each shingle flips one bit; its length is a power of two that depends on the size alone."""
    bits = max(BITS, 1 << int(2 * len(held) - 1).bit_length()) if len(held) else BITS
    flips = np.bincount((held & np.uint64(bits - 1)).astype("i8"), minlength=bits)
    return np.packbits((flips & 1).astype("u1"), bitorder="little").tobytes()


def _differ(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two bitmaps differ; the longer one is folded, which keeps parities."""
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _close(batches):
    """Pairs whose bitmaps allow a link: each shingle that only one of the two sets has flips one bit."""
    for batch in batches:
        n, m = (batch.column(k).to_numpy() for k in ("n", "m"))
        differ = np.fromiter((_differ(np.frombuffer(x.as_buffer(), "u8"), np.frombuffer(y.as_buffer(), "u8")) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)), "i8", len(n))
        yield batch.filter(pa.array(differ <= n + m - 2 * _needed(n, m))).select(["a", "b", "n", "m", "w"])


class _Counter:
    """Counts the shingles of different sets in spans; each span yields (hash bucket, tokens and counts) of those that several hold."""

    def __init__(self, buckets: int):
        self.buckets, self.kept, self.size, self.seen = buckets, [], 0, set()

    def add(self, held: np.ndarray, bounds: np.ndarray, keys: list[bytes]) -> None:
        for i, key in enumerate(keys):
            if key not in self.seen and bounds[i] < bounds[i + 1]:
                self.seen.add(key)
                self.kept.append(held[bounds[i] : bounds[i + 1]])
                self.size += len(self.kept[-1])

    def often(self) -> Iterator[tuple[int, bytes]]:
        if self.kept:
            tokens = np.sort(np.concatenate(self.kept))
            cuts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1], [True]]))
            at = np.flatnonzero(np.diff(cuts) > 1)
            counts = np.empty((len(at), 2), "u8")
            counts[:, 0], counts[:, 1] = tokens[cuts[at]], np.diff(cuts)[at]
            yield from packed((mix(counts[:, 0]) % np.uint64(self.buckets)).astype("i8"), counts)
        self.kept, self.size, self.seen = [], 0, set()


def _summaries(buckets: int):
    """A row for each document, and rows that hold only shared shingles with their counts."""

    def rows(*columns) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "n_shingles", "key", "cls", "bits", "bucket", "often"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(buckets)

        def often() -> Iterator[pa.RecordBatch]:
            if sent := list(counter.often()):
                none = [None] * len(sent)
                yield rows(none, none, none, none, none, [b for b, _ in sent], [x for _, x in sent])

        for batch in batches:
            for at, to, held, bounds, cls in _sets(batch.column(1)):
                keys = _keys(cls)
                counter.add(held, bounds, keys)
                none = [None] * (to - at)
                yield rows(batch.column(0).slice(at, to - at), np.diff(bounds), keys, np.ascontiguousarray(cls[:, 0]).view("i8"), [_parity(held[bounds[i] : bounds[i + 1]]) for i in range(to - at)], none, none)
                if counter.size > SPAN:
                    yield from often()
        yield from often()

    return run


def _summed(key, pdf):
    """Shingles of a bucket with their counts over all spans."""
    import pandas as pd

    c = np.concatenate([np.frombuffer(x, "u8").reshape(-1, 2) for x in pdf["often"]])
    u, _, place = distinct(c[:, 0].copy())
    return pd.DataFrame({"token": u.view("i8"), "n": np.bincount(place, weights=c[:, 1], minlength=len(u)).astype("i8")})


def _order(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent shingles, FREQUENT at most: sorted, the rank of each by ascending count, and whether it is hot."""
    step = lambda n: F.floor(F.log2(n) * 16)  # noqa: E731  finely graded, so the rows of the histogram are few
    least, total = None, 0
    for r in sorted(counts.groupBy(step(F.col("n")).alias("step")).agg(F.count("*").alias("k")).collect(), reverse=True):
        total += r.k
        if total > FREQUENT:
            break
        least = r.step
    if least is None:
        return np.zeros(0, "u8"), np.zeros(0, "i8"), np.zeros(0, bool)
    got = counts.filter(step(F.col("n")) >= least).select("token", "n").toArrow()
    token, n = got.column("token").to_numpy().view("u8"), got.column("n").to_numpy()
    rank = np.empty(len(token), "i8")
    rank[np.lexsort((token, n))] = np.arange(len(token))
    by = np.argsort(token)
    return token[by], rank[by], n[by] >= HOT


def _prefixes(buckets: int, frequent):
    """Emits buckets of ENTRY blobs, by shingle; entries of hot shingles go by class to buckets under 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, ranks, hots = frequent.value
        sent = set()
        for batch in batches:
            for _, _, held, bounds, cls in _sets(batch.column(0)):
                keys, found, hot = _keys(cls), [], []
                if len(order):
                    at = np.minimum(np.searchsorted(order, held), len(order) - 1)
                    known = order[at] == held
                    rank, is_hot = np.where(known, ranks[at] + 1, 0), known & hots[at]
                else:
                    rank, is_hot = np.zeros(len(held), "i8"), np.zeros(len(held), bool)
                for i, key in enumerate(keys):
                    b = slice(bounds[i], bounds[i + 1])
                    n = b.stop - b.start
                    if not n or key in sent:
                        continue
                    if len(sent) < 200_000:
                        sent.add(key)
                    take = prefix_length(n)
                    first = np.argsort(rank[b], kind="stable")[:take]
                    e = np.empty(take, ENTRY)
                    e["token"], e["cls"], e["size"], e["pos"] = held[b][first], cls[i, 0], n, np.arange(take)
                    found.append(e)
                    hot.append(is_hot[b][first])
                if found:
                    e, h = np.concatenate(found), np.concatenate(hot)
                    bucket = (mix(np.where(h, e["cls"], e["token"])) % np.uint64(buckets)).astype("i8")
                    rows = list(packed(np.where(h, -1 - bucket, bucket), e))
                    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "blob"])

    return run


def reach(size, pos):
    """The largest set that a set may link with if their first shared shingle stands at this position of it."""
    return (4 * size - 7 * pos) // 3


def list_pairs(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct candidate pairs (least class, other class) of entries sorted by token, and the lists that each pair shares."""
    if not len(e):
        return np.zeros((0, 2), "i8"), np.zeros(0, "i8")
    size, far = e["size"].astype("i8"), reach(e["size"].astype("i8"), e["pos"].astype("i8"))
    begin = np.flatnonzero(np.concatenate([[True], e["token"][1:] != e["token"][:-1]]))
    last = np.repeat(np.append(begin[1:], len(e)), np.diff(np.append(begin, len(e))))
    found = []
    at = np.arange(len(e))
    for shift in range(1, len(e)):
        at = at[at + shift < last[at]]
        if not len(at):
            break
        i, j = at, at + shift
        ok = (size[i] <= far[j]) & (size[j] <= far[i])
        a, b = e["cls"][i[ok]].view("i8"), e["cls"][j[ok]].view("i8")
        p = np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)
        found.append(p[p[:, 0] != p[:, 1]])
    p = np.concatenate(found) if found else np.zeros((0, 2), "i8")
    _, first, place = distinct(mix(np.ascontiguousarray(p[:, 0]).view("u8")) + np.ascontiguousarray(p[:, 1]).view("u8"))
    return p[first], np.bincount(place, minlength=len(first))


def _meet(key, pdf):
    """One bucket: weighted pairs of its short lists; entries of its long lists (token is then set). Buckets under 0 hold entries of hot shingles."""
    import pandas as pd

    e = np.concatenate([np.frombuffer(x, ENTRY) for x in pdf["blob"]])
    hot = int(key[0]) < 0
    e = e[np.argsort(e["token"], kind="stable")]

    def lengths() -> np.ndarray:
        count = np.diff(np.flatnonzero(np.concatenate([[True], e["token"][1:] != e["token"][:-1], [True]]))) if len(e) else np.zeros(0, "i8")
        return np.repeat(count, count)

    e = e if hot else e[lengths() > 1]  # most shingles stand alone
    e = e[np.lexsort((e["pos"], e["size"], e["cls"], e["token"]))]
    e = e[np.concatenate([[True], e[1:] != e[:-1]])] if len(e) else e  # copies of a set from other tasks
    here = lengths()
    short, long = (e[:0], e) if hot else (e[(here > 1) & (here <= LIST)], e[here > LIST])
    p, w = list_pairs(short)
    pairs = pd.DataFrame({"a": p[:, 0], "b": p[:, 1], "w": w})
    pairs["token"] = pd.array([None] * len(p), "Int64")
    rest = pd.DataFrame({"a": np.ascontiguousarray(long["cls"]).view("i8"), "b": long["size"].astype("i8"), "w": long["pos"].astype("i8"), "token": pd.array(np.ascontiguousarray(long["token"]).view("i8"), "Int64")})
    return pd.concat([pairs, rest])


def _class_sets(filtered):
    """One row for each class and task: its sorted shingles, of the classes that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = filtered.value
        seen: set[bytes] = set()
        for batch in batches:
            for _, _, held, bounds, cls in _sets(batch.column(0)):
                rows = []
                for i, key in enumerate(_keys(cls)):
                    at = zlib.crc32(key) % FILTER
                    if not bits[at >> 3] >> (at & 7) & 1 or key in seen:
                        continue
                    if len(seen) < 200_000:
                        seen.add(key)
                    rows.append((key, held[bounds[i] : bounds[i + 1]].tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.binary()), pa.array([s for _, s in rows], pa.binary())], names=["key", "held"])

    return run


def _overlaps(batches):
    for batch in batches:
        found = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), "u8"), np.frombuffer(y.as_buffer(), "u8")
            at = np.searchsorted(x, y)
            found.append(int((x[np.minimum(at, len(x) - 1)] == y).sum()))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("n"), batch.column("m"), pa.array(found, pa.int64())], names=["a", "b", "n", "m", "overlap"])


def _band(x: Column) -> Column:
    return F.floor(F.log(x.cast("double")) / float(np.log(BAND))).cast("int")


def met(entries: DataFrame, keep: Callable[[DataFrame], DataFrame] = saved) -> DataFrame:
    """``a, b, n, m, w``: classes of different parts that meet within each other's reach in a list; entries: token, key, size, pos, part.

    Entries of a list form blocks of one part and of a band of sizes and of reaches. A block of reach under its sizes is
    only the larger side of a pair, so each block looks up the blocks of the bands from its size to its reach. What
    is left after the blocks' least sizes and greatest reaches is compared entry by entry.
    """
    held = entries.withColumn("far", F.floor((4 * F.col("size") - 7 * F.col("pos")) / 3).cast("bigint")).filter("far > 0")
    held = held.withColumn("s", _band(F.col("size"))).withColumn("f", _band(F.col("far")))
    block = ["token", "part", "s", "f"]
    cells = keep(held.groupBy(*block).agg(F.min("size").alias("least"), F.max("far").alias("most")))
    small = cells.filter("f >= s").withColumn("t", F.explode(F.sequence("s", "f")))
    of = lambda df, x: df.select(*[F.col(c).alias(f"{x}{c}") for c in df.columns])
    near = of(small, "y").join(of(cells, "x"), (F.col("ytoken") == F.col("xtoken")) & (F.col("yt") == F.col("xs"))).filter("ypart <> xpart and yleast <= xmost and xleast <= ymost")
    near = near.select(*[x + c for x in "yx" for c in block])
    y, x = of(held, "p"), of(held, "q")
    both = near.join(y, [F.col(f"y{c}") == F.col(f"p{c}") for c in block]).drop(*[f"p{c}" for c in block if c != "part"])
    both = both.join(x, [F.col(f"x{c}") == F.col(f"q{c}") for c in block])
    both = both.filter("psize <= qfar and qsize <= pfar and (psize < qsize or psize = qsize and pkey < qkey)")
    pair = both.select(F.when(F.col("pkey") < F.col("qkey"), F.struct(F.col("pkey").alias("a"), F.col("qkey").alias("b"), F.col("psize").alias("n"), F.col("qsize").alias("m"))).otherwise(F.struct(F.col("qkey").alias("a"), F.col("pkey").alias("b"), F.col("qsize").alias("n"), F.col("psize").alias("m"))).alias("p"))
    return pair.select("p.*").groupBy("a", "b", "n", "m").agg(F.count("*").alias("w"))


class _Join:
    """The state of one run: which pairs are verified, and what is connected."""

    def __init__(self, texts: DataFrame, classes: DataFrame, keep: Callable[[DataFrame], DataFrame]):
        self.texts, self.classes, self.keep = texts, classes, keep

    def near(self, pairs: DataFrame, name: str) -> DataFrame:
        """a, b, n, m, w as keys and sizes, of the pairs a, b, w that sizes and bitmaps allow; a and b are ``name``: keys, or their first 64 bits.

        Classes that share the first 64 bits are all looked at.
        """
        of = lambda k, n, x: self.classes.select(F.col(name).alias(k), F.col("key").alias(f"k{k}"), F.col("n_shingles").alias(n), F.col("bits").alias(x))
        both = pairs.join(of("a", "n", "x"), "a").join(of("b", "m", "y"), "b").filter("4 * least(n, m) >= 3 * greatest(n, m)")
        return self.keep(both.select(F.col("ka").alias("a"), F.col("kb").alias("b"), "n", "m", "w", "x", "y").mapInArrow(_close, "a binary, b binary, n bigint, m bigint, w bigint"))

    def verify(self, pairs: DataFrame) -> DataFrame:
        """pairs with their overlap, on full sets; the sets of no other classes leave the scan, but for a few by chance."""
        spark = self.texts.sparkSession
        wanted = self.keep(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct())
        bit = F.crc32("key") % FILTER
        words = wanted.select(F.floor(bit / 64).alias("word"), F.expr(f"shiftleft(1L, cast(crc32(key) % {FILTER} % 64 as int))").alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
        bits = np.zeros(FILTER // 64, "i8")
        bits[words.column("word").to_numpy()] = words.column("mask").to_numpy()
        filtered = spark.sparkContext.broadcast(bits.view("u1"))
        sets = self.texts.mapInArrow(_class_sets(filtered), "key binary, held binary").join(small_or_shuffled(wanted), "key", "left_semi")
        sets = self.keep(sets.dropDuplicates(["key"]))
        filtered.unpersist()
        both = pairs.join(sets.select(F.col("key").alias("a"), F.col("held").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("held").alias("y")), "b")
        done = self.keep(both.select("a", "b", "n", "m", "x", "y").mapInArrow(_overlaps, "a binary, b binary, n bigint, m bigint, overlap bigint"))
        discard(sets, wanted)
        return done

    def derived(self, pairs: DataFrame, done: DataFrame) -> DataFrame:
        """pairs with ``overlap`` between ``low`` and ``high``, from the computed answers of a's leader, the class of its greatest share."""
        ways = done.select("a", "b", "n", "m", "overlap").union(done.select("b", "a", "m", "n", "overlap"))
        share = (F.col("overlap") / (F.col("n") + F.col("m") - F.col("overlap"))).alias("share")
        lead = ways.groupBy(F.col("a").alias("x")).agg(F.max(F.struct(share, F.col("b").alias("l"), F.col("m").alias("size"), F.col("overlap").alias("within"))).alias("p")).select("x", "p.l", "p.size", "p.within")
        answers = ways.select(F.col("a").alias("of"), F.col("b").alias("y"), F.col("overlap").alias("there"))
        asked = pairs.join(lead, F.col("a") == F.col("x"), "left").join(answers, (F.col("l") == F.col("of")) & (F.col("b") == F.col("y")), "left")
        low = F.greatest(F.lit(0).cast("bigint"), F.col("within") + F.col("there") - F.col("size"))
        high = F.least("n", "m", F.col("there") + F.col("n") - F.col("within"))
        return asked.select("a", "b", "n", "m", "w", F.coalesce(low, F.lit(0)).alias("low"), F.coalesce(high, F.least("n", "m")).alias("high"))


def _linked(done: DataFrame) -> DataFrame:
    return done.filter("7 * overlap >= 3 * (n + m)").select("a", "b")


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pairs: bool = False) -> DataFrame:
    """Connected near-duplicate groups of all documents under a Jaccard similarity of at least 0.75 on five-word shingles.

    Returns ``id, n_shingles, component_id, key, component``: one row for each input row; component_id is the least
    id that links reach, itself included. ``key`` tells equal sets, ``component`` connected ones (null for empty sets).
    With ``pairs`` it returns instead every link between different classes, as their keys ``a, b``, also where others
    connect the two; only component ids go without verifying the pairs inside a component.

    Null and empty texts have an empty set: size 0, linked with nothing, their own component. A null id is
    never a component's least id unless all are null. Rows that repeat share class and component. Columns
    other than the two named are not read, so their names cannot clash. An empty table gives an empty table.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    spark = docs.sparkSession
    ship(spark)
    buckets = bucket_count(docs)
    keep = partial(saved, tasks=task_count(docs))
    summary = keep(rows.mapInArrow(_summaries(buckets), "id bigint, n_shingles bigint, key binary, cls bigint, bits binary, bucket bigint, often binary"))
    held = summary.filter("often is null").select("id", "n_shingles", "key", "cls", "bits")
    counts = keep(summary.filter("often is not null").select("bucket", "often").groupBy("bucket").applyInPandas(_summed, "token bigint, n bigint"))
    frequent = spark.sparkContext.broadcast(_order(counts))
    discard(counts)

    entries = texts.mapInArrow(_prefixes(buckets, frequent), "bucket bigint, blob binary")
    found = keep(entries.groupBy("bucket").applyInPandas(_meet, "a bigint, b bigint, w bigint, token bigint"))
    frequent.unpersist()
    lists = found.filter("token is not null").select("token", F.col("a").alias("cls"), F.col("b").alias("size"), F.col("w").alias("pos"))
    classes = held.filter("n_shingles > 0").groupBy("key").agg(F.first("n_shingles").alias("n_shingles"), F.first("cls").alias("cls"), F.first("bits").alias("bits"), F.min("id").alias("id"))
    classes = keep(classes)
    state = _Join(texts, classes, keep)
    if pairs:
        own = classes.select("cls", "key", F.col("key").alias("part"))
        short = state.near(found.filter("token is null").select("a", "b", "w"), "cls")
        every = short.union(state.near(met(lists.join(own, "cls"), keep).select("a", "b", "w"), "key"))
        return _linked(state.verify(keep(every.select("a", "b", "n", "m").distinct())))

    # each class of a long list with its leaders, of its own band of sizes and of the two beside it
    central = lists.groupBy("cls").agg(F.count("*").alias("lists"))
    banded = keep(lists.join(central, "cls").select("token", "cls", "size", "lists", F.floor(F.log(F.col("size").cast("double")) / float(np.log(4 / 3))).alias("band")))
    leader = banded.groupBy("token", "band").agg(F.max(F.struct("lists", "cls", "size")).alias("p"))
    leader = leader.select("token", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])).alias("band"), F.col("p.cls").alias("l"), F.col("p.size").alias("ls"))
    star = banded.join(leader, ["token", "band"]).filter("l <> cls and 4 * least(size, ls) >= 3 * greatest(size, ls)")
    star = star.groupBy(F.least("cls", "l").alias("a"), F.greatest("cls", "l").alias("b")).agg(F.count("*").alias("w"))
    first = state.near(found.filter("token is null").select("a", "b", "w").union(star).groupBy("a", "b").agg(F.sum("w").alias("w")), "cls")
    done = state.verify(first)
    discard(banded)
    component = components(_linked(done), keep)

    # lists that are not yet one component
    of = keep(classes.join(component.select(F.col("node").alias("key"), "component"), "key", "left").select("cls", "key", "id", F.coalesce("component", "key").alias("part")))
    parted = keep(lists.join(of.drop("id"), "cls"))
    open_ = parted.groupBy("token").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p <> q").select("token")
    rest = keep(state.derived(met(parted.join(open_, "token", "left_semi"), keep), done))
    needed = F.ceil(3 * (F.col("n") + F.col("m")) / 7)
    derived = rest.filter(F.col("low") >= needed).select("a", "b")
    asked = state.near(rest.filter((F.col("low") < needed) & (F.col("high") >= needed)).select("a", "b", "w"), "key")
    more = derived if asked.isEmpty() else derived.union(_linked(state.verify(asked)))
    # the links found last join whole components, so only components are connected anew
    name = lambda k: of.select(F.col("key").alias(k), F.col("part").alias(f"p{k}"))
    again = components(more.join(name("a"), "a").join(name("b"), "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")), keep)
    again = again.select(F.col("node").alias("part"), F.col("component").alias("joined"))
    grouped = of.join(small_or_shuffled(again), "part", "left").select("key", "id", F.coalesce("joined", "part").alias("component"))
    grouped = keep(grouped)
    named = grouped.groupBy("component").agg(F.min("id").alias("component_id"))
    named = keep(grouped.select("key", "component").join(named, "component").select("key", "component_id", "component"))
    discard(parted, rest, asked, grouped)
    filled = held.filter("n_shingles > 0").join(small_or_shuffled(named), "key", "left")
    empty = held.filter("n_shingles = 0")
    none = F.lit(None).cast("binary").alias("component")
    return filled.select("id", "n_shingles", "component_id", "key", "component").union(empty.select("id", "n_shingles", F.col("id").alias("component_id"), "key", none))


def with_key(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """docs with the key of each row's set in a further column."""
    ship(docs.sparkSession)
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, _, _, cls in _sets(batch.column(text_at)):
                columns = batch.slice(at, to - at).columns
                yield pa.RecordBatch.from_arrays([*columns, pa.array(_keys(cls), pa.binary())], names=[*batch.schema.names, name])

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names may hold any character
    return plain.mapInArrow(run, StructType([*plain.schema.fields, StructField(name, BinaryType())])).toDF(*docs.columns, name)


def link_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, key, n_links`` of every row: n_links other rows have a set that links with its own, copies counted each. Empty sets have none."""
    links = saved(ngram_jaccard_join(docs, id_col, text_col, pairs=True))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    held = saved(with_key(rows, "key").withColumn("empty", F.coalesce(F.col("text"), F.lit("")).rlike(r"^[ \t\n\x0B\f\r]*\z")).drop("text"))
    copies = saved(held.filter("not empty").groupBy("key").agg(F.count("*").alias("copies")))
    ends = links.select(F.col("a").alias("key"), F.col("b").alias("other")).union(links.select("b", "a"))
    more = ends.join(copies.withColumnRenamed("key", "other"), "other").groupBy("key").agg(F.sum("copies").alias("others"))
    total = copies.join(more, "key", "left").select("key", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return held.join(small_or_shuffled(total), "key", "left").select("id", "key", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
