"""The training-data operators against SQL, brute force, round trips and held-out accuracy."""

import collections
import hashlib
import itertools
import math
import random
import struct
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
from oracle import same
from pyspark.sql import functions as F

from joinwright.llm import context_mixing, inner_products, ngram_join, packing, quality, registry, toxicity, warc, words
from joinwright.llm.components import components
from joinwright.llm.exact_dedup import exact_dedup
from joinwright.llm.mixing import mix_sources, mixed_documents
from joinwright.llm.ngram_join import _needed, link_counts, list_pairs, ngram_jaccard_join
from joinwright.llm.tokens import default_path, token_counts

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{i % 97}x{i}" for i in range(30_000))
EDGES = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, " \t\n ", None, None, 4),
    (4, "one two", "en", "b", 7),
    (5, "one two  One", "en", None, 3),
    (6, "One TWO", "en", "b", 7),
    (7, "one two", "de", "c", None),
    (7, "one two", "de", "c", None),
    (8, LONG, "en", "a", 1),
    (9, LONG + " tail", "en", "d", 1),
    (10, "<|endoftext|> x<|ENDOFTEXT|>'s and, ok" + "z" * 5000, "en", "e", 1),
    (None, "no id at all in this row", "en", "e", 1),
]


@pytest.fixture(scope="module")
def edges(spark):
    # extra columns with names that operators use inside
    return spark.createDataFrame(EDGES, DOC).withColumn("id", F.lit("x")).withColumn("row", F.lit(1)).withColumn("size", F.lit(2)).withColumn("cls", F.lit(3))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def texts(spark, folder):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(docs):
    sets = [(d, shingle_set(t)) for d, t in docs]
    up = list(range(len(sets)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, _) in enumerate(sets):
        least[top(i)] = min(least.get(top(i), math.inf), math.inf if d is None else d)
    return [(d, len(s), d if not s else None if least[top(i)] == math.inf else least[top(i)]) for i, (d, s) in enumerate(sets)]


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, name):
    same(registry.QUERIES[name](spark, SF), registry.SQL[name], SF)


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))


# --- n-gram join ---------------------------------------------------------------------------------
def test_ngram_join_against_brute_force(spark):
    got = registry.QUERIES["op1_ngram_jaccard_join"](spark, SMALL)
    want = brute_components(sorted(texts(spark, SMALL).items()))
    assert sorted(map(tuple, got.collect())) == want


def test_ngram_join_long_lists(spark):
    """Lists beyond LIST: a group around one base whose members barely resemble each other, a chain, copies, and strangers that share a passage."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base, passage = [word() for _ in range(120)], [word() for _ in range(30)]
    docs = [" ".join(base)]
    for _ in range(60):
        w = list(base)
        for i in rng.sample(range(120), rng.choice((1, 2, 3, 4))):
            w[i] = word()
        docs.append(" ".join(w))
    docs += [" ".join([word() for _ in range(20)] + passage) for _ in range(40)]
    chain = [word() for _ in range(60)]
    for k in range(20):
        chain = [*chain[3:], *(word() for _ in range(3))]
        docs.append(" ".join(chain))
    docs += [docs[3]] * 5
    rng.shuffle(docs)
    rows = list(enumerate(docs))
    got = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, got.select("id", "n_shingles", "component_id").collect())) == brute_components(rows)


def test_ngram_links_are_whole(spark):
    """All links, also among classes that others connect, in a long list; counts go by copies."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(100)]
    docs = [" ".join(base)]
    for _ in range(40):
        w = list(base)
        for i in rng.sample(range(100), rng.choice((1, 2))):
            w[i] = word()
        docs.append(" ".join(w))
    docs += [docs[3]] * 4 + [None, " \t", "lone words only here now"]
    rows = list(enumerate(docs))
    sets = [shingle_set(t) for t in docs]
    linked = lambda a, b: bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.id: (bytes(r.key), r.n_links) for r in link_counts(df).collect()}
    assert {i: n for i, (_, n) in got.items()} == {i: sum(linked(s, t) for j, t in enumerate(sets) if j != i) for i, s in enumerate(sets)}
    want = {frozenset((got[i][0], got[j][0])) for i in range(len(docs)) for j in range(i) if linked(sets[i], sets[j]) and sets[i] != sets[j]}
    found = [frozenset((bytes(r.a), bytes(r.b))) for r in ngram_jaccard_join(df, pairs=True).collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_ngram_join_edges(edges, none):
    got = [tuple(r) for r in ngram_jaccard_join(edges).select("id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=repr) == sorted(brute_components([(r[0], r[1]) for r in EDGES]), key=repr)
    assert ngram_jaccard_join(none).count() == 0


def test_block_skips_lose_no_pair():
    from joinwright.llm.ngram_join import ENTRY

    rng = np.random.default_rng(2)
    e = np.zeros(400, ENTRY)
    e["token"], e["cls"], e["size"] = np.repeat(np.arange(40), 10), rng.integers(0, 60, 400), rng.integers(5, 60, 400)
    e["size"] = e["cls"] % 30 + 10
    e["pos"] = rng.integers(0, 10, 400) % e["size"]
    e = e[np.lexsort((e["cls"], e["pos"], e["token"]))]
    want = set()
    for i in range(400):
        for j in range(i):
            x, y = e[i], e[j]
            if x["token"] == y["token"] and x["cls"] != y["cls"]:
                s, t = int(x["size"]), int(y["size"])
                if 4 * min(s, t) >= 3 * max(s, t) and 1 + min(s - 1 - int(x["pos"]), t - 1 - int(y["pos"])) >= _needed(s, t):
                    want.add((min(x["cls"], y["cls"]), max(x["cls"], y["cls"])))
    assert set(map(tuple, list_pairs(e)[0].tolist())) == {(int(a), int(b)) for a, b in want}


def test_blocks_of_long_lists_lose_no_pair(spark):
    rng = random.Random(8)
    rows = sorted({(t, f"c{c:02d}".encode(), 20 + 7 * c % 60, rng.randrange(0, 8), f"p{c % 9}".encode()) for t in range(5) for c in rng.sample(range(90), 60)})
    got = {(bytes(r.a), bytes(r.b)): r.w for r in ngram_join.met(spark.createDataFrame(rows, "token bigint, key binary, size bigint, pos bigint, part binary")).collect()}
    want = collections.Counter()
    for t, k, n, i, p in rows:
        for u, q, m, j, o in rows:
            if t == u and k < q and p != o and 1 + min(n - 1 - i, m - 1 - j) >= _needed(n, m):
                want[k, q] += 1
    assert got == want and len(want) > 100


def test_ngram_join_of_a_line_in_thousands(spark):
    """A line that thousands of otherwise unrelated documents share makes no pairs of them all; documents that are mostly that line do meet."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    line = " ".join(word() for _ in range(40))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(30, 50))) + " " + line) for i in range(3000)]
    rows += [(3000 + i, " ".join(word() for _ in range(2 + i % 3)) + " " + line) for i in range(60)]
    got = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, got.select("id", "n_shingles", "component_id").filter("id >= 2900").collect())) == brute_components(rows[2900:])
    assert got.filter("id < 2900 and id <> component_id").count() == 0


def thue_morse(n, one, two):
    return "".join((one, two)[i.bit_count() & 1] for i in range(n))


WOVEN = [thue_morse(n, *x) for n in (512, 1024, 2048, 4096) for one, two in ("th", "zs", "ab", "éö") for x in ((one, two), (two, one))]


def test_woven_words_are_told_apart(spark):
    """Words that collide under every polynomial hash modulo 2^64."""
    rows = [(i, f"{w} {w[::-1]} the end of it") for i, w in enumerate(WOVEN)]
    got = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, got.select("id", "n_shingles", "component_id").collect())) == brute_components(rows)
    assert len({bytes(r.key) for r in got.collect()}) == len(rows)


def test_tokens_of_woven_words(spark, library):
    """Woven words, with cases mixed, in one block: counts and ids are the library's for each."""
    words = [w for x in WOVEN for w in (x, x.upper(), x + "!")]
    df = spark.createDataFrame(list(enumerate(words)), "doc_id bigint, text string").coalesce(1)
    want = library_ids(library, words)
    assert [r.n_tokens for r in token_counts(df).orderBy("id").collect()] == [len(x) for x in want]
    pieces = collections.defaultdict(list)
    for r in packing.pack(df, with_ids=True).collect():
        pieces[r.id].append((r.start, list(r.ids)))
    assert {k: [x for _, v in sorted(p) for x in v] for k, p in pieces.items()} == {k: [*x, 2] for k, x in enumerate(want)}


def test_halves_of_the_cache(library, monkeypatch):
    """Pieces are found, taken over or encoded anew, whatever has gone before."""
    from joinwright.llm import tokens

    monkeypatch.setattr(tokens, "CACHE", 50)
    own, rng = tokens.Encoder(default_path()), random.Random(1)
    names = [f"piece{i}of{i * 7}" for i in range(200)]
    for _ in range(60):
        some = rng.sample(names, rng.randrange(1, 80))
        at = own.places([x.encode() for x in some])
        got = [own.young.ids[s : s + n].tolist() for s, n in zip(own.young.start[at], own.young.length[at], strict=True)]
        assert got == library_ids(library, some)


def test_words_that_share_a_hash_are_compared():
    from joinwright.llm.words import Words, distinct_spans

    data = np.frombuffer(b"onetwoone" + b"x" * 700 + b"x" * 699 + b"y", "u1")
    w = Words(np.array([0, 3, 6, 9, 709]), np.array([3, 6, 9, 709, 1409]), np.zeros(5, "i8"), np.zeros(5, "u8"))
    first, place = distinct_spans(w, data)
    assert sorted(first) == [0, 1, 3, 4] and place[0] == place[2] and len(set(place.tolist())) == 4


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 101), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 1 for i in range(2, 41)} | {101: 100, 103: 100}


# --- mixing --------------------------------------------------------------------------------------
def test_mixing_targets_and_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = mix_sources(docs).select("source", "size", "source_size", "target", "copies").collect()
    assert max(r.copies for r in rows) <= 3
    taken, target, have = collections.Counter(), {}, {}
    for r in rows:
        taken[r.source] += r.copies * r.size
        target[r.source], have[r.source] = r.target, r.source_size
    assert math.isclose(sum(target.values()), sum(have.values()), rel_tol=1e-9)
    assert all(t <= 3 * have[s] * (1 + 1e-12) for s, t in target.items())
    assert all(abs(taken[s] - t) < 0.12 * t for s, t in target.items())


def test_mixing_edges(edges, none):
    rows = mix_sources(edges).collect()
    assert len(rows) == len(EDGES) and {r.id: r.size for r in rows}[1] == 0
    mixed = mixed_documents(edges)
    assert mixed.columns == edges.columns
    assert mixed.count() == sum(r.copies for r in rows)
    assert mix_sources(none).count() == 0 and mixed_documents(none).count() == 0


# --- tokens and packing --------------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def library_ids(library, values):
    return [e.ids for e in library.encode_batch([v or "" for v in values], add_special_tokens=False)]


def test_token_counts(spark, library):
    docs = texts(spark, SMALL)
    ids = dict(zip(docs, library_ids(library, docs.values()), strict=True))
    for r in registry.QUERIES["op4_token_counts"](spark, SMALL).collect():
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((docs[r.doc_id] or "").encode()), len(ids[r.doc_id]), len(ids[r.doc_id]) > 2048)


def test_token_counts_of_odd_texts(spark, library, edges, none):
    rng = random.Random(9)
    pool = [*"abXY'’.,!|<>=&%0129 \t\n 　̸́éÉßİΣσﬁ½٣日\U0001f600\x1c\x85‍", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "don't", "THE"]
    odd = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(odd)), "doc_id bigint, text string")
    got = {r.id: r.n_tokens for r in token_counts(rows).collect()}
    assert [got[i] for i in range(len(odd))] == [len(x) for x in library_ids(library, odd)]
    assert sorted(r.n_tokens for r in token_counts(edges).collect()) == sorted(len(x) for x in library_ids(library, [r[1] for r in EDGES]))
    assert token_counts(none).count() == 0


def check_packing(rows, docs, library, window=4096):
    ids = {d: i + [2] for d, i in zip(docs, library_ids(library, docs.values()), strict=True)}
    spans, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert (len(part), r.doc_tokens) == (r.length, len(ids[r.doc_id]))
        assert zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r.ids_crc32
        spans[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces, whole in [*((s, len(ids[d])) for d, s in spans.items()), *((s, None) for s in sequences.values())]:
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == whole or whole is None and at <= window
    assert set(spans) == set(ids)
    return sum(len(i) for i in ids.values()), len(sequences)


def test_packing(spark, library):
    total, sequences = check_packing(registry.QUERIES["op8_packing"](spark, SF).collect(), texts(spark, SF), library)
    assert sequences * 4096 < total * 1.01


def test_packing_edges(spark, library, edges, none):
    unique = edges.filter("doc_id is not null and doc_id <> 7")
    docs = {r[0]: r[1] for r in EDGES if r[0] not in (None, 7)}
    check_packing(packing.pack(unique).withColumnRenamed("id", "doc_id").collect(), docs, library)
    rows = packing.pack(edges, with_ids=True).collect()
    assert sum(r.id == 7 for r in rows) == 2 and sum(r.id is None for r in rows) == 1
    assert all(zlib.crc32(struct.pack(f"<{r.length}I", *r.ids)) == r.ids_crc32 for r in rows)
    assert packing.pack(none).count() == 0


def test_least_slack():
    rng = random.Random(1)
    for _ in range(300):
        counts = {rng.randint(1, 25): rng.randint(1, 3) for _ in range(rng.randint(0, 6))}
        capacity = rng.randint(0, 60)
        sums = {0}
        for size, n in counts.items():
            sums = {s + size * k for s in sums for k in range(n + 1)}
        taken = packing.fill(counts, capacity)
        assert all(n <= counts[k] for k, n in taken.items())
        assert sum(k * n for k, n in taken.items()) == max(s for s in sums if s <= capacity)
    counts = {rng.randint(1, 50): rng.randint(1, 9) for _ in range(20)}
    used = collections.Counter()
    for times, taken in packing.plan(counts, 50):
        assert sum(k * n for k, n in taken.items()) <= 50
        for k, n in taken.items():
            used[k] += n * times
    assert used == counts


# --- exact dedup ---------------------------------------------------------------------------------
def test_exact_dedup_edges(spark, edges, none):
    got = exact_dedup(edges).collect()
    assert len(got) == len(EDGES)
    by = collections.defaultdict(list)
    for r in got:
        by[r.id].append(r)
    assert [(r.keep_id, r.group_size) for i in (1, 2, 3) for r in by[i]] == [(3, 3)] * 3
    assert [by[i][0].keep_id for i in (4, 5, 6)] == [4, 5, 6]
    assert sorted(r.kept for i in (4, 7) for r in by[i]) == [False, False, True]
    twice = exact_dedup(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b")], "doc_id bigint, text string")).collect()
    assert sum(r.kept for r in twice) == 1 and {r.keep_id for r in twice} == {1}
    assert exact_dedup(none).count() == 0
    plan = exact_dedup(edges)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# --- toxicity and quality ------------------------------------------------------------------------
def accuracy(spark, query, label, folder):
    scored = registry.QUERIES[query](spark, folder).toPandas().merge(spark.read.parquet(f"{folder}/labels.parquet").toPandas(), on="doc_id")
    held = scored[scored.held_out]
    rank, y = held.score.rank(), held[label]
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    return auc, (held.predicted == y).mean(), scored


def test_toxicity_held_out(spark):
    auc, right, scored = accuracy(spark, "op5_toxicity", "toxic", "/root/testdata/sf0.1")
    assert auc > 0.95 and right > 0.97
    assert scored.score.between(0, 1).all()
    want = [zlib.crc32(str(d).encode()) % 4 == 2 for d in scored.doc_id]
    assert list(scored.held_out) == want


def test_quality_held_out(spark):
    auc, right, scored = accuracy(spark, "op9_quality", "quality", "/root/testdata/sf0.1")
    assert auc > 0.99 and right > 0.97
    assert list(scored.held_out) == [zlib.crc32(str(d).encode()) % 3 == 1 for d in scored.doc_id]


def brute_terms(text):
    """Terms by plain loops: runs of letters, digits and non-ASCII bytes, and the beginnings of longer ones."""
    clean = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in (text or "").encode())
    words = clean.split()
    return collections.Counter([(0, w) for w in words] + [(n, w[:n]) for n in toxicity.BEGINNINGS for w in words if len(w) > n])


def test_toxicity_against_brute_force(spark, monkeypatch):
    """Scores, neighbours and calibration by dense vectors over all terms of all examples; blocks small enough to be skipped."""
    monkeypatch.setattr(toxicity, "BLOCK_EXAMPLES", 16)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    text = texts(spark, SMALL)
    y = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.toxic is not None and r.doc_id in text}
    of = {}
    for d in sorted(y):
        of.setdefault((text[d] or "", y[d]), d)
    ids = sorted(of.values())
    counts = {d: brute_terms(t) for d, t in text.items()}
    df = collections.Counter(t for d in ids for t in counts[d])
    bad = collections.Counter(t for d in ids if y[d] for t in counts[d])
    n, share = len(ids), sum(y[d] for d in ids) / len(ids)

    def weight(t):
        if df[t] < 2:
            return math.log(1 + n)
        e, b, k = df[t] * share, bad[t], df[t]
        g = 2 * ((b * math.log(b / e) if b else 0) + ((k - b) * math.log((k - b) / (k * (1 - share))) if k > b else 0))
        return math.log(1 + n / k) * math.sqrt(1 + (g if b > e else 0))

    def vector(d):
        w = {t: (1 + math.log(c)) * weight(t) for t, c in counts[d].items()}
        size = math.sqrt(sum(x * x for x in w.values())) or 1.0
        return {t: x / size for t, x in w.items() if df[t] >= 2}

    example = {d: vector(d) for d in ids}
    cosines = lambda v, but=None: sorted(((sum(x * example[d].get(t, 0) for t, x in v.items()) if d != but else -9, d) for d in ids), reverse=True)

    def vote(near):
        w = [(1 / (1.05 - min(c, 1)), y[d]) for c, d in near if c > 0]
        return sum(a * b for a, b in w) / sum(a for a, _ in w)

    def settled(near):  # examples as near as the last one make the choice among them arbitrary
        return near[14][0] - near[15][0] > 1e-5

    hits, all_ = np.zeros(10), np.zeros(10)
    for d in ids:
        if (near := cosines(example[d], d))[0][0] > 0:
            step = min(int(vote(near[:15]) * 10), 9)
            hits[step] += y[d]
            all_[step] += 1
    middle = (np.arange(10) + 0.5) / 10
    steps = np.minimum(np.maximum.accumulate((hits + middle) / (all_ + 1)), 1)
    model = toxicity.fit(docs, labels)
    assert len(model.index.terms) == sum(k >= 2 for k in df.values()) and model.index.n == n
    assert np.allclose(model.steps, steps, atol=0.02)
    got = {r.id: r for r in toxicity.score_toxicity(docs, model).collect()}
    checked = 0
    for d in text:
        near = cosines(vector(d))
        if near[0][0] > 0 and settled(near):
            v = vote(near[:15])
            assert abs(got[d].score - (0.99 * np.interp(v, middle, model.steps) + 0.01 * v)) < 1e-3
            assert near[0][0] - near[1][0] < 1e-5 or got[d].evidence[0] == near[0][1]
            checked += 1
    assert checked > 100


def test_terms_of_the_sample_are_bounded(spark, monkeypatch):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    whole = toxicity.fit(docs, labels).index.n
    for bound, fewer in ((3000, True), (1, True), (10**7, False)):
        monkeypatch.setattr(toxicity, "POSTINGS", bound)
        model = toxicity.fit(docs, labels)
        assert (model.index.n < whole) == fewer and len(model.index.value) <= bound
        assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(docs, model).collect())


def test_blocks_out_of_reach_are_not_read():
    rng = np.random.default_rng(3)
    n = 640
    term = [np.unique(rng.choice(50, 6)) + 50 * (i // 64) for i in range(n)]
    begin = np.concatenate([[0], np.cumsum([len(t) for t in term])])
    index = toxicity.Index(np.arange(n), np.arange(n) % 2, begin, np.concatenate(term).astype("u8"), np.ones(begin[-1]))
    dense = np.zeros((n, len(index.terms)))
    doc, place, w = index.vectors(np.repeat(np.arange(n), np.diff(begin)), np.concatenate(term).astype("u8"), np.ones(begin[-1]), n)
    dense[doc, place] = w
    found, score = index.nearest(doc, place, w, n)
    want = -np.sort(-(dense @ dense.T), axis=1)[:, :15]
    assert np.allclose(np.maximum(score, 0), want, atol=1e-5) and index.read < 0.4 * index.looked


def test_quality_against_brute_force(spark):
    """Features by plain loops, an exact decomposition, cosines and votes one by one."""
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    text = texts(spark, SMALL)
    model = quality.fit(docs, labels)
    got = {r.id: r.score for r in quality.quality(docs, labels).collect()}

    def counted(t):
        x = np.zeros(quality.FEATURES)
        data = (t or "").encode()
        s = [int(quality._SHAPE[c]) for c in data]
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            x[quality._CODE[(a << 14) | (b << 7) | c]] += 1
        for w in data.split():
            part = np.frombuffer(w, "u1")
            x[quality.SHAPES + int(words.hash_spans(part, np.array([0]), np.array([len(w)]), fold=True)[0] % np.uint64(quality.WORDS))] += 1
        return x

    raw = {d: counted(t) for d, t in text.items()}
    y = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.quality is not None and r.doc_id in text}
    of = {}
    for d in sorted(y):
        of.setdefault((text[d] or "", y[d]), d)
    ids = sorted(of.values())
    x = np.array([raw[d] for d in ids])
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 0.1

    def unit(v):
        return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)

    x = unit(np.log1p(x) * idf)
    top = np.linalg.svd(x, full_matrices=False)
    d = model.basis.shape[1]
    assert np.linalg.norm(x @ model.basis) ** 2 > 0.995 * (top[1][:d] ** 2).sum()  # it spans what the exact one does
    z = unit(x @ model.basis)
    for k, t in text.items():
        if not (t or "").split():
            assert math.isclose(got[k], np.mean([y[i] for i in ids]), rel_tol=1e-5)
            continue
        c = z @ unit(np.log1p(raw[k]) * idf @ model.basis)
        near = np.argsort(-c, kind="stable")[: quality.NEIGHBOURS + 1]
        if c[near[-2]] - c[near[-1]] < 1e-6:
            continue
        w = 1 / (1.02 - np.clip(c[near[:-1]], 0, 1))
        prior = np.mean([y[i] for i in ids])
        assert abs(got[k] - ((w * [y[ids[i]] for i in near[:-1]]).sum() + prior) / (w.sum() + 1)) < 2e-3


def test_quality_tells_words_of_equal_shape_apart():
    one, two = (np.frombuffer(t, "u1") for t in (b"good words all over", b"evil crimp out luck"))
    a, b = (quality.features(t, np.array([0, len(t)]))[0] for t in (one, two))
    assert (a[: quality.SHAPES] == b[: quality.SHAPES]).all() and (a != b).any()


def test_label_edges(spark, edges, none):
    nothing = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    some = spark.createDataFrame([(4, 1, 0), (4, None, 1), (6, 0, 1), (None, 1, 1), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    for labels in (nothing, some):
        for f in (toxicity.toxicity, quality.quality):
            rows = f(edges, labels).collect()
            assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)
            assert f(none, labels).count() == 0


# --- language model ------------------------------------------------------------------------------
def test_language_model(spark):
    rows = registry.QUERIES["op3_lm_scoring"](spark, SMALL).collect()
    words = {d: [*(t or "").encode().lower().split(), None] for d, t in texts(spark, SMALL).items()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in words}
    counts = collections.Counter(w for d, ws in words.items() if not held[d] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        ws = words[r.doc_id]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    again = registry.QUERIES["op3_lm_scoring"](spark, SMALL).collect()
    assert {r.doc_id: round(r.score, 6) for r in rows} == {r.doc_id: round(r.score, 6) for r in again}


def test_spellings_add_up():
    """The bits of a byte are a distribution over bytes, whatever the weights."""
    tables = [np.random.default_rng(1).integers(0, 50, (1 << b, 2)).astype("u2") for b in context_mixing.SLOTS]
    mixer = context_mixing.Mixer(tables)
    e = np.zeros(256, context_mixing.TOKEN)
    e["length"] = 1
    total = np.zeros(256)
    for token, gate, bit, slots in context_mixing.events(e, np.arange(256, dtype="u1")):
        x, way = mixer.inputs(slots, bit, None)
        p = mixer.refined(mixer.mixed(x, way), gate)
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        total += np.log(np.where(bit == 1, p, 1 - p))[first]
    assert math.isclose(np.exp(total).sum(), 1, rel_tol=1e-6)


def test_contexts_do_not_collide():
    """However many contexts there are, each has its own node and counts."""
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(5, 12))).encode() for _ in range(60_000)})
    e = np.zeros(len(words), context_mixing.TOKEN)
    e["length"], e["train"] = [len(w) for w in words], np.arange(len(words)) % 3 > 0
    text = np.frombuffer(b"".join(words), "u1")
    _, _, contexts = context_mixing.spell(e, text)
    for _, gate, _, nodes in context_mixing.events(e, text):
        for k in range(context_mixing.PREDICTORS):
            assert len(np.unique(nodes[k])) == len(np.unique((contexts[k] & ~np.uint64(255)) | gate.astype("u8")))


def test_context_counts_are_of_the_whole_corpus(spark):
    """Each bucket of words gets, for the words so far that its words have, the counts of all training words."""
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))).encode() for _ in range(400)})
    rows = []
    for b in range(4):
        mine = words[b::4]
        e = np.zeros(len(mine), context_mixing.TOKEN)
        e["length"], e["train"] = [len(w) for w in mine], [zlib.crc32(w) % 4 for w in mine]
        rows.append((b, bytearray(e.tobytes()), bytearray(b"".join(mine))))
    want = collections.Counter((w[:i], (w + b" ")[i]) for w in words if zlib.crc32(w) % 4 for i in range(len(w) + 1))
    for r in context_mixing.with_contexts(spark.createDataFrame(rows, "bucket bigint, fixed binary, spelled binary"), 5).collect():
        e, text = np.frombuffer(r.fixed, context_mixing.TOKEN), np.frombuffer(r.spelled, "u1")
        assert len(e) == len(words[r.bucket :: 4])
        known = np.frombuffer(r.follows, context_mixing.FOLLOWS)
        _, _, key = context_mixing.follows(e[context_mixing.needs_spelling(e)], text)
        spots = [(w[:i], (w + b" ")[i]) for w, use in zip(words[r.bucket :: 4], context_mixing.needs_spelling(e), strict=True) if use for i in range(len(w) + 1)]
        assert known["n"][np.searchsorted(known["key"], key[-1])].tolist() == [want[s] for s in spots]


def test_spelling_learns_from_every_word_that_training_has_once(spark, monkeypatch):
    cm = context_mixing
    words = sorted({f"w{i * 7919 % 1000:03}{'x' * (i % 5)}".encode() for i in range(400)})
    e = np.zeros(len(words), cm.TOKEN)
    e["key"], e["length"] = cm.mix(np.arange(len(words), dtype="u8")), [len(w) for w in words]
    e["train"] = e["all"] = np.arange(len(words)) % 4
    e["all"] += 1
    once = sum(len(w) + 1 for w in itertools.islice(words, 1, None, 4))
    rows = [(k, e[k::3].tobytes(), b"".join(words[k::3])) for k in range(3)]
    ready = cm.with_contexts(spark.createDataFrame(rows, "bucket bigint, fixed binary, spelled binary"), 3)
    mixer = cm.fit(ready)
    assert mixer.seen.sum() - cm.Mixer([]).seen.sum() == 8 * once
    # every bucket sends as many candidates as the table of frequent tokens may hold
    monkeypatch.setattr(cm, "FREQUENT", 16)
    shares = cm.Shares(int(e["train"].sum()), int((e["train"] > 0).sum()), [int((e["train"] == k).sum()) for k in range(1, 5)])
    sent = pa.Table.from_batches(list(cm._valued(types.SimpleNamespace(value=mixer), shares)(iter(ready.toArrow().to_batches()))))
    assert all(len(x) == 16 * cm.VALUE.itemsize for x in sent.column("top").to_pylist())


def test_spelling_sums_bits_that_are_alike_once(spark):
    """Words that begin alike give the same sums as bit by bit, and contexts travel and lie in fewer bytes than as records."""
    cm = context_mixing
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))).encode() for _ in range(3000)})
    e = np.zeros(len(words), cm.TOKEN)
    e["key"], e["length"], e["train"] = cm.mix(np.arange(len(words), dtype="u8")), [len(w) for w in words], [rng.choice((0, 1, 1, 2)) for _ in words]
    table = spark.createDataFrame([(k, e[k::3].tobytes(), b"".join(words[k::3])) for k in range(3)], "bucket bigint, fixed binary, spelled binary")
    plain = {r.bucket: r for r in cm.with_contexts(table, 3).collect()}
    packed = cm.with_contexts(table, 3, name="dense")
    mixer = types.SimpleNamespace(value=cm.Mixer([]))
    slopes, places = np.zeros((cm.GATES, 43)), np.zeros((2, 256, 33))
    for batch in packed.toArrow().to_batches():
        for bucket, _, spelled, text, known in cm._bucket_rows(iter([batch])):
            raw = plain[bucket].follows
            assert known.tobytes() == raw and len(cm.dense(known)) < 0.6 * len(raw)
            for _, part, chars, index in cm._indexed(*cm.only(spelled["train"] == 1, spelled, text), known):
                own, bits = cm.Mixer([index.table] * cm.PREDICTORS), 0
                for _, node, bit, slots in cm.events(part, chars, index):
                    x, gate = own.inputs(slots, bit, 1)
                    one = np.ones(len(bit))
                    slopes += own.slopes(x, gate, bit, one)
                    places += own.places(x, gate, node, bit, one)
                    bits += len(bit)
                assert sum(len(bit) for _, _, bit, _ in cm.alike(part, chars, index)) < 0.8 * bits
    for want, last in ((slopes, False), (places, True)):
        got = sum(np.frombuffer(r.sums) for r in packed.mapInArrow(cm._training_sums(mixer, last), "sums binary").collect())
        assert np.allclose(got, want.ravel(), rtol=1e-9, atol=1e-6)
    for r in (e, e[:1], e[:0], e["key"].copy()):
        assert cm.records(cm.dense(r), r.dtype).tobytes() == r.tobytes()


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    """One mixer learns from all training words, however they are dealt to buckets."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = []
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("4", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            monkeypatch.setattr(context_mixing, "bucket_count", lambda df, size, n=n: int(n) + 1)
            found.append({r.id: r.score for r in context_mixing.score_documents(docs).select("id", "score").collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert all(math.isclose(x, found[1][i], rel_tol=1e-7) for i, x in found[0].items())


def test_context_model_against_brute_force(spark):
    """Contexts of words, their states, sums and scores by plain loops; every held-out word is known, so that none is spelled."""
    cm = context_mixing
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    phrases = [[rng.choice(vocabulary) for _ in range(25)] for _ in range(6)]
    rows = [(0 if not i else i, " ".join(vocabulary)) for i in (1, 2)]
    for i in range(3, 90):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 30))]
        for _ in range(rng.randrange(0, 3)):
            p = list(rng.choice(phrases))
            p[rng.randrange(25)] = rng.choice(vocabulary)
            words += p
        rows.append((i, " ".join(words)))
    rows += [(200 + k, rows[10 + k][1]) for k in range(5)]
    train = {d: zlib.crc32(str(d).encode()) % 10 != 0 for d, _ in rows}
    assert train[1] or train[2]
    doc = {}
    for d, t in rows:
        data = np.frombuffer(t.encode(), "u1")
        doc[d] = cm.tokens(data, np.array([0, len(data)])).hash
    short = {d: cm.short(k).tolist() for d, k in doc.items()}
    runs = {d: [(int(a), int(n)) for _, a, _, n in zip(*cm.anchors(k, np.array([0, len(k)])), strict=True)] for d, k in doc.items()}
    sums, events, shares, count = np.zeros((cm.STATES, 2)), {}, {}, collections.Counter(int(x) for d, k in doc.items() if train[d] for x in k)
    times = [sum(c == k for c in count.values()) for k in (1, 2, 3, 4)]
    share = cm.Shares(sum(count.values()), len(count), times)
    for d, keys in doc.items():
        corpus = [(0, 0)] * len(keys)
        for at, n in runs[d]:
            context = keys[at - 3 : at + 1].tolist()
            for t in range(n):
                all_, own = collections.Counter(), collections.Counter()
                for e in doc:
                    for b, m in runs[e]:
                        if train[e] and m > t and doc[e][b - 3 : b + 1].tolist() == context and short[e][b + 1 : b + 1 + t] == short[d][at + 1 : at + 1 + t]:
                            all_[short[e][b + 1 + t]] += 1
                            own[short[e][b + 1 + t]] += e == d
                top = sorted(all_, key=lambda w: (-all_[w], w))[:2]
                left = sum(all_.values()) - sum(own.values())
                best = min(top, key=lambda w: (own[w] - all_[w], w), default=None)
                if left and all_[best] > own[best]:
                    part = (all_[best] - own[best]) / left
                    corpus[at + 1 + t] = (1 + 3 * min(int(math.log2(left)), 4) + (part > 0.5) + (part > 0.95), best)
        found, total, k = [], 0.0, keys.tolist()
        for i in range(len(k)):
            how, guess = corpus[i]
            state = how
            for width in (2, 1):
                spots = [j for j in range(width, i) if k[j - width : j] == k[i - width : i]] if i >= width else []
                says, way = 0, 0
                if spots:
                    says = short[d][spots[-1]]
                    way = 1 if len(spots) < 2 else 2 if k[spots[-1]] == k[spots[-2]] else 3
                    guess = guess or says
                state = state * cm.OWN + (0 if not says else way if says == guess else way + 3)
            came = bool(guess) and guess == short[d][i]
            if state:
                found.append((state, int(came)))
                sums[state, int(came)] += train[d]
            total += 0 if came else float(share.known(np.array([count[k[i]]]))[0])
        events[d], shares[d] = found, total
    p = cm.fit_states(sums)
    want = {d: shares[d] + sum(math.log10(p[s] if y else 1 - p[s]) for s, y in events[d]) for d in doc}
    assert sum(len(x) for x in events.values()) > 500 and sum(s >= cm.OWN * cm.OWN for x in events.values() for s, _ in x) > 300
    got = {r.id: r.score for r in cm.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[d], want[d], rel_tol=1e-5) for d in want)


def test_order_of_words_and_repetition_count(spark):
    """Held-out texts score above the base; of a corpus' own texts, those that occur twice above the others, and shuffled words below."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rng = random.Random(2)
    some = [r for r in docs.orderBy("doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 10 == 0 and len((r.text or "").split()) > 50][:40]

    def shuffled(t):
        w = t.split()
        rng.shuffle(w)
        return " ".join(w)

    other = [i for i in range(10**6, 10**6 + 5000) if zlib.crc32(str(i).encode()) % 10 == 0][: len(some)]
    more = spark.createDataFrame([(i, shuffled(r.text)) for i, r in zip(other, some, strict=True)], "doc_id bigint, text string")
    rows = {r.id: r for r in context_mixing.score_documents(docs.union(more)).collect()}
    assert sum(rows[i].score for i in other) < sum(rows[r.doc_id].score for r in some)
    held = [r for r in rows.values() if r.held_out and r.id < 10**6]
    assert sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held)


def test_language_model_edges(edges, none):
    rows = context_mixing.score_documents(edges).collect()
    assert len(rows) == len(EDGES) and all(math.isfinite(r.score) for r in rows)
    assert {r.id: r.n_tokens for r in rows}[1] == 1
    assert context_mixing.score_documents(none).count() == 0


# --- WARC ----------------------------------------------------------------------------------------
def test_warc_round_trip(spark, tmp_path):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    archives = warc.write_archives(pages)
    warc.save_files(archives, str(tmp_path / "w"))
    got = warc.read_archives(spark.read.format("binaryFile").load(str(tmp_path / "w")), with_payload=True).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in got} == {r.page_id: r.html for r in pages.collect()}


def test_warc_revisits_and_edges(spark):
    big = "x" * 1000
    rows = [(1, "u", big), (2, None, big), (3, "a\r\nb: c", big), (4, "u", "y" * 999), (5, "u", "y" * 999), (6, "u", None), (None, "u", big), (3, "u", big), (7, "u", "\r\n\r\n" + big)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("size", F.lit(1))
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()), key=repr)
    want = [(1, 1000, "revisit", 3), (2, 1000, "revisit", 3), (3, 1000, "response", None), (3, 1000, "response", None), (4, 999, "response", None), (5, 999, "response", None), (6, 0, "response", None), (7, 1004, "response", None), (None, 1000, "revisit", 3)]
    assert got == sorted(want, key=repr)
    assert all(r.payload_digest == hashlib.sha1(b"").hexdigest() for r in warc.round_trip(df.filter("page_id = 6")).collect())
    assert warc.round_trip(df.filter("page_id = 100")).count() == 0


def test_warc_reader_rejects_damage():
    good = warc.record(1, "u", b"hello" * 500) + warc.record(2, "v", b"")
    assert [r.page_id for r in warc.read_archive(good)] == [1, 2]
    raw = b"".join(next(iter(warc.members(memoryview(good)))))
    packed = lambda b: (lambda z: z.compress(bytes(b)) + z.flush())(zlib.compressobj(6, zlib.DEFLATED, 31))
    for bad in (good[:-5], packed(raw.replace(b"hello", b"hellO", 1)), packed(raw + b"x"), packed(raw.replace(b"WARC/1.1", b"WARC/9.9")), good[:40] + b"\0\0\0" + good[43:]):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(bad))
    big = packed(raw.split(b"\r\n\r\n", 1)[0] + b"\r\n\r\n" + b"\0" * (64 << 20))  # far more than it states: not read to its end
    with pytest.raises(warc.WarcError, match="frame"):
        list(warc.read_archive(big))
    bare = b"\r\n".join(x for x in raw.split(b"\r\n") if not x.startswith(b"WARC-Payload-Digest"))
    assert [r.payload_sha1 for r in warc.read_archive(packed(bare))] == [hashlib.sha1(b"hello" * 500).hexdigest()]


def test_warc_revisits_are_held_against_their_response(spark):
    good = warc.record(1, "u", b"x" * 2000)
    row = lambda data: spark.createDataFrame([("a", bytearray(data))], "path string, content binary")
    records = lambda data: warc.resolved(warc.read_archives(row(data))).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in records(good + warc.EMPTY + warc.record(2, "u", b"x" * 2000, 1))) == [(1, 2000), (2, 2000)]
    for other in (warc.record(2, "u", b"y" * 2000, 1), warc.record(2, "u", b"x" * 2000, 7)):
        with pytest.raises(Exception, match="isn't there"):
            records(good + other)


def test_shared_folder(monkeypatch):
    """The cluster's folder where it names one; without, never a machine's own folder on a cluster."""
    from types import SimpleNamespace

    from joinwright.llm.storage import shared_folder

    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    session = lambda master, **conf: SimpleNamespace(conf=Conf({"spark.sql.warehouse.dir": "hdfs://warehouse/", **conf}), sparkContext=SimpleNamespace(master=master))
    assert shared_folder(session("yarn", **{"spark.checkpoint.dir": "s3://there/"})) == "s3://there"
    assert shared_folder(session("local-cluster[2,1,1024]")) == shared_folder(session("spark://host:1")) == "hdfs://warehouse/joinwright-tables"
    assert shared_folder(session("local[4]")).startswith("file:///")


def test_groups_beyond_a_broadcast(spark, monkeypatch):
    from joinwright.llm import storage

    rows = spark.createDataFrame([(k, i) for i in range(200) for k in [["hot", f"k{i % 30}", None][i % 3]]], "key string, v bigint")
    groups = storage.saved(rows.filter("key is not null").groupBy("key").agg(F.count("*").alias("n")))
    want = sorted(map(tuple, storage.join_groups(rows, groups, "key", 200).select("key", "v", "n").collect()), key=repr)
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(storage, "GROUPS", 10)
    assert sorted(map(tuple, storage.join_groups(rows, groups, "key", 200).select("key", "v", "n").collect()), key=repr) == want and len(want) == 200


# --- inner products ------------------------------------------------------------------------------
def test_inner_products_edges(spark, monkeypatch):
    monkeypatch.setattr(inner_products, "QUERIES", 3)  # several passes
    monkeypatch.setattr(inner_products, "LEADERS", 5)
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(6)]) for i in range(200)]
    rows += [(500, None), (501, [1.0, None]), (502, [float("nan")]), (503, [float("inf")]), (None, [1.0] * 6), (20, [1.0] * 6), (504, [1.0] * 3), (505, []), (506, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = inner_products.top_inner_products(df).collect()
    live = [(k, i, [math.floor(64 * x) for x in v]) for k, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for k, q, v in live:
        if q is not None and q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), math.inf if c is None else c, j) for j, c, w in live if j != k)  # noqa: B905
            want += [(q, r, None if c == math.inf else c, -s) for r, (s, c, _) in enumerate(scored[:20], 1)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert inner_products.top_inner_products(df.filter("vec_id > 1000")).count() == 0


def test_inner_products_beyond_doubles(spark):
    rows = [(0, [2.0**44 + 1, 1.0]), (1, [2.0**3, 3.0]), (2, [2.0**3, 4.0])]
    got = inner_products.top_inner_products(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(2, 4096 * ((2**44 + 1) * 8 + 4)), (1, 4096 * ((2**44 + 1) * 8 + 3))]


def brute_products(rows, k=20):
    low, high = -(1 << 63), (1 << 63) - 1
    top = int(np.finfo("f8").max)
    whole = lambda x: min(max(math.floor(64 * x) if abs(x) < 1e300 else math.copysign(top, x), -top), top)
    live = [(i, [int(whole(x)) for x in v]) for i, v in rows]
    out = []
    for n, (q, v) in enumerate(live):
        if q % 20 == 0:
            scored = sorted((-min(max(sum(a * b for a, b in zip(v, w, strict=True)), low), high), c) for j, (c, w) in enumerate(live) if j != n)
            out += [(q, r, c, -s) for r, (s, c) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_inner_products_ties_huge_values_and_clashing_names(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(8)]) for i in range(400)]  # few different scores: many ties
    rows += [(500, [1e160] + [0.0] * 7), (520, [-1e160] * 8), (540, [1e307] * 8), (541, [-1e307] + [1.0] * 7), (560, [0.0] * 8), (580, [1e-300] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for name in ("id", "v", "row", "norm", "part", "query_id", "score", "rank"):
        df = df.withColumn(name, F.lit("x"))
    assert sorted(map(tuple, inner_products.top_inner_products(df).collect())) == brute_products(rows)


def test_bounds_drop_most_pairs(spark):
    """The bounds leave few pairs of the given vectors, none of them among the results."""
    got = spark.read.parquet(f"{SF.replace('0.01', '0.1')}/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.floor(64 * np.stack(got.embedding.to_list()).astype("f8"))
    x, ids = x[np.argsort(-(x * x).sum(axis=1), kind="stable")], got.vec_id.to_numpy()[np.argsort(-(x * x).sum(axis=1), kind="stable")]
    rows = np.arange(len(x))
    asked = ids % 20 == 0
    search = inner_products.Searcher(ids[asked], rows[asked], x[asked], np.linalg.svd(x.T @ x)[0], 20)
    search.first_bounds(rows, x)
    left = {(int(q), int(a + c)) for a in range(0, len(x), 256) for q, c in zip(*search.left(x[a : a + 256]), strict=True)}
    scores = x[asked] @ x.T
    scores[np.arange(asked.sum()), rows[asked]] = -np.inf
    assert all((q, int(c)) in left for q in range(len(scores)) for c in np.argsort(-scores[q], kind="stable")[:20])
    assert search.pairs_left < 0.05 * search.pairs_met and search.pairs_met == scores.size


# --- pipeline ------------------------------------------------------------------------------------
def test_pipeline(spark, library):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    model = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    kept = [r.id for r in toxicity.score_toxicity(docs, model).collect() if r.score < 0.3]
    stages = dict(p.STAGES)
    clean = stages["toxicity"](spark, docs, SMALL)
    assert clean.columns == columns and sorted(r.doc_id for r in clean.collect()) == sorted(kept)
    text = {d: t for d, t in texts(spark, SMALL).items() if d in set(kept)}
    best = {}
    for d, t in text.items():
        k = "".join(c for c in t or "" if c not in " \t\n\v\f\r")
        best[k] = min(best.get(k, (0, math.inf)), (-len(t or ""), d)) if k in best else (-len(t or ""), d)
    exact = stages["exact_dedup"](spark, clean, SMALL)
    assert exact.columns == columns and sorted(r.doc_id for r in exact.collect()) == sorted(d for _, d in best.values())
    near = stages["ngram_jaccard_join"](spark, exact, SMALL)
    want = sorted(d for d, n, c in brute_components([(d, text[d]) for d in sorted(d for _, d in best.values())]) if d == c)
    assert near.columns == columns and sorted(r.doc_id for r in near.collect()) == want
    mixed = stages["mixing"](spark, near, SMALL)
    copies = {r.id: r.copies for r in mix_sources(near).collect()}
    assert mixed.columns == columns and collections.Counter(r.doc_id for r in mixed.collect()) == {d: n for d, n in copies.items() if n}
    rows = p.run(spark, SMALL).collect()
    assert sum(r.length for r in rows) == sum((len(i) + 1) * copies[d] for d, i in zip(text, library_ids(library, text.values()), strict=True) if d in copies)


def test_saved_tables_trim_the_drivers_native_memory(spark, monkeypatch):
    from joinwright.llm import storage

    assert storage.trim(spark)
    done, trim = [], storage.trim
    monkeypatch.setattr(storage, "trim", lambda s: done.append(trim(s)))
    assert storage.saved(spark.range(3)).count() == 3 and done == [True]


def test_small_tables_are_few_files_and_executors_shrink_before_them(spark, monkeypatch):
    from joinwright.llm import labelled, storage

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    assert storage.task_count(docs) == cores  # was four times as many
    parts, merged = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    before = {k: spark.conf.get(k) for k in (parts, merged)}
    called = []
    monkeypatch.setattr(storage, "shrink", lambda s: called.append(1))
    try:
        spark.conf.set(parts, 211)
        spark.conf.set(merged, "false")
        known = docs.select(F.col("doc_id").alias("id"), F.lit(1).alias("y"))
        sample = labelled.sampled(docs, known, "doc_id", "text")
        assert len(sample.inputFiles()) <= cores and called
        assert sample.count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_shrink_asks_each_executor_once_in_a_while(monkeypatch):
    from joinwright.llm import storage

    asked = []
    frame = types.SimpleNamespace(selectExpr=lambda e: types.SimpleNamespace(collect=lambda: asked.append(e)))
    status = types.SimpleNamespace(getExecutorMemoryStatus=lambda: types.SimpleNamespace(size=lambda: 4))
    context = types.SimpleNamespace(applicationId="no application", _jsc=types.SimpleNamespace(sc=lambda: status))
    fake = types.SimpleNamespace(sparkContext=context, range=lambda a, b, step, n: frame if (a, b, step, n) == (0, 3, 1, 3) else None)
    monkeypatch.setattr(storage, "_shrunk", {})
    assert [storage.shrink(fake), storage.shrink(fake)] == [3, 0] and len(asked) == 1


def test_lookups_of_hashes_are_those_of_numpy():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3000):
        h = rng.integers(0, 2**64, max(n // 3, 1), dtype="u8")
        h = rng.choice(h, n)
        table = np.unique(np.concatenate([h[::2], rng.integers(0, 2**64, 500, dtype="u8")]))
        assert (words.unique(h) == np.unique(h)).all() and (words.find(table, h) == np.searchsorted(table, h)).all()
        order = words.stable_order(h)
        groups = [np.flatnonzero(h == x).tolist() for x in np.unique(h)]
        assert sorted(groups) == sorted(list(g) for _, g in itertools.groupby(order.tolist(), key=lambda i: h[i]))
        n_of = rng.integers(1, 9, n)
        for given, want in ((n_of, [n_of[g].sum() for g in groups]), (None, [len(g) for g in groups])):
            r = context_mixing._summed(h, given)
            assert r["key"].tolist() == np.unique(h).tolist() and r["n"].tolist() == want
    close = np.array([5, 4, 5, 7, 4, 4], "u8")  # these differ in no bits but those of places
    assert words.stable_order(close).tolist() == [1, 4, 5, 0, 2, 3]


@pytest.mark.parametrize("crowd", [0, 20, 500])
def test_frequent_codes_where_keys_share_their_first_bits(crowd):
    rng = np.random.default_rng(6)
    key = np.unique(np.concatenate([rng.integers(0, 2**64, 4000, dtype="u8"), np.arange(crowd, dtype="u8"), np.array([2**64 - 1], "u8")]))
    top = pa.table({"key": rng.permutation(key).view("i8"), "count": np.arange(len(key)), "score": np.zeros(len(key))})
    f = context_mixing.Frequent(top)
    assert f.even == (crowd < 30) and (f.codes(key) == np.arange(len(key))).all()
    others = np.setdiff1d(np.concatenate([key + np.uint64(1), key - np.uint64(1)]), key)
    assert (f.codes(others) == context_mixing.FREQUENT).all()


def test_toxicity_stage_without_labels(spark, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(EDGES, DOC)
    assert p.toxicity(spark, docs, str(tmp_path)).count() == len(EDGES)


def test_near_copies_by_row(spark):
    """One row of each group stays where ids repeat or are null, and a clean text under a repeated id stays."""
    import corpus_pipeline as p

    a, b, clean = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (2, a + " tail"), (2, clean), (None, b), (None, b + " tail"), (None, b), (3, ""), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = sorted(((r.doc_id, r.text) for r in p.near_copies(spark, docs, SMALL).collect()), key=repr)
    assert len(left) == 5 and left[:4] == sorted([(1, a), (2, clean), (3, ""), (3, "")], key=repr)
    assert left[4][0] is None and left[4][1].startswith(b)


def test_stages_with_clashing_names(spark):
    import corpus_pipeline as p

    names = ["__n", "__rate", "__sha", "__id", "__again", "__key", "n", "rate", "sha", "id", "key", "again", "component", "a`b", "size", "norm", "row"]
    docs = spark.createDataFrame([(r[0], r[1], r[3], *(f"{c}{i}" for c in names)) for i, r in enumerate(EDGES)], "doc_id bigint, text string, source string, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in names))
    whole = set(map(tuple, docs.collect()))
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        rows = out.collect()
        assert out.columns == docs.columns and rows and set(map(tuple, rows)) <= whole


def test_copies_under_one_id(spark):
    """Texts that differ stay apart under one id; of rows that repeat id and text, one stays."""
    import corpus_pipeline as p

    rows = [(1, "a b c"), (1, "another text"), (1, "a  b c"), (1, "a b c"), (2, "abc"), (3, "another text"), (None, "x y"), (None, "xy"), (None, "z")]
    left = sorted(((r.doc_id, r.text) for r in p.exact_copies(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), SMALL).collect()), key=repr)
    assert left == sorted([(1, "a  b c"), (1, "another text"), (None, "x y"), (None, "z")], key=repr)


def test_pipeline_edges(spark, none):
    import corpus_pipeline as p

    docs = spark.createDataFrame(EDGES, DOC)
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, none, SMALL).count() == 0
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and out.count() > 0
    assert sorted(r.doc_id for r in dict(p.STAGES)["exact_dedup"](spark, docs, SMALL).filter("doc_id is not null").collect()) == [3, 4, 5, 6, 8, 9, 10]
