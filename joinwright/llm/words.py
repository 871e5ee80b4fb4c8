"""Words of Arrow text columns as numpy arrays, without a Python object for each word.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r. Its hash is a chain over its eight-byte parts:
each part is folded in and then scrambled by a bijective mixer, so the hash is no linear function of the text and
words with algebraic structure don't collide more than others do. Up to eight bytes, words of one length never
collide. Where a result depends on a word itself, callers compare bytes (see ``same_spans``); elsewhere 64 bits stand
for words and shingles, and 128 for whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; longer documents are cut at white space.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd pseudo-random uint64."""
    return mix(np.arange(1, n + 1, dtype="u8") * np.uint64(_BASE) + np.uint64(seed)) | np.uint64(1)


SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes with A-Z as a-z.
LOWER = np.arange(256, dtype="u1")
LOWER[ord("A") : ord("Z") + 1] += 32
#: Longer words than this are hashed one by one, by a cryptographic hash.
LONG = 512
_SIZES = mix(np.arange(1, LONG + 3, dtype="u8") * np.uint64(_BASE))
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], "u8")
#: Where ``cut`` divides words: after an ASCII letter and before one of these.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "|"]] = True


@dataclass
class Words:
    """start, end: byte positions in the block; doc: the row of each word within the block; hash: 64 bits of each word."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray


def blocks(column: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``most`` bytes: (first row, end row, bytes, offsets). A null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    held = column.buffers()
    offsets = np.frombuffer(held[1], "i8")[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, "i8")
    data = np.frombuffer(held[2], "u1") if held[2] is not None else np.zeros(0, "u1")
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def find_words(data: np.ndarray, offsets: np.ndarray, fold: bool, hashes: bool = True, cut: bool = False) -> Words:
    """All words of a block. fold: hash A-Z as a-z. cut: divide words between an ASCII letter and an ASCII mark other than |."""
    n = len(data)
    word = ~SEPARATOR[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    if cut and n:
        between = _LETTER[data[:-1]] & _MARK[data[1:]]
        first[1:] |= between
        last[:-1] |= between
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    first[edges] = word[edges]
    last[edges - 1] = word[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    found = hash_spans(data, start, end, fold) if hashes else np.zeros(0, "u8")
    return Words(start, end, np.searchsorted(offsets, start, side="right") - 1, found)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as little-endian numbers; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, "u1")])
    return np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool) -> np.ndarray:
    """Hashes of byte spans; they may overlap."""
    if not len(start):
        return np.zeros(0, "u8")
    data = LOWER[data] if fold else data
    eights, size = _eights(data), end - start
    found = mix(_SIZES[np.minimum(size, LONG + 1)] ^ (eights[start] & _KEEP[np.minimum(size, 8)]))
    at, left = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(at):
        found[at] = mix(found[at] ^ (eights[start[at] + left] & _KEEP[np.minimum(size[at] - left, 8)]))
        left += 8
        at = at[size[at] > left]
    for i in np.flatnonzero(size > LONG):
        found[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return found


def same_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """Whether spans hold the same bytes as those beside them."""
    size = end - start
    same = size == end_b - start_b
    if not len(start):
        return same
    eights = _eights(data)
    at, left = np.flatnonzero(same), 0
    while len(at):
        here = (eights[start[at] + left] ^ eights[start_b[at] + left]) & _KEEP[np.minimum(size[at] - left, 8)]
        same[at[here != 0]] = False
        left += 8
        at = at[(here == 0) & (size[at] > left)]
        if left >= LONG:
            for i in at:
                same[i] = data[start[i] + left : end[i]].tobytes() == data[start_b[i] + left : end_b[i]].tobytes()
            break
    return same


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct values, an index of each, each value's place among them)."""
    order = np.argsort(hashes)
    s = hashes[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    place = np.empty(len(s), "i8")
    place[order] = np.cumsum(new) - 1
    return s[new], order[new], place


def unique(x: np.ndarray) -> np.ndarray:
    """np.unique of numbers by sorting, which beats its hash table."""
    s = np.sort(x, axis=None)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """np.searchsorted(table, keys) in several times less time where both are large and keys in no order: they are looked up in theirs."""
    order = np.argsort(keys)
    out = np.empty(len(keys), "i8")
    out[order] = np.searchsorted(table, keys[order])
    return out


def stable_order(hashes: np.ndarray) -> np.ndarray:
    """An order that brings equal hashes together, each group's as they stand.

    The place of each stands in its low bits, so that values alone are sorted; where two hashes differ in no other bits, they are
    sorted by a stable sort instead.
    """
    low = np.uint64((1 << max(len(hashes) - 1, 1).bit_length()) - 1)
    s = np.sort((hashes & ~low) | np.arange(len(hashes), dtype="u8"))
    order = (s & low).astype("i8")
    found = hashes[order]
    mixed = ((s[1:] ^ s[:-1]) <= low) & (found[1:] != found[:-1])
    return np.argsort(hashes, kind="stable") if mixed.any() else order


def distinct_spans(words: Words, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an index of each different word, each word's place among them), by hash, then by bytes: data is as it was hashed."""
    _, first, place = distinct(words.hash)
    like = first[place]
    if same_spans(data, words.start, words.end, words.start[like], words.end[like]).all():
        return first, place
    met: dict[bytes, int] = {}  # words that share a hash
    place = np.array([met.setdefault(data[a:b].tobytes(), len(met)) for a, b in zip(words.start, words.end, strict=True)], "i8")
    return np.unique(place, return_index=True)[1], place


def shingles(words: Words, docs: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the sorted distinct ``width``-word shingles of row i are hashes[bounds[i]:bounds[i + 1]].

    A row with fewer words has its whole sequence as its one shingle; a row without words has none.
    """
    c = constants(width + 1, 29)
    count = np.bincount(words.doc, minlength=docs)
    begin = np.concatenate([[0], np.cumsum(count)])
    n = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], n) + np.repeat(begin[:-1], n)
    here = np.repeat(count, n)
    found = np.zeros(len(at), "u8")
    for k in range(width):
        inside = at + k < len(words.hash)
        part = np.where(k < here, words.hash[np.where(inside, at + k, 0)] if len(words.hash) else np.uint64(0), np.uint64(0))
        found += part * c[k]
    found = mix(found + np.minimum(here, width).astype("u8") * c[width])
    kept, sizes = [], np.zeros(docs, "i8")
    for i in np.flatnonzero(n):
        s = np.sort(found[bounds[i] : bounds[i + 1]])
        if len(s) > 1:
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        kept.append(s)
        sizes[i] = len(s)
    return np.concatenate(kept) if kept else np.zeros(0, "u8"), np.concatenate([[0], np.cumsum(sizes)])


def packed(bucket: np.ndarray, records: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Records grouped by bucket, as (bucket, bytes): a shuffle then moves a few large rows instead of one per record."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]])) if len(b) else np.zeros(1, "i8")
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(b[i]), records[order[i:j]].tobytes()
