"""Packing pieces of token sequences into windows with the least slack."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import saved
from .tokens import token_pieces


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length to take so that the sum is as near to capacity as it can be, not above it.

    Subset sums as bits of an integer: each length, in portions of 1, 2, 4, ... copies, shifts the reachable
    sums; the walk back over the portions gives the counts. It ends as soon as capacity itself is reached.
    """
    mask, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for size in sorted((k for k, n in counts.items() if n > 0 and 0 < k <= capacity), reverse=True):
        left, portion = min(counts[size], capacity // size), 1
        while left and not reach >> capacity & 1:
            take = min(portion, left)
            steps.append((size, take, reach))
            reach |= reach << (size * take) & mask
            left, portion = left - take, portion * 2
        if reach >> capacity & 1:
            break
    total, taken = reach.bit_length() - 1, {}
    for size, take, before in reversed(steps):
        if not before >> total & 1:
            taken[size] = taken.get(size, 0) + take
            total -= size * take
    return taken


def plan(counts: dict[int, int], window: int) -> list[tuple[int, dict[int, int]]]:
    """(repetitions, counts by length) of windows that take every piece once.

    Each window starts with the longest piece left, so that long pieces don't remain for the end, and is
    filled from all others. The multiset repeats while the counts last: lengths are few, so a plan stays
    small however many pieces there are.
    """
    left, out = {k: n for k, n in counts.items() if n > 0}, []
    while left:
        top = max(left)
        left[top] -= 1
        taken = fill(left, window - top)
        left[top] += 1
        taken[top] = taken.get(top, 0) + 1
        times = min(left[k] // n for k, n in taken.items())
        out.append((times, taken))
        for k, n in taken.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def _slots(plans: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, copies in a window, first sequence, offset there), sorted by length and rank."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for times, taken in plans:
        offset = 0
        for size in sorted(taken, reverse=True):
            rows.append((size, rank.get(size, 0), taken[size], sequence, offset))
            rank[size] = rank.get(size, 0) + taken[size] * times
            offset += size * taken[size]
        sequence += times
    return np.array(sorted(rows), "i8").reshape(-1, 5)


def pack(docs: DataFrame, window: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Packs every document's token ids, with end_id after each, into sequences of at most ``window`` ids.

    One row for each piece: ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, with
    ``with_ids``, the ``ids``. Documents above the window are cut into whole windows and a rest. Each window
    takes the multiset of remaining lengths that leaves the least slack. Only the count of each length, at
    most ``window`` numbers, reaches the driver; a piece finds its place from its rank within its length,
    which comes from counts by task, so no group of equal lengths is gathered.

    A null or empty text is the one id end_id. Null ids, repeated rows and other columns are allowed: each
    row is packed; an empty table gives an empty table. Task numbers are saved with the pieces, so a retried
    task cannot change ranks.
    """
    pieces = saved(token_pieces(docs, window, end_id, id_col, text_col, tokenizer, with_ids))
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = docs.sparkSession.sparkContext.broadcast(_slots(plan(counts, window)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    ranked = pieces.join(by_task.select("length", "task", before.alias("before")), ["length", "task"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        key = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("before").to_numpy() + batch.column("nth").to_numpy()
            row = table[np.searchsorted(key, length << 44 | rank, side="right") - 1]
            j = rank - row[:, 1]
            sequence, offset = row[:, 3] + j // row[:, 2], row[:, 4] + j % row[:, 2] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    kept = ["id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    schema = "id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * with_ids + ", sequence_id bigint, offset bigint"
    return ranked.mapInArrow(place, schema)
