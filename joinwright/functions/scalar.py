"""Scalar column expressions; all stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def radix_id(key: Column | str, bits: int, skip: int = 0) -> Column:
    """Partition number of a key: ``bits`` bits of it after the lowest ``skip``. No mixing hash, so it is reproducible anywhere."""
    mask = ((1 << bits) - 1) << skip
    return F.shiftright(_col(key).cast("bigint").bitwiseAND(F.lit(mask).cast("bigint")), skip).cast("int")


def next_pow_2(n: Column | str) -> Column:
    """Smallest power of two that is at least n (1 for n <= 1)."""
    n = _col(n)
    return F.when(n <= 1, F.lit(1).cast("bigint")).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(F.bin(n.cast("bigint") - 1))))


def log2_floor(n: Column | str) -> Column:
    """The position of the highest bit that is set: 0 for 1, 10 for 1024; null for 0 and less."""
    n = _col(n).cast("bigint")
    return F.when(n > 0, F.length(F.bin(n)) - 1)


def text_between(text: Column | str, first: int, end: int) -> Column:
    """Characters from ``first`` up to, not including, ``end``, counted from 0; fewer where the text ends before."""
    return F.substring(_col(text), first + 1, max(end - first, 0))


def joined_by(separator: str, *texts: Column | str) -> Column:
    """The texts with the separator between them; null if any is."""
    parts = [_col(t) for t in texts]
    return F.concat(*[x for k, t in enumerate(parts) for x in ([F.lit(separator)] if k else []) + [t]])


def descending_places(values: Column | str) -> Column:
    """For an array, the places (from 0) of its elements in descending order; ties in the order of places, nulls last."""
    tagged = F.transform(_col(values), lambda x, i: F.struct(x.alias("x"), (-i).alias("i")))
    return F.transform(F.sort_array(tagged, asc=False), lambda s: (-s["i"]).cast("int"))


def is_promo(p_type: Column | str) -> Column:
    """Types that begin with PROMO."""
    return _col(p_type).startswith("PROMO")


def brand_number(p_brand: Column | str) -> Column:
    """The digits after ``Brand#``."""
    return F.substring(_col(p_brand), 7, 10).cast("int")
