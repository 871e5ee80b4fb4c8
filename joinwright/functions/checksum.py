"""Unsigned 64-bit wrap-around addition and sums under ANSI arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMB = 22  # three limbs of 22, 22 and 20 bits: each bigint sum is safe for 2^41 rows


def wrap64(total: Column) -> Column:
    """A wide decimal reduced modulo 2^64."""
    return F.pmod(total, F.expr("18446744073709551616BD")).cast("decimal(20,0)")


def wrap64_add(a: Column, b: Column) -> Column:
    """a + b of bigint columns modulo 2^64, as the bigint of the same bits; plain addition fails beyond 2^63 under ANSI arithmetic."""
    half = F.lit((1 << 32) - 1).cast("bigint")
    low = a.bitwiseAND(half) + b.bitwiseAND(half)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(half))


def wrap64_sum(*cols: Column | str) -> Column:
    """``SUM(c1 + c2 + ...) mod 2^64`` of bigint columns read as unsigned; 0 for no rows. A row with a null among them doesn't count.

    Each column is summed as three limbs in plain bigint arithmetic, which is partial-aggregated and
    code-generated, unlike sums of wide decimals; the limbs meet as decimals once per group.
    """
    terms = []
    cols = [(F.col(c) if isinstance(c, str) else c).cast("bigint") for c in cols]
    whole = reduce(lambda a, b: a & b, (c.isNotNull() for c in cols))
    for c in cols:
        c = F.when(whole, c)
        for k in range(3):
            limb = F.shiftrightunsigned(c, LIMB * k)
            if k < 2:
                limb = limb.bitwiseAND(F.lit((1 << LIMB) - 1).cast("bigint"))
            part = F.coalesce(F.sum(limb), F.lit(0).cast("bigint")).cast("decimal(19,0)")
            terms.append((part * F.lit(1 << (LIMB * k)).cast("decimal(14,0)")).cast("decimal(38,0)"))
    return wrap64(reduce(lambda a, b: a + b, terms))
