"""Late materialisation: join row ids first, fetch rows afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fetch_rows(pairs: DataFrame, r: DataFrame, s: DataFrame) -> DataFrame:
    """The rows behind a join index, as struct columns ``r`` and ``s``. Row ids must be unique in each relation.

    The joins are merges, which spill: left to the optimizer, it may broadcast millions of rows by the size of their compressed files.
    """
    left = r.select(F.col("row_id").alias("r_row_id"), F.struct(*r.columns).alias("r"))
    right = s.select(F.col("row_id").alias("s_row_id"), F.struct(*s.columns).alias("s"))
    return pairs.join(left.hint("merge"), "r_row_id").join(right.hint("merge"), "s_row_id").select("r", "s")


def late_materialised_join(r: DataFrame, s: DataFrame, how: str = "shuffle_hash") -> DataFrame:
    """Join on key by row ids alone, then fetch both rows; pays off where few rows match and payloads are wide."""
    from .joins import join_pairs

    return fetch_rows(join_pairs(r, s, how), r, s)
