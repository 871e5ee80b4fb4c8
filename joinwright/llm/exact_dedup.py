"""Exact duplicates by progressive refinement, with native functions only."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import BROADCAST_ROWS, GROUPS, saved, small_or_shuffled, task_count

#: Characters that do not count: space and \t \n \v \f \r.
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
#: Characters of the normalised text that the second step hashes.
PREFIX = 128


def normalised(text: Column) -> Column:
    """The text without WHITE; null counts as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), WHITE, "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_all: bool = False) -> DataFrame:
    """Groups of texts that are equal once white space is deleted: ``id, keep_id, group_size, kept, text_sha256``.

    Of a group, the row with the most code points in its original text stays, then the one with the least id.
    Progressive refinement, each step a scan over what the one before left: normalised lengths are counted; rows that
    share one are counted by the hash of a prefix too; and only those that share both have their whole content hashed.
    ``text_sha256`` is null for rows that dropped out before, unless ``hash_all``.

    Groups are never gathered: counts and the row that stays are partial aggregates. Groups that hold more than a
    fixed share of the rows, few by definition, are broadcast, and only the rows of the others meet by their digest.
    Texts aren't shuffled: where lengths are too many to broadcast, prefixes meet them, and where surviving keys
    are, every row is hashed before it meets them.

    Null and empty texts are one group. A null id sorts after all others. Of rows that repeat id and text,
    exactly one is kept. Other columns are not read; an empty table gives an empty table.
    """
    keep = partial(saved, tasks=task_count(docs))
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("norm", normalised(text)).withColumn("size", F.octet_length("norm"))
    # length: only rows that share one have a prefix hashed
    lengths = keep(rows.groupBy("size").agg(F.count("*").alias("n")))
    total = lengths.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = lengths.filter("n > 1").select("size")
    start = F.substring("norm", 1, PREFIX).alias("start")
    heads = rows.select("size", start).join(small_or_shuffled(shared), "size", "left_semi").select("size", F.xxhash64("start").alias("head"))
    # prefix: only rows that share length and prefix have their content hashed
    left = keep(heads.groupBy("size", "head").agg(F.count("*").alias("n")).filter("n > 1").select("size", "head"))
    few = left.count() <= BROADCAST_ROWS
    digest = F.sha2(F.col("norm").cast("binary"), 256)
    points = F.char_length(F.coalesce(text, F.lit(""))).alias("points")
    sizes = left.select("size").distinct().withColumn("sized", F.lit(True))
    known = rows.select("id", points, "size", start, "norm" if few else digest.alias("text_sha256")).join(sizes.hint("broadcast") if few else sizes, "size", "left")
    known = known.withColumn("head", F.when(F.col("sized"), F.xxhash64("start")))
    known = known.join(left.withColumn("survives", F.lit(True)).hint("broadcast") if few else left.withColumn("survives", F.lit(True)), ["size", "head"], "left")
    sha = digest if few else F.col("text_sha256")
    full = known.select("id", "points", "survives", (sha if hash_all else F.when(F.col("survives"), sha)).alias("text_sha256"))
    full = keep(full.withColumn("row", F.monotonically_increasing_id()))
    # the number of the row only tells rows apart that agree in everything else
    order = F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("row").alias("row"))
    among = full.filter("survives")
    groups = keep(among.groupBy("text_sha256").agg(F.count("*").alias("group_size"), F.min(order).alias("best")).select("text_sha256", "group_size", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row")))
    large = F.col("group_size") >= max(2, total // GROUPS)
    big = groups.filter(large).hint("broadcast")
    # a row of no large group meets the others by its digest; one whose digest is unique is among neither's partners
    rest = among.join(big.select("text_sha256"), "text_sha256", "left_anti").join(groups.filter(~large), "text_sha256")
    grouped = among.join(big, "text_sha256").unionByName(rest).select("id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")
    alone = full.filter("survives is null").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return grouped.union(alone)
