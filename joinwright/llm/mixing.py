"""Mixing sources to target weights, with native functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import own_names, quoted, saved, small_or_shuffled, task_count

#: Weights of the sources by code point, null last, repeating.
WEIGHTS = (5, 2, 1)
#: No document is taken more often than this.
MOST = 3


def text_size(text: Column) -> Column:
    """Words: runs of characters other than space and \\t \\n \\v \\f \\r; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_rates(sized: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, target, rate`` from rows of ``source, size``.

    Sources share the total size by weight; a target stops at ``most`` times its source's size, and what is
    left is shared among the others by weight until none is above. That fixed point is min(most * size,
    level * weight): sources in order of most * size / weight are capped up to the first whose share of the
    rest fits. The windows run over one row a source, after the documents are aggregated.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(order) - 1) % len(weights)
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (nth + 1).cast("int")).cast("double"))
    cap = (F.col("source_size") * most).cast("double")
    by = by.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    w = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    below = w.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    total = F.sum("source_size").over(every).cast("double")
    rest = total - F.coalesce(F.sum("cap").over(below), F.lit(0.0))
    share = rest / F.sum("weight").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    by = by.withColumn("share", share).withColumn("level", F.min(F.when(F.col("share") <= F.col("ratio"), F.struct("ratio", "source", "share"))).over(every)["share"])
    target = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0)))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    return by.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "target", "rate")


def coin(id_: Column, seed: int, text: Column) -> Column:
    """A number in [0, 1) from the md5 of id and seed, or of the text and seed where the id is null: the same in every run, on any engine."""
    name = F.coalesce(id_.cast("string"), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))
    whole = F.concat(name, F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id, source, size, source_size, target, rate, copies`` for every row: how often the mix takes it.

    copies = floor(rate) + one more with probability equal to rate's fraction, by a coin that depends on id
    and seed alone. One scan sizes the rows; sizes are pre-aggregated by source, so a source with a third of
    all rows is no hot group, and the few rates are joined back (broadcast if few by count). Texts aren't shuffled.

    A null text has size 0; a null source is a source of its own, after all others; sources of size 0 get
    target 0. Rows that repeat have the same coin; rows without an id have that of their text. Other columns are not
    read. An empty table gives an empty one.
    """
    text = F.col(text_col).cast("string")
    sized = saved(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), text_size(text).alias("size"), coin(F.col(id_col), seed, text).alias("coin")), task_count(docs))
    rates = saved(source_rates(sized, weights, most)).withColumnRenamed("source", "of")
    joined = sized.join(small_or_shuffled(rates), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    copies = F.floor("rate") + (F.col("coin") < F.col("rate") - F.floor("rate")).cast("bigint")
    return joined.withColumn("copies", copies.cast("bigint")).drop("coin")


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: docs' columns, whatever their names, each row as often as ``mix_sources`` takes it."""
    of, n = own_names(docs, "rate", "n")
    sized = docs.select(F.col(source_col).cast("string").alias("source"), text_size(F.col(text_col).cast("string")).alias("size"))
    rates = saved(source_rates(sized, weights, most)).select(F.struct("source", "rate").alias(of))
    joined = docs.join(small_or_shuffled(rates), F.col(source_col).cast("string").eqNullSafe(F.col(of)["source"]))
    rate = F.col(of)["rate"]
    copies = F.floor(rate) + (coin(F.col(id_col), seed, F.col(text_col)) < rate - F.floor(rate)).cast("bigint")
    many = joined.withColumn(n, copies.cast("int")).filter(F.col(n) > 0).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n))))
    return many.select(*quoted(docs.columns))
