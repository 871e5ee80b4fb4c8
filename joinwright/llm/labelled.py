"""A bounded sample of labelled documents to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import saved, task_count


def held_out(id_: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; a null id counts as the text ''."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def labelled(labels: DataFrame, label: str, modulus: int, remainder: int, id_col: str) -> DataFrame:
    """``id, y`` of the labelled ids outside the held-out fold; an id with several labels counts once, with the greatest."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).filter("id is not null and y is not null")
    return known.filter(~held_out(F.col("id"), modulus, remainder)).groupBy("id").agg(F.max("y").alias("y"))


def sampled(docs: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text, y`` of the documents of a few known ids; texts that repeat count once for each label."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = rows.join(F.broadcast(known), "id")
    return saved(found.groupBy(F.xxhash64("text").alias("h"), "y").agg(F.min_by(F.struct("id", "text"), "id").alias("r")).select("r.id", "r.text", "y"), task_count(docs))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, most: int, id_col: str, text_col: str) -> DataFrame:
    """``id, text, y`` of at most ``most`` labelled documents outside the held-out fold, the first by a hash of their id."""
    known = labelled(labels, label, modulus, remainder, id_col).orderBy(F.xxhash64("id"), "id").limit(most)
    return sampled(docs, known, id_col, text_col)
