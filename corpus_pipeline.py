"""A corpus pipeline of the training-data operators: each stage reads what its predecessor wrote.

STAGES holds (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the
last return the columns of documents. ``run`` applies them to the documents table. The order decides results, so
the stages that drop documents come before the mix, and copies that the mix emits are packed each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joinwright.llm.exact_dedup import exact_dedup, normalised
from joinwright.llm.mixing import mixed_documents
from joinwright.llm.ngram_join import ngram_jaccard_join, with_key
from joinwright.llm.packing import pack
from joinwright.llm.storage import own_names, quoted, saved, small_or_shuffled, task_count
from joinwright.llm.toxicity import fit, score_toxicity

#: Toxicity scores are no SQL, so the pipeline is tested against brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.3 or more; without a vocabulary, which is no evidence against any, all stay."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model, keep=docs.columns) if len(model.index.terms) else docs


def one_of_each(docs: DataFrame, keyed: DataFrame, gone: DataFrame, names: list[str]) -> DataFrame:
    """docs without the rows of ``gone`` that aren't marked ``again``; of those so marked, which repeat, the longest text stays.

    keyed: docs with the columns ``names``; gone: these, and ``again``. Only keys move, but for rows that repeat.
    """
    columns = quoted(docs.columns)
    gone = saved(gone, task_count(docs))
    left = keyed.join(small_or_shuffled(gone.filter("not again").select(*names)), names, "left_anti")
    again = gone.filter("again").select(*names)
    if again.isEmpty():
        return left.select(*columns)
    longest = left.join(small_or_shuffled(again), names, "left_semi").groupBy(*names).agg(F.max_by(F.struct(*columns), F.char_length("text")).alias("r"))
    return left.join(small_or_shuffled(again), names, "left_anti").select(*columns).unionByName(longest.select("r.*"))


def id_text(id_: Column) -> Column:
    return F.coalesce(id_.cast("string"), F.lit("null"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts: the one with the most code points, then the least id.

    Rows that repeat id and text are one group too, of which one row stays.
    """
    sha, id_ = names = own_names(docs, "sha", "id")
    groups = exact_dedup(docs).filter("group_size > 1 and not kept")
    gone = groups.select(id_text(F.col("id")).alias(id_), F.col("text_sha256").alias(sha), F.col("id").eqNullSafe(F.col("keep_id")).alias("again")).distinct()
    keyed = docs.withColumn(sha, F.sha2(normalised(F.col("text")).cast("binary"), 256)).withColumn(id_, id_text(F.col("doc_id")))
    return one_of_each(docs, keyed, gone, names)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group, of the least id (a null one last); documents without words all stay."""
    key, id_ = names = own_names(docs, "key", "id")
    tasks = task_count(docs)
    held = saved(ngram_jaccard_join(docs).filter("n_shingles > 0").groupBy("component", "id", "key").agg(F.count("*").alias("k")), tasks)
    best = held.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("p"), F.sum("k").alias("rows")).filter("rows > 1")
    stays = F.col("id").eqNullSafe(F.col("p.id")) & (F.col("key") == F.col("p.key"))
    marked = held.join(small_or_shuffled(saved(best, tasks)), "component").filter(~stays | (F.col("k") > 1))
    gone = marked.select(id_text(F.col("id")).alias(id_), F.col("key").alias(key), stays.alias("again"))
    return one_of_each(docs, with_key(docs, key).withColumn(id_, id_text(F.col("doc_id"))), gone, names)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 4096, with their sequence and place."""
    return pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_copies), ("ngram_jaccard_join", near_copies), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), task_count(docs))
    return STAGES[-1][1](spark, docs, sf_dir)
