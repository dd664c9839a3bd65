"""From raw documents to packed training sequences: four stages, each a stored table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casemill.llm import ngram_join, packing, quality, surrogates
from casemill.session import scratch_dir, store, table

#: The stages train a classifier and call a tokenizer; SQL cannot express them.
ORACLE_SQL = None
#: Key of the surrogates; a run on real data passes its own to `surrogates.replace`.
SURROGATE_KEY = "corpus pipeline"


def _keys() -> list[Column]:
    """A row by its id and its text, without nulls. Hidden names, so that no column can clash."""
    return [
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id"),
        F.xxhash64(F.col("text").cast("string")).alias("__text"),
    ]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject, with all their columns."""
    scored = quality.score(docs, table(spark, sf_dir, "labels"))
    rejected = scored.where("predicted = 0").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id"), F.col("text_hash").alias("__text")
    )
    keyed = docs.select("*", *_keys())
    return keyed.join(rejected.distinct(), ["__id", "__text"], "left_anti").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8): the one with the smallest id.

    Texts without words are in no group and all stay, repeated rows of them too.
    """
    linked = ngram_join.link(docs, words=5, percent=80)
    first = linked.where("first and n_shingles > 0").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id"), F.col("text_hash").alias("__text")
    )
    keyed = docs.select("*", *_keys())
    same = Window.partitionBy("__id", "__text").orderBy(F.lit(0))
    kept = (
        keyed.join(first.distinct(), ["__id", "__text"])
        .withColumn("__n", F.row_number().over(same))
        .where("__n = 1")
        .select(*docs.columns)
    )
    without_words = docs.where(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return kept.union(without_words)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; `n_chars` follows the new text."""
    replaced = surrogates.replace(docs, SURROGATE_KEY)
    counted = replaced.withColumn(
        "n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    )
    return counted.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("personal_data", without_personal_data),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of the folder; each stage's rows are stored and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_dir(spark, f"pipeline-{name}")
        store(stage(spark, docs, sf_dir), path)
        docs = spark.read.parquet(path)
    return docs
