"""The corpus pipeline: quality rules, quality classifier, near duplicates, repeated passages, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import minhash, ordinal, quality_rules, suffix
from attesta.llm import packing as pack
from attesta.llm.common import durable

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def own_mark() -> Column:
    """A document's own mark: a verdict goes back to the row that it was given to, also where rows share an id or have none."""
    return F.xxhash64("text", F.coalesce("source", F.lit("")), F.col("source").isNull())


def only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The documents whose doc_id and mark are in kept; null ids match each other. Rows that are alike have one verdict."""
    same = docs.withColumn("mark_", own_mark())
    ids = kept.select(F.col("doc_id").alias("kept_id"), F.col("mark").alias("kept_mark"))
    return same.join(ids, (F.col("mark_") == F.col("kept_mark")) & F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select(*COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host passes."""
    return only(docs, quality_rules.quality_rules(docs, mark=own_mark()).filter("kept"))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a grade above the lowest is high enough, by a model trained on graded labels."""
    ratings = ordinal.graded(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = ordinal.learn_grades(spark.read.parquet(f"{sf_dir}/documents.parquet"), ratings)
    return ordinal.grade(docs, model, carry=tuple(COLUMNS[1:])).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    return only(docs, minhash.near_duplicates(docs, width=5, percent=80, mark=own_mark()).filter("kept"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a document with a smaller doc_id holds. Documents of which nothing is left go."""
    found = suffix.remove_repeats(docs, carry=("lang", "source"))
    rest = found.filter("n_removed = 0 or length(kept_text) > 0")
    return rest.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece of each text, read back from its bin. Near duplicates are gone by now, so equal texts are the clusters."""
    return pack.unpack(pack.pack(docs))


STAGES: list[tuple[str, Callable]] = [
    ("quality_rules", rules), ("quality_classifier", classifier), ("minhash", near_duplicates), ("suffix_array", repeats), ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable(docs)
    return docs
