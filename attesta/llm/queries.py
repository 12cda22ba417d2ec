"""The numbered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import audit, byte_bpe, chat, language, media, merkle, minhash, mixing, ordinal, packing, quality_rules, sql, suffix, toxicity
from attesta.llm.common import crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"), keep=False).drop("removed", "kept", "kept_text")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = packing.with_clusters(table(spark, sf_dir, "documents"))
    return packing.unpack(packing.pack(docs, cluster="near_duplicate"))


def op4_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ratings = ordinal.graded(table(spark, sf_dir, "labels")).filter(crc_mod("doc_id", 4) != 2)
    return ordinal.grade(docs, ordinal.learn_grades(docs, ratings)).withColumn("held_out", crc_mod("doc_id", 4) == 2)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_chat(chat.text_parts(rows.unionByName(more))))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 4) != 2)
    scored = toxicity.toxicity(docs, toxicity.learn_toxicity(docs, labels))
    return scored.withColumn("held_out", crc_mod("doc_id", 4) == 2)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.digests(byte_bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.learn_languages(docs)).withColumn("held_out", crc_mod("doc_id", 5) == 0)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).drop("host")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", mixing.taken(F.col("pieces")).alias("taken"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.replay(audit.flags(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    stripped = F.when(crc_mod("doc_id", 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered=stripped)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_suffix_array, op2_media, op3_packing, op4_ordinal, op5_chat, op6_minhash, op7_toxicity, op8_byte_bpe, op9_language, op10_quality_rules,
        op11_mixing, op12_filter_audit, op13_merkle,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op12_filter_audit": sql.filter_audit_sql(), "op13_merkle": sql.merkle_sql()}
