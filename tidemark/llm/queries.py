"""The registered queries: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_pairs, conversations, edit_prints, html_text, language, mixing, near_join, packing, phrases, pii, quality_knn, quality_rules, token_counts
from tidemark.llm.common import documents, fold


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)))
    model = language.fit(docs.where(fold("doc_id", 4) != 2))
    return language.identify(docs, model, keep=["doc_id", "held_out"])


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.find(docs, pii.fit(docs), keep=["doc_id"])


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > token_counts.LIMIT)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 5) != 0)
    return quality_knn.classify(docs, quality_knn.fit(docs, labels), keep=["doc_id", "held_out"])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_rules.fit_apply(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=["doc_id"])


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op7_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.link(documents(spark, sf_dir)).selectExpr("id AS doc_id", "class_id", "n_links")


def op8_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_prints.near_classes(edit_prints.fingerprints(documents(spark, sf_dir)))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), keep=["doc_id"])


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=["page_id", "url"])


def damaged(conversations_table: DataFrame) -> DataFrame:
    """The damage of the contract: rows dropped, emptied, without ends, repeated or given to the user."""
    name = "concat(coalesce(CAST(conv_id AS STRING), ' '), ':', coalesce(CAST(turn AS STRING), ' '))"
    rows = conversations_table.selectExpr("conv_id", "turn", "coalesce(role, ' ') AS role", "coalesce(text, ' ') AS text", f"crc32(CAST({name} AS BINARY)) % 20 AS fault")
    return rows.where("fault <> 0").selectExpr(
        "conv_id",
        "turn",
        "IF(fault = 4, 'user', role) AS role",
        "CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text",
        "explode(array_repeat(0, IF(fault = 3, 2, 1))) AS copy",
    ).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    fixed = conversations.repair(damaged(table)).drop("repaired").withColumnRenamed("conv_id", "own")
    every = table.select("conv_id").distinct().join(fixed, F.expr("conv_id <=> own"), "left")
    counts = [f"coalesce({c}, 0) AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.selectExpr("conv_id", *counts, "coalesce(audit, '') AS audit", "coalesce(repaired_sha256, sha2(CAST('' AS BINARY), 256)) AS repaired_sha256")


def op12_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = byte_pairs.encode(documents(spark, sf_dir), path, pattern, keep=["doc_id"])
    return byte_pairs.decode(coded, path, pattern).selectExpr(
        "doc_id",
        "CAST(size(ids) AS BIGINT) AS n_tokens",
        "sha2(CAST(concat_ws(' ', CAST(ids AS ARRAY<STRING>)) AS BINARY), 256) AS ids_sha256",
        "sha2(decoded, 256) AS decoded_sha256",
    )


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_personal_data,
        op3_token_counts,
        op4_quality_classifier,
        op5_quality_rules,
        op6_packing,
        op7_near_join,
        op8_edit_fingerprints,
        op9_source_mix,
        op10_main_text,
        op11_conversation_repair,
        op12_byte_pairs,
        op13_phrases,
    )
}
ORACLES = {"op9_source_mix": mixing.MIX_SQL, "op13_phrases": phrases.COLLOCATIONS_SQL}
