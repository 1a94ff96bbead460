"""The registered queries of this subpackage and their SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sectiva.llm._common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sectiva.llm.substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sectiva.llm.simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sectiva.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sectiva.llm.pieces import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sectiva.llm.line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sectiva.llm.quality_classifier import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sectiva.llm.decontaminate import overlaps

    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sectiva.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sectiva.llm.secrets import secret_scan

    return secret_scan(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sectiva.llm.pii import personal_data, span_string

    found = personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", span_string().alias("spans"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sectiva.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op12_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sectiva.llm.chat import format_conversations

    return format_conversations(table(spark, sf_dir, "conversations"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sectiva.llm.centroids import cluster_report, hamerly_clusters

    return cluster_report(hamerly_clusters(table(spark, sf_dir, "embeddings")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from sectiva.llm import centroids, chat, line_dedup, phrases, quality_rules

    return {"op3_quality_rules": quality_rules.SQL, "op5_line_dedup": line_dedup.SQL, "op11_collocations": phrases.SQL, "op12_chat_trees": chat.SQL, "op13_centroids": centroids.SQL}
