"""The registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import (
    centroids, decontamination, line_dedup, near_duplicates, packing, periodic_runs, pii, quality_rules, repeated_bytes, rule_ensemble, sentence_spans, sql,
    toxicity, warc,
)
from basketry.llm.tables import read_table


def op1_quality_rules(spark: SparkSession, directory: str) -> DataFrame:
    ledger = quality_rules.evaluate(read_table(spark, directory, "documents"))
    rows = quality_rules.decide(ledger, (quality_rules.POLICIES[0], quality_rules.CURRENT))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~F.col("kept_base")).alias("base_failed"), F.col(f"kept_{quality_rules.CURRENT.name}").alias("kept"), "failed",
    )


def op2_repeated_bytes(spark: SparkSession, directory: str) -> DataFrame:
    return repeated_bytes.clean(read_table(spark, directory, "documents")).drop("kept")


def op3_pii(spark: SparkSession, directory: str) -> DataFrame:
    return pii.find(read_table(spark, directory, "documents"))


def op4_minhash(spark: SparkSession, directory: str) -> DataFrame:
    return near_duplicates.classes(read_table(spark, directory, "documents"))


def op5_decontamination(spark: SparkSession, directory: str) -> DataFrame:
    found = decontamination.matches(read_table(spark, directory, "documents"), read_table(spark, directory, "benchmark"))
    return found.select("doc_id", "item_id", "score")


def op6_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    return toxicity.scores(read_table(spark, directory, "documents"), read_table(spark, directory, "labels"))


def op7_line_dedup(spark: SparkSession, directory: str) -> DataFrame:
    cleaned = line_dedup.clean(read_table(spark, directory, "documents"), min_chars=line_dedup.ALL_LINES)
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_warc(spark: SparkSession, directory: str) -> DataFrame:
    records = warc.round_trip(read_table(spark, directory, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_sentence_spans(spark: SparkSession, directory: str) -> DataFrame:
    cleaned = sentence_spans.clean(read_table(spark, directory, "documents"))
    return cleaned.select("doc_id", "n_sentences", "n_removed", "n_spans", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_best_fit_packing(spark: SparkSession, directory: str) -> DataFrame:
    return packing.pack(read_table(spark, directory, "documents"))


def op11_rule_ensemble(spark: SparkSession, directory: str) -> DataFrame:
    return rule_ensemble.scores(read_table(spark, directory, "documents"), read_table(spark, directory, "labels"))


def op12_bisector_tournament(spark: SparkSession, directory: str) -> DataFrame:
    return centroids.clusters(read_table(spark, directory, "embeddings"))


def op13_periodic_runs(spark: SparkSession, directory: str) -> DataFrame:
    found = periodic_runs.find(read_table(spark, directory, "documents"), rewrite=True, texts=False)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_repeated_bytes, op3_pii, op4_minhash, op5_decontamination, op6_toxicity, op7_line_dedup, op8_warc, op9_sentence_spans,
        op10_best_fit_packing, op11_rule_ensemble, op12_bisector_tournament, op13_periodic_runs,
    )
}
ORACLES = {"op1_quality_rules": sql.QUALITY_RULES, "op8_warc": sql.WARC, "op12_bisector_tournament": sql.CENTROIDS}
