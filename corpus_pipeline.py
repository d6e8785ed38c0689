"""A corpus pipeline: five stages over the documents table, each written and read again by the next.

1. quality: documents that the current policy of the rule ledger rejects go.
2. lines: lines that are copies or near copies of an earlier line go; a document all of whose words went with them goes.
3. near_duplicates: one document of each class stays, that with the smallest id.
4. decontamination: documents that hold a benchmark passage go.
5. packing: the rest is packed; the result has a row per piece.

Learned and sampled steps (MinHash bands, tokenizer files) have no SQL, so there is no ORACLE_SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import decontamination, line_dedup, near_duplicates, packing, quality_rules
from basketry.llm.tables import read_table
from basketry.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    policy = quality_rules.CURRENT
    ledger = quality_rules.decide(quality_rules.evaluate(docs.select(*COLUMNS), carry=True), (policy,))
    return ledger.where(f"kept_{policy.name}").select(*[f"row.{c}" for c in COLUMNS])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; ``n_chars`` follows the text. Untouched documents stay as they are."""
    cleaned = line_dedup.clean(docs.select(*COLUMNS), min_chars=line_dedup.ALL_LINES)
    words_left = F.length(F.translate("text", line_dedup.BLANKS, "")) > 0
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("text")).otherwise(F.col("row.text")).alias("text")
    n_chars = F.when(changed, F.length("text").cast("long")).otherwise(F.col("row.n_chars")).alias("n_chars")
    return cleaned.where(~changed | words_left).select("row.doc_id", text, "row.lang", "row.source", n_chars)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates; of rows with equal id and text one stays."""
    return near_duplicates.keep_one(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontamination.keep_clean(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the sequences."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_copies), ("decontamination", decontaminate), ("packing", best_fit)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
