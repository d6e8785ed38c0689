"""Long-form encodings: one row per visit and value instead of one column per value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry import config
from basketry.functions.columns import DEPARTMENT, FINELINE, VISIT
from basketry.operators.clean import merge_departments, nonempty_lines
from basketry.operators.joins import lookup_join


def onehot_lines(lines: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """One entry of value 1 per line with a department of the vocabulary."""
    known = lookup_join(nonempty_lines(lines), vocabulary.select(DEPARTMENT, "feature_idx"), [DEPARTMENT])
    return known.select(*lines.columns, "feature_idx", F.lit(1.0).alias("value"))


def dept_line_counts(lines: DataFrame, merges: dict[str, str] = config.MERGED_DEPARTMENTS) -> DataFrame:
    merged = merge_departments(nonempty_lines(lines), merges)
    return merged.groupBy(VISIT, DEPARTMENT).agg(F.count(F.lit(1)).alias("n_lines"))


def dept_line_counts_wide(lines: DataFrame, vocabulary: list[str], merges: dict[str, str]) -> DataFrame:
    """The same counts as columns, for a vocabulary that is given and short."""
    merged = merge_departments(nonempty_lines(lines), merges)
    return merged.groupBy(VISIT).pivot(DEPARTMENT, vocabulary).count().na.fill(0)


def dept_scan_counts(lines: DataFrame) -> DataFrame:
    return nonempty_lines(lines).groupBy(VISIT, DEPARTMENT).agg(F.sum("scan_count").alias("scan_sum"))


def value_scan_counts(lines: DataFrame, column: str, vocabulary: DataFrame) -> DataFrame:
    """Net scans per visit and vocabulary value.

    The lines are summed per (visit, value) first, so the join sees each pair once however often it was scanned.
    """
    pairs = (
        nonempty_lines(lines)
        .filter(F.col(column).isNotNull())
        .groupBy(VISIT, column)
        .agg(F.sum("scan_count").alias("scan_sum"))
    )
    return lookup_join(pairs, vocabulary.select(column), [column], derived=True)


def value_line_counts(lines: DataFrame, column: str, vocabulary: DataFrame) -> DataFrame:
    """Lines per visit and vocabulary value. Pass only the lines that should count."""
    pairs = lines.filter(F.col(column).isNotNull()).groupBy(VISIT, column).agg(F.count(F.lit(1)).alias("n_lines"))
    return lookup_join(pairs, vocabulary.select(column), [column], derived=True)


def tfidf_lines(lines: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """TF-IDF per line. A line has one department, so after L2 scaling its weight is always 1."""
    return onehot_lines(lines, vocabulary).withColumnRenamed("value", "tfidf")


def tfidf_visits(lines: DataFrame) -> DataFrame:
    """Sublinear TF-IDF over the departments of a visit, scaled to length 1."""
    tf = nonempty_lines(lines).groupBy(VISIT, DEPARTMENT).agg((1 + F.log(F.count(F.lit(1)).cast("double"))).alias("tf"))
    n_visits = nonempty_lines(lines).agg(F.count_distinct(VISIT).cast("double")).scalar()
    idf = tf.groupBy(DEPARTMENT).agg(F.count(F.lit(1)).cast("double").alias("df"))
    idf = idf.select(DEPARTMENT, (F.log((1 + n_visits) / (1 + F.col("df"))) + 1).alias("idf"))
    weights = lookup_join(tf, idf, [DEPARTMENT], derived=True).withColumn("w", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(VISIT)))
    return weights.select(VISIT, DEPARTMENT, (F.col("w") / length).alias("tfidf"))
