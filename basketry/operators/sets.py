"""Set operations on single columns and on prediction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).select(column).distinct()


def not_in(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Distinct values of ``left`` that ``right`` does not have; null is no member."""
    return distinct_values(left, column).join(distinct_values(right, column), column, "left_anti")


def max_per_key(predictions: DataFrame) -> DataFrame:
    """One row per visit and class (and model, if there are several) with the larger probability."""
    return predictions.groupBy(*[c for c in predictions.columns if c != "p"]).agg(F.max("p").alias("p"))
