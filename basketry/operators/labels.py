"""Class tables: class value to 0..k-1 in numeric order, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CLASSES = 1_000


def class_values(labels: DataFrame, column: str = "trip_type") -> list[int]:
    """The sorted distinct classes, which every model keeps with it. A label with too many values is refused."""
    rows = labels.filter(F.col(column).isNotNull()).groupBy(column).count().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{column} has more than {MAX_CLASSES} values and is no class label")
    return sorted(r[0] for r in rows)


def class_index(column: str, classes: list[int]) -> Column:
    """0-based position of a class; null for a class that was not seen in training."""
    return F.nullif(F.array_position(F.array(*map(F.lit, classes)), F.col(column)), F.lit(0)).cast("int") - 1


def class_at(index: Column, classes: list[int]) -> Column:
    return F.get(F.array(*map(F.lit, classes)), index)


def per_class(visits: DataFrame, classes: list[int]) -> DataFrame:
    """One row per visit and class. The classes are literals of the plan, so nothing is joined."""
    return visits.withColumn("trip_type", F.explode(F.array(*map(F.lit, classes))))
