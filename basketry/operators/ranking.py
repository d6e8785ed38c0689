"""Positions in a total order, without sending all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.session import materialize


def with_position(df: DataFrame, *order: Column, name: str = "position", start: int = 0) -> DataFrame:
    """Number the rows in sort order; ties are put in order by the other columns, so that none is too large to split.

    The range-sorted rows are written once with their place inside the sort partition; the partition sizes
    (one row per sort partition) then give each partition its first number.
    """
    placed = materialize(df.orderBy(*order, *df.columns).withColumn("_place", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_place", 33).alias("_part")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    in_part = F.col("_place").bitwiseAND((1 << 33) - 1)
    return (
        placed.withColumn("_part", F.shiftright("_place", 33))
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + in_part + start)
        .drop("_part", "_place", "_offset")
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per non-null value."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def value_counts_ranked(df: DataFrame, column: str) -> DataFrame:
    """``value_counts`` with the place of each value, most frequent first and ties by value."""
    return with_position(value_counts(df, column), F.desc("n"), F.asc(column), name="place", start=1)


def frequent_values(df: DataFrame, column: str, more_than: int) -> DataFrame:
    return value_counts(df, column).filter(F.col("n") > more_than)


def first_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of a stated order, as partial top-n per task and one merge."""
    return df.orderBy(*order).limit(n)
