"""Aggregates per visit.

Every aggregate combines inside the map tasks before its shuffle, so a visit that holds a large part of all
lines arrives as one partial row per task. Distinct counts group by (visit, value) first, which spreads such a
visit over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry import config
from basketry.functions.columns import (
    DEPARTMENT,
    FINELINE,
    VISIT,
    in_set,
    purchased,
    ratio,
    return_flag,
    returned,
    weekend_flag,
)
from basketry.operators.clean import nonempty_lines
from basketry.operators.joins import lookup_join


def scalar_aggregates() -> dict[str, Column]:
    return {
        "day_type": F.max(weekend_flag()),
        "total_unique_items": F.count_distinct("upc"),
        "total_dept_visit": F.count_distinct(DEPARTMENT),
        "total_fineline_visit": F.count_distinct(FINELINE),
        "total_purchase": F.sum(purchased()),
        "total_return": F.sum(returned()),
        "return_visit": return_flag(F.sum("scan_count")),
    }


def visit_aggregates(lines: DataFrame, *names: str) -> DataFrame:
    """The named scalar features (all of them if none is named) from a single aggregate."""
    known = scalar_aggregates()
    return (
        nonempty_lines(lines)
        .groupBy(VISIT)
        .agg(*[known[n].alias(n) for n in (names or known)])
    )


def item_count(lines: DataFrame) -> DataFrame:
    return lines.groupBy(VISIT).agg(F.count("upc").alias("item_count"))


def visit_labels(lines: DataFrame) -> DataFrame:
    return nonempty_lines(lines).groupBy(VISIT).agg(F.max("trip_type").alias("trip_type"))


def label_conflicts(lines: DataFrame) -> DataFrame:
    """Visits whose lines disagree about the class; must be empty."""
    return lines.groupBy(VISIT).agg(F.min("trip_type").alias("low"), F.max("trip_type").alias("high")).filter("low <> high")


def scan_sum(lines: DataFrame) -> DataFrame:
    return lines.groupBy(VISIT).agg(F.sum("scan_count").alias("scan_sum"))


def group_shares(lines: DataFrame, groups: dict[str, list[str]] = config.DEPARTMENT_GROUPS) -> DataFrame:
    """Share of a visit's lines per department group. Groups may overlap, so each is its own condition."""
    shares = [ratio(F.sum(in_set(DEPARTMENT, members)), F.count(F.lit(1))).alias(name) for name, members in groups.items()]
    return nonempty_lines(lines).groupBy(VISIT).agg(*shares)


def value_shares(lines: DataFrame, column: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """Share of a visit's lines per value, in long form; a pair that is absent has share zero.

    With a vocabulary only its values are reported, still as shares of all the visit's lines.
    """
    pairs = nonempty_lines(lines).groupBy(VISIT, column).agg(F.count(F.lit(1)).alias("n"))
    totals = Window.partitionBy(VISIT)
    shares = pairs.select(VISIT, column, ratio("n", F.sum("n").over(totals)).alias("share")).filter(F.col(column).isNotNull())
    return shares if vocabulary is None else lookup_join(shares, vocabulary.select(column), [column], derived=True)


def empty_visits(lines: DataFrame) -> DataFrame:
    """Visits without a single known department."""
    return lines.groupBy(VISIT).agg(F.count(DEPARTMENT).alias("n")).filter("n = 0").select(VISIT)


def nonempty_visits(lines: DataFrame) -> DataFrame:
    return nonempty_lines(lines).select(VISIT).distinct()


def empty_visits_by_difference(lines: DataFrame) -> DataFrame:
    """The same set as an anti join of the visits with an unknown department against the visits with a known one."""
    unknown = lines.filter(F.col(DEPARTMENT).isNull()).select(VISIT).distinct()
    return unknown.join(nonempty_visits(lines), VISIT, "left_anti")


def return_visits(lines: DataFrame) -> DataFrame:
    return scan_sum(lines).filter("scan_sum <= 0")


def all_items(lines: DataFrame) -> DataFrame:
    return nonempty_lines(lines).groupBy(VISIT).agg(F.sum(F.abs("scan_count")).alias("total_all_items"))


def fineline_zero(lines: DataFrame) -> DataFrame:
    """1 for a visit whose finelines add up to zero."""
    total = F.coalesce(F.sum(FINELINE), F.lit(0))
    return lines.groupBy(VISIT).agg(F.when(total == 0, 1).otherwise(0).alias("all_fineline_zero"))


def lines_per_visit(lines: DataFrame) -> DataFrame:
    return nonempty_lines(lines).groupBy(VISIT).agg(F.count("scan_count").alias("total_purchased"))


def returned_items(lines: DataFrame) -> DataFrame:
    """Number of returned lines and whether there is one."""
    n = F.count_if(F.col("scan_count") < 0)
    return (
        nonempty_lines(lines)
        .groupBy(VISIT)
        .agg(n.alias("returned_lines"), (n > 0).cast("int").alias("has_return"), F.count_if(F.col("scan_count") > 0).alias("purchased_lines"))
    )


def dominant_department(lines: DataFrame, group: list[str], name: str = "group_share") -> DataFrame:
    """Per visit and class: the department with most lines (ties by name), its line count, and a group's share."""
    pairs = nonempty_lines(lines).groupBy(VISIT, "trip_type", DEPARTMENT).agg(F.count(F.lit(1)).alias("n"))
    top = F.min(F.struct((-F.col("n")).alias("minus_n"), F.col(DEPARTMENT).alias("dept")))
    grouped = pairs.groupBy(VISIT, "trip_type").agg(
        top.alias("top"),
        ratio(F.sum(F.when(in_set(DEPARTMENT, group) == 1, F.col("n")).otherwise(0)), F.sum("n")).alias(name),
    )
    return grouped.select(
        VISIT, "trip_type", F.col("top.dept").alias("top_department"), (-F.col("top.minus_n")).alias("top_lines"), name
    )
