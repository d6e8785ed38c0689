"""Cleaning of scan lines: filters, fills, casts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry import config
from basketry.functions.columns import DEPARTMENT, FINELINE, other_than, replace_by, weekday_number, weekend_flag


def nonempty_lines(lines: DataFrame) -> DataFrame:
    """Lines with a known department; only these carry features."""
    return lines.filter(F.col(DEPARTMENT).isNotNull())


def with_day(lines: DataFrame) -> DataFrame:
    return lines.withColumn("weekday", weekday_number()).withColumn("day", (F.col("weekday") > config.LAST_WORKDAY).cast("int"))


def with_weekend(lines: DataFrame) -> DataFrame:
    return lines.withColumn("day", weekend_flag())


def rows_with_nulls(df: DataFrame) -> DataFrame:
    return df.filter(reduce(or_, [F.col(c).isNull() for c in df.columns]))


def fill_constants(
    lines: DataFrame, fineline: int = config.MISSING_FINELINE, upc: int = config.MISSING_UPC
) -> DataFrame:
    return lines.na.fill({DEPARTMENT: config.MISSING_DEPARTMENT, FINELINE: fineline, "upc": upc, "scan_count": 0})


def cast_ids(lines: DataFrame) -> DataFrame:
    return lines.withColumns(
        {
            "visit_number": F.col("visit_number").cast("bigint"),
            "upc": F.col("upc").cast("bigint"),
            FINELINE: F.col(FINELINE).cast("bigint"),
            "scan_count": F.col("scan_count").cast("int"),
        }
    )


def other_fineline(
    lines: DataFrame,
    fineline: int = 0,
    other_class: int = config.OTHER_CLASS,
    department: str = config.FINANCIAL_DEPARTMENT,
) -> DataFrame:
    """Lines of one fineline outside the catch-all class and outside one department."""
    return lines.filter(
        (F.col(FINELINE) == fineline) & (F.col("trip_type") != other_class) & other_than(DEPARTMENT, department)
    )


def exclude_department(lines: DataFrame, department: str = config.EXCLUDED_DEPARTMENT) -> DataFrame:
    return nonempty_lines(lines).filter(F.col(DEPARTMENT) != department)


def merge_departments(lines: DataFrame, merges: dict[str, str] = config.MERGED_DEPARTMENTS) -> DataFrame:
    return lines.withColumn(DEPARTMENT, replace_by(DEPARTMENT, merges))


def drop_columns(lines: DataFrame, *columns: str) -> DataFrame:
    return lines.drop(*columns)


def conform_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these columns in this order; a column that is missing is filled with zero."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(0).alias(c) for c in columns])
