"""Vocabularies fitted on the training lines: departments, frequent finelines, frequent products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry import config
from basketry.functions.columns import DEPARTMENT, FINELINE
from basketry.operators.clean import exclude_department, nonempty_lines
from basketry.operators.ranking import frequent_values, with_position
from basketry.operators.sets import not_in


def departments(lines: DataFrame) -> DataFrame:
    return nonempty_lines(lines).select(DEPARTMENT).distinct()


def indexed_departments(lines: DataFrame) -> DataFrame:
    return with_position(departments(lines), F.asc(DEPARTMENT), name="feature_idx")


def frequent(
    lines: DataFrame, column: str, more_than: int, excluded_department: str | None = config.EXCLUDED_DEPARTMENT
) -> DataFrame:
    """Values on more than ``more_than`` lines outside the excluded department (``None``: over all lines)."""
    kept = lines if excluded_department is None else exclude_department(lines, excluded_department)
    return frequent_values(kept, column, more_than)


def indexed_frequent(lines: DataFrame, column: str, more_than: int, excluded_department: str | None) -> DataFrame:
    """Frequent values numbered in text order."""
    values = frequent(lines, column, more_than, excluded_department)
    return with_position(values, F.asc(F.col(column).cast("string")), name="feature_idx")


def finelines_shared_with_test(
    train: DataFrame,
    test: DataFrame,
    more_than: int = config.SHARE_FINELINE_COUNT,
    excluded_department: str = config.EXCLUDED_DEPARTMENT,
) -> DataFrame:
    """Frequent training finelines without those that never occur in the test lines."""
    absent = not_in(train, test, FINELINE)
    return frequent(train, FINELINE, more_than, excluded_department).join(absent, FINELINE, "left_anti")
