"""Column expressions shared by the operators. All of them stay inside generated code; none is a UDF."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from basketry import config

VISIT = "visit_number"
DEPARTMENT = "department_description"
FINELINE = "fineline_number"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def weekday_number(day: str | Column = "weekday") -> Column:
    """Day name to 1..7 with Monday first; an unknown name gives null."""
    number = F.lit(None).cast("int")
    for name, n in config.WEEKDAYS.items():
        number = F.when(col(day) == name, F.lit(n)).otherwise(number)
    return number


def weekend_flag(day: str | Column = "weekday") -> Column:
    return (weekday_number(day) > config.LAST_WORKDAY).cast("int")


def purchased(count: str | Column = "scan_count") -> Column:
    return F.greatest(col(count), F.lit(0))


def returned(count: str | Column = "scan_count") -> Column:
    return F.greatest(-col(count), F.lit(0))


def return_flag(net: str | Column) -> Column:
    """A visit that brings back at least as much as it takes is a return visit."""
    return F.when(col(net) <= 0, config.RETURN_VISIT).otherwise(config.PURCHASE_VISIT)


def in_set(c: str | Column, members: Iterable[str]) -> Column:
    """1 where the value is in the set, else 0; null counts as not in the set."""
    return F.coalesce(col(c).isin(list(members)), F.lit(False)).cast("int")


def ratio(part: str | Column, whole: str | Column) -> Column:
    """Exact double division; null where the whole is zero."""
    return F.try_divide(col(part).cast("double"), col(whole).cast("double"))


def strip_prefix(name: str | Column, prefix: str) -> Column:
    return F.when(col(name).startswith(prefix), F.substring(col(name), len(prefix) + 1, 1 << 20)).otherwise(col(name))


def other_than(c: str | Column, value: str | None) -> Column:
    """True for every value but one; a missing value is also other."""
    return F.lit(True) if value is None else ~col(c).eqNullSafe(F.lit(value))


def clipped(p: str | Column, eps: float = 1e-15) -> Column:
    return F.least(F.greatest(col(p), F.lit(eps)), F.lit(1.0 - eps))


def replace_by(c: str | Column, mapping: dict[str, str]) -> Column:
    """The mapped value, or the value itself where the mapping does not name it."""
    result = col(c)
    for old, new in mapping.items():
        result = F.when(col(c) == old, F.lit(new)).otherwise(result)
    return result


def vector_parts(features: str = "features") -> tuple[Column, Column]:
    """Positions and values of a vector column, sparse or dense, without leaving the JVM."""
    vector = F.unwrap_udt(features)
    dense = F.transform(vector["values"], lambda v, i: i.cast("int"))
    return F.coalesce(vector["indices"], dense), vector["values"]
