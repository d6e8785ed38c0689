"""Exact order statistics of columns of any length.

Every rank is enclosed by two values of the column. Rounds of one aggregate each narrow the open interval
between them with approximate percentiles, check it by exact counts, and stop when few enough rows lie inside to
sort them. Only interval bounds and counts reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000


@dataclass
class Interval:
    """``low`` and ``high`` are values of the column, or None for no bound.

    ``below`` rows are < low, ``inside`` rows lie strictly between the bounds.
    """

    column: str
    rank: int
    low: object = None
    high: object = None
    below: int = 0
    at_low: int = 0
    inside: int = 0
    at_high: int = 0

    @property
    def holds(self) -> bool:
        return self.below <= self.rank < self.below + self.at_low + self.inside + self.at_high

    @property
    def answer(self):
        if 0 <= self.rank - self.below < self.at_low:
            return self.low
        return self.high if self.inner_rank >= self.inside else None

    @property
    def inner_rank(self) -> int:
        return self.rank - self.below - self.at_low

    def contains(self):
        c = F.col(self.column)
        inside = c.isNotNull()
        inside = inside if self.low is None else inside & (c > F.lit(self.low))
        return inside if self.high is None else inside & (c < F.lit(self.high))


def _measured(df: DataFrame, bounds: list[tuple[str, int, object, object]]) -> list[Interval]:
    """Exact counts for proposed bounds, all in one aggregate."""
    counts = []
    for column, _, low, high in bounds:
        c, lo, hi = F.col(column), F.lit(low), F.lit(high)
        counts += [
            F.count_if(c < lo),
            F.count_if(c == lo),
            F.count_if((c > lo) & (c < hi)),
            F.count_if((c == hi) & (hi > lo)),
        ]
    row = df.agg(*[e.alias(f"c{i}") for i, e in enumerate(counts)]).first()
    return [Interval(c, r, lo, hi, *row[4 * i : 4 * i + 4]) for i, (c, r, lo, hi) in enumerate(bounds)]


def _narrowed(df: DataFrame, wide: list[Interval], margin: float) -> list[Interval]:
    """Closer bounds; an interval stays as it is if the proposal turns out not to hold its rank."""
    proposals = []
    for i in wide:
        at = i.inner_rank / i.inside
        probs = [max(0.0, at - margin), min(1.0, (i.inner_rank + 1) / i.inside + margin)]
        proposals.append(F.percentile_approx(F.when(i.contains(), F.col(i.column)), probs, ACCURACY))
    found = df.agg(*[e.alias(f"p{n}") for n, e in enumerate(proposals)]).first()
    closer = _measured(df, [(i.column, i.rank, *found[n]) for n, i in enumerate(wide)])
    return [new if new.holds else old for old, new in zip(wide, closer, strict=True)]


def _sorted_inside(df: DataFrame, intervals: list[Interval]) -> list:
    """Answers for intervals that are small: count per value, running sum, first value beyond the rank."""
    spans = {(i.column, i.low, i.high): i for i in intervals}
    number = {span: n for n, span in enumerate(spans)}
    values = F.array_compact(
        F.array(
            *[
                F.when(i.contains(), F.struct(F.lit(number[s]).alias("span"), F.col(i.column).cast("double").alias("v")))
                for s, i in spans.items()
            ]
        )
    )
    counts = df.select(F.inline(values)).groupBy("span", "v").agg(F.count(F.lit(1)).alias("n"))
    numbered = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("span").orderBy("v")))
    picks = [
        F.min(F.when((F.col("span") == number[(i.column, i.low, i.high)]) & (F.col("upto") > i.inner_rank), F.col("v")))
        for i in intervals
    ]
    return list(numbered.agg(*[p.alias(f"v{n}") for n, p in enumerate(picks)]).first())


def order_statistics(
    df: DataFrame, ranks: dict[str, list[int]], sizes: dict[str, int], max_sorted: int = 1_000_000
) -> dict[tuple[str, int], float]:
    """The value at each zero-based rank among the non-null values of each column; ``sizes`` are their numbers."""
    intervals = [Interval(c, r, inside=sizes[c]) for c, rs in ranks.items() for r in rs]
    margin = 3 / ACCURACY
    while wide := [i for i in intervals if i.answer is None and i.inside > max_sorted]:
        closer = dict(zip(map(id, wide), _narrowed(df, wide, margin), strict=True))
        if any(closer[id(i)] is i for i in wide):
            margin *= 4
        intervals = [closer.get(id(i), i) for i in intervals]
    small = [i for i in intervals if i.answer is None]
    inner = dict(zip([(i.column, i.rank) for i in small], _sorted_inside(df, small) if small else [], strict=True))
    return {(i.column, i.rank): float(inner[(i.column, i.rank)] if i.answer is None else i.answer) for i in intervals}


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float], max_sorted: int = 1_000_000) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation between the two neighbouring values."""
    sizes = df.agg(*[F.count(c).alias(c) for c in columns]).first().asDict()
    filled = [c for c in columns if sizes[c]]
    ranks = {c: sorted({f(p * (sizes[c] - 1)) for p in probs for f in (floor, ceil)}) for c in filled}
    at = order_statistics(df, ranks, sizes, max_sorted) if filled else {}

    def quantile(c: str, p: float) -> float:
        h = p * (sizes[c] - 1)
        low, high = at[(c, floor(h))], at[(c, ceil(h))]
        return low + (high - low) * (h - floor(h))

    return {c: [quantile(c, p) if c in filled else None for p in probs] for c in columns}
