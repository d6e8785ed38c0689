"""Joins of a large table with a lookup table that has one row per key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.session import materialize

MAX_BROADCAST_BYTES = 64 * 1024 * 1024
HEAVY_SHARE = 1e-4  # a key holding more than this share of the rows is spread over several tasks
SALTS = 1024


def size_in_bytes(df: DataFrame) -> int:
    """Bytes of all values, from one aggregate over the table (nothing but the sum leaves the executors)."""
    width = reduce(
        lambda a, b: a + b,
        [
            F.coalesce(F.octet_length(f.name), F.lit(0)) if isinstance(f.dataType, T.StringType)
            else F.coalesce(F.size(f.name), F.lit(0)) * 32 if isinstance(f.dataType, T.ArrayType)
            else F.lit(8)
            for f in df.schema.fields
        ],
        F.lit(16),
    )
    return df.agg(F.sum(width)).first()[0] or 0


def _common_types(big: DataFrame, lookup: DataFrame, on: list[str]) -> list[T.DataType]:
    """The types in which Spark compares the keys of both sides."""
    return [
        big.sparkSession.range(1).select(F.coalesce(F.lit(None).cast(big.schema[c].dataType), F.lit(None).cast(lookup.schema[c].dataType)).alias("c")).schema["c"].dataType
        for c in on
    ]


def heavy_keys(keys: DataFrame, share: float) -> list[int]:
    """The values of ``key`` that hold more than this share of the rows.

    The sketch names every such value, but up to ``1 / share`` others as well; those named are counted.
    """
    named = keys.freqItems(["key"], share).first()[0]
    if not named:
        return []
    counts = keys.groupBy(F.when(F.col("key").isin(list(named)), F.col("key")).alias("key")).agg(F.count(F.lit(1)).alias("n")).collect()
    bound = share * sum(r["n"] for r in counts)
    return sorted(r["key"] for r in counts if r["key"] is not None and r["n"] > bound)


def lookup_join(
    big: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "inner",
    derived: bool = False,
    row_bytes: int | None = None,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    heavy_share: float = HEAVY_SHARE,
    salts: int = SALTS,
    keys_from: DataFrame | None = None,
) -> DataFrame:
    """Join on keys that are unique in ``lookup``.

    A lookup table of checked size is broadcast. A larger one is joined by shuffle, and the keys that hold a
    large share of ``big`` are split: their rows get a salt computed from the row itself, so a retried task
    computes the same one, and the few matching lookup rows are repeated once per salt. Where no key is large the
    join is by the keys alone, so that a later aggregate per key needs no shuffle of its own.

    ``derived``: the lookup is itself computed from large tables; it is written once instead of being computed
    for the check and again for the join. ``row_bytes``: no row is wider than this, so counting rows is enough.
    ``keys_from``: a table with the key columns of all rows of ``big`` that is cheaper to read; large keys are looked for there.
    """
    if derived:
        lookup = materialize(lookup, "lookup")
    if (lookup.count() * row_bytes if row_bytes else size_in_bytes(lookup)) <= max_broadcast_bytes:
        return big.join(F.broadcast(lookup), on, how)
    # equal keys of different types hash alike only in one common type
    key = F.xxhash64(*[F.col(c).cast(t) for c, t in zip(on, _common_types(big, lookup, on), strict=True)])
    heavy = heavy_keys((big if keys_from is None else keys_from).select(key.alias("key")), heavy_share)
    if not heavy:
        return big.join(lookup, on, how)
    is_heavy = key.isin(heavy)
    spread = F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int")
    big = big.withColumn("_salt", F.when(is_heavy, spread).otherwise(F.lit(0)))
    copies = F.when(is_heavy, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    lookup = lookup.withColumn("_salt", F.explode(copies))
    return big.join(lookup, [*on, "_salt"], how).drop("_salt")


def join_blocks(first: DataFrame, *others: DataFrame, on: str = "visit_number") -> DataFrame:
    """Inner join of tables that each hold one row per visit."""
    return reduce(lambda a, b: a.join(b, on, "inner"), others, first)
