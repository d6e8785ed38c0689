"""How often large inputs are read and dealt: what grows beyond its input on large tables."""

import numpy as np
from pyspark.sql import functions as F

from basketry.catalog import base
from basketry.operators import neighbors, profile
from basketry.operators.joins import heavy_keys, lookup_join
from conftest import SMALL


def counted(df, column):
    """The rows, with a counter of how often any of them is computed."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    @F.udf(df.schema[column].dataType)
    def passed(value):
        seen.add(1)
        return value

    return df.withColumn(column, passed(column)), seen


def test_only_keys_that_are_counted_as_heavy_are_salted(spark):
    keys = spark.range(30_000).select(F.when(F.col("id") % 4 == 0, F.lit(-1)).otherwise(F.col("id") % 20_000).alias("key"))
    assert heavy_keys(keys, 0.01) == [-1]
    assert heavy_keys(keys.where("key >= 0"), 0.01) == []
    assert heavy_keys(keys.where("key < -1"), 0.01) == []


def test_a_join_without_heavy_keys_stays_dealt_by_its_keys(spark):
    big = spark.range(30_000).select(F.col("id").alias("row"), (F.col("id") % 20_000).alias("k"))
    lookup = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    joined = lookup_join(big, lookup, ["k"], max_broadcast_bytes=0, heavy_share=0.01)
    assert "_salt" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert joined.agg(F.sum("v")).first()[0] == big.agg(F.sum(F.col("k") * 2)).first()[0] and joined.count() == 30_000


def test_heavy_keys_may_be_looked_for_in_a_cheaper_table(spark):
    big, seen = counted(spark.range(4_000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k")), "k")
    plain = spark.range(4_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    lookup = spark.range(4_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    joined = lookup_join(big, lookup, ["k"], max_broadcast_bytes=0, heavy_share=0.01, salts=8, keys_from=plain)
    assert seen.value == 0
    assert joined.agg(F.sum("v")).first()[0] == plain.agg(F.sum(F.col("k") * 2)).first()[0]


def test_described_columns_are_computed_once(spark):
    values = np.random.default_rng(3).normal(size=5_000)
    df, seen = counted(spark.createDataFrame([(float(v),) for v in values], "x double"), "x")
    row = profile.describe_numeric(df, ["x"], max_sorted=20).first()
    assert seen.value == 5_000
    assert np.allclose((row.q25, row.q50, row.q75), np.quantile(values, (0.25, 0.5, 0.75)))


def test_written_lines_are_joined_once(spark):
    """A query that reads its lines several times reads them from the folder to which they were written."""
    base.over_lines("read_twice", written=True)(lambda lines: lines.agg(F.sum("scan_count")).union(lines.agg(F.max("scan_count"))))
    try:
        found = base.QUERIES["read_twice"](spark, SMALL)
    finally:
        del base.QUERIES["read_twice"]
    assert found.inputFiles() and all("scan-lines" in f for f in found.inputFiles())
    assert len(found.collect()) == 2


def test_probability_rows_are_dealt_by_their_number(small_lines, monkeypatch):
    whole = base.fixed_probabilities(small_lines)
    n = whole.count()
    monkeypatch.setattr(base, "ROWS_PER_TASK", 1_000)
    dealt = base.fixed_probabilities(small_lines)
    assert dealt.rdd.getNumPartitions() == -(-n // 1_000)
    assert dealt.exceptAll(whole).count() == 0 and dealt.count() == n


def test_neighbours_over_many_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "QUERY_BLOCKS", 2)
    random = np.random.default_rng(7)
    train, queries = random.integers(0, 5, (120, 3)).astype(float), random.integers(0, 5, (200, 3)).astype(float)
    t = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(train)], "id bigint, label int, vec array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "id bigint, vec array<double>")
    got = {}
    for r in neighbors.neighbour_join(t, q, 5, block_rows=16, cell_rows=40).neighbours.orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(r.neighbour_id)
    for i, v in enumerate(queries):
        distance = ((train - v) ** 2).sum(axis=1)
        assert got[i] == sorted(range(120), key=lambda j: (distance[j], j))[:5]
