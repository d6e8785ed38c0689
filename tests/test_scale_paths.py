"""The code paths that only large tables take, forced on small ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.operators import profile
from basketry.operators.joins import lookup_join
from basketry.operators.neighbors import nearest_neighbours
from basketry.operators.quantiles import exact_quantiles, order_statistics
from basketry.operators.ranking import with_position


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, how):
    hot = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 500)  # one key holds a third of all rows
    big = spark.range(30_000).select(F.col("id").alias("row"), hot.alias("k"), F.lit("x").alias("kind"))
    lookup = spark.range(400).select(F.col("id").alias("k"), F.lit("x").alias("kind"), (F.col("id") * 2).alias("v"))
    plain = big.join(lookup, ["k", "kind"], how)
    salted = lookup_join(big, lookup, ["k", "kind"], how, max_broadcast_bytes=0, heavy_share=0.01, salts=16)
    assert same(salted, plain)


def test_salted_join_spreads_the_hot_key(spark):
    big = spark.range(8_000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    lookup = spark.range(8_000).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    previous = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        salted = lookup_join(big, lookup, ["k"], max_broadcast_bytes=0, heavy_share=0.01, salts=64)
        hot = salted.filter("k = 7").groupBy(F.spark_partition_id().alias("part")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", previous[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", previous[1])
    assert len(hot) > 4 and max(r["count"] for r in hot) < 0.5 * sum(r["count"] for r in hot)


def test_positions_follow_the_sort_order(spark):
    df = spark.range(5_000).select((F.col("id") * 7919 % 5003).alias("x")).repartition(7)
    got = with_position(df, F.desc("x"), name="place", start=1).orderBy("place").collect()
    values = sorted((r.x for r in got), reverse=True)
    assert [r.place for r in got] == list(range(1, 5001)) and [r.x for r in got] == values


@pytest.mark.parametrize("max_sorted", [20, 1_000_000])
def test_quantiles_are_exact(spark, max_sorted):
    rng = np.random.default_rng(3)
    hot = np.where(rng.random(20_000) < 0.4, 5, rng.integers(-1000, 1000, 20_000))
    data = {"spread": rng.normal(0, 1e6, 20_000), "hot": hot.astype(float), "constant": np.full(20_000, 2.0)}
    df = spark.createDataFrame(list(zip(*[v.tolist() for v in data.values()], strict=True)), list(data))
    probs = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = exact_quantiles(df, list(data), probs, max_sorted)
    for c, values in data.items():
        assert got[c] == pytest.approx(np.quantile(values, probs).tolist(), abs=1e-9), c


def test_order_statistics_of_two_heavy_values(spark):
    df = spark.range(10_000).select(F.when(F.col("id") < 5_000, 1).otherwise(2).alias("x"))
    assert order_statistics(df, {"x": [0, 4_999, 5_000, 9_999]}, {"x": 10_000}, max_sorted=10) == {
        ("x", 0): 1.0, ("x", 4_999): 1.0, ("x", 5_000): 2.0, ("x", 9_999): 2.0,
    }


def test_quantiles_of_an_empty_column(spark):
    df = spark.range(3).select(F.lit(None).cast("double").alias("x"))
    assert exact_quantiles(df, ["x"], [0.5]) == {"x": [None]}


@pytest.mark.parametrize("whole_numbers", [True, False])
def test_neighbours_equal_brute_force_over_many_blocks(spark, whole_numbers):
    rng = np.random.default_rng(5)
    train = rng.integers(0, 4, (150, 3)).astype(float) if whole_numbers else rng.normal(size=(150, 3))
    queries = rng.integers(0, 4, (40, 3)).astype(float) if whole_numbers else rng.normal(size=(40, 3))
    t = spark.createDataFrame([(i * 3, i % 4, v.tolist()) for i, v in enumerate(train)], "id bigint, label int, vec array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "id bigint, vec array<double>")
    found = nearest_neighbours(t, q, k=9, block_rows=16).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.place)):
        got.setdefault(r.query_id, []).append(r.neighbour_id)
    for i, v in enumerate(queries):
        distance = ((train - v) ** 2).sum(axis=1)
        expected = sorted(range(150), key=lambda j: (distance[j], j))[:9]
        assert got[i] == [j * 3 for j in expected]


def test_fewer_training_rows_than_neighbours(spark):
    t = spark.createDataFrame([(1, 0, [0.0]), (2, 1, [5.0])], "id bigint, label int, vec array<double>")
    q = spark.createDataFrame([(1, [4.0])], "id bigint, vec array<double>")
    assert [r.neighbour_id for r in nearest_neighbours(t, q, 5).orderBy("place").collect()] == [2, 1]


def test_histogram_of_a_constant_column_has_one_bin(spark):
    df = spark.range(100).select(F.lit(4).alias("c"), F.col("id").alias("x"))
    bins = {(r.column_name, r.bin): r.n for r in profile.histogram(df, ["c", "x"], 10).collect()}
    assert bins[("c", 5)] == 100 and all(bins[("x", b)] == 10 for b in range(9)) and bins[("x", 9)] == 10


def test_packed_members_refuses_a_long_vocabulary(spark):
    df = spark.range(20).select((F.col("id") % 2).alias("k"), F.col("id").alias("m"))
    with pytest.raises(ValueError, match="members_per"):
        profile.packed_members(df, "k", "m", max_members=5)
    assert profile.members_per(df, "k", "m").count() == 20


def test_a_missing_member_counts_once(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("a", None), ("b", 2), (None, 3)], "k string, m int")
    counts = {r.k: r.n_members for r in profile.distinct_count_per(df, "k", "m").collect()}
    packed = {r.k: (r.n_members, r.members, r.has_missing) for r in profile.packed_members(df, "k", "m").collect()}
    assert counts == {"a": 2, "b": 1} and packed == {"a": (2, "1", 1), "b": (1, "2", 0)}


@pytest.mark.parametrize(("left", "right"), [("int", "bigint"), ("bigint", "int"), ("string", "int"), ("int", "string"), ("smallint", "double"), ("int", "decimal(12,2)")])
def test_salted_join_keeps_heavy_keys_of_other_types(spark, left, right):
    big = spark.range(3000).selectExpr(f"cast(if(id % 3 = 0, 7, id % 50) as {left}) as k", "id")
    lookup = spark.range(40).selectExpr(f"cast(id as {right}) as k", "id * 10 as v")
    plain = big.join(lookup, "k").select("id", "v")
    salted = lookup_join(big, lookup, ["k"], max_broadcast_bytes=0, heavy_share=0.01, salts=16).select("id", "v")
    assert sorted(map(tuple, salted.collect())) == sorted(map(tuple, plain.collect()))
    assert salted.count() > 1000
