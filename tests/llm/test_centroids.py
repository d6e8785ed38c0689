"""The bisector tournament against plain distances, and its edge cases."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from basketry.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance int"


def brute(rows, k, rounds, dimensions):
    """Plain Python over exact integers: (vec_id, cluster, distance, cluster_inertia, inertia, digest) per vector."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]

    def order(row):
        return (row[0] is None, hashlib.sha256(f"2:{row[0]}".encode()).hexdigest(), row[1])

    centres = [v for _, v in sorted(kept, key=order)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        mine = [[] for _ in centres]
        for _, v in kept:
            mine[nearest(v)[1]].append(v)
        centres = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else c for m, c in zip(mine, centres, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = {n: sum(d for _, d, c in found if c == n) for _, _, n in found}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, d, c in found]


def same(spark, rows, k=4, rounds=3, dimensions=3):
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    found = centroids.clusters(table, k=k, rounds=rounds, dimensions=dimensions)
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    wanted = brute(exact, k, rounds, dimensions)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, wanted))
    return found


def test_tournament_equals_all_distances():
    random = np.random.default_rng(3)
    for spread in (2, 50, 5000):  # the small spread makes many ties
        vectors = random.integers(-spread, spread + 1, (300, 5))
        points = vectors[random.integers(0, 300, 17)]
        winners, distances = centroids.nearest(vectors, centroids.bisectors(points.tolist()))
        every = ((vectors[:, None] - points[None]) ** 2).sum(axis=2)
        assert (winners == every.argmin(axis=1)).all() and (distances == every.min(axis=1)).all()


def test_python_integers_equal_longs():
    random = np.random.default_rng(4)
    vectors = random.integers(-9, 10, (60, 4))
    small = centroids.nearest(vectors, centroids.bisectors(vectors[:7].tolist()))
    big = centroids.nearest(vectors.astype(object) * 10**30, centroids.bisectors((vectors[:7].astype(object) * 10**30).tolist()))
    assert (small[0] == big[0]).all() and (small[1].astype(object) * 10**60 == big[1]).all()


def test_floor_of_negative_components():
    assert centroids.integers(np.array([[-0.001, 0.0, 0.999 / 256, -1 / 256]])).tolist() == [[-1, 0, 0, -1]]
    assert centroids.integers(np.array([[1e300, -2.0**60, 0.5, -0.001]])).tolist() == [[int(1e300) * 256, -(2**68), 128, -1]]


def test_clusters_equal_brute_force(spark):
    random = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in random.normal(0, 0.05, 3)]) for i in range(120)]
    same(spark, rows)
    same(spark, rows, k=11, rounds=0)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    left_out = [(50, None), (51, []), (52, [1.0, 2.0]), (53, [1.0, 2.0, 3.0, 4.0]), (54, [1.0, None, 2.0]), (55, [nan, 1.0, 1.0]), (56, [1.0, -inf, 1.0])]
    rows = [(1, [0.1, 0.2, 0.3]), (1, [0.1, 0.2, 0.3]), (1, [0.5, -0.2, 0.3]), (None, [0.0, 0.0, 0.0]), (2, [-0.0, 5.0, 1.0])]
    assert same(spark, rows + left_out).count() == 5
    assert same(spark, [(7, [0.0, 0.0, 0.0])] * 9).select("cluster").distinct().count() == 1  # equal centroids: the smallest number
    assert same(spark, rows, k=9).count() == 5  # fewer vectors than centroids
    assert same(spark, left_out).count() == 0
    empty = same(spark, [])
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_values_beyond_a_long(spark):
    rows = [(1, [1e30, 0.0, 0.0]), (2, [-1e30, 0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, [2.0, 0.0, 0.0])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    found = {r.vec_id: r for r in centroids.clusters(table, k=1, rounds=1, dimensions=3).collect()}
    assert all(r.distance is None or r.distance < 2**40 for r in found.values()) and found[1].distance is None and found[1].inertia is None


def test_null_id_is_the_last_choice(spark):
    table = spark.createDataFrame([(None, [9.0], "x", 1), (5, [1.0], "x", 1), (6, [2.0], "x", 1)], SCHEMA)
    assert [9 * 256] not in centroids.first_centroids(centroids.kept(table, dimensions=1), 2)
    assert centroids.kept(table.withColumn("embedding", F.lit(None).cast("array<float>")), dimensions=1).count() == 0
