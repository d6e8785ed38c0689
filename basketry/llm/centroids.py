"""Centroid clustering of integer vectors by a bisector tournament.

Every component x of a vector becomes the integer floor(256 * x). The centroids start as the vectors whose ids have the
smallest hashes; each round assigns all vectors and replaces every non-empty centroid by the exact floor of its vectors' mean.

A vector finds its nearest centroid without computing distances: for each pair a < b of centroids the bisecting plane is
precomputed as an integer normal ``c_b - c_a`` and threshold ``|c_b|^2 - |c_a|^2``. The champion, at first centroid 0, meets the
centroids 1, 2, ... in turn; the sign of ``2 x . normal - threshold`` tells which of the two is nearer, and zero favours the
smaller number, so k - 1 sign tests are enough. Only the distance to the winner is computed, exactly.

One pass over the table per round; a task sends one row per centroid (count and sums), so the shuffle grows with the number of
tasks, not of vectors, and a cluster with a third of all rows is summed where its rows lie. The driver holds the centroids,
k vectors. The final assignment is written once and reread for the inertia.

Vectors with another number of components, or with a null, NaN or infinite one, are left out, as are null vectors. A null id
hashes to null and is chosen as a first centroid only after all others; rows of equal id are ordered by their components, and
repeated rows each count. With fewer than k vectors there are as many centroids as vectors; an empty table gives no rows. Integers of any size
are exact (Python integers take over where 64 bits might not do); a distance or inertia beyond a long is null. Further columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.tables import stored

K = 40
ROUNDS = 5
DIMENSIONS = 64
SCALE = 256
SEED = "2"
BLOCK = 2048
SAFE = 1 << 26  # below it, 64 bits hold every sum of a sign test or a distance of up to 256 components
LONGEST = (1 << 63) - 1
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"

Centroids = list[list[int]]


def kept(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    whole = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return whole.where(F.col("v").isNotNull() & (F.size("v") == dimensions) & finite)


def integers(values: np.ndarray) -> np.ndarray:
    """floor(256 * x), as int64 where that is safe and as Python integers otherwise."""
    if not values.size or np.abs(values).max() < SAFE / SCALE - 1:
        return np.floor(SCALE * values).astype(np.int64)
    exact = [int(x) * SCALE if abs(x) >= 2.0**53 else math.floor(SCALE * x) for x in values.ravel().tolist()]
    return np.array(exact, object).reshape(values.shape)


def bisectors(centroids: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The centroids, and for all pairs (a, b) the normals c_b - c_a and thresholds |c_b|^2 - |c_a|^2."""
    small = all(abs(x) < SAFE for c in centroids for x in c)
    points = np.array(centroids, np.int64 if small else object)
    squares = (points * points).sum(axis=1)
    return points, points[None, :, :] - points[:, None, :], squares[None, :] - squares[:, None]


def nearest(vectors: np.ndarray, planes: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The winner of each vector's tournament and its squared distance."""
    points, normals, thresholds = planes
    if vectors.dtype != points.dtype:
        vectors, points, normals, thresholds = (x.astype(object) for x in (vectors, points, normals, thresholds))
    champion = np.zeros(len(vectors), np.int64)
    for challenger in range(1, len(points)):
        normal = normals[champion, challenger]
        projected = np.einsum("nd,nd->n", vectors, normal) if vectors.dtype != object else (vectors * normal).sum(axis=1)
        champion[(2 * projected - thresholds[champion, challenger] > 0).astype(bool)] = challenger
    away = vectors - points[champion]
    return champion, (away * away).sum(axis=1)


def _blocks(batch: pa.RecordBatch, dimensions: int) -> Iterator[tuple[int, np.ndarray]]:
    values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    for at in range(0, len(values), BLOCK):
        yield at, integers(values[at : at + BLOCK])


def moved(vectors: DataFrame, centroids: Centroids) -> Centroids:
    """The centroids after one round over ``kept`` vectors."""
    dimensions = len(centroids[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = bisectors(centroids)
        counts, totals = [0] * len(centroids), [[0] * dimensions for _ in centroids]
        for batch in batches:
            for _, block in _blocks(batch, dimensions):
                winners, _ = nearest(block, planes)
                for c in np.unique(winners).tolist():
                    mine = block[winners == c]
                    counts[c] += len(mine)
                    totals[c] = [t + int(s) for t, s in zip(totals[c], mine.sum(axis=0).tolist(), strict=True)]
        found = [c for c, n in enumerate(counts) if n]
        columns = [pa.array(found, pa.int32()), pa.array([counts[c] for c in found], pa.int64()), pa.array([[str(t) for t in totals[c]] for c in found], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", "sums"])

    def means(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        count = int(rows["n"].sum())
        mean = [str(sum(map(int, column)) // count) for column in zip(*rows["sums"], strict=True)]
        return pd.DataFrame({"cluster": [key[0]], "mean": [mean]})

    partial = vectors.mapInArrow(sums, "cluster int, n long, sums array<string>")
    new = {r["cluster"]: [int(x) for x in r["mean"]] for r in partial.groupBy("cluster").applyInPandas(means, "cluster int, mean array<string>").collect()}
    return [new.get(c, old) for c, old in enumerate(centroids)]


def first_centroids(vectors: DataFrame, k: int = K, seed: str = SEED) -> Centroids:
    """The ``k`` vectors with the smallest hashes of seed and id, in that order."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(rank.asc_nulls_last(), "vec_id", "v").limit(k).collect()
    return [integers(np.array([r["v"]])).tolist()[0] for r in rows]


def fit(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: str = SEED) -> Centroids:
    """The final centroids of ``kept`` vectors."""
    centroids = first_centroids(vectors, k, seed)
    for _ in range(rounds if centroids else 0):
        new = moved(vectors, centroids)
        if new == centroids:  # nothing moves any more
            break
        centroids = new
    return centroids


def assign(vectors: DataFrame, centroids: Centroids) -> DataFrame:
    """(vec_id, cluster, distance) of ``kept`` vectors."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = bisectors(centroids)
        for batch in batches:
            for at, block in _blocks(batch, len(centroids[0])):
                winners, distances = nearest(block, planes)
                far = pa.array([d if d <= LONGEST else None for d in distances.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(block)), pa.array(winners.astype(np.int32)), far], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(rows, "vec_id long, cluster int, distance long")


def clusters(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = table.sparkSession
    vectors = kept(table, id_col, vector_col, dimensions)
    centroids = fit(vectors, k, rounds)
    if not centroids:
        return spark.createDataFrame([], RESULT)
    assigned = stored(assign(vectors, centroids), "clusters")
    whole = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r["cluster"]: r["inertia"] for r in assigned.groupBy("cluster").agg(whole.alias("inertia")).collect()}
    total = None if None in sums.values() else sum(sums.values())

    def as_long(n):
        return None if n is None or n > LONGEST else int(n)

    digests = {c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest() for c in sums}
    facts = spark.createDataFrame([(c, as_long(n), as_long(total), digests[c]) for c, n in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
