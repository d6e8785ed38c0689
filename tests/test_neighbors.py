"""The pruned neighbour join against brute force; what it visits; the approximate search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.operators import neighbors
from basketry.operators.neighbors import Rows, approximate_neighbours, as_sparse, nearest_neighbours, neighbour_join, recall


def frames(spark, train, queries):
    t = spark.createDataFrame([(i * 3, i % 4, v.tolist()) for i, v in enumerate(train)], "id bigint, label int, vec array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "id bigint, vec array<double>")
    return t, q


def brute(train, queries, k):
    found = {}
    for i, v in enumerate(queries):
        distance = ((train - v) ** 2).sum(axis=1)
        found[i] = [j * 3 for j in sorted(range(len(train)), key=lambda j: (distance[j], j))[:k]]
    return found


def listed(rows):
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.place)):
        got.setdefault(r.query_id, []).append(r.neighbour_id)
    return got


def clustered(n, seed, spread=0.05):
    random = np.random.default_rng(seed)
    return np.random.default_rng(9).normal(0, 5, (12, 6))[random.integers(0, 12, n)] + random.normal(0, spread, (n, 6))


@pytest.mark.parametrize("kind", ["clustered", "whole numbers", "normal", "hot point"])
def test_equals_brute_force_over_cells_and_blocks(spark, kind):
    random = np.random.default_rng(5)
    if kind == "clustered":
        train, queries = clustered(400, 1), clustered(60, 2)
    elif kind == "whole numbers":  # many ties
        train, queries = (random.integers(0, 3, (n, 4)).astype(float) for n in (300, 60))
    elif kind == "hot point":
        train, queries = random.normal(size=(300, 3)), random.normal(size=(60, 3))
        train[::3], queries[::3] = 1.0, 1.0
    else:
        train, queries = random.normal(size=(300, 5)), random.normal(size=(60, 5)) * 3
    t, q = frames(spark, train, queries)
    joined = neighbour_join(t, q, k=9, block_rows=16, pivots=20, cell_rows=16)
    assert listed(joined.neighbours.collect()) == brute(train, queries, 9)


def test_one_block_of_training_rows_gives_the_same(spark):
    train, queries = np.random.default_rng(3).normal(size=(200, 5)), np.random.default_rng(4).normal(size=(50, 5))
    t, q = frames(spark, train, queries)
    assert listed(nearest_neighbours(t, q, 7).collect()) == brute(train, queries, 7)
    assert nearest_neighbours(t.limit(0), q, 7).count() == nearest_neighbours(t, q.limit(0), 7).count() == 0


def test_prunes_most_cells_of_clustered_rows(spark):
    train, queries = clustered(600, 1), clustered(80, 2)
    t, q = frames(spark, train, queries)
    joined = neighbour_join(t, q, k=3, pivots=30, cell_rows=20)
    report = joined.report
    assert report["cells"] == 30 and report["all_visits"] == 80 * 30 and report["train_rows"] == 600
    assert report["home_visits"] + report["more_visits"] < 0.3 * report["all_visits"]
    assert listed(joined.neighbours.collect()) == brute(train, queries, 3)


def test_sparse_rows_of_very_many_features(spark):
    random = np.random.default_rng(7)
    rows = [(i, i % 3, sorted(random.choice(10**9, 5, replace=False).tolist()), random.normal(size=5).tolist()) for i in range(100)]
    rows += [(1000 + i, 1, r[2], [v + 0.01 for v in r[3]]) for i, r in enumerate(rows[:20])]
    t = spark.createDataFrame(rows, "id bigint, label int, idx array<int>, val array<double>")
    joined = neighbour_join(t, t.drop("label"), k=2, cell_rows=10).neighbours.collect()
    assert all({r.neighbour_id for r in joined if r.query_id == i} == {i, 1000 + i} for i in range(20))


def test_slices_of_columns_give_the_same_products(monkeypatch):
    random = np.random.default_rng(8)
    dense = [np.round(random.normal(size=(n, 40)) * (random.random((n, 40)) < 0.3), 3) for n in (12, 17)]
    a, b = (Rows([np.flatnonzero(r) for r in m], [r[r != 0] for r in m]) for m in dense)
    monkeypatch.setattr(neighbors, "COLUMNS", 3)
    assert np.allclose(neighbors.products(a, b), dense[0] @ dense[1].T)
    rows, cols = (x.ravel() for x in np.meshgrid(np.arange(12), np.arange(17), indexing="ij"))
    assert np.allclose(neighbors.exact_distances(a, b, rows, cols), ((dense[0][rows] - dense[1][cols]) ** 2).sum(axis=1))


def test_odd_tables(spark):
    t, q = frames(spark, np.array([[0.0, 0.0], [0.0, 0.0], [5.0, 0.0]]), np.array([[0.0, 0.0], [9.0, 0.0]]))
    assert listed(neighbour_join(t, q, 5).neighbours.collect()) == {0: [0, 3, 6], 1: [6, 0, 3]}
    assert neighbour_join(t.limit(0), q, 5).neighbours.count() == 0
    assert neighbour_join(t, q.limit(0), 5).neighbours.count() == 0
    assert as_sparse(q).orderBy("id").first()["idx"] == []


def test_approximate_search_and_its_recall(spark):
    train, queries = clustered(500, 1, 0.3), clustered(60, 2, 0.3)
    t, q = frames(spark, train, queries)
    exact = neighbour_join(t, q, 5).neighbours
    near = approximate_neighbours(t, q, 5, width=6.0).cache()
    assert 0.9 <= recall(near, exact) <= 1
    distances = {(r.query_id, r.neighbour_id): r.distance2 for r in near.collect()}
    assert all(abs(d - ((train[j // 3] - queries[i]) ** 2).sum()) < 1e-9 for (i, j), d in distances.items())
    assert recall(approximate_neighbours(t, q, 5, width=0.05, tables=1), exact) < 0.5
    assert near.groupBy("query_id").count().agg(F.max("count")).first()[0] == 5


def test_turns_over_the_cells_give_the_same(spark, monkeypatch):
    """Cells take turns, nearest first, and what is known already leaves out more of the later ones."""
    random = np.random.default_rng(6)
    train, queries = (random.integers(0, 3, (n, 4)).astype(float) for n in (400, 50))
    t, q = frames(spark, train, queries)
    whole = neighbour_join(t, q, k=5, pivots=20, cell_rows=20)
    monkeypatch.setattr(neighbors, "ROUND_VISITS", 50 * 7)
    turns = neighbour_join(t, q, k=5, pivots=20, cell_rows=20)
    assert listed(turns.neighbours.collect()) == listed(whole.neighbours.collect()) == brute(train, queries, 5)
    assert whole.report["rounds"] == 1 < turns.report["rounds"] and turns.report["more_visits"] <= whole.report["more_visits"]


def test_only_nearer_rows_leave_a_block():
    """A query that knows k neighbours takes nothing that is farther than the last of them, nor as far with a higher id."""
    import pandas as pd

    train = pd.DataFrame({"id": [1, 2, 3, 4], "label": [0, 0, 1, 1], "idx": [[0]] * 4, "val": [[1.0], [2.0], [2.0], [9.0]]})
    query = pd.DataFrame({"id": [7], "idx": [np.zeros(0, int)], "val": [np.zeros(0)], "reach2": [4.0], "reach_id": [3]})
    assert neighbors._best(query, train, 4)["neighbour_id"].tolist() == [1, 2]
    assert neighbors._best(query.drop(columns=["reach2", "reach_id"]), train, 4)["neighbour_id"].tolist() == [1, 2, 3, 4]


def test_rare_and_common_columns_give_the_same_products():
    random = np.random.default_rng(8)
    dense = [np.round(random.normal(size=(n, 60)) * (random.random((n, 60)) < np.linspace(0.005, 0.9, 60)), 3) for n in (30, 400)]
    a, b = (Rows([np.flatnonzero(r) for r in m], [r[r != 0] for r in m]) for m in dense)
    assert len(b.by_column().rare) > 0 and len(b.by_column().slices) == 1
    assert np.allclose(neighbors.products(a, b), dense[0] @ dense[1].T)
