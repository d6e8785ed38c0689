"""Trees over vectors of a vocabulary far wider than any visit: work and rows follow the entries, not the vocabulary."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from basketry.models import evaluation, forests, random_trees
from basketry.models.classifiers import Params, binned_visits, train_model
from basketry.models.softmax_boosting import Cuts, asked, binned_rows, sampled_cuts, spread
from test_softmax_boosting import made, table

WIDE = 1_000_000


def scattered(spark, x, y, first=0):
    """The rows of ``table`` with their features far apart."""
    rows = [(first + i, int(v), Vectors.sparse(WIDE, {250_000 * j + 7: a for j, a in enumerate(r) if a})) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, ["visit_number", "trip_type", "features"]).repartition(3)


@pytest.mark.parametrize(("kind", "params"), [
    ("RF", Params(n_est=4, max_depth=3)), ("ET", Params(n_est=4, max_depth=3)), ("AB", Params(n_est=2, max_depth=3)),
    ("xGB", Params(n_est=2, max_depth=2, learning_rate=0.3, gamma=0.1)),
])
def test_learns_whatever_the_width(spark, kind, params):
    x, y = made(240)
    model = train_model(kind, scattered(spark, x, y), params)
    assert evaluation.model_loss(model, scattered(spark, x, y)).first()[0] < np.log(3)


def test_rows_keep_the_entries_of_splitting_features_alone(spark):
    x, y = made(60)
    x[:, 1] = 5.0  # one value: no cut point
    for rows in (scattered(spark, x, y), table(spark, x, y)):
        cuts = sampled_cuts(rows, 32)
        assert len(cuts.splitting) == 3 and cuts.narrowed().size == 3
        found = binned_rows(rows, None, [3, 7, 11], cuts, np.zeros(3)).collect()
        assert {i for r in found for i in r.idx} == {0, 1, 2}
        _, binned = binned_visits(rows, Params(), [3, 7, 11])
        assert {r.visit_number: (r.idx, r.bin) for r in binned.collect()} == {r.visit_number: (r.idx, r.bin) for r in found}


def test_rows_are_dense_in_the_used_features_only():
    dense = spread(np.array([4, 900_000]), np.array([0, 7]), 2, np.array([0, 0, 1]), np.array([4, 5, 900_000]), np.array([3, 9, 2]))
    assert dense.tolist() == [[3, 7], [0, 2]]
    assert asked([]).tolist() == [] and spread(asked([]), np.zeros(0), 2, *(np.array([0]),) * 3).shape == (2, 0)


def test_best_cut_equals_a_plain_search():
    random = np.random.default_rng(0)
    x, y, w = random.integers(0, 4, (80, 3)), random.integers(0, 3, 80), random.random(80)
    cuts = Cuts(np.array([0, 3, 6, 9]), np.tile([0.5, 1.5, 2.5], 3))

    def gini(rows):
        shares = np.bincount(y[rows], w[rows], 3) / w[rows].sum()
        return w[rows].sum() * (1 - (shares**2).sum())

    every = np.arange(80)
    wanted = max((gini(every) - gini(every[x[:, f] <= c]) - gini(every[x[:, f] > c]), -f, -c) for f in (0, 2) for c in range(3))
    cells = np.zeros((2, 8, 3))
    for place, f in enumerate((0, 2)):
        for r in np.flatnonzero(x[:, f]):  # zeros are not listed
            cells[:, 4 * place + x[r, f], y[r]] += (1, w[r])
    whole = np.bincount(y, minlength=3).astype(float), np.bincount(y, w, 3)
    feature, cut, gain, n_left, left = forests.best_cut(cuts, np.array([0, 2]), *cells, *whole, 3)
    assert (gain * w.sum(), -feature, -cut) == pytest.approx(wanted)
    below = x[:, feature] <= cut
    assert n_left == pytest.approx(below.sum()) and left == pytest.approx(np.bincount(y[below], w[below], 3))


def test_passes_and_groups_give_the_same_forest(spark, monkeypatch):
    x, y = made(120, noise=0.1)
    train = table(spark, x, y)
    first = train_model("RF", train, Params(n_est=3, max_depth=3))
    monkeypatch.setattr(forests, "CELLS", 1)
    monkeypatch.setattr(forests, "TREES_AT_ONCE", 2)
    again = train_model("RF", train, Params(n_est=3, max_depth=3))
    assert first.model.toDebugString.split("\n")[1:] == again.model.toDebugString.split("\n")[1:]


def test_ranges_that_leave_a_task_in_parts_are_the_same(spark, monkeypatch):
    x, y = made(120, noise=0.1)
    train = table(spark, x, y)
    whole = random_trees.fit_random_trees(train, 3, 3)
    monkeypatch.setattr(random_trees, "CELLS", 40)
    parts = random_trees.fit_random_trees(train, 3, 3)
    assert np.allclose(parts.votes(x), whole.votes(x))


@pytest.mark.parametrize("kind", ["RF", "AB"])
def test_a_missing_label_is_refused(spark, kind):
    x, y = made(40)
    labels = [None if i % 5 == 0 else v for i, v in enumerate(y)]
    with pytest.raises(ValueError, match="must not be missing"):
        train_model(kind, table(spark, x, labels), Params(n_est=2, max_depth=3))
