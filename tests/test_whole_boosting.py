"""Boosting by name takes all rounds, cut points come from all visits, and one task grows the trees that the passes grow."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from basketry.catalog import QUERIES, learning
from basketry.models import softmax_boosting as boosting
from basketry.models.classifiers import Params, gradient_growth, newton_growth
from conftest import SMALL
from test_softmax_boosting import made, table


class Asked(Exception):
    pass


@pytest.mark.parametrize(("name", "growth", "depth"), [("gb_probs", gradient_growth, 7), ("xgb_probs", newton_growth, 8)])
def test_registered_boosting_is_the_whole_run(spark, monkeypatch, name, growth, depth):
    def asked(kind, train, params):
        raise Asked(params)

    monkeypatch.setattr(learning, "train_model", asked)
    with pytest.raises(Asked) as found:
        QUERIES[name](spark, SMALL)
    whole = growth(found.value.args[0])
    assert (whole.rounds, whole.depth) == (200, depth)


def test_cuts_come_from_all_visits(spark):
    n = 10_050
    last = {r[0] for r in spark.range(n).orderBy(F.xxhash64("id").desc()).limit(5).collect()}  # a sample in the order of this hash would not hold them
    rows = [(i, 1, Vectors.sparse(3, {0: float(i % 40), **({2: 1.0} if i in last else {})})) for i in range(n)]
    train = spark.createDataFrame(rows, ["visit_number", "trip_type", "features"])
    cuts = boosting.feature_cuts(train, 32)
    assert cuts.splitting.tolist() == [0, 2] and cuts.value[-1] == 0.5
    listed = [(j, v) for _, _, x in rows for j, v in zip(x.indices.tolist(), x.values.tolist(), strict=True)]
    wanted = boosting.find_cuts(3, *map(np.array, zip(*listed, strict=True)), n, 32)
    assert cuts.start.tolist() == wanted.start.tolist() and cuts.value.tolist() == wanted.value.tolist()


@pytest.mark.parametrize("bins", [2, 4, 32])
def test_cuts_equal_those_of_one_table(spark, bins):
    x, y = made(333, seed=4)
    x[:, 3] = np.abs(x[:, 3]) - 0.5
    cuts = boosting.feature_cuts(table(spark, x, y), bins)
    place, feature = np.nonzero(x)
    wanted = boosting.find_cuts(4, feature, x[place, feature], len(x), bins)
    assert cuts.start.tolist() == wanted.start.tolist() and cuts.value.tolist() == wanted.value.tolist()


@pytest.mark.parametrize("params", [
    Params(n_est=4, max_depth=4, learning_rate=0.5, gamma=1.0, min_rows=1),
    Params(n_est=4, max_depth=1, learning_rate=0.5, gamma=0.0, patience=None),
])
@pytest.mark.parametrize("of", [gradient_growth, newton_growth])
def test_one_task_grows_the_trees_of_the_passes(spark, monkeypatch, params, of):
    x, y = made(260, noise=0.2)
    train, held = table(spark, x[:200], [None if i % 20 == 0 else v for i, v in enumerate(y[:200])]), table(spark, x[200:], y[200:], 200)
    whole = boosting.fit_softmax(train, of(params), held)
    monkeypatch.setattr(boosting, "ONE_TASK", -1)
    passes = boosting.fit_softmax(train, of(params), held)
    assert len(whole.trees) == len(passes.trees)
    for a, b in zip(whole.trees, passes.trees, strict=True):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and np.allclose(a.weight, b.weight)
    for a, b in zip(whole.history, passes.history, strict=True):
        assert [v is None for v in vars(a).values()] == [v is None for v in vars(b).values()]
        assert [v for v in vars(a).values() if v is not None] == pytest.approx([v for v in vars(b).values() if v is not None], abs=1e-9)
