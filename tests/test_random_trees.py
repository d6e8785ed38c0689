"""Extremely randomised trees: their draws, counts and leaves recounted, and how well they learn."""

import numpy as np
import pytest

from basketry.models import evaluation, random_trees
from basketry.models.classifiers import Params, train_model
from basketry.models.persistence import load_model, save_model
from basketry.models.random_trees import fit_random_trees
from basketry.session import fresh_path
from test_softmax_boosting import made, table


def walk(trees, t, x, visit, node=0, rows=None):
    """Calls ``visit`` with every node of a tree and the rows that reach it."""
    rows = np.arange(len(x)) if rows is None else rows
    visit(node, rows)
    f = trees.feature[t, node]
    if f >= 0:
        below = x[rows, f] <= trees.cut[t, node]
        walk(trees, t, x, visit, trees.left[t, node], rows[below])
        walk(trees, t, x, visit, trees.right[t, node], rows[~below])


def test_nodes_split_inside_their_own_range_and_leaves_hold_class_shares(spark):
    x, y = made(200, noise=0.2)
    model = fit_random_trees(table(spark, x, y), n_trees=5, depth=4, min_rows=3)
    (trees, shares), = model.groups
    k = np.searchsorted(model.classes, y)
    for t in range(5):

        def visit(node, rows, t=t):
            f = trees.feature[t, node]
            assert len(rows) >= 3
            if f >= 0:
                assert x[rows, f].min() <= trees.cut[t, node] < x[rows, f].max() and trees.gain[t, node] == len(rows)
            else:
                assert np.allclose(shares[t, node], np.bincount(k[rows], minlength=3) / len(rows))

        walk(trees, t, x, visit)
    got = {r.visit_number: r.p for r in model.with_probability(table(spark, x, y), "p").collect()}
    assert np.allclose([got[i] for i in range(200)], model.votes(x) / 5)
    assert np.allclose([sum(p) for p in got.values()], 1) and sum(model.importances()) == pytest.approx(1)


def test_the_purest_draw_wins(spark):
    x, y = made(150, noise=0.1)
    model = fit_random_trees(table(spark, x, y), n_trees=30, depth=1, draws=4)
    (trees, _), = model.groups
    assert (trees.feature[:, 0] >= 0).all()
    assert trees.feature[:, 0].tolist().count(3) <= 3  # it explains nothing; a draw at random would win seven or eight times


def test_seeds_and_trees_differ_in_their_cuts(spark):
    x, y = made(150)
    train = table(spark, x, y)
    first, again, other = (fit_random_trees(train, 4, 2, seed=s) for s in (1, 1, 2))
    cuts = [m.groups[0][0].cut[:, 0].tolist() for m in (first, again, other)]
    assert cuts[0] == cuts[1] and not set(cuts[0]) & set(cuts[2]) and len(set(cuts[0])) == 4


def test_groups_and_many_passes_give_the_same_trees(spark, monkeypatch):
    x, y = made(120, noise=0.1)
    train = table(spark, x, y)
    whole = fit_random_trees(train, 3, 2)
    monkeypatch.setattr(random_trees, "TREES_AT_ONCE", 2)
    monkeypatch.setattr(random_trees, "CELLS", 1)
    parts = fit_random_trees(train, 3, 2)
    assert len(parts.groups) == 2 and np.allclose(parts.votes(x), whole.votes(x))


def test_learns_nearly_as_well_as_a_forest(spark):
    x, y = made(900, seed=2, noise=0.1)
    train, held = table(spark, x[:600], y[:600]), table(spark, x[600:], y[600:], 600)
    params = Params(n_est=40, max_depth=14)
    random, forest = (evaluation.model_loss(train_model(k, train, params), held).first()[0] for k in ("ET", "RF"))
    assert random < 0.5 * np.log(3) and random < 1.6 * forest


def test_saved_and_loaded(spark):
    x, y = made(60)
    train = table(spark, x, y)
    model = fit_random_trees(train, 3, 3)
    path = fresh_path(spark, "random-trees")
    save_model(spark, model, path)
    loaded = load_model(spark, path)
    assert np.allclose(loaded.votes(x), model.votes(x)) and loaded.classes == model.classes


def test_odd_tables(spark):
    x, y = made(40)
    partly = fit_random_trees(table(spark, x, [None if i % 4 == 0 else v for i, v in enumerate(y)]), 2, 3)
    assert partly.n_trees == 2
    one = fit_random_trees(table(spark, x, [5] * 40), 2, 3)
    assert np.allclose(one.votes(x), 2)
    constant = fit_random_trees(table(spark, np.ones((20, 2)), [3, 7] * 10), 2, 3)
    assert np.allclose(constant.votes(np.ones((1, 2))) / 2, 0.5) and constant.importances() == [0, 0]
    with pytest.raises(ValueError, match="no labelled visits"):
        fit_random_trees(table(spark, x, [None] * 40), 2, 3)
