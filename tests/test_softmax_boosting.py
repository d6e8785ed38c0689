"""Joint boosting against a plain single-table version, its stopping rule, sampling, saving and edge cases."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from basketry.models import evaluation
from basketry.models import softmax_boosting as boosting
from basketry.models.classifiers import Params, gradient_growth, newton_growth, train_model
from basketry.models.persistence import load_model, save_model
from basketry.models.softmax_boosting import Cuts, Growth, find_cuts, fit_softmax, left_out
from basketry.session import fresh_path


def table(spark, x, y, first=0):
    rows = [(first + i, None if v is None else int(v), [float(a) for a in r]) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "visit_number long, trip_type int, x array<double>")
    return df.select("visit_number", "trip_type", array_to_vector("x").alias("features")).repartition(3)


def made(n, seed=0, noise=0.0):
    random = np.random.default_rng(seed)
    x = np.round(random.normal(size=(n, 4)) * (random.random((n, 4)) < 0.7), 3)
    y = np.where(x[:, 0] > 0.3, 7, np.where(x[:, 1] - x[:, 2] > 0, 3, 11))
    wrong = random.random(n) < noise
    return x, np.where(wrong, random.choice([3, 7, 11], n), y)


def plain(x, y, growth):
    """The same model on one table: every cut of every feature is tried in every node."""
    classes = sorted(set(y))
    k = np.searchsorted(classes, y)
    cuts = [np.unique(c) for c in x.T]
    cuts = [(c[1:] + c[:-1]) / 2 for c in cuts]
    margin = np.zeros((len(x), len(classes)))
    if not growth.newton:
        margin += np.log([np.mean(k == c) for c in range(len(classes))])

    def node(rows, g, h, depth):
        """Row values of the subtree, and whether it is a leaf."""
        value = growth.rate * growth.leaf(g[rows].sum(), h[rows].sum(), len(classes))
        best = (1e-6, None)
        if depth < growth.depth:
            for f, points in enumerate(cuts):
                for point in points:
                    left, right = rows[x[rows, f] <= point], rows[x[rows, f] > point]
                    if min(len(left), len(right)) < growth.min_rows or (growth.newton and min(h[left].sum(), h[right].sum()) < growth.min_hessian):
                        continue
                    gain = sum(s * growth.score(g[r].sum(), h[r].sum(), len(r), len(classes)) for s, r in ((1, left), (1, right), (-1, rows)))
                    if gain > best[0]:
                        best = (gain, (left, right))
        if best[1] is None:
            return {int(r): value for r in rows}, True
        (a, a_leaf), (b, b_leaf) = (node(r, g, h, depth + 1) for r in best[1])
        if growth.newton and a_leaf and b_leaf and best[0] < growth.gamma:
            return {int(r): value for r in rows}, True
        return a | b, False

    losses = []
    for _ in range(growth.rounds):
        p = boosting._softmax(margin)
        step = np.zeros_like(margin)
        for c in range(len(classes)):
            g, h = p[:, c] - (k == c), (2 if growth.newton else 1) * p[:, c] * (1 - p[:, c])
            for r, v in node(np.arange(len(x)), g, h, 0)[0].items():
                step[r, c] = v
        margin += step
        losses.append(float(boosting._losses(margin, k).mean()))
    return boosting._softmax(margin), losses


NEWTON = Growth(rounds=3, depth=3, rate=0.3, gamma=0.4, min_hessian=1.0, max_delta_step=1.0, max_bins=1000, patience=None)
GRADIENT = Growth(rounds=3, depth=2, rate=0.2, newton=False, min_rows=3, max_bins=1000, patience=None)


@pytest.mark.parametrize("growth", [NEWTON, GRADIENT, replace(NEWTON, gamma=0.0, max_delta_step=0.0, min_hessian=0.0, depth=2)])
def test_equals_a_plain_version(spark, growth):
    x, y = made(90, noise=0.1)
    model = fit_softmax(table(spark, x, y), growth)
    wanted, losses = plain(x, y, growth)
    got = {r.visit_number: r.p for r in model.with_probability(table(spark, x, y), "p").collect()}
    assert np.allclose([got[i] for i in range(len(x))], wanted, atol=1e-9)
    assert [r.train_loss for r in model.history] == pytest.approx(losses, abs=1e-9)
    assert sum(model.importances()) == pytest.approx(1)


def test_gamma_prunes_and_leaf_steps_are_bounded(spark):
    x, y = made(120)
    train = table(spark, x, y)
    nodes = [int((fit_softmax(train, replace(NEWTON, rounds=1, gamma=g)).trees[0].feature >= 0).sum()) for g in (0.0, 5.0, 1e9)]
    assert nodes[0] > nodes[1] > nodes[2] == 0
    bounded = fit_softmax(train, replace(NEWTON, rounds=2, max_delta_step=0.25))
    assert max(np.abs(t.weight).max() for t in bounded.trees) <= 0.3 * 0.25 + 1e-12


def test_nodes_beyond_one_pass_and_many_tasks_give_the_same_trees(spark, monkeypatch):
    x, y = made(90, noise=0.1)
    train = table(spark, x, y)
    growth = replace(NEWTON, rounds=1, depth=2)
    whole = fit_softmax(train, growth)
    monkeypatch.setattr(boosting, "CELLS", 1)
    monkeypatch.setattr(boosting, "LANES", 2)
    apart = fit_softmax(train, growth)
    for a, b in zip(whole.trees, apart.trees, strict=True):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and np.allclose(a.weight, b.weight)


def test_stops_by_patience_and_keeps_the_best_round(spark):
    x, y = made(300, noise=0.9)
    train, held = table(spark, x[:200], y[:200]), table(spark, x[200:], y[200:], 200)
    model = fit_softmax(train, Growth(rounds=40, depth=5, rate=0.8, patience=3), held)
    losses = [r.held_loss for r in model.history]
    assert len(losses) == model.best_round + 3 < 40 and len(model.trees) == model.best_round
    assert model.best_score == min(losses) < losses[-1]
    assert evaluation.model_loss(model, held).first()[0] == pytest.approx(model.best_score, abs=1e-9)
    table_of = evaluation.round_losses(spark, model)
    assert table_of.count() == len(losses) and table_of.orderBy("held_loss").first()["round"] == model.best_round


def test_out_of_bag_gain_equals_a_recount(spark):
    x, y = made(200, noise=0.1)
    train = table(spark, x, y)
    params = Params(n_est=3, max_depth=2, learning_rate=0.3)
    model, growth = train_model("GB", train, params), gradient_growth(params)
    for turn, reported in enumerate(model.history):
        out = train.where(left_out(growth, turn))
        assert 60 < out.count() < 140
        losses = [evaluation.model_loss(model.staged(n), out).first()[0] for n in (turn, turn + 1)]
        assert reported.oob_gain == pytest.approx(losses[0] - losses[1], abs=1e-9)
    assert model.history[0].oob_gain > 0 and len({r.oob_gain for r in model.history}) == 3


def test_learns_from_many_rounds(spark):
    x, y = made(1500, seed=2)
    train, held = table(spark, x[:1000], y[:1000]), table(spark, x[1000:], y[1000:], 1000)
    model = train_model("xGB", train, Params(n_est=15, max_depth=3, learning_rate=0.5, gamma=0.1), held)
    losses = [r.held_loss for r in model.history]
    assert losses[-1] < 0.25 * np.log(3) and all(b < a for a, b in zip(losses[:8], losses[1:9], strict=True))


def test_seeds_share_and_sampling(spark):
    x, y = made(150, noise=0.1)
    train = table(spark, x, y)
    params = Params(n_est=2, max_depth=2, learning_rate=0.3, gamma=0.0)
    first, again, other = (train_model("xGB", train, replace(params, seed=s)) for s in (1, 1, 2))
    same = [np.array_equal(a.weight, b.weight) for a, b in zip(first.trees, again.trees, strict=True)]
    assert all(same) and not np.array_equal(first.trees[0].weight, other.trees[0].weight)
    used = [set(t.feature[c][t.feature[c] >= 0]) for t in first.trees for c in range(3)]
    assert all(len(u) <= 2 for u in used)  # half of four features per tree
    assert newton_growth(Params()).max_delta_step == 1 and newton_growth(Params()).min_hessian == 3


def test_saved_and_loaded(spark):
    x, y = made(80)
    train = table(spark, x, y)
    model = train_model("xGB", train, Params(n_est=2, max_depth=2, learning_rate=0.3, gamma=0.0), train.limit(20))
    path = fresh_path(spark, "boosted")
    save_model(spark, model, path)
    loaded = load_model(spark, path)
    a, b = (sorted((r.visit_number, tuple(r.p)) for r in m.with_probability(train, "p").collect()) for m in (model, loaded))
    assert a == b and loaded.history == model.history and loaded.best_round == model.best_round


def test_cuts_and_bins():
    cuts = find_cuts(3, np.array([0, 0, 2, 2, 2]), np.array([2.0, -1.0, 5.0, 5.0, 5.0]), 3, 32)
    assert cuts.start.tolist() == [0, 2, 2, 2] and cuts.value.tolist() == [-0.5, 1.0]
    assert cuts.bins(np.array([0, 0, 0, 0, 1, 2]), np.array([-0.5, -0.4, 1.0, 9.0, 4.0, 1.0])).tolist() == [0, 1, 1, 2, 0, 0]
    assert cuts.zeros().tolist() == [1, 0, 0]
    many = find_cuts(1, np.zeros(5000, int), np.random.default_rng(0).random(5000), 5000, 32)
    assert 16 < len(many.value) < 32
    assert Cuts(np.array([0]), np.zeros(0)).size == 0


def test_odd_tables(spark):
    x, y = made(40)
    rows = [None if i % 10 == 0 else v for i, v in enumerate(y)]  # unlabelled visits teach nothing
    model = fit_softmax(table(spark, x, rows), replace(GRADIENT, rounds=1))
    assert model.classes == [3, 7, 11]
    unseen = table(spark, x[:5], [3, 99, None, 7, 7], 100)
    followed = fit_softmax(table(spark, x, y), replace(GRADIENT, rounds=1), unseen)
    assert followed.history[0].held_loss is not None
    one = fit_softmax(table(spark, x, [5] * 40), NEWTON)
    assert one.with_probability(table(spark, x, y), "p").select(F.get("p", F.lit(0))).distinct().collect()[0][0] == 1.0
    assert model.with_probability(table(spark, x, y).limit(0), "p").count() == 0
    constant = fit_softmax(table(spark, np.zeros((20, 2)), [3, 7] * 10), NEWTON)
    assert constant.importances() == [0, 0]
    with pytest.raises(ValueError, match="no labelled visits"):
        fit_softmax(table(spark, x, [None] * 40), NEWTON)
