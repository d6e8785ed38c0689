"""Exact splits and folds, staged scores against separate models, and the cross-validated search."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.models import evaluation
from basketry.models.classifiers import Params, train_model
from basketry.models.evaluation import random_search, stratified_fold, stratified_split
from basketry.models.staging import leaf_shares, with_leaf_shares, with_staged
from test_softmax_boosting import made, table


@pytest.fixture(scope="module")
def noisy(spark):
    x, y = made(240, noise=0.15)
    return table(spark, x, y).cache()


def labels(spark, sizes):
    rows = [(100 * c + i, c) for c, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "visit_number long, trip_type int").repartition(5)


@pytest.mark.parametrize("share", [0.1, 0.25, 0.0, 1.0])
def test_split_holds_out_exactly_its_share_of_every_class(spark, share):
    sizes = {3: 50, 7: 15, 11: 4, 12: 1}
    whole = labels(spark, sizes)
    fitted, held = stratified_split(whole, share)
    assert {r[0]: r[1] for r in held.groupBy("trip_type").count().collect()} == {c: int(n * share + 0.5) for c, n in sizes.items() if int(n * share + 0.5)}
    assert fitted.unionByName(held).exceptAll(whole).count() == 0 and fitted.count() + held.count() == 70
    again = stratified_split(whole.repartition(2), share)[1]
    assert held.exceptAll(again).count() == again.exceptAll(held).count() == 0


def test_seeds_hold_out_different_visits(spark):
    whole = labels(spark, {3: 60})
    first, second = (set(r[0] for r in stratified_split(whole, 0.2, seed)[1].select("visit_number").collect()) for seed in (1, 2))
    assert len(first) == len(second) == 12 and first != second


def test_folds_differ_by_one_at_most_in_every_class(spark):
    sizes = {3: 50, 7: 14, 11: 3, 12: 1}
    whole = labels(spark, sizes)
    for n in (3, 4):
        folded = whole.withColumn("fold", stratified_fold(whole, n))
        counts = {(r.trip_type, r.fold): r["count"] for r in folded.groupBy("trip_type", "fold").count().collect()}
        for c, total in sizes.items():
            assert sorted(counts.get((c, f), 0) for f in range(n)) == sorted(total // n + (i < total % n) for i in range(n))


def test_visits_without_a_label_stay(spark):
    whole = labels(spark, {3: 10}).unionByName(spark.createDataFrame([(9001, None)], "visit_number long, trip_type int"))
    fitted, held = stratified_split(whole, 0.5)
    assert fitted.where("trip_type is null").count() == 1 and held.count() == 5


def probabilities(model, data):
    return {r.visit_number: r.p for r in model.with_probability(data, "p").collect()}


@pytest.mark.parametrize(("kind", "params"), [
    ("ET", Params(max_depth=3)), ("GB", Params(max_depth=2)), ("xGB", Params(max_depth=2, patience=None, gamma=0.1, learning_rate=0.3)),
    ("AB", Params(max_depth=2)), ("KNN", Params()),
])
def test_stages_equal_models_of_that_size(noisy, kind, params):
    sizes = [2, 5]
    whole = train_model(kind, noisy, replace(params, n_est=5))
    staged = {r.visit_number: r.s for r in with_staged(whole, noisy, sizes, "s").collect()}
    for i, n in enumerate(sizes):
        single = probabilities(train_model(kind, noisy, replace(params, n_est=n)), noisy)
        assert np.allclose([staged[v][i] for v in single], list(single.values()), atol=1e-12)


def test_stages_of_a_forest_average_its_first_trees(noisy):
    model = train_model("RF", noisy, Params(n_est=6, max_depth=4))
    with_leaf_shares(model, noisy)
    staged = {r.visit_number: r.s for r in with_staged(model, noisy, [1, 4, 6, 99], "s").collect()}
    for r in noisy.limit(40).collect():
        each = np.array([tree.predictProbability(r.features).toArray() for tree in model.model.trees])
        for i, n in enumerate((1, 4, 6, 6)):
            assert np.allclose(staged[r.visit_number][i], each[:n].mean(axis=0))
    assert np.allclose([sum(row) for t in leaf_shares(model, noisy) for row in t if row.any()], 1)


def test_curve_ends_with_the_whole_model(noisy):
    fitted, held = stratified_split(noisy, 0.25)
    curve = {(r.n_est, r.part): r.log_loss for r in evaluation.learning_curve("RF", fitted, held, [2, 8], Params(n_est=1, max_depth=4)).collect()}
    whole = train_model("RF", fitted, Params(n_est=8, max_depth=4))
    assert curve[8, "holdout"] == pytest.approx(evaluation.model_loss(whole, held).first()[0], abs=1e-9)
    assert curve[8, "train"] == pytest.approx(evaluation.model_loss(whole, fitted).first()[0], abs=1e-9)
    assert set(curve) == {(n, p) for n in (2, 8) for p in ("train", "holdout")}


def test_search_finds_the_same_in_parallel_and_one_by_one(spark, noisy):
    grid = {"max_depth": [1, 4], "min_rows": [3, 100]}
    apart = random_search("RF", noisy, Params(n_est=4, parallelism=1), grid)
    together = random_search("RF", noisy, Params(n_est=4, parallelism=4), grid)
    assert apart.best.point == together.best.point and apart.best.losses == pytest.approx(together.best.losses)
    assert all(len(d.losses) <= 3 for d in apart.draws) and len(apart.draws) == 4
    every = [evaluation.cross_validated_loss(noisy, replace(Params(n_est=4), **d.point)) for d in apart.draws]
    assert min(every) == pytest.approx(apart.best.mean) and apart.draws[int(np.argmin(every))] is apart.best
    for d, loss in zip(apart.draws, every, strict=True):
        assert d.mean is None or d.mean == pytest.approx(loss)
    again = train_model("RF", noisy, replace(Params(n_est=4, parallelism=1), **apart.best.point))
    assert evaluation.model_loss(apart.model, noisy).first()[0] == pytest.approx(evaluation.model_loss(again, noisy).first()[0])
    rows = apart.table(spark).collect()
    assert sum(r.best for r in rows) == 1 and {r.folds for r in rows} <= {1, 2, 3}


def test_hopeless_draws_stop_early(noisy, monkeypatch):
    losses = {1: [0.5, 0.5, 0.5], 2: [9.0, 9.0, 9.0], 3: [0.1, 0.1, 0.1]}
    monkeypatch.setattr(evaluation, "fold_loss", lambda kind, folded, i, params: losses[params.max_depth][i])
    monkeypatch.setattr(evaluation, "train_model", lambda *a: None)
    found = random_search("RF", noisy, Params(parallelism=1), {"max_depth": [1, 2, 3]})
    assert [len(d.losses) for d in found.draws] == [3, 1, 3] and found.best.point == {"max_depth": 3}
    assert found.draws[1].mean is None


def test_staged_forest_asks_for_its_leaves(noisy):
    with pytest.raises(ValueError, match="with_leaf_shares"):
        with_staged(train_model("RF", noisy, Params(n_est=2, max_depth=2)), noisy.withColumn("x", F.lit(1)), [1])
