"""Training, evaluation, blending, persistence."""

from dataclasses import replace
from math import exp, log

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from basketry.models import evaluation
from basketry.models.blending import fit_blend
from basketry.models.classifiers import KINDS, Params, bagged_models, indexed, train_model
from basketry.models.persistence import load_model, save_model
from basketry.operators import metrics, visits
from basketry.plans.scoring import final_predictions, predict
from basketry.plans.workflow import prepare_train
from basketry.session import fresh_path, materialize
from basketry.sources.tables import STAR_CONFIG, planted_labels, scoring_lines, training_lines

SMALL = Params(n_est=5, max_depth=4, parallelism=8)


@pytest.fixture(scope="module")
def planted(small_lines):
    """Visits with a label that the group shares explain."""
    names = list(STAR_CONFIG.groups)
    shares = visits.group_shares(small_lines, STAR_CONFIG.groups)
    labels = planted_labels(small_lines).withColumnRenamed("planted_label", "trip_type")
    rows = shares.select("visit_number", array_to_vector(F.array(*names)).alias("features")).join(labels, "visit_number")
    rows = materialize(rows, "planted")
    return training_lines(rows), scoring_lines(rows)


@pytest.fixture(scope="module")
def models(planted):
    boost = replace(SMALL, n_est=2, max_depth=3, learning_rate=0.3)
    params = {"GB": boost, "xGB": replace(boost, gamma=0.1), "AB": replace(SMALL, n_est=3), "KNN": Params(n_est=5)}
    return {kind: train_model(kind, planted[0], params.get(kind, SMALL)) for kind in KINDS}


@pytest.mark.parametrize("kind", list(KINDS))
def test_each_kind_beats_the_class_shares(planted, models, kind):
    train, test = planted
    probs = predict(models[kind], test).cache()
    n_classes = len(models[kind].classes)
    assert probs.count() == test.count() * n_classes
    sums = probs.groupBy("visit_number").agg(F.sum("p").alias("s"), F.min("p").alias("low")).collect()
    assert all(abs(r.s - 1) < 1e-9 and r.low >= 0 for r in sums)
    prior = metrics.prior_log_loss(train, test).first()[0]
    eps = 0.01  # a neighbour vote may be zero for the true class
    loss = metrics.multiclass_log_loss(probs, test.select("visit_number", "trip_type"), eps=eps).first()[0]
    assert loss < prior


def test_model_loss_equals_the_evaluator(planted, models):
    model, test = models["RF"], planted[1]
    scored = model.model.transform(indexed(test, model.classes))
    expected = MulticlassClassificationEvaluator(labelCol="class_idx", metricName="logLoss").evaluate(scored)
    assert evaluation.model_loss(model, test).first()[0] == pytest.approx(expected, rel=1e-9)
    probs = predict(model, test)
    assert metrics.log_loss(probs, test.select("visit_number", "trip_type")).first()[0] == pytest.approx(expected, rel=1e-9)


def test_unknown_kind():
    with pytest.raises(ValueError, match="unknown model kind"):
        train_model("LR", None)


@pytest.mark.parametrize("kind", ["RF", "GB", "AB", "KNN"])
def test_saved_models_predict_the_same(spark, planted, models, kind):
    path = fresh_path(spark, "model")
    save_model(spark, models[kind], path)
    loaded = load_model(spark, path)
    both = metrics.joined_product(predict(models[kind], planted[1]), predict(loaded, planted[1]))
    alone = predict(models[kind], planted[1]).withColumnRenamed("p", "q")
    worst = both.join(alone, ["visit_number", "trip_type"]).agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0]
    assert worst < 1e-12


def test_bagged_models_differ_by_seed(planted):
    first, second = bagged_models("RF", planted[0], 2, replace(SMALL, n_est=2))
    a, b = predict(first, planted[1]), predict(second, planted[1]).withColumnRenamed("p", "q")
    assert a.join(b, ["visit_number", "trip_type"]).agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] > 0


def test_blend_adds_one_feature_per_class(planted):
    train, test = planted
    blend, rest = fit_blend(train, {"RF": SMALL, "ET": SMALL, "KNN": Params(n_est=5)}, F.col("visit_number") % 5 == 1)
    assert rest.filter(F.col("visit_number") % 5 == 1).count() == 0
    blended = blend.transform(test)
    n = len(blend.models[0].classes)
    assert {r.features.size for r in blended.select("features").collect()} == {len(STAR_CONFIG.groups) + n}
    own = {r.visit_number: r.features for r in test.collect()}
    parts = [{(r.visit_number, r.trip_type): r.p for r in predict(m, test).collect()} for m in blend.models]
    classes = blend.models[0].classes
    for r in blended.limit(20).collect():
        expected = [(parts[0][k] * parts[1][k] * parts[2][k]) ** (1 / 3) for k in [(r.visit_number, c) for c in classes]]
        assert list(r.features.toArray()) == pytest.approx([*own[r.visit_number].toArray(), *expected], abs=1e-9)


def test_splits_are_disjoint_and_whole(planted):
    train = planted[0]
    fitted, held = evaluation.holdout_split(train, 0.2)
    n = train.count()
    assert fitted.count() + held.count() == n and 0.1 * n < held.count() < 0.3 * n
    assert fitted.join(held, "visit_number").count() == 0
    folds = {r[0]: r[1] for r in train.groupBy(evaluation.fold(3)).count().collect()}
    assert set(folds) == {0, 1, 2} and min(folds.values()) > 0.2 * n


def test_search_draws():
    assert evaluation.search_draws() == [{"learning_rate": 0.07, "max_depth": 10, "subsample": 0.5, "feature_share": 0.3}]
    many = evaluation.search_draws({"a": list(range(10)), "b": list(range(10))}, draws=7)
    assert len({tuple(d.values()) for d in many}) == 7


def test_importances_sum_to_one(planted, models):
    for kind in ("RF", "GB", "AB"):
        assert sum(models[kind].importances()) == pytest.approx(1, abs=1e-6)


def test_uniform_loss_is_log_k(small_lines):
    labels = visits.visit_labels(small_lines)
    probs = labels.select("visit_number", F.explode(F.array(*[F.lit(c) for c in range(1, 1000)])).alias("trip_type"))
    loss = metrics.log_loss(probs.withColumn("p", F.lit(0.1)), labels).first()[0]
    assert loss == pytest.approx(log(10))


def test_ensemble_of_one_model_is_that_model(planted, models):
    probs = predict(models["RF"], planted[1])
    mean = metrics.ensemble_mean(probs).withColumnRenamed("p", "q")
    assert probs.join(mean, ["visit_number", "trip_type"]).agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] == 0


def test_geometric_mean_with_a_zero(spark):
    rows = [(1, 3, 0.5), (1, 3, 0.0), (1, 4, 0.2), (1, 4, 0.8)]
    probs = spark.createDataFrame(rows, "visit_number bigint, trip_type int, p double")
    got = {r.trip_type: r.p for r in metrics.geometric_mean(probs).collect()}
    assert got[3] == 0 and got[4] == pytest.approx(exp((log(0.2) + log(0.8)) / 2))


def test_predicted_and_empty_visits_together(small_lines):
    classes = [1, 999]
    known = visits.nonempty_visits(small_lines).select("visit_number", F.lit(1).alias("trip_type"), F.lit(0.4).alias("p"))
    final = final_predictions(known, small_lines, classes)
    everyone = small_lines.select("visit_number").distinct().count()
    assert final.select("visit_number").distinct().count() == everyone
    assert final.filter("p = 0.75").count() == visits.empty_visits(small_lines).count()


def test_training_matrix_is_written(small_lines):
    features, matrix = prepare_train(training_lines(small_lines), STAR_CONFIG)
    assert matrix.count() == visits.nonempty_visits(training_lines(small_lines)).count()
    assert len(matrix.inputFiles()) > 0
