"""One boosted model per class: passes per round, Spark's own learner as the plain version, stopping, saving."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from basketry.models import evaluation
from basketry.models.classifiers import Params, fit_boosted
from basketry.models.persistence import load_model, save_model
from basketry.session import fresh_path, materialize, over_all_cores

CLASSES = 4
ROWS = 300


@pytest.fixture(scope="module")
def matrix(spark):
    random = np.random.default_rng(5)
    x = random.integers(0, 6, (ROWS, 5)) * (random.random((ROWS, 5)) < 0.6)
    y = np.where(random.random(ROWS) < 0.2, random.integers(0, CLASSES, ROWS), (x[:, 0] + 2 * x[:, 1] > 5) + 2 * (x[:, 2] > 2))
    rows = [(i, int(10 * c), Vectors.sparse(5, [(j, a) for j, a in enumerate(v.tolist()) if a])) for i, (v, c) in enumerate(zip(x.astype(float), y, strict=True))]
    return materialize(spark.createDataFrame(rows, ["visit_number", "trip_type", "features"]), "apart-test")


def jobs(spark, work) -> int:
    """Spark jobs that ``work`` starts: job numbers are given in a row."""

    def mark(group: str) -> int:
        spark.sparkContext.setJobGroup(group, group)
        spark.sparkContext.parallelize([1], 1).count()
        return max(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    start = mark("apart-start")
    work()
    return mark("apart-end") - start - 1


def test_jobs_do_not_grow_with_the_classes(spark, matrix):
    params = Params(n_est=2, max_depth=2)
    two = jobs(spark, lambda: fit_boosted(matrix.where("trip_type < 20"), params))
    four = jobs(spark, lambda: fit_boosted(matrix, params))
    assert four <= two + 2


def test_equals_sparks_learner(matrix):
    params = Params(n_est=4, max_depth=3, learning_rate=0.3, subsample=1.0, feature_share=1.0, min_rows=3)
    model = fit_boosted(matrix, params)
    learner = GBTClassifier(labelCol="c", maxIter=4, stepSize=0.3, maxDepth=3, minInstancesPerNode=3, featureSubsetStrategy="all")
    spark_models = OneVsRest(classifier=learner, labelCol="c").fit(matrix.withColumn("c", F.col("trip_type") / 10)).models
    mine = {r[0]: r[1] for r in model.with_probability(matrix, "p").select("visit_number", "p").collect()}
    scored = [one.transform(matrix).select("visit_number", vector_to_array("probability")[1]).orderBy("visit_number").collect() for one in spark_models]
    own = np.array([[r[1] for r in rows] for rows in scored]).T
    expected = own / own.sum(axis=1, keepdims=True)
    assert np.abs(np.array([mine[i] for i in range(ROWS)]) - expected).max() < 1e-6
    for (c, best, score), one in zip(model.rounds(matrix), spark_models, strict=True):
        losses = one.evaluateEachIteration(matrix.select((F.col("trip_type") == c).cast("double").alias(one.getLabelCol()), "features"))
        assert best == int(np.argmin(losses)) + 1 and abs(score - min(losses)) < 1e-6


def test_stops_like_spark(matrix):
    params = Params(n_est=12, max_depth=4, learning_rate=0.9, subsample=1.0, feature_share=1.0, min_rows=1, validation_column="held")
    held = matrix.withColumn("held", F.col("visit_number") % 3 == 0)
    model = fit_boosted(held, params)
    learner = GBTClassifier(labelCol="c", maxIter=12, stepSize=0.9, maxDepth=4, minInstancesPerNode=1, featureSubsetStrategy="all", validationIndicatorCol="held")
    spark_models = OneVsRest(classifier=learner, labelCol="c").fit(held.withColumn("c", F.col("trip_type") / 10)).models
    assert min(model.kept) < 12
    assert model.kept == [m.getNumTrees for m in spark_models]


def test_missing_label_is_rest_and_saving_keeps_all(spark, matrix):
    some = matrix.withColumn("trip_type", F.when(F.col("visit_number") % 7 != 0, F.col("trip_type")))
    model = fit_boosted(some, Params(n_est=2, max_depth=2))
    path = fresh_path(spark, "apart-model")
    save_model(spark, model, path)
    loaded = load_model(spark, path)
    assert (loaded.classes, loaded.kept) == (model.classes, [2] * CLASSES)
    assert evaluation.model_loss(loaded, matrix).first() == evaluation.model_loss(model, matrix).first()
    assert loaded.rounds(matrix) == model.rounds(matrix)
    assert abs(sum(model.importances()) - 1) < 1e-9
    with pytest.raises(ValueError):
        model.rounds(some)


def test_a_matrix_of_one_file_is_dealt_over_all_cores(spark, matrix):
    one = materialize(matrix.coalesce(1), "one-file")
    dealt = over_all_cores(one, lambda df: materialize(df, "dealt"))
    cores = spark.sparkContext.defaultParallelism
    assert one.rdd.getNumPartitions() < cores <= dealt.rdd.getNumPartitions()
    assert sorted(r["visit_number"] for r in dealt.collect()) == list(range(ROWS))
    assert over_all_cores(dealt, lambda df: None) is dealt
