"""Tables with a row per visit and class are never sent through the driver, whatever Spark takes their size for."""

import pytest
from pyspark.sql import functions as F

from basketry.catalog import base
from basketry.operators import metrics, visits


@pytest.fixture(scope="module")
def probs(small_lines):
    return base.fixed_probabilities(small_lines)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("loss", [metrics.log_loss, metrics.multiclass_log_loss])
def test_losses_do_not_broadcast_probabilities(spark, small_lines, probs, loss):
    labels = spark.createDataFrame(visits.visit_labels(small_lines).collect())
    assert "Broadcast" not in plan(loss(probs, labels, "model_index"))


def test_products_do_not_broadcast_probabilities(probs):
    tables = [probs.filter(F.col("model_index") == i) for i in range(3)]
    assert "Broadcast" not in plan(metrics.joined_product(*tables))


def test_losses_of_missing_and_repeated_keys(spark):
    """A row counts once for each label it agrees with; missing visits, classes and labels count for none."""
    p = spark.createDataFrame([(1, 5, 0.5), (1, 6, 0.25), (1, 5, 0.125), (2, 5, 0.5), (3, None, 0.5), (None, 5, 0.5)], "visit_number long, trip_type int, p double")
    labels = spark.createDataFrame([(1, 5), (1, 5), (1, 6), (2, 6), (3, None), (None, 5)], "visit_number long, trip_type int")
    wanted = p.join(labels, ["visit_number", "trip_type"]).agg(F.count("*"), -F.avg(F.log("p"))).first()
    assert wanted[0] == 5
    assert metrics.log_loss(p, labels).first()[0] == pytest.approx(wanted[1])
