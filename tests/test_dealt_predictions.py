"""Predictions that are dealt by visit once are written, averaged and sorted where they are."""

import pytest

from basketry.catalog import base
from basketry.operators.metrics import ensemble_mean
from basketry.plans.scoring import final_predictions_of_models
from basketry.session import fresh_path
from basketry.sources import files


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def finals(small_lines):
    probs, tasks = base.dealt_probabilities(small_lines)
    return final_predictions_of_models(probs, small_lines, base.CLASSES, 3, tasks)


def test_final_predictions_are_not_dealt_again(finals):
    above = plan(files.wide_predictions(finals, base.CLASSES)).split("Union")[0]
    assert "HashAggregate" in above and "Exchange" not in above


def test_final_predictions_are_those_of_undealt_ones(spark, small_lines, finals, monkeypatch):
    monkeypatch.setattr(base, "ROWS_PER_TASK", 5_000)
    probs, tasks = base.dealt_probabilities(small_lines)
    assert tasks > 1
    dealt, apart = (final_predictions_of_models(probs, small_lines, base.CLASSES, 3, *t) for t in ((tasks,), ()))
    assert dealt.exceptAll(apart).count() == 0 and dealt.count() == apart.count() == finals.count()


def test_a_visit_that_is_predicted_and_empty_keeps_the_larger_value(spark, hand):
    predicted = spark.createDataFrame([(2, 999, 0, 0.9), (2, 3, 0, 0.1), (1, 3, 0, 0.5), (1, 3, 0, 0.25)], "visit_number long, trip_type int, model_index int, p double")
    found = final_predictions_of_models(predicted.repartition(4, "visit_number"), hand, [3, 999], 1, 4)
    assert sorted((r.visit_number, r.trip_type, r.p) for r in found.collect()) == [(1, 3, 0.5), (2, 3, 0.1), (2, 999, 0.9)]


def test_an_ensemble_moves_rows_of_visits_once(spark):
    probs = spark.createDataFrame([(v, c, m, 0.1 * (m + 1)) for v in range(40) for c in (3, 999) for m in range(3)], "visit_number long, trip_type int, model_index int, p double")
    root = fresh_path(spark, "three-models")
    files.write_model_predictions(probs, root, [3, 999])
    mean = ensemble_mean(files.read_predictions(spark, root, [3, 999], by_visit=True))
    exchanges = [line for line in plan(files.wide_predictions(mean, [3, 999]).orderBy("VisitNumber")).split("\n") if "Exchange" in line]
    assert len(exchanges) == 1 and "rangepartitioning(VisitNumber" in exchanges[0]
    plain = ensemble_mean(files.read_predictions(spark, root, [3, 999]))
    got, wanted = ({(r.visit_number, r.trip_type): r.p for r in df.collect()} for df in (mean, plain))
    assert got == pytest.approx(wanted) and len(got) == 80
