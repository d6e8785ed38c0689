"""The whole run with all reports."""

from math import isfinite

import pytest
from pyspark.errors import AnalysisException

from basketry.models.classifiers import Params
from basketry.plans.workflow import Reports, begin_test, begin_train, ensemble, feature_names, load_run, save_run
from basketry.session import fresh_path
from basketry.sources import files
from basketry.sources.tables import STAR_CONFIG, scoring_lines, training_lines


def test_full_run(spark, small_lines):
    forest = Params(n_est=3, max_depth=4)
    path, profiles = fresh_path(spark, "saved"), fresh_path(spark, "profiles")
    trained = begin_train(
        training_lines(small_lines), "RF", forest, n_models=2, config=STAR_CONFIG, blend_base={"RF": forest, "ET": forest},
        save_to=path, reports=Reports(chi2=True, distances=True, importance=True, cross_validation=True, curve=[1, 2], profiles=profiles),
        test=scoring_lines(small_lines),
    )
    done = trained.reports
    n_classes = len(trained.models[0].classes)
    assert feature_names(trained).count() == trained.features.size + n_classes
    assert done["chi2"].filter("chi2 < 0").count() == 0 and done["chi2"].count() > 25
    n = len(STAR_CONFIG.groups) and done["distances"].count()
    assert n == 25 * 26 // 2
    assert done["importance"][0].count() == trained.features.size + n_classes
    assert done["least_important"][0].count() == 1
    assert isfinite(done["cross_validation"]) and done["curve"].count() == 4
    assert {r.model for r in done["losses"].collect()} == {"RF-0", "RF-1"}

    assert spark.read.option("header", True).csv(f"{profiles}/type_departments").count() == 15

    test = scoring_lines(small_lines).drop("trip_type")
    root, target = fresh_path(spark, "predictions"), fresh_path(spark, "ensemble")
    begin_test(trained, test, root)
    classes = trained.models[0].classes
    visits = test.select("visit_number").distinct().count()
    assert files.read_predictions(spark, root, classes).count() == visits * n_classes * 2
    ensemble(spark, root, target, classes)
    assert spark.read.option("header", True).csv(target).count() == visits

    again = fresh_path(spark, "predictions-of-the-saved-run")
    begin_test(path, test, again)
    first, second = (files.read_predictions(spark, r, classes) for r in (root, again))
    assert first.exceptAll(second).count() == second.exceptAll(first).count() == 0
    assert {r.model for r in done["training_losses"].collect()} == {"RF-0", "RF-1"}
    with pytest.raises(AnalysisException):
        save_run(trained, path)  # an existing run is not replaced


@pytest.mark.parametrize("kind", ["ET", "GB", "AB", "KNN", "xGB"])
def test_saved_runs_of_every_kind(spark, small_lines, kind):
    base = {"ET": Params(n_est=2, max_depth=2), "KNN": Params(n_est=5)}
    path, params = fresh_path(spark, "saved"), Params(n_est=2, max_depth=2, learning_rate=0.3, gamma=0.0)
    trained = begin_train(training_lines(small_lines), kind, params, config=STAR_CONFIG, with_blend=kind == "KNN", blend_base=base, save_to=path)
    loaded = load_run(spark, path)
    assert loaded.models[0].classes == trained.models[0].classes and (loaded.blend is None) == (trained.blend is None)
    test = scoring_lines(small_lines).drop("trip_type")
    roots = [fresh_path(spark, "predictions") for _ in range(2)]
    begin_test(trained, test, roots[0])
    begin_test(path, test, roots[1])
    first, second = (files.read_predictions(spark, r, trained.models[0].classes) for r in roots)
    assert first.count() > 0 and first.exceptAll(second).count() == second.exceptAll(first).count() == 0
    if kind == "xGB":
        assert trained.reports["best_rounds"][0][0] in (1, 2) and trained.reports["rounds"][0].where("held_loss is null").count() == 0


def test_a_run_without_its_manifest_is_not_read(spark, tmp_path):
    with pytest.raises(ValueError, match="holds no whole run"):
        load_run(spark, str(tmp_path))
