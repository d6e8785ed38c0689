"""The whole run: prepare, profile, train, score, ensemble."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.config import FeatureConfig
from basketry.models import evaluation
from basketry.models.blending import Blend, fit_blend
from basketry.models.classifiers import Params, bagged_models
from basketry.models.persistence import load_model, save_model
from basketry.models.softmax_boosting import SoftmaxBoostedModel
from basketry.operators import profile, ranking, sets
from basketry.operators.distances import line_distances
from basketry.operators.joins import lookup_join
from basketry.operators.labels import class_values
from basketry.operators.metrics import ensemble_mean
from basketry.operators.stats import chi2_of_observed, chi2_pvalues, least_important
from basketry.plans.features import FeatureModel
from basketry.plans.scoring import final_predictions_of_models, predict
from basketry.sources import files


def prepare_train(lines: DataFrame, config: FeatureConfig | None = None) -> tuple[FeatureModel, DataFrame]:
    """Fits the vocabularies and builds the training matrix, written once for the many passes of a fit."""
    features = FeatureModel.fit(lines, config)
    return features, features.matrix(lines, "train-matrix")


def prepare_test(lines: DataFrame, features: FeatureModel) -> DataFrame:
    """Test visits in the columns of the training vocabulary; values it does not have are ignored.

    Written once: every model reads the vectors again, and none should compute them again.
    """
    return features.matrix(lines, "test-matrix")


def write_profiles(train: DataFrame, test: DataFrame, root: str) -> None:
    """The files of the profiling run."""
    dept, fineline = "department_description", "fineline_number"
    files.write_profile(profile.distinct_count_per(train, dept, fineline), f"{root}/dept_fineline_count")
    files.write_profile(profile.packed_members(train, "trip_type", dept), f"{root}/type_departments")
    files.write_profile(profile.packed_members(train, dept, "trip_type"), f"{root}/dept_types")
    files.write_profile(ranking.value_counts(train, "upc"), f"{root}/upc_counts")
    sums = profile.frequent_line_counts(train, "upc")
    files.write_profile(sums, f"{root}/upc_sums")
    files.write_lines(sets.not_in(train, test, fineline), f"{root}/finelines_not_in_test")


@dataclass(frozen=True)
class Reports:
    """Which extra reports a training run makes."""

    chi2: bool = False
    distances: bool = False
    importance: bool = False
    cross_validation: bool = False
    search: bool = False
    profiles: str | None = None  # a folder for the profiling files
    curve: list[int] = field(default_factory=list)


@dataclass
class Trained:
    features: FeatureModel
    models: list
    blend: Blend | None = None
    reports: dict = field(default_factory=dict)


def chi2_of_blocks(matrix: DataFrame, features: FeatureModel) -> DataFrame:
    """feature, chi2, p_value of everything that cannot be negative: group and department shares, line counts per department and product.

    The label stands in the matrix row, so the entries need no join with it; names are joined to one row per feature.
    """
    known = features.names().filter(F.col("feature").rlike("^(dept_share|dept_lines|upc_lines)=") | F.col("feature").isin(features.groups))
    labelled = matrix.where(F.col("trip_type").isNotNull())
    entries = labelled.select("trip_type", F.inline("entries")).select(F.col("idx").alias("feature_idx"), "trip_type", F.col("v").alias("value"))
    observed = lookup_join(entries.groupBy("feature_idx", "trip_type").agg(F.sum("value").alias("o")), known, ["feature_idx"])
    scores = chi2_of_observed(observed.select("feature", "trip_type", "o"), labelled.select("trip_type"))
    return chi2_pvalues(scores, len(class_values(labelled)))


def feature_names(trained: Trained) -> DataFrame:
    """Names of all positions of the final model's vectors, with the blended classes at the end."""
    names = trained.features.names()
    if not trained.blend:
        return names
    classes = trained.blend.models[0].classes
    extra = [(trained.features.size + i, f"blend={c}") for i, c in enumerate(classes)]
    return names.unionByName(names.sparkSession.createDataFrame(extra, "feature_idx int, feature string"))


def begin_train(
    train: DataFrame,
    kind: str = "xGB",
    params: Params | None = None,
    n_models: int = 1,
    config: FeatureConfig | None = None,
    holdout_share: float = 0.1,
    blend_base: dict[str, Params] | None = None,
    with_blend: bool = True,
    save_to: str | None = None,
    reports: Reports | None = None,
    test: DataFrame | None = None,
) -> Trained:
    """Train ``n_models`` models of one kind; their training loss and, with a holdout, their loss on it are reported.

    Boosted kinds follow the holdout round by round; xGB stops by it and reports its best round. The profiling files compare
    with the ``test`` lines, if there are any.
    """
    params, reports = params or Params(), reports or Reports()
    if reports.profiles:
        write_profiles(train, train.limit(0) if test is None else test, reports.profiles)
    spark = train.sparkSession
    features, matrix = prepare_train(train, config)
    done = {}
    if reports.chi2:
        done["chi2"] = chi2_of_blocks(matrix, features)
    if reports.distances:
        done["distances"] = line_distances(train)
    fitted, held = evaluation.stratified_split(matrix, holdout_share) if holdout_share else (matrix, None)
    blend = None
    if with_blend:
        blend, fitted = fit_blend(fitted, blend_base)
        held = blend.transform(held) if held is not None else None
    if reports.cross_validation:
        done["cross_validation"] = evaluation.cross_validated_loss(fitted, params, kind=kind)
    if reports.search:
        done["search"] = evaluation.random_search(kind, fitted, params)
    if reports.curve and held is not None:
        done["curve"] = evaluation.learning_curve(kind, fitted, held, reports.curve, params)
    models = bagged_models(kind, fitted, n_models, params, held)
    done["training_losses"] = evaluation.model_losses(spark, {f"{kind}-{i}": m for i, m in enumerate(models)}, fitted)
    boosted = [m for m in models if isinstance(m, SoftmaxBoostedModel)]
    if boosted:
        done["rounds"] = [evaluation.round_losses(spark, m) for m in boosted]
        done["best_rounds"] = [(m.best_round, m.best_score) for m in boosted]
    trained = Trained(features, models, blend, done)
    if save_to:
        save_run(trained, save_to)
    if reports.importance and kind != "KNN":
        tables = [evaluation.feature_importance(m, feature_names(trained)) for m in models]
        done["importance"] = tables
        done["least_important"] = [least_important(t) for t in tables]
    if held is not None:
        done["losses"] = evaluation.model_losses(spark, {f"{kind}-{i}": m for i, m in enumerate(models)}, held)
    return trained


def save_run(trained: Trained, path: str) -> None:
    """Everything that scoring needs: vocabulary, blend and all models, each in its folder, and then the manifest that lists them.

    The manifest is written last, in one commit: a run without it is not whole and is not read. An existing run is not replaced.
    """
    spark = trained.features.features.sparkSession
    trained.features.save(f"{path}/features")
    blend = trained.blend.models if trained.blend else []
    for name, models in (("blend", blend), ("models", trained.models)):
        for i, model in enumerate(models):
            save_model(spark, model, f"{path}/{name}/{i}")
    about = {"version": 1, "blend": len(blend) if trained.blend else None, "models": len(trained.models), "n_encoded": trained.features.n_encoded}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.parquet(f"{path}/manifest")


def load_run(spark: SparkSession, path: str) -> Trained:
    """A saved run, ready for ``begin_test``."""
    try:
        rows = spark.read.schema("value string").parquet(f"{path}/manifest").collect()
    except AnalysisException as missing:
        raise ValueError(f"{path} holds no whole run") from missing
    if len(rows) != 1:
        raise ValueError(f"{path} holds no whole run")
    about = json.loads(rows[0]["value"])
    features = FeatureModel.load(spark, f"{path}/features")
    if features.n_encoded != about["n_encoded"]:
        raise ValueError(f"the vocabulary of {path} has {features.n_encoded} entries, its manifest says {about['n_encoded']}")
    blend = None if about["blend"] is None else Blend([load_model(spark, f"{path}/blend/{i}") for i in range(about["blend"])])
    return Trained(features, [load_model(spark, f"{path}/models/{i}") for i in range(about["models"])], blend)


def begin_test(trained: Trained | str, test: DataFrame, root: str) -> None:
    """Predict every test visit with every model, and write one folder per model. A saved run is given by its path."""
    if isinstance(trained, str):
        trained = load_run(test.sparkSession, trained)
    matrix = prepare_test(test, trained.features)
    if trained.blend:
        matrix = trained.blend.transform(matrix)
    classes = trained.models[0].classes
    each = [predict(m, matrix).withColumn("model_index", F.lit(i)) for i, m in enumerate(trained.models)]
    predicted = reduce(lambda a, b: a.unionByName(b), each)
    finals = final_predictions_of_models(predicted, test, classes, len(each))
    files.write_model_predictions(finals, root, classes)


def ensemble(spark, root: str, target: str, classes: list[int]) -> None:
    """The mean over all models of a prediction folder, in the same wide form."""
    predictions = files.read_predictions(spark, root, classes, by_visit=True)
    files.write_predictions(ensemble_mean(predictions), target, classes, sort=True)
