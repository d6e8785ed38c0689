"""Classifiers by name, all trained by Spark ML, all giving one probability array per visit.

A trained model has ``classes`` (class values in index order) and ``with_probability(matrix, out)``, which adds an
array column of class probabilities. Training data has the columns visit_number, trip_type and features.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from math import log

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.columns import vector_parts
from basketry.models.apart_boosting import BoostedModel, RestGrowth, fit_against_rest
from basketry.models.forests import BINNED, grow_trees, missed_rows, root_draws, spark_forest
from basketry.models.random_trees import RandomTreesModel, fit_random_trees
from basketry.models.softmax_boosting import Cuts, Growth, SoftmaxBoostedModel, binned_rows, feature_cuts, fit_softmax
from basketry.operators.labels import class_index, class_values
from basketry.operators.neighbors import nearest_neighbours, neighbour_votes
from basketry.session import fresh_path, materialize, over_all_cores

MAX_TREE_DEPTH = 30  # the deepest tree Spark ML grows; stands in for "no limit"


@dataclass(frozen=True)
class Params:
    """Parameters shared by the classifiers; ``None`` means the default of the kind."""

    n_est: int = 200
    max_depth: int | None = None
    seed: int = 1
    parallelism: int = 4
    learning_rate: float | None = None
    subsample: float | None = None
    feature_share: float | None = None
    min_rows: int = 3
    gamma: float = 2.0
    validation_column: str | None = None
    validation_tol: float = 0.01
    max_bins: int = 32
    patience: int | None = 50
    max_delta_step: float = 1.0


def indexed(train: DataFrame, classes: list[int]) -> DataFrame:
    return train.withColumn("class_idx", class_index("trip_type", classes).cast("double"))


# -- forests ----------------------------------------------------------------------------------------------------


@dataclass
class ForestModel:
    classes: list[int]
    model: RandomForestClassificationModel
    leaf_shares: list | None = None  # class shares per tree and leaf, where staged scores are wanted

    def with_probability(self, matrix: DataFrame, out: str = "probability") -> DataFrame:
        scored = self.model.transform(matrix)
        return scored.withColumn("_p", vector_to_array("probability")).select(*matrix.columns, F.col("_p").alias(out))

    def importances(self) -> list[float]:
        return [float(v) for v in self.model.featureImportances.toArray()]


def binned_visits(train: DataFrame, params: Params, classes: list[int]) -> tuple[Cuts, DataFrame]:
    """The cut points, and the visits as bins of the features that have any: y (-1: no label), w (all 1), idx, bin."""
    cuts = feature_cuts(train, params.max_bins)
    return cuts, binned_rows(train, None, classes, cuts, []).select("visit_number", "y", F.lit(1.0).alias("w"), "idx", "bin")


def fit_forest(train: DataFrame, params: Params) -> ForestModel:
    """Gini trees over all visits; a node tries the root of the number of features, drawn from those that have a cut point."""
    classes = class_values(train)
    if not classes:
        raise ValueError("no labelled visits to learn from")
    depth = MAX_TREE_DEPTH if params.max_depth is None else params.max_depth
    cuts, rows = binned_visits(train, params, classes)
    rows = over_all_cores(materialize(rows.drop("visit_number"), "forest-rows"), lambda df: materialize(df, "forest-rows"))
    groups = grow_trees(rows, cuts.narrowed(), len(classes), params.n_est, depth, params.min_rows, root_draws(cuts.size), params.seed)
    about = {"numTrees": params.n_est, "maxDepth": depth, "minInstancesPerNode": params.min_rows, "maxBins": params.max_bins, "seed": params.seed}
    about |= {"bootstrap": False, "featureSubsetStrategy": "sqrt"}
    return ForestModel(classes, spark_forest(train.sparkSession, groups, cuts.narrowed(), cuts.splitting, cuts.size, about))


def fit_random_cuts(train: DataFrame, params: Params) -> RandomTreesModel:
    """Extremely randomised trees: each node draws its own cut points."""
    depth = MAX_TREE_DEPTH if params.max_depth is None else params.max_depth
    return fit_random_trees(train, params.n_est, depth, params.min_rows, params.seed)


# -- boosting ---------------------------------------------------------------------------------------------------


def fit_boosted(train: DataFrame, params: Params, n_rows: int | None = None) -> BoostedModel:
    """One model per class, each against the rest; the joint model of ``softmax_boosting`` is what the kinds by name use.

    ``n_rows`` turns a total loss reduction (``gamma``) into the gain per row that a split needs. Rows that ``validation_column``
    marks are held out, and a class stops at its best round on them.
    """
    params = _defaults(params, learning_rate=0.07, max_depth=7, subsample=0.5, feature_share=0.3)
    growth = RestGrowth(
        rounds=params.n_est, depth=params.max_depth, rate=params.learning_rate, newton=False,
        subsample=params.subsample, feature_share=params.feature_share, min_rows=params.min_rows, max_bins=params.max_bins, patience=None,
        seed=params.seed, row_gain=params.gamma / n_rows if n_rows else 0.0,
    )
    if not params.validation_column:
        return fit_against_rest(train, growth)
    held = F.col(params.validation_column)
    return fit_against_rest(train.where(~held), growth, train.where(held), params.validation_tol)


def _defaults(params: Params, **values) -> Params:
    return replace(params, **{k: v for k, v in values.items() if getattr(params, k) is None})


def gradient_growth(params: Params) -> Growth:
    """Gradient steps from the class shares; a round learns from a share of the visits, a node from a share of the features."""
    params = _defaults(params, learning_rate=0.07, max_depth=7, subsample=0.5, feature_share=0.3)
    return Growth(
        rounds=params.n_est, depth=params.max_depth, rate=params.learning_rate, newton=False, subsample=params.subsample,
        feature_share=params.feature_share, min_rows=params.min_rows, max_bins=params.max_bins, patience=None, seed=params.seed,
    )


def newton_growth(params: Params) -> Growth:
    """Newton steps with a price per split (``gamma``), a least weight per leaf (``min_rows``) and a bound on leaf steps."""
    params = _defaults(params, learning_rate=0.01, max_depth=8, subsample=0.75, feature_share=0.5)
    return Growth(
        rounds=params.n_est, depth=params.max_depth, rate=params.learning_rate, subsample=params.subsample, feature_share=params.feature_share,
        min_hessian=params.min_rows, gamma=params.gamma, max_delta_step=params.max_delta_step, max_bins=params.max_bins,
        patience=params.patience, seed=params.seed,
    )


def fit_gradient_boosting(train: DataFrame, params: Params, holdout: DataFrame | None = None) -> SoftmaxBoostedModel:
    return fit_softmax(train, gradient_growth(params), holdout)


def fit_extreme_boosting(train: DataFrame, params: Params, holdout: DataFrame | None = None) -> SoftmaxBoostedModel:
    """Stops after ``params.patience`` rounds without gain on the holdout, or in the training loss if there is none."""
    return fit_softmax(train, newton_growth(params), holdout)


# -- SAMME ------------------------------------------------------------------------------------------------------


@dataclass
class SammeModel:
    """Weighted vote of shallow trees."""

    classes: list[int]
    trees: list = field(default_factory=list)
    alphas: list[float] = field(default_factory=list)

    def with_votes(self, matrix: DataFrame, out: str) -> DataFrame:
        """Each tree is evaluated once per visit: its answer enters the plan in one place only."""
        scored = matrix
        for i, tree in enumerate(self.trees):
            one = tree.copy({tree.probabilityCol: "", tree.rawPredictionCol: "", tree.predictionCol: f"_c{i}"})
            scored = one.transform(scored)
        answers = F.array(*[F.struct(F.col(f"_c{i}").alias("c"), F.lit(a).alias("a")) for i, a in enumerate(self.alphas)])
        none = F.array(*[F.lit(0.0)] * len(self.classes))

        def add(votes: Column, answer: Column) -> Column:
            return F.transform(votes, lambda v, k: v + F.when(answer["c"] == k, answer["a"]).otherwise(0.0))

        return scored.select(*matrix.columns, F.aggregate(answers, none, add).alias(out))

    def with_probability(self, matrix: DataFrame, out: str = "probability") -> DataFrame:
        """Softmax of the class votes, scaled by the number of classes less one."""
        k, total = len(self.classes), sum(self.alphas)

        def share(powers: Column) -> Column:
            return F.transform(powers, lambda e: e / F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x))

        voted = self.with_votes(matrix, "_votes")
        powers = F.transform("_votes", lambda v: F.exp(v / F.lit(total) / F.lit(k - 1.0)))
        return voted.select(*matrix.columns, F.transform(F.array(powers), share)[0].alias(out))

    def importances(self) -> list[float]:
        weighted = [a * t.featureImportances.toArray() for a, t in zip(self.alphas, self.trees, strict=True)]
        return [float(v) for v in sum(weighted) / sum(self.alphas)]


def fit_samme(train: DataFrame, params: Params) -> SammeModel:
    """Multiclass AdaBoost. The visits are binned once; a round writes which ones its tree missed, in two folders that take turns."""
    params = _defaults(params, learning_rate=0.1, max_depth=4)
    spark, classes = train.sparkSession, class_values(train)
    if not classes:
        raise ValueError("no labelled visits to learn from")
    model = SammeModel(classes)
    folders = [fresh_path(spark, "samme-a"), fresh_path(spark, "samme-b")]
    cuts, rows = binned_visits(train, params, classes)
    weighted, narrow = materialize(rows.drop("visit_number"), "samme-rows"), cuts.narrowed()
    weighted = over_all_cores(weighted, lambda df: materialize(df, "samme-rows"))
    n_rows = weighted.count()
    about = {"numTrees": 1, "maxDepth": params.max_depth, "maxBins": params.max_bins, "seed": params.seed}
    for turn in range(params.n_est):
        groups = grow_trees(weighted, narrow, len(classes), 1, params.max_depth, 1, narrow.size, params.seed)
        fitted = spark_forest(spark, groups, narrow, cuts.splitting, cuts.size, about).trees[0]
        missed_rows(weighted, narrow, groups[0]).write.mode("overwrite").parquet(folders[turn % 2])
        scored = spark.read.schema(f"{BINNED}, missed double").parquet(folders[turn % 2])
        weight, lost = scored.agg(F.sum("w"), F.sum(F.col("w") * F.col("missed"))).first()
        error = lost / weight
        if error >= 1 - 1 / len(classes):  # no better than chance: the round is not used
            break
        bounded = max(error, 1e-12)
        model.trees.append(fitted)
        model.alphas.append(params.learning_rate * log((1 - bounded) / bounded * (len(classes) - 1)))
        if lost == 0:
            break
        grown = F.col("w") * F.exp(F.lit(model.alphas[-1]) * F.col("missed"))
        weighted = scored.select("y", (grown * F.lit(n_rows / weight)).alias("w"), "idx", "bin")
    if not model.trees:
        model.trees.append(fitted)
        model.alphas.append(1.0)
    return model


# -- nearest neighbours -------------------------------------------------------------------------------------------


def _entries() -> tuple[Column, Column]:
    positions, values = vector_parts("features")
    return positions.alias("idx"), values.alias("val")


@dataclass
class NeighbourModel:
    classes: list[int]
    train: DataFrame  # id, label, idx, val
    k: int

    def with_probability(self, matrix: DataFrame, out: str = "probability") -> DataFrame:
        queries = matrix.select(F.col("visit_number").alias("id"), *_entries())
        votes = neighbour_votes(nearest_neighbours(self.train, queries, self.k))
        share = F.map_from_entries(F.collect_list(F.struct("label", "p")))
        of_class = votes.groupBy(F.col("query_id").alias("visit_number")).agg(share.alias("_share"))
        p = F.array(*[F.coalesce(F.try_element_at("_share", F.lit(c)), F.lit(0.0)) for c in self.classes])
        return matrix.join(of_class, "visit_number").withColumn(out, p).drop("_share")


def fit_neighbours(train: DataFrame, params: Params) -> NeighbourModel:
    rows = train.select(F.col("visit_number").alias("id"), F.col("trip_type").alias("label"), *_entries())
    return NeighbourModel(class_values(train), rows, params.n_est)


# -- by name ------------------------------------------------------------------------------------------------------

KINDS: dict[str, Callable[..., object]] = {
    "RF": fit_forest,
    "ET": fit_random_cuts,
    "GB": fit_gradient_boosting,
    "AB": fit_samme,
    "KNN": fit_neighbours,
    "xGB": fit_extreme_boosting,
}


BOOSTED = ("GB", "xGB")


def train_model(kind: str, train: DataFrame, params: Params | None = None, holdout: DataFrame | None = None):
    """A model by name. Boosted kinds follow the loss on the holdout round by round; the others do not look at it."""
    if kind not in KINDS:
        raise ValueError(f"unknown model kind {kind!r}; known are {', '.join(KINDS)}")
    extra = {"holdout": holdout} if kind in BOOSTED else {}
    return KINDS[kind](train, params or Params(), **extra)


def bagged_models(kind: str, train: DataFrame, n: int, params: Params | None = None, holdout: DataFrame | None = None) -> list:
    """The same model for the seeds 1..n, fitted side by side."""
    params = params or Params()

    def one(seed: int):
        return train_model(kind, train, replace(params, seed=seed), holdout)

    with ThreadPoolExecutor(max(1, min(n, params.parallelism))) as pool:
        return list(pool.map(one, range(1, n + 1)))
