"""Splits, losses, cross validation, parameter search and importances."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce
from itertools import product
from threading import Lock

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.columns import clipped
from basketry.models.apart_boosting import BoostedModel
from basketry.models.classifiers import Params, train_model
from basketry.models.softmax_boosting import SoftmaxBoostedModel
from basketry.models.staging import with_leaf_shares, with_staged
from basketry.operators.labels import class_index
from basketry.operators.ranking import with_position
from basketry.session import materialize

SEARCH_GRID = {"learning_rate": [0.07], "max_depth": [10], "subsample": [0.5], "feature_share": [0.3]}
SEARCH_DRAWS = 20


def hash_share(percent: float, seed: int = 1) -> Column:
    """True for about ``percent`` of the visits, always the same ones: a split that needs no shuffle."""
    return F.pmod(F.xxhash64("visit_number", F.lit(seed)), F.lit(10_000)) < F.lit(int(percent * 100))


def holdout_split(matrix: DataFrame, share: float = 0.1, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """A split by hash alone: about ``share`` of the visits, without a pass over the data. ``stratified_split`` is exact."""
    held = hash_share(share * 100, seed)
    return matrix.filter(~held), matrix.filter(held)


def fold(n: int = 3, seed: int = 1) -> Column:
    return F.pmod(F.xxhash64("trip_type", "visit_number", F.lit(seed)), F.lit(n)).cast("int")


def digest(seed: int = 1, visit: str = "visit_number") -> Column:
    """A random place of a visit that any database can compute again."""
    return F.md5(F.concat(F.col(visit).cast("string"), F.lit(f":{seed}")))


def class_bounds(labels: DataFrame, places: dict[int, list[int]], seed: int = 1) -> dict[int, list[str | None]]:
    """Per class the digests at the given places of its order by digest; null beyond the last visit.

    Only (class, digest) pairs are sorted, by range over all tasks, so a class with most visits is no larger task than others.
    """
    counts = _class_counts(labels)
    start, before = {}, 0
    for c in sorted(counts):
        start[c], before = before, before + counts[c]
    wanted = {start[c] + place: (c, i) for c, listed in places.items() for i, place in enumerate(listed) if place < counts.get(c, 0)}
    found: dict[int, list[str | None]] = {c: [None] * len(listed) for c, listed in places.items()}
    if wanted:
        pairs = labels.where(F.col("trip_type").isNotNull()).select("trip_type", digest(seed).alias("d"))
        placed = with_position(pairs, F.asc("trip_type"), F.asc("d"))
        for r in placed.where(F.col("position").isin(list(wanted))).select("position", "d").collect():
            c, i = wanted[r["position"]]
            found[c][i] = r["d"]
    return found


def _class_counts(labels: DataFrame) -> dict[int, int]:
    return {r[0]: r[1] for r in labels.where(F.col("trip_type").isNotNull()).groupBy("trip_type").count().collect()}


def _of_class(values: dict[int, Column]) -> Column:
    """The value that belongs to a visit's class; null for other classes."""
    found = F.lit(None).cast("string")
    for c, value in values.items():
        found = F.when(F.col("trip_type") == c, value).otherwise(found)
    return found


def in_holdout(labels: DataFrame, share: float = 0.1, seed: int = 1) -> Column:
    """True for the first round(share * n) visits of each class in the order of their digests: exact, stratified and repeatable.

    The rows themselves are not moved: a visit is compared with one digest per class. Visits without a label are not held out.
    """
    places = {c: [int(n * share + 0.5)] for c, n in _class_counts(labels).items()}
    bounds = class_bounds(labels, places, seed)
    ends = {c: F.lit(b[0] if b[0] is not None else "~") for c, b in bounds.items()}  # ~ comes after every digest
    return F.coalesce(digest(seed) < _of_class(ends), F.lit(False))


def stratified_split(matrix: DataFrame, share: float = 0.1, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Training and held-out visits, the latter exactly round(share * n) of each class."""
    held = in_holdout(matrix.select("visit_number", "trip_type"), share, seed)
    return matrix.filter(~held), matrix.filter(held)


def stratified_fold(labels: DataFrame, n: int = 3, seed: int = 1) -> Column:
    """The fold of a visit: its class in the order of the digests, cut into n parts whose sizes differ by one at most."""
    places = {c: [(total * i + n - 1) // n for i in range(1, n)] for c, total in _class_counts(labels).items()}
    bounds = class_bounds(labels, places, seed)
    own = digest(seed)
    steps = [F.coalesce((own >= _of_class({c: F.lit(b[i] if b[i] is not None else "~") for c, b in bounds.items()})).cast("int"), F.lit(0)) for i in range(n - 1)]
    return reduce(lambda a, b: a + b, steps, F.lit(0))


def model_loss(model, labelled: DataFrame) -> DataFrame:
    """Log loss of a model on labelled visits."""
    scored = model.with_probability(labelled, "_p")
    p = F.get("_p", class_index("trip_type", model.classes))
    return scored.agg((-F.avg(F.log(clipped(F.coalesce(p, F.lit(0.0)))))).alias("log_loss"))


def model_losses(spark: SparkSession, models: dict[str, object], labelled: DataFrame) -> DataFrame:
    """One loss per model."""
    losses = None
    for name, model in models.items():
        loss = model_loss(model, labelled).select(F.lit(name).alias("model"), "log_loss")
        losses = loss if losses is None else losses.unionByName(loss)
    return losses


def with_folds(train: DataFrame, folds: int = 3, seed: int = 1) -> DataFrame:
    """The visits with their fold, written once for all fits."""
    return materialize(train.withColumn("fold", stratified_fold(train.select("visit_number", "trip_type"), folds, seed)), "folds")


def fold_loss(kind: str, folded: DataFrame, i: int, params: Params) -> float:
    """Loss on one fold of a model fitted on the others."""
    rest, own = folded.filter(F.col("fold") != i).drop("fold"), folded.filter(F.col("fold") == i).drop("fold")
    return model_loss(train_model(kind, rest, params), own).first()[0]


def cross_validated_loss(train: DataFrame, params: Params, folds: int = 3, kind: str = "RF") -> float:
    """Mean log loss of models of ``kind`` over exact, stratified folds; folds are fitted side by side."""
    folded = with_folds(train, folds)
    with ThreadPoolExecutor(max(1, min(folds, params.parallelism))) as pool:
        losses = list(pool.map(lambda i: fold_loss(kind, folded, i, params), range(folds)))
    return sum(losses) / folds


def search_draws(grid: dict[str, list] | None = None, draws: int = SEARCH_DRAWS, seed: int = 1) -> list[dict]:
    """Random draws without repetition from a grid; a grid with fewer points than draws is used whole."""
    from random import Random

    grid = grid or SEARCH_GRID
    points = [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]
    return points if len(points) <= draws else Random(seed).sample(points, draws)


@dataclass
class Draw:
    """One point of a search: its losses on the folds that were fitted, and their mean if all were."""

    point: dict
    losses: list[float]
    folds: int

    @property
    def mean(self) -> float | None:
        return sum(self.losses) / self.folds if len(self.losses) == self.folds else None


@dataclass
class Search:
    draws: list[Draw]
    best: Draw
    model: object

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per draw: its parameters as text, the folds fitted, the mean loss (null if it was stopped)."""
        rows = [(", ".join(f"{k}={v}" for k, v in sorted(d.point.items())), len(d.losses), d.mean, d is self.best) for d in self.draws]
        return spark.createDataFrame(rows, "parameters string, folds int, mean_loss double, best boolean")


def random_search(kind: str, train: DataFrame, params: Params, grid: dict[str, list] | None = None, draws: int = SEARCH_DRAWS, folds: int = 3) -> Search:
    """Cross-validated random search. The best point is fitted again on all visits.

    Folds are written once; the draws share ``params.parallelism`` threads. A draw stops as soon as the folds it has lost cannot be
    made up for: losses are not negative, so once their sum exceeds that of the best whole draw it cannot win. The winner (ties to the earlier draw)
    is therefore the same whatever the order.
    """
    folded = with_folds(train, folds)
    found = [Draw(point, [], folds) for point in search_draws(grid, draws)]
    least, lock = [float("inf")], Lock()

    def work(draw: Draw) -> None:
        for i in range(folds):
            draw.losses.append(fold_loss(kind, folded, i, replace(params, **draw.point)))
            if i < folds - 1 and sum(draw.losses) > least[0]:
                return
        with lock:
            least[0] = min(least[0], sum(draw.losses))

    with ThreadPoolExecutor(max(1, params.parallelism)) as pool:
        list(pool.map(work, found))
    best = min((d for d in found if d.mean is not None), key=lambda d: d.mean)
    return Search(found, best, train_model(kind, train, replace(params, **best.point)))


def parameter_search(kind: str, train: DataFrame, params: Params, grid: dict[str, list] | None = None, draws: int = SEARCH_DRAWS) -> list[tuple[dict, float]]:
    """Each draw with its loss on a held-out tenth, best first; ``random_search`` cross-validates."""
    fitted, held = holdout_split(train)
    scored = []
    for point in search_draws(grid, draws):
        model = train_model(kind, fitted, replace(params, **point))
        scored.append((point, model_loss(model, held).first()[0]))
    return sorted(scored, key=lambda s: s[1])


def staged_losses(model, data: DataFrame, sizes: list[int]) -> dict[int, float]:
    """Log loss of a model as it was with so many estimators, all sizes in one pass."""
    staged = with_staged(model, data, sizes, "_staged")
    index = class_index("trip_type", model.classes)
    losses = [(-F.avg(F.log(clipped(F.coalesce(F.get(F.get("_staged", F.lit(i)), index), F.lit(0.0)))))).alias(str(n)) for i, n in enumerate(sizes)]
    return {n: v for n, v in zip(sizes, staged.agg(*losses).first(), strict=True)}


def learning_curve(kind: str, train: DataFrame, holdout: DataFrame, sizes: list[int], params: Params) -> DataFrame:
    """Training and holdout loss for growing numbers of estimators, from one fit of the largest."""
    model = train_model(kind, train, replace(params, n_est=max(sizes), patience=None))
    with_leaf_shares(model, train)
    rows = [(n, part, loss) for part, data in (("train", train), ("holdout", holdout)) for n, loss in staged_losses(model, data, sizes).items()]
    return train.sparkSession.createDataFrame(rows, "n_est int, part string, log_loss double")


def feature_importance(model, names: DataFrame) -> DataFrame:
    """feature_idx, feature, importance. One number per feature comes from the model, the names from the table."""
    spark = names.sparkSession
    values = spark.createDataFrame(list(enumerate(model.importances())), "feature_idx int, importance double")
    return values.join(names, "feature_idx").select("feature_idx", "feature", "importance")


def round_losses(spark: SparkSession, model: SoftmaxBoostedModel) -> DataFrame:
    """The losses after every round that was fitted, also of those after the best one."""
    return spark.createDataFrame(model.rounds(), "round int, train_loss double, held_loss double, oob_gain double")


def boosting_rounds(model: BoostedModel, holdout: DataFrame) -> DataFrame:
    spark = holdout.sparkSession
    return spark.createDataFrame(model.rounds(holdout), "trip_type int, best_round int, best_score double")
