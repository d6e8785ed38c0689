"""From a trained model to final predictions, and from several predictions to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.config import EMPTY_VISIT_P, OTHER_CLASS
from basketry.operators.labels import class_at, per_class
from basketry.operators.sets import max_per_key
from basketry.operators.visits import empty_visits


def predict(model, matrix: DataFrame) -> DataFrame:
    """visit_number, trip_type, p for every visit and class."""
    scored = model.with_probability(matrix, "_p").select("visit_number", F.posexplode("_p").alias("idx", "p"))
    return scored.select("visit_number", class_at(F.col("idx"), model.classes).alias("trip_type"), "p")


def empty_visit_default(lines: DataFrame, classes: list[int], tasks: int | None = None) -> DataFrame:
    """Visits without a department: a fixed probability for the catch-all class, zero for the rest. Dealt by visit over ``tasks``, if given."""
    p = F.when(F.col("trip_type") == OTHER_CLASS, EMPTY_VISIT_P).otherwise(0.0)
    visits = empty_visits(lines) if tasks is None else empty_visits(lines).repartition(tasks, "visit_number")
    return per_class(visits, classes).withColumn("p", p)


def final_predictions(predicted: DataFrame, lines: DataFrame, classes: list[int]) -> DataFrame:
    """Predicted and empty visits together, one row per visit and class."""
    return max_per_key(predicted.unionByName(empty_visit_default(lines, classes)))


def final_predictions_of_models(predicted: DataFrame, lines: DataFrame, classes: list[int], n_models: int, tasks: int | None = None) -> DataFrame:
    """The same for predictions of several models (column ``model_index``), in one pass over the lines.

    ``tasks``: ``predicted`` is dealt by visit over so many. The empty visits are then dealt alike, and no row per class is moved.
    """
    every = F.explode(F.array(*[F.lit(i) for i in range(n_models)]))
    empty = empty_visit_default(lines, classes, tasks).withColumn("model_index", every)
    return max_per_key(predicted.unionByName(empty))
