"""Statistics, losses, predictions and ensembles that have exact results."""

from pyspark.sql import functions as F

from basketry.catalog.base import CLASSES, dealt_probabilities, fixed_probabilities, over_lines, register, rounded
from basketry.models.evaluation import fold, holdout_split, stratified_fold, stratified_split
from basketry.operators import clean, encode, labels, metrics, stats, visits
from basketry.operators.ranking import value_counts, with_position
from basketry.operators.sets import max_per_key
from basketry.plans.scoring import empty_visit_default, final_predictions, final_predictions_of_models
from basketry.plans.workflow import ensemble
from basketry.session import fresh_path
from basketry.sources import files
from basketry.sources.tables import star_scan_lines, scoring_lines, training_lines

DEPT = "department_description"

CHI2_SQL = f"""
with x as (select visit_number, {DEPT} as f, cast(count(*) as double) as v, max(trip_type) as c from ne group by 1, 2),
cp as (select trip_type as c, cast(count(*) as double) / sum(count(*)) over () as cp from labels group by 1),
fs as (select f, sum(v) as tot from x group by 1),
ob as (select f, c, sum(v) as o from x group by 1, 2),
s as (
  select fs.f as feature, sum(pow(coalesce(o, 0) - cp * tot, 2) / (cp * tot)) as chi2
  from fs cross join cp left join ob on ob.f = fs.f and ob.c = cp.c group by 1)
"""


def _chi2(lines):
    counts = encode.dept_line_counts(lines, {})
    triples = counts.select("visit_number", F.col(DEPT).alias("feature"), F.col("n_lines").cast("double").alias("value"))
    return stats.chi2_scores(triples, visits.visit_labels(lines))


@over_lines("chi2_scores", CHI2_SQL + "select feature, round(chi2, 6) as chi2 from s")
def chi2_scores(lines):
    return rounded(_chi2(lines), "chi2")


@over_lines(
    "chi2_pvalues",
    CHI2_SQL
    + """select feature, round(chi2, 6) as chi2,
      round(list_sum(list_transform(generate_series(0, 6), lambda i: exp(-chi2 / 2 + i * ln(chi2 / 2) - lgamma(i + 1)))), 6) as p_value
    from s""",
)
def chi2_pvalues(lines):
    return rounded(stats.chi2_pvalues(_chi2(lines), len(CLASSES)), "chi2", "p_value")


SCALED = ["total_unique_items", "total_purchase", "total_return"]
SCALED_SQL = """select visit_number, count(distinct upc) as total_unique_items,
  sum(case when scan_count > 0 then scan_count else 0 end) as total_purchase,
  sum(case when scan_count < 0 then -scan_count else 0 end) as total_return from ne group by 1"""


@over_lines(
    "standardize",
    "select visit_number, "
    + ", ".join(f"round(({c} - avg({c}) over ()) / nullif(stddev_samp({c}) over (), 0), 6) as {c}" for c in SCALED)
    + f" from ({SCALED_SQL}) v",
)
def standardize(lines):
    return rounded(stats.standardized(visits.visit_aggregates(lines, *SCALED), SCALED), *SCALED)


@over_lines(
    "impute_mean",
    """select visit_number, scan_count, round(coalesce(cast(upc as double), avg(upc) over ()), 6) as upc,
      round(coalesce(cast(fineline_number as double), avg(fineline_number) over ()), 6) as fineline_number from scans""",
)
def impute_mean(lines):
    columns = ["upc", "fineline_number"]
    return rounded(stats.imputed(lines.select("visit_number", "scan_count", *columns), columns), *columns)


@over_lines(
    "label_encode",
    """select l.visit_number, l.trip_type, c.class_idx from labels l join (
      select trip_type, cast(row_number() over (order by trip_type) as int) - 1 as class_idx
      from (select distinct trip_type from labels where visit_number % 10 <> 0) t) c on c.trip_type = l.trip_type""",
)
def label_encode(lines):
    """Classes numbered on the training visits, applied to all."""
    known = visits.visit_labels(lines)
    classes = labels.class_values(training_lines(known))
    return known.withColumn("class_idx", labels.class_index("trip_type", classes)).filter("class_idx is not null")


@over_lines(
    "unique_values",
    "select trip_type, row_number() over (order by trip_type) as place from (select distinct trip_type from scans) d",
)
def unique_values(lines):
    return with_position(lines.select("trip_type").distinct(), F.asc("trip_type"), name="place", start=1)


@over_lines(
    "argmin_importance",
    f"""select importance, feature_idx, feature from (
      select {DEPT} as feature, cast(count(*) as double) as importance, row_number() over (order by {DEPT}) - 1 as feature_idx
      from ne group by 1) t order by importance, feature_idx limit 1""",
)
def argmin_importance(lines):
    counts = value_counts(clean.nonempty_lines(lines), DEPT)
    table = with_position(counts, F.asc(DEPT), name="feature_idx")
    return stats.least_important(table.select("feature_idx", F.col(DEPT).alias("feature"), F.col("n").cast("double").alias("importance")))


# Losses -----------------------------------------------------------------------------------------------------------


@over_lines(
    "log_loss",
    """select model_index, round(-avg(ln(least(greatest(p, 1e-15), 1 - 1e-15))), 6) as log_loss
    from probs join labels on labels.visit_number = probs.visit_number and labels.trip_type = probs.trip_type group by 1""",
)
def log_loss(lines):
    return rounded(metrics.log_loss(fixed_probabilities(lines), visits.visit_labels(lines), "model_index"), "log_loss")


@over_lines(
    "multiclass_log_loss",
    """select model_index, round(-avg(ln(q)), 6) as log_loss from (
      select visit_number, trip_type, model_index,
        least(greatest(p, 0.01), 0.99) / sum(least(greatest(p, 0.01), 0.99)) over (partition by visit_number, model_index) as q
      from probs) n
    join labels on labels.visit_number = n.visit_number and labels.trip_type = n.trip_type group by 1""",
)
def multiclass_log_loss(lines):
    probs = fixed_probabilities(lines)
    return rounded(metrics.multiclass_log_loss(probs, visits.visit_labels(lines), "model_index", eps=0.01), "log_loss")


@over_lines(
    "prior_log_loss",
    """select round(-avg(ln(p)), 6) as log_loss from (
      select trip_type, cast(count(*) as double) / sum(count(*)) over () as p from labels where visit_number % 10 <> 0 group by 1) c
    join labels l on l.trip_type = c.trip_type where l.visit_number % 10 = 0""",
)
def prior_log_loss(lines):
    known = visits.visit_labels(lines)
    return rounded(metrics.prior_log_loss(training_lines(known), scoring_lines(known)), "log_loss")


# Predictions ------------------------------------------------------------------------------------------------------

EMPTY_SQL = """select e.visit_number, k.trip_type, cast(case when k.trip_type = 999 then 0.75 else 0 end as double) as p
from (select visit_number from scans group by visit_number having count(department_description) = 0) e cross join classes k"""


@over_lines("empty_visit_default", EMPTY_SQL)
def empty_default(lines):
    return empty_visit_default(lines, CLASSES)


FINAL_SQL = f"""select visit_number, trip_type, round(max(p), 6) as p from (
  select visit_number, trip_type, p from probs where model_index = 0 union all {EMPTY_SQL}) z group by 1, 2"""


def _final(lines):
    predicted = fixed_probabilities(lines).filter("model_index = 0").drop("model_index")
    return final_predictions(predicted, lines, CLASSES)


@over_lines("final_predictions", FINAL_SQL)
def finals(lines):
    return rounded(_final(lines), "p")


@over_lines("union_predictions", f"select visit_number, trip_type, round(p, 6) as p from probs where model_index = 0 union all {EMPTY_SQL}")
def union_predictions(lines):
    predicted = fixed_probabilities(lines).filter("model_index = 0").drop("model_index")
    return rounded(predicted.unionByName(empty_visit_default(lines, CLASSES)), "p")


@over_lines("max_dedup", "select visit_number, trip_type, round(max(p), 6) as p from probs group by 1, 2")
def max_dedup(lines):
    return rounded(max_per_key(fixed_probabilities(lines).drop("model_index")), "p")


@over_lines("ensemble_mean", "select visit_number, trip_type, round(avg(p), 6) as p from probs group by 1, 2")
def ensemble_means(lines):
    return rounded(metrics.ensemble_mean(fixed_probabilities(lines)), "p")


WIDE_SQL = ", ".join(f"max(case when trip_type = {c} then p end) as p_{c}" for c in CLASSES)


def _wide(df):
    return df.select(F.col("VisitNumber").alias("visit_number"), *[F.col(f"TripType_{c}").alias(f"p_{c}") for c in CLASSES])


def _read_wide(spark, path):
    schema = ", ".join(["VisitNumber bigint", *[f"TripType_{c} double" for c in CLASSES]])
    return _wide(spark.read.schema(schema).option("header", True).csv(path))


@register("pred_sink", f"select visit_number, {WIDE_SQL} from ({FINAL_SQL}) f group by 1")
def pred_sink(spark, directory):
    """The wide prediction file, written and read again."""
    path = fresh_path(spark, "predictions")
    files.write_predictions(_final(star_scan_lines(spark, directory)), path, CLASSES)
    return _read_wide(spark, path)


def _write_models(spark, directory):
    root = fresh_path(spark, "model-predictions")
    lines = star_scan_lines(spark, directory)
    probs, tasks = dealt_probabilities(lines)
    files.write_model_predictions(final_predictions_of_models(probs, lines, CLASSES, 3, tasks), root, CLASSES)
    return root


MODELS_SQL = f"""select visit_number, trip_type, cast(model_index as int) as model_index, round(max(p), 6) as p from (
  select visit_number, trip_type, model_index, p from probs 
  union all select e.*, m.model_index from ({EMPTY_SQL}) e cross join (select 0 as model_index union all select 1 union all select 2) m
) z group by 1, 2, 3""".replace("select e.*, m.model_index", "select e.visit_number, e.trip_type, m.model_index, e.p")


@register("pred_scan", MODELS_SQL)
def pred_scan(spark, directory):
    return files.read_predictions(spark, _write_models(spark, directory), CLASSES)


@register(
    "ensemble_sink",
    f"select visit_number, {WIDE_SQL} from (select visit_number, trip_type, round(avg(p), 6) as p from ({MODELS_SQL}) m group by 1, 2) f group by 1",
)
def ensemble_sink(spark, directory):
    """Three prediction files, averaged into a fourth."""
    target = fresh_path(spark, "ensemble")
    ensemble(spark, _write_models(spark, directory), target, CLASSES)
    return _read_wide(spark, target)


@over_lines(
    "blend_fraction",
    """select visit_number, case when visit_number % 5 = 1 then 'base' else 'rest' end as part
    from labels where visit_number % 10 <> 0""",
)
def blend_fraction(lines):
    known = training_lines(visits.visit_labels(lines))
    is_base = F.col("visit_number") % 5 == 1
    return known.select("visit_number", F.when(is_base, "base").otherwise("rest").alias("part"))


@over_lines("random_split", "select visit_number, 1 as n_parts from labels")
def random_split(lines):
    """Each visit falls into exactly one part of the hash split."""
    fitted, held = holdout_split(visits.visit_labels(lines), 0.1)
    both = fitted.unionByName(held)
    return both.groupBy("visit_number").agg(F.count(F.lit(1)).cast("int").alias("n_parts"))


@over_lines(
    "cross_validation_folds",
    "select visit_number, trip_type, 1 as n_folds, 1 as in_range from labels",
)
def cross_validation_folds(lines):
    folds = visits.visit_labels(lines).withColumn("fold", fold(3))
    return folds.groupBy("visit_number", "trip_type").agg(
        F.count_distinct("fold").cast("int").alias("n_folds"), F.max(F.col("fold").between(0, 2).cast("int")).alias("in_range")
    )


STRATA_SQL = """select visit_number, trip_type, row_number() over (partition by trip_type order by md5(visit_number || ':1')) - 1 as place,
  count(*) over (partition by trip_type) as n from labels"""


@over_lines("stratified_split", f"select visit_number, trip_type, cast(place < floor(n * 0.1 + 0.5) as int) as held from ({STRATA_SQL}) s")
def stratified_split_of_visits(lines):
    """Exactly a tenth of each class is held out, the same visits everywhere."""
    labels = visits.visit_labels(lines)
    fitted, held = stratified_split(labels, 0.1)
    return fitted.withColumn("held", F.lit(0)).unionByName(held.withColumn("held", F.lit(1)))


@over_lines("stratified_folds", f"select visit_number, trip_type, cast(floor(place * 3 / n) as int) as fold from ({STRATA_SQL}) s")
def stratified_folds(lines):
    labels = visits.visit_labels(lines)
    return labels.withColumn("fold", stratified_fold(labels, 3))
