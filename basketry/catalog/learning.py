"""Trained models.

Learned numbers have no SQL, so most queries report what must hold for any correct model: each visit and class once,
probabilities within 0..1 that sum to one. Boosting by name (``gb_probs``, ``xgb_probs``) takes the rounds and depth of the whole run; the other
queries fit fewer or smaller trees, which are parameters.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.catalog.base import CONFIG, over_lines, register, rounded
from basketry.catalog.encoding import VOCAB_SQL
from basketry.models import evaluation
from basketry.models.blending import fit_blend
from basketry.models.classifiers import KINDS, Params, bagged_models, fit_boosted, gradient_growth, train_model
from basketry.models.persistence import load_model, save_model
from basketry.models.softmax_boosting import left_out
from basketry.operators import clean, encode, visits
from basketry.operators.joins import join_blocks
from basketry.operators.metrics import ensemble_mean, multiclass_log_loss, prior_log_loss
from basketry.plans.features import FeatureModel
from basketry.plans.scoring import predict
from basketry.plans.workflow import begin_test, begin_train, ensemble, load_run, prepare_test, prepare_train
from basketry.session import fresh_path, materialize
from basketry.sources.tables import planted_labels, scoring_lines, star_scan_lines, training_lines

FOREST = Params(n_est=8, max_depth=5, parallelism=8)
BOOST = Params(n_est=2, max_depth=3, parallelism=8)
ROUNDS = Params(n_est=200)  # the rounds of the whole run, each tree of its kind's own depth

PREDICTED_SQL = """select v.visit_number, c.trip_type, 1 as p_in_range, cast(1 as double) as p_sum
from (select distinct visit_number from test where department_description is not null) v
cross join (select distinct trip_type from train where department_description is not null) c"""


def matrices(lines: DataFrame):
    features, train = prepare_train(training_lines(lines), CONFIG)
    return features, train, prepare_test(scoring_lines(lines), features)


def checked(predictions: DataFrame) -> DataFrame:
    total = F.sum("p").over(Window.partitionBy("visit_number"))
    return predictions.select(
        "visit_number", "trip_type", F.col("p").between(0, 1).cast("int").alias("p_in_range"), F.round(total, 6).alias("p_sum")
    )


def _trained(name: str, kind: str, params: Params) -> None:
    @over_lines(name, PREDICTED_SQL, written=True)
    def query(lines):
        _, train, test = matrices(lines)
        return checked(predict(train_model(kind, train, params), test))


_trained("rf_probs", "RF", FOREST)
_trained("et_probs", "ET", FOREST)
_trained("gb_probs", "GB", ROUNDS)
_trained("ab_probs", "AB", replace(FOREST, n_est=4, max_depth=None))
_trained("xgb_probs", "xGB", ROUNDS)

BRANDS = [f"Brand#{i}" for i in range(1, 26)]
NEIGHBOURS = 15


def department_vectors(lines: DataFrame) -> DataFrame:
    wide = encode.dept_line_counts_wide(lines, BRANDS, {})
    counts = F.array(*[F.col(f"`{b}`").cast("double") for b in BRANDS])
    return join_blocks(wide.select("visit_number", array_to_vector(counts).alias("features")), visits.visit_labels(lines))


COUNT_ARRAY = ", ".join(f"count(case when department_description = '{b}' then 1 end)" for b in BRANDS)


@over_lines(
    "knn_probs",
    f"""with v as (
      select visit_number, max(trip_type) as label, cast([{COUNT_ARRAY}] as double[25]) as x from ne group by 1),
    r as (
      select q.visit_number, t.label,
        row_number() over (partition by q.visit_number order by array_distance(q.x, t.x), t.visit_number) as place
      from (select * from v where visit_number % 10 = 0) q cross join (select * from v where visit_number % 10 <> 0) t),
    n as (select visit_number, label, count(*) as n from r where place <= {NEIGHBOURS} group by 1, 2)
    select q.visit_number, c.trip_type, round(coalesce(n.n, 0) / {NEIGHBOURS}.0::double, 6) as p
    from (select visit_number from v where visit_number % 10 = 0) q
    cross join (select distinct label as trip_type from v where visit_number % 10 <> 0) c
    left join n on n.visit_number = q.visit_number and n.label = c.trip_type""",
    written=True,
)
def knn_probs(lines):
    """Exact: the distances are sums of squared whole numbers, and ties go to the lower visit."""
    vectors = materialize(department_vectors(clean.nonempty_lines(lines)), "department-vectors")
    model = train_model("KNN", training_lines(vectors), Params(n_est=NEIGHBOURS))
    return rounded(predict(model, scoring_lines(vectors)), "p")


@over_lines("predict", PREDICTED_SQL, written=True)
def predicted(lines):
    _, train, test = matrices(lines)
    return checked(predict(train_model("RF", train, FOREST), test))


@register("model_persist", PREDICTED_SQL)
def model_persist(spark, directory):
    """A model that was saved and loaded predicts the same visits."""
    _, train, test = matrices(materialize(star_scan_lines(spark, directory), "scan-lines"))
    path = fresh_path(spark, "model")
    save_model(spark, train_model("RF", train, FOREST), path)
    return checked(predict(load_model(spark, path), test))


@over_lines("bagged_models", PREDICTED_SQL, written=True)
def bagged(lines):
    _, train, test = matrices(lines)
    first, second = [predict(m, test) for m in bagged_models("RF", train, 2, replace(FOREST, n_est=4))]
    return checked(ensemble_mean(first.unionByName(second)))


SMALL_BASE = {
    "RF": replace(FOREST, seed=1),
    "ET": replace(FOREST, seed=2),
    "KNN": Params(n_est=25),
    "xGB": replace(BOOST, n_est=1, learning_rate=0.1, subsample=0.9),
}


@over_lines("blend_train", PREDICTED_SQL, written=True)
def blend_train(lines):
    """Four base models on a fifth of the training visits, the final model on the rest."""
    _, train, test = matrices(lines)
    blend, rest = fit_blend(train, SMALL_BASE, is_base=F.col("visit_number") % 5 == 1)
    return checked(predict(train_model("RF", rest, FOREST), blend.transform(test)))


def _classes_sql(columns: str) -> str:
    return f"select trip_type, {columns} from (select distinct trip_type from train where department_description is not null) c"


@over_lines("early_stopping", _classes_sql("1 as rounds_in_range"), written=True)
def early_stopping(lines):
    """Rounds kept per class when boosting stops on a validation fifth."""
    _, train, _ = matrices(lines)
    params = replace(BOOST, n_est=4, learning_rate=0.1, subsample=0.9, feature_share=0.5, validation_column="held")
    model = fit_boosted(train.withColumn("held", evaluation.hash_share(20)), params)
    rounds = [(c, int(1 <= n <= params.n_est)) for c, n in zip(model.classes, model.kept, strict=True)]
    return train.sparkSession.createDataFrame(rounds, "trip_type int, rounds_in_range int")


@over_lines("oob_improvement", _classes_sql("1 as round_in_range, 1 as score_is_positive"), written=True)
def oob_improvement(lines):
    """Best round and holdout loss per class of one boosted model per class; the gains out of the bag are in ``oob_gains``."""
    _, train, _ = matrices(lines)
    fitted, held = evaluation.holdout_split(train)
    model = fit_boosted(fitted, BOOST)
    best = evaluation.boosting_rounds(model, held)
    return best.select(
        "trip_type",
        F.col("best_round").between(1, BOOST.n_est).cast("int").alias("round_in_range"),
        (F.col("best_score") > 0).cast("int").alias("score_is_positive"),
    )


PLANTED_SQL = """g as (
  select visit_number, cast(substr(department_description, 7) as int) % 5 as grp, count(*) as n
  from scans where department_description is not null group by 1, 2),
planted as (
  select visit_number, grp as label from (
    select *, row_number() over (partition by visit_number order by n desc, grp) as place from g) t where place = 1),
shares as (select label, count(*) / sum(count(*)) over () as share from planted where visit_number % 10 <> 0 group by label),
prior as (
  select count(*) as n_held, round(-avg(ln(share)), 6) as prior_loss from planted join shares using (label) where visit_number % 10 = 0)"""


def planted_matrices(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The full matrix with a label that the features explain: training and held-out visits."""
    labels = planted_labels(lines).withColumnRenamed("planted_label", "trip_type")
    matrix = FeatureModel.fit(training_lines(lines), CONFIG).matrix(lines.drop("trip_type"))
    rows = materialize(matrix.select("visit_number", "features").join(labels, "visit_number"), "planted-matrix")
    return training_lines(rows), scoring_lines(rows)


def with_prior(train: DataFrame, held: DataFrame, flags: dict[str, bool]) -> DataFrame:
    """Held-out visits and the loss of the training class shares on them, next to what a model must reach."""
    prior = prior_log_loss(train, held).select(F.round("log_loss", 6).alias("prior_loss"))
    counted = held.agg(F.count("*").alias("n_held")).join(F.broadcast(prior))
    return counted.select("n_held", "prior_loss", *[F.lit(int(v)).alias(k) for k, v in flags.items()])


JOINT = Params(n_est=20, max_depth=3, learning_rate=0.3, gamma=0.5, parallelism=8)


@over_lines("joint_boosting", f"select * from (with {PLANTED_SQL} select n_held, prior_loss, 1 as beats_prior, 1 as beats_one_vs_rest from prior) p", written=True)
def joint_boosting(lines):
    """Joint softmax boosting against the class shares and against one model per class with as many rounds.

    As in Spark the first tree of a separate model has its full weight, so with very few rounds the separate models lead.
    """
    train, held = planted_matrices(lines)
    joint = evaluation.model_loss(train_model("xGB", train, JOINT), held).first()[0]
    apart = evaluation.model_loss(fit_boosted(train, replace(JOINT, subsample=0.75, feature_share=0.5)), held).first()[0]
    prior = prior_log_loss(train, held).first()[0]
    return with_prior(train, held, {"beats_prior": joint < prior / 2, "beats_one_vs_rest": joint < apart})


@over_lines("joint_early_stopping", "select 1 as stopped, 1 as rolled_back, 1 as best_below_last, 1 as follows_holdout", written=True)
def joint_early_stopping(lines):
    """A label that nothing explains overfits: fitting stops by patience and ends with the best round on the holdout."""
    _, train, _ = matrices(lines)
    fitted, held = evaluation.holdout_split(train)
    params = replace(JOINT, n_est=60, max_depth=4, gamma=0.0, min_rows=1, learning_rate=0.5, patience=3)
    model = train_model("xGB", fitted, params, held)
    losses = [r.held_loss for r in model.history]
    loss = evaluation.model_loss(model, held).first()[0]
    flags = (
        len(losses) < params.n_est and len(losses) - model.best_round == params.patience,
        len(model.trees) == model.best_round and losses[model.best_round - 1] == min(losses),
        min(losses) < losses[-1],
        abs(loss - model.best_score) < 1e-9,
    )
    return train.sparkSession.createDataFrame([tuple(map(int, flags))], "stopped int, rolled_back int, best_below_last int, follows_holdout int")


@over_lines("oob_gains", "select cast(unnest(range(1, 5)) as int) as round, 1 as gains, 1 as equals_recount", written=True)
def oob_gains(lines):
    """Loss saved per round on the training visits it left out, and the same counted again from the models of both rounds."""
    train, _ = planted_matrices(lines)
    params = Params(n_est=4, max_depth=3)
    model, growth = train_model("GB", train, params), gradient_growth(params)
    rows = []
    for turn, reported in enumerate(model.history):
        out = train.where(left_out(growth, turn))
        before, after = (evaluation.model_loss(model.staged(n), out).first()[0] for n in (turn, turn + 1))
        rows.append((turn + 1, int(reported.oob_gain > 0), int(abs(before - after - reported.oob_gain) < 1e-9)))
    return train.sparkSession.createDataFrame(rows, "round int, gains int, equals_recount int")


KIND_SIZES = {
    "RF": Params(n_est=50, max_depth=8, parallelism=8),
    "ET": Params(n_est=40, max_depth=6),
    "GB": Params(n_est=15, max_depth=4, learning_rate=0.3),
    "AB": Params(n_est=20),
    "KNN": Params(n_est=25),
    "xGB": Params(n_est=15, max_depth=4, learning_rate=0.5, gamma=0.1, patience=5),
}


@over_lines(
    "planted_losses",
    f"select * from (with {PLANTED_SQL} select k.model, n_held, prior_loss, 1 as beats_prior from prior cross join (values ('RF'), ('ET'), ('GB'), ('AB'), ('KNN'), ('xGB')) k(model)) p",
    written=True,
)
def planted_losses(lines):
    """Each kind on a label that its features explain: its held-out loss must be below that of the class shares, which no uniform guess reaches."""
    train, held = planted_matrices(lines)
    prior = prior_log_loss(train, held).first()[0]
    rows = None
    for kind, params in KIND_SIZES.items():
        scored = predict(train_model(kind, train, params, held), held)
        loss = multiclass_log_loss(scored, held.select("visit_number", "trip_type"), eps=1e-3).first()[0]  # neighbours may give the true class no vote
        one = with_prior(train, held, {"beats_prior": loss < prior}).withColumn("model", F.lit(kind))
        rows = one if rows is None else rows.unionByName(one)
    return rows


STAGES = [50, 100, 150, 200]


@over_lines(
    "staged_curve",
    f"""select * from (with {PLANTED_SQL} select n_est, part, n_held, prior_loss, 1 as beats_prior from prior
      cross join (select cast(unnest([{", ".join(map(str, STAGES))}]) as int) as n_est) s cross join (values ('train'), ('holdout')) p(part)) c""",
    written=True,
)
def staged_curve(lines):
    """Training and held-out loss of a forest at 50, 100, 150 and 200 trees, all from one fit."""
    train, held = planted_matrices(lines)
    curve = evaluation.learning_curve("RF", train, held, STAGES, replace(FOREST, max_depth=6))
    prior = prior_log_loss(train, held).first()[0]
    flags = curve.select("n_est", "part", (F.col("log_loss") < prior / 2).cast("int").alias("beats_prior"))
    return flags.join(F.broadcast(with_prior(train, held, {})))


SEARCHED = {"max_depth": [1, 4], "learning_rate": [0.05, 0.5]}


@over_lines("random_search", f"select * from (with {PLANTED_SQL} select 4 as n_draws, n_held, prior_loss, 1 as best_is_least, 1 as beats_prior from prior) p", written=True)
def random_search(lines):
    """Threefold cross-validation of every draw, hopeless ones stopped, and the best point fitted again."""
    train, held = planted_matrices(lines)
    found = evaluation.random_search("xGB", train, Params(n_est=4, gamma=0.1, parallelism=4), SEARCHED)
    whole = [d.mean for d in found.draws if d.mean is not None]
    loss, prior = evaluation.model_loss(found.model, held).first()[0], prior_log_loss(train, held).first()[0]
    flags = {"n_draws": len(found.draws), "best_is_least": found.best.mean == min(whole), "beats_prior": loss < prior}
    return with_prior(train, held, flags)


@over_lines("test_model", "select * from (values ('ET', 1), ('RF', 1)) as t(model, loss_in_range)", written=True)
def test_models(lines):
    """Holdout loss per model, which for any sane probabilities lies between zero and the clipping bound."""
    _, train, _ = matrices(lines)
    fitted, held = evaluation.holdout_split(train)
    models = {kind: train_model(kind, fitted, replace(FOREST, n_est=4)) for kind in ("RF", "ET")}
    losses = evaluation.model_losses(train.sparkSession, models, held)
    return losses.select("model", F.col("log_loss").between(0, 35).cast("int").alias("loss_in_range"))


@over_lines("cross_validate", "select 3 as folds, 1 as loss_in_range", written=True)
def cross_validate(lines):
    _, train, _ = matrices(lines)
    loss = evaluation.cross_validated_loss(train, replace(FOREST, n_est=4))
    return train.sparkSession.createDataFrame([(3, int(0 < loss < 35))], "folds int, loss_in_range int")


GRID = {"learning_rate": [0.07], "max_depth": [2, 3], "subsample": [0.5], "feature_share": [0.3]}


@over_lines("param_search", "select * from (values (0.07::double, 2, 1), (0.07::double, 3, 1)) as t(learning_rate, max_depth, loss_in_range)", written=True)
def param_search(lines):
    _, train, _ = matrices(lines)
    found = evaluation.parameter_search("GB", train, replace(BOOST, n_est=1), GRID)
    rows = [(p["learning_rate"], p["max_depth"], int(0 < loss < 35)) for p, loss in found]
    return train.sparkSession.createDataFrame(rows, "learning_rate double, max_depth int, loss_in_range int")


@over_lines(
    "learning_curve",
    "select n_est, part, 1 as loss_in_range from (values (2), (4), (6)) n(n_est) cross join (values ('train'), ('holdout')) p(part)",
    written=True,
)
def learning_curve(lines):
    _, train, _ = matrices(lines)
    fitted, held = evaluation.holdout_split(train)
    curve = evaluation.learning_curve("RF", fitted, held, [2, 4, 6], FOREST)
    return curve.select("n_est", "part", F.col("log_loss").between(0, 35).cast("int").alias("loss_in_range"))


FIXED_NAMES = [
    "day_type", "total_unique_items", "total_dept_visit", "total_fineline_visit", "total_purchase", "total_return",
    "return_visit", *CONFIG.groups,
]
NAMES_SQL = "\nunion all\n".join(f"select '{n}' as feature, {i} as feature_idx" for i, n in enumerate(FIXED_NAMES))


@over_lines(
    "feature_importance",
    f"""select feature, cast(feature_idx as int) as feature_idx, 1 as in_range, cast(1 as double) as total
    from ({NAMES_SQL} union all select * from ({VOCAB_SQL}) v) n""",
    written=True,
)
def feature_importance(lines):
    """One importance per feature, together one."""
    features, train, _ = matrices(lines)
    table = evaluation.feature_importance(train_model("RF", train, FOREST), features.names())
    total = F.round(F.sum("importance").over(Window.partitionBy(F.lit(1))), 6)  # one row per feature
    return table.select("feature", "feature_idx", F.col("importance").between(0, 1).cast("int").alias("in_range"), total.alias("total"))


@register(
    "train_and_score",
    """select visit_number, case when count(department_description) = 0 then 0.75::double else 1.0::double end as p_sum,
      1 as p_in_range from test group by 1""",
)
def train_and_score(spark, directory):
    """The whole run: train, predict every test visit, write the files, average them."""
    lines = materialize(star_scan_lines(spark, directory), "scan-lines")
    trained = begin_train(
        training_lines(lines), "RF", replace(FOREST, n_est=4), n_models=2, config=CONFIG, blend_base={"RF": FOREST, "ET": FOREST}
    )
    root, target = fresh_path(spark, "run-models"), fresh_path(spark, "run-ensemble")
    begin_test(trained, scoring_lines(lines).drop("trip_type"), root)
    classes = trained.models[0].classes
    ensemble(spark, root, target, classes)
    schema = ", ".join(["VisitNumber bigint", *[f"TripType_{c} double" for c in classes]])
    wide = spark.read.schema(schema).option("header", True).csv(target)
    p = F.array(*[F.col(f"TripType_{c}") for c in classes])
    return wide.select(
        F.col("VisitNumber").alias("visit_number"),
        F.round(F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x), 4).alias("p_sum"),
        F.forall(p, lambda x: x.between(0, 1)).cast("int").alias("p_in_range"),
    )


@over_lines(
    "train_model",
    """select k.model, count(*) as n_rows, cast(0 as bigint) as n_invalid
    from (values ('RF'), ('ET'), ('GB'), ('AB'), ('KNN'), ('xGB')) k(model)
    cross join (select distinct visit_number from test where department_description is not null) v
    cross join (select distinct trip_type from train where department_description is not null) c group by 1""",
    written=True,
)
def train_models(lines):
    """Every kind by its name: rows predicted and how many are no probability."""
    _, train, test = matrices(lines)
    smallest = Params(n_est=1, max_depth=2, parallelism=8)
    scored = [
        predict(train_model(kind, train, replace(smallest, n_est=5) if kind == "KNN" else smallest), test)
        .withColumn("model", F.lit(kind))
        for kind in KINDS
    ]
    invalid = F.count_if(~F.coalesce(F.col("p").between(0, 1), F.lit(False)))
    counted = [s.groupBy("model").agg(F.count(F.lit(1)).alias("n_rows"), invalid.alias("n_invalid")) for s in scored]
    return reduce(DataFrame.unionByName, counted)


@register("saved_run", f"select * from (with {PLANTED_SQL} select cast(count(*) as bigint) as n_rows, 0 as n_different from planted cross join (select distinct label from planted where visit_number % 10 <> 0) c where visit_number % 10 = 0) r")
def saved_run(spark, directory):
    """A blended run of three kinds, saved, loaded by its path, and its predictions of the held-out visits compared with those before."""
    lines = materialize(star_scan_lines(spark, directory), "scan-lines")
    labels = planted_labels(lines).withColumnRenamed("planted_label", "trip_type")
    train = training_lines(lines).drop("trip_type").join(labels, "visit_number")
    base = {"ET": Params(n_est=5, max_depth=4), "KNN": Params(n_est=5), "xGB": replace(JOINT, n_est=2)}
    trained = begin_train(train, "xGB", replace(JOINT, n_est=3), config=CONFIG, blend_base=base, save_to=(path := fresh_path(spark, "run")))
    loaded = load_run(spark, path)
    test = scoring_lines(lines).drop("trip_type")

    def scored(run):
        return predict(run.models[0], run.blend.transform(prepare_test(test, run.features)))

    both = scored(trained).join(scored(loaded).withColumnRenamed("p", "q"), ["visit_number", "trip_type"])
    return both.agg(F.count("*").alias("n_rows"), F.count_if(F.abs(F.col("p") - F.col("q")) > 1e-12).cast("int").alias("n_different"))
