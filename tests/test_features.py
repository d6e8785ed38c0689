"""The feature matrix: vectors, vocabularies, invariance."""

import pytest
from pyspark.sql import functions as F

from basketry.config import FeatureConfig
from basketry.operators import vocabulary
from basketry.plans.features import FeatureModel, triples, vector_triples
from basketry.session import fresh_path
from basketry.sources.tables import STAR_CONFIG, scoring_lines, training_lines

CONFIG = FeatureConfig(fineline_count=0, upc_count=1)


@pytest.fixture(scope="module")
def model(hand):
    return FeatureModel.fit(hand, CONFIG)


def named(model, entries):
    rows = entries.join(model.names(), "feature_idx").collect()
    return {(r.visit_number, r.feature): r.value for r in rows}


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_hand_table(hand, model):
    got = named(model, triples(model.transform(hand)))
    assert got[(1, "total_purchase")] == 3 and got[(3, "return_visit")] == -10
    assert got[(1, "toy_visit")] == pytest.approx(2 / 3)
    assert got[(4, "dept_lines=BEAUTY")] == 3 and (4, "dept_lines=HEALTH AND BEAUTY AIDS") not in got
    assert got[(4, "dept_scans=HEALTH AND BEAUTY AIDS")] == 1 and (4, "dept_scans=BEAUTY") not in got
    assert got[(4, "dept_share=BEAUTY")] == pytest.approx(2 / 3) and got[(1, "dept_share=DAIRY")] == pytest.approx(1 / 3)
    assert (1, "dept_share=TOYS") not in got  # TOYS is a group, not one of the single shares
    assert got[(1, "fineline_scans=10")] == 3 and got[(1, "upc_lines=1001")] == 2
    assert (3, "upc_lines=1003") not in got  # seen once only
    assert "electronics_visit" not in model.fixed


def test_vectors_hold_the_entries(hand, model):
    matrix = model.matrix(hand)
    assert same(triples(matrix), vector_triples(matrix))
    assert same(triples(matrix), triples(model.transform(hand)))
    sizes = {v.features.size for v in matrix.select("features").collect()}
    assert sizes == {model.size} and model.names().count() == model.size


def test_order_and_partitioning_do_not_matter(small_lines):
    model = FeatureModel.fit(training_lines(small_lines), STAR_CONFIG)
    again = FeatureModel.fit(training_lines(small_lines).repartition(5, "upc").sortWithinPartitions(F.desc("scan_count")), STAR_CONFIG)
    assert same(model.features, again.features)
    lines = scoring_lines(small_lines)
    assert same(triples(model.transform(lines)), triples(model.transform(lines.repartition(6, "fineline_number"))))


def test_values_unknown_in_training_are_ignored(spark, hand, model):
    new = hand.withColumn("department_description", F.lit("NEW DEPARTMENT")).withColumn("upc", F.lit(1).cast("bigint")).drop("trip_type")
    matrix = model.transform(new)
    assert "trip_type" not in matrix.columns
    got = named(model, triples(matrix))
    assert got[(1, "total_dept_visit")] == 1 and got[(1, "total_unique_items")] == 1
    assert not [f for _, f in got if f.startswith(("dept_", "upc_"))]


def test_saved_and_loaded(spark, hand, model):
    path = fresh_path(spark, "test-model")
    model.save(path)
    loaded = FeatureModel.load(spark, path)
    assert loaded.config == model.config and loaded.size == model.size
    assert same(triples(loaded.transform(hand)), triples(model.transform(hand)))


def test_large_vocabulary_takes_the_salted_join(hand, model, monkeypatch):
    from basketry.operators import joins
    from basketry.plans import features

    expected = triples(model.transform(hand)).collect()

    def salted(big, lookup, on, how="inner", **_):
        return joins.lookup_join(big, lookup, on, how, max_broadcast_bytes=0, heavy_share=0.01, salts=4)

    monkeypatch.setattr(features, "lookup_join", salted)
    assert sorted(triples(model.transform(hand)).collect()) == sorted(expected)


def test_frequent_values_leave_out_the_excluded_department(hand):
    finelines = {r[0] for r in vocabulary.frequent(hand, "fineline_number", 0, "TOYS").collect()}
    assert finelines == {20, 30, 40, 50}
    assert {r[0] for r in vocabulary.frequent(hand, "fineline_number", 1, None).collect()} == {10, 40, 50}


def test_a_visit_with_a_third_of_all_lines(small_lines):
    """Two ways to the same scalars, with one visit and one product that each hold a third of the lines."""
    from basketry.operators.visits import visit_aggregates

    part = F.pmod(F.xxhash64("visit_number", "upc", "fineline_number"), F.lit(3))
    hot = small_lines.select(
        F.when(part == 0, -1).otherwise(F.col("visit_number")).alias("visit_number"),
        F.when(part == 0, 1).otherwise(F.col("trip_type")).alias("trip_type"),
        F.when(part == 0, "Friday").otherwise(F.col("weekday")).alias("weekday"),
        F.when(part == 1, 77).otherwise(F.col("upc")).alias("upc"),
        "scan_count", "department_description", "fineline_number",
    )
    scalars = visit_aggregates(hot)
    matrix = FeatureModel.fit(hot, STAR_CONFIG).transform(hot)
    assert same(matrix.select(scalars.columns), scalars)
    assert scalars.filter("visit_number = -1").count() == 1


def test_registered_entries_hold_every_block_of_all_visits(spark):
    from conftest import SMALL

    from basketry.catalog import QUERIES

    found = QUERIES["visit_feature_entries"](spark, SMALL).collect()
    blocks = {r.feature.split("=")[0] for r in found if "=" in r.feature}
    assert {"dept_share", "dept_lines", "dept_scans", "upc_lines"} <= blocks
    assert blocks == {r.feature.split("=")[0] for r in QUERIES["vocab_persist"](spark, SMALL).collect()}
    assert {r.visit_number for r in found} == {r.visit_number for r in QUERIES["visit_feature_matrix"](spark, SMALL).collect()}


def test_a_visit_of_very_many_values(spark):
    """Entries are gathered and sorted, so a visit's work grows with its values and not with their square."""
    from time import monotonic

    config = FeatureConfig(fineline_count=0, upc_count=0, merges={"HEALTH AND BEAUTY AIDS": "BEAUTY"})
    merged = F.when(F.col("id") % 2 == 0, "BEAUTY").otherwise("HEALTH AND BEAUTY AIDS")
    lines = spark.range(20_000).select(
        F.lit(1).cast("long").alias("visit_number"), F.lit(3).alias("trip_type"), F.lit("Friday").alias("weekday"), F.col("id").alias("upc"),
        F.lit(1).alias("scan_count"), merged.alias("department_description"), F.col("id").alias("fineline_number"),
    )
    model = FeatureModel.fit(lines, config)
    start = monotonic()
    row = model.matrix(lines).first()
    assert monotonic() - start < 30
    names = {r.feature: r.feature_idx for r in model.names().where("feature like 'dept_%'").collect()}
    assert row.features.numNonzeros() > 40_000 and row.features[names["dept_lines=BEAUTY"]] == 20_000
    assert "dept_lines=HEALTH AND BEAUTY AIDS" not in names and row.features[names["dept_scans=BEAUTY"]] == 10_000


def test_flagship_reads_the_vocabulary(spark):
    from conftest import SMALL

    import __spark_entry__ as entry_points

    rows = entry_points.entry(spark)
    assert {"entries", "n_entries"} <= set(rows.columns)
    assert rows.agg(F.min("n_entries")).first()[0] > 0
    most = max(int(e.split(":")[0]) for r in rows.select("entries").collect() for e in r.entries.split(","))
    assert most >= len(FeatureModel.fit(training_lines(entry_lines(spark, SMALL)), STAR_CONFIG).fixed)


def entry_lines(spark, directory):
    from basketry.sources.tables import star_scan_lines

    return star_scan_lines(spark, directory)
