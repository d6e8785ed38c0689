"""Files in and out."""

import pytest
from pyspark.sql import functions as F

from basketry import config
from basketry.plans.workflow import ensemble, write_profiles
from basketry.schema import TEST_LINES, TRAIN_LINES
from basketry.session import fresh_path, shared_dir
from basketry.sources import files


def test_scan_lines_round_trip(spark, hand):
    path = fresh_path(spark, "csv")
    hand.write.option("header", True).csv(path)
    back = files.read_scan_lines(spark, path, labelled=True)
    assert back.schema == TRAIN_LINES and sorted(map(str, back.collect())) == sorted(map(str, hand.collect()))
    unlabelled = fresh_path(spark, "csv")
    hand.drop("trip_type").write.option("header", True).csv(unlabelled)
    assert files.read_scan_lines(spark, unlabelled, labelled=False).schema == TEST_LINES


def test_partial_load(hand):
    assert [r.visit_number for r in files.partial_lines(hand, True, rows=3).collect()] == [1, 1, 1]
    assert files.partial_lines(hand, True).count() == 10


def test_wide_predictions_have_all_classes_and_six_decimals(spark):
    rows = [(7, 3, 1 / 3), (7, 999, 2 / 3)]
    probs = spark.createDataFrame(rows, "visit_number bigint, trip_type int, p double")
    wide = files.wide_predictions(probs)
    assert wide.columns == ["VisitNumber", *[f"TripType_{c}" for c in config.TRIP_TYPES]] and len(wide.columns) == 39
    row = wide.first()
    assert (row.TripType_3, row.TripType_999, row.TripType_4) == ("0.333333", "0.666667", None)


def test_ensemble_of_files(spark):
    rows = [(v, c, m, (m + 1) * (0.1 if c == 3 else 0.2)) for v in (1, 2) for c in (3, 999) for m in (0, 1, 2)]
    probs = spark.createDataFrame(rows, "visit_number bigint, trip_type int, model_index int, p double")
    root, target = fresh_path(spark, "models"), fresh_path(spark, "ensemble")
    files.write_model_predictions(probs, root, [3, 999])
    assert files.read_predictions(spark, root, [3, 999]).filter("model_index = 2").count() == 4
    ensemble(spark, root, target, [3, 999])
    lines = sorted(r.value for r in spark.read.text(target).collect() if not r.value.startswith("Visit"))
    assert lines == ["1,0.200000,0.400000", "2,0.200000,0.400000"]


def test_profile_files(spark, hand):
    root = fresh_path(spark, "profiles")
    write_profiles(hand, hand.filter(F.col("visit_number") == 1), root)
    missing = {r.value for r in spark.read.text(f"{root}/finelines_not_in_test").collect()}
    assert missing == {"30", "40", "50"}
    counts = spark.read.option("header", True).csv(f"{root}/upc_counts").collect()
    assert {r.upc: r.n for r in counts} == {"1001": "2", "1002": "1", "1003": "1", "1004": "2", "1005": "2"}


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/") or shared_dir(spark)


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        shared_dir(Session())
