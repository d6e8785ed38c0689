import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from basketry.schema import TRAIN_LINES  # noqa: E402
from basketry.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"

HAND_ROWS = [
    (3, 1, "Friday", 1001, 2, "TOYS", 10),
    (3, 1, "Friday", 1001, 1, "TOYS", 10),
    (3, 1, "Friday", 1002, -1, "DAIRY", 20),
    (999, 2, "Monday", None, 1, None, None),
    (5, 3, "Sunday", None, 1, "PHARMACY RX", None),
    (5, 3, "Sunday", 1003, -3, "PHARMACY OTC", 30),
    (8, 4, "Wednesday", 1004, 2, None, 40),
    (8, 4, "Wednesday", 1004, 1, "HEALTH AND BEAUTY AIDS", 40),
    (8, 4, "Wednesday", 1005, 4, "BEAUTY", 50),
    (8, 4, "Wednesday", 1005, -4, "BEAUTY", 50),
]


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def hand(spark):
    return spark.createDataFrame(HAND_ROWS, TRAIN_LINES)


@pytest.fixture(scope="session")
def small_lines(spark):
    from basketry.sources.tables import star_scan_lines

    return star_scan_lines(spark, SMALL).cache()
