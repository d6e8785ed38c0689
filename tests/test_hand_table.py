"""Features of four visits, worked out by hand."""

import pytest

from basketry.operators import clean, encode, visits
from basketry.plans.scoring import empty_visit_default


def rows(df, key="visit_number"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_scalars(hand):
    got = rows(visits.visit_aggregates(hand))
    names = [
        "day_type", "total_unique_items", "total_dept_visit", "total_fineline_visit", "total_purchase", "total_return",
        "return_visit",
    ]
    assert [got[1][n] for n in names] == [1, 2, 2, 2, 3, 1, 10]
    assert [got[3][n] for n in names] == [1, 1, 2, 1, 1, 3, -10]
    assert [got[4][n] for n in names] == [0, 2, 2, 2, 5, 4, 10]
    assert set(got) == {1, 3, 4}


def test_group_shares_may_overlap(hand):
    got = rows(visits.group_shares(hand))
    assert got[1]["toy_visit"] == pytest.approx(2 / 3)
    assert got[3]["medl_visit"] == 1.0 and got[3]["pharma_otc_visit"] == 0.5
    assert got[1]["medl_visit"] == 0.0


def test_single_department_shares_sum_to_one(hand):
    shares = visits.value_shares(hand, "department_description")
    assert all(abs(r[1] - 1) < 1e-12 for r in shares.groupBy("visit_number").sum("share").collect())


def test_line_counts_are_merged_and_scan_sums_are_not(hand):
    lines = {(r.visit_number, r.department_description): r.n_lines for r in encode.dept_line_counts(hand).collect()}
    assert lines == {(1, "TOYS"): 2, (1, "DAIRY"): 1, (3, "PHARMACY RX"): 1, (3, "PHARMACY OTC"): 1, (4, "BEAUTY"): 3}
    scans = {(r.visit_number, r.department_description): r.scan_sum for r in encode.dept_scan_counts(hand).collect()}
    assert scans[(4, "HEALTH AND BEAUTY AIDS")] == 1 and scans[(4, "BEAUTY")] == 0 and scans[(1, "TOYS")] == 3


def test_empty_visits(hand):
    assert [r.visit_number for r in visits.empty_visits(hand).collect()] == [2]
    assert [r.visit_number for r in visits.empty_visits_by_difference(hand).collect()] == [2]
    p = {r.trip_type: r.p for r in empty_visit_default(hand, [3, 5, 999]).collect()}
    assert p == {3: 0.0, 5: 0.0, 999: 0.75}


def test_purchase_minus_return_is_net_scan(hand):
    net = rows(visits.scan_sum(clean.nonempty_lines(hand)))
    for visit, r in rows(visits.visit_aggregates(hand)).items():
        assert r["total_purchase"] - r["total_return"] == net[visit]["scan_sum"]


def test_missing_department_is_other_than_any_name(hand):
    zero = hand.na.fill({"fineline_number": 0})
    kept = clean.other_fineline(zero, fineline=0).collect()
    assert [(r.visit_number, r.department_description) for r in kept] == [(3, "PHARMACY RX")]
    kept = clean.other_fineline(hand, fineline=40, department="HEALTH AND BEAUTY AIDS").collect()
    assert [(r.visit_number, r.department_description) for r in kept] == [(4, None)]


def test_unknown_weekday_is_null(spark):
    from basketry.functions.columns import weekday_number

    df = spark.createDataFrame([("Monday",), ("Sunday",), ("Noday",), (None,)], "weekday string")
    assert [r[0] for r in df.select(weekday_number()).collect()] == [1, 7, None, None]
