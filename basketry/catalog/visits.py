"""Aggregates per visit."""

from pyspark.sql import functions as F

from basketry.catalog.base import CONFIG, EXCLUDED, over_lines, rounded
from basketry.operators import clean, stats, visits, vocabulary
from basketry.sources.tables import planted_labels, scoring_lines, training_lines

SCALAR_SQL = {
    "day_type": "max(case when weekday in ('Friday', 'Saturday', 'Sunday') then 1 else 0 end)",
    "total_unique_items": "count(distinct upc)",
    "total_dept_visit": "count(distinct department_description)",
    "total_fineline_visit": "count(distinct fineline_number)",
    "total_purchase": "cast(sum(case when scan_count > 0 then scan_count else 0 end) as bigint)",
    "total_return": "cast(sum(case when scan_count < 0 then -scan_count else 0 end) as bigint)",
    "return_visit": "case when sum(scan_count) <= 0 then -10 else 10 end",
}


def _scalar(name):
    over_lines(name, f"select visit_number, {SCALAR_SQL[name]} as {name} from ne group by 1")(
        lambda lines: visits.visit_aggregates(lines, name)
    )


for _name in SCALAR_SQL:
    _scalar(_name)

ALL_SCALARS_SQL = ", ".join(f"{e} as {n}" for n, e in SCALAR_SQL.items())


@over_lines("visit_scalars", f"select visit_number, {ALL_SCALARS_SQL} from ne group by 1")
def visit_scalars(lines):
    return visits.visit_aggregates(lines)


@over_lines("item_count", "select visit_number, count(upc) as item_count from scans group by 1")
def item_count(lines):
    return visits.item_count(lines)


GROUP_SQL = ", ".join(
    f"cast(sum(case when department_description in ({', '.join(repr(m) for m in members)}) then 1 else 0 end) as double)"
    f" / cast(count(*) as double) as {name}"
    for name, members in CONFIG.groups.items()
)


@over_lines("dept_group_share", f"select visit_number, {GROUP_SQL} from ne group by 1")
def dept_group_share(lines):
    return visits.group_shares(lines, CONFIG.groups)


@over_lines(
    "dept_share",
    """select visit_number, department_description,
      cast(count(*) as double) / cast(sum(count(*)) over (partition by visit_number) as double) as share
    from ne group by 1, 2""",
)
def dept_share(lines):
    return visits.value_shares(lines, "department_description")


@over_lines(
    "fineline_share",
    f"""select s.visit_number, s.fineline_number, s.share from (
      select visit_number, fineline_number,
        cast(count(*) as double) / cast(sum(count(*)) over (partition by visit_number) as double) as share
      from train where department_description is not null group by 1, 2) s
    join (
      select fineline_number from train
      where department_description is not null and department_description <> '{EXCLUDED}' and fineline_number is not null
        and fineline_number in (select fineline_number from test where fineline_number is not null)
      group by 1 having count(*) > 500) v on v.fineline_number = s.fineline_number""",
)
def fineline_share(lines):
    train = training_lines(lines)
    kept = vocabulary.finelines_shared_with_test(train, scoring_lines(lines), excluded_department=EXCLUDED)
    return visits.value_shares(train, "fineline_number", kept)


@over_lines("visit_label", "select visit_number, trip_type from labels")
def visit_label(lines):
    return visits.visit_labels(lines)


@over_lines("label_conflicts", "select visit_number, min(trip_type) as low, max(trip_type) as high from scans group by 1 having count(distinct trip_type) > 1")
def label_conflicts(lines):
    return visits.label_conflicts(lines)


@over_lines("scan_sum_per_visit", "select visit_number, cast(sum(scan_count) as bigint) as scan_sum from scans group by 1")
def scan_sum_per_visit(lines):
    return visits.scan_sum(lines)


@over_lines("empty_visit_ids", "select visit_number from scans group by 1 having count(department_description) = 0")
def empty_visit_ids(lines):
    return visits.empty_visits(lines)


@over_lines("nonempty_visit_ids", "select distinct visit_number from ne")
def nonempty_visit_ids(lines):
    return visits.nonempty_visits(lines)


@over_lines(
    "planted_label",
    """select visit_number, grp as planted_label from (
      select visit_number, grp, row_number() over (partition by visit_number order by n desc, grp) as rn from (
        select visit_number, cast(substr(department_description, 7) as int) % 5 as grp, count(*) as n from ne group by 1, 2) g) r
    where rn = 1""",
)
def planted_label(lines):
    return planted_labels(lines)


# Features that are described but not part of the matrix -----------------------------------------------------------


@over_lines("total_all_items", "select visit_number, cast(sum(abs(scan_count)) as bigint) as total_all_items from ne group by 1")
def total_all_items(lines):
    return visits.all_items(lines)


@over_lines(
    "all_fineline_zero",
    "select visit_number, case when coalesce(sum(fineline_number), 0) = 0 then 1 else 0 end as all_fineline_zero from scans group by 1",
)
def all_fineline_zero(lines):
    return visits.fineline_zero(lines)


@over_lines("lines_per_visit", "select visit_number, count(scan_count) as total_purchased from ne group by 1")
def lines_per_visit(lines):
    return visits.lines_per_visit(lines)


@over_lines(
    "log_counts",
    """select visit_number, department_description, round((l - avg(l) over ()) / stddev_samp(l) over (), 6) as scaled from (
      select visit_number, department_description, ln(1 + count(*)) as l from ne group by 1, 2) t""",
)
def log_counts(lines):
    counts = clean.nonempty_lines(lines).groupBy("visit_number", "department_description").agg(F.count(F.lit(1)).alias("scaled"))
    return rounded(stats.standardized(stats.log_counts(counts, ["scaled"]), ["scaled"]), "scaled")


@over_lines(
    "dominant_department",
    """with d as (
      select visit_number, trip_type, department_description, count(*) as n from ne group by 1, 2, 3),
    r as (
      select *, row_number() over (partition by visit_number, trip_type order by n desc, department_description) as rn,
        sum(case when department_description in ('Brand#5', 'Brand#10', 'Brand#15', 'Brand#20', 'Brand#25') then n else 0 end)
          over (partition by visit_number, trip_type) as g,
        sum(n) over (partition by visit_number, trip_type) as t from d)
    select visit_number, trip_type, department_description as top_department, n as top_lines,
      cast(g as double) / cast(t as double) as group_share from r where rn = 1""",
)
def dominant_department(lines):
    return visits.dominant_department(lines, CONFIG.groups["brand_mod_0"])


@over_lines(
    "financial_profile",
    """with d as (
      select visit_number, trip_type, department_description, count(*) as n from ne where trip_type = 3 group by 1, 2, 3),
    r as (
      select *, row_number() over (partition by visit_number, trip_type order by n desc, department_description) as rn,
        sum(case when department_description in ('Brand#7', 'Brand#8') then n else 0 end)
          over (partition by visit_number, trip_type) as g,
        sum(n) over (partition by visit_number, trip_type) as t from d)
    select visit_number, trip_type, department_description as top_department, n as top_lines,
      cast(g as double) / cast(t as double) as financial_share from r where rn = 1""",
)
def financial_profile(lines):
    of_type = lines.filter(F.col("trip_type") == 3)
    return visits.dominant_department(of_type, CONFIG.groups["brand_7_8"], "financial_share")


@over_lines("return_trips", "select visit_number, cast(sum(scan_count) as bigint) as scan_sum from scans group by 1 having sum(scan_count) <= 0")
def return_trips(lines):
    return visits.return_visits(lines)


@over_lines(
    "described_shares",
    """select visit_number, upc, cast(count(*) as double) / cast(sum(count(*)) over (partition by visit_number) as double) as share
    from ne group by 1, 2 qualify upc is not null""",
)
def described_shares(lines):
    return visits.value_shares(lines, "upc")


@over_lines(
    "returned_items",
    """select visit_number, count(case when scan_count < 0 then 1 end) as returned_lines,
      case when count(case when scan_count < 0 then 1 end) > 0 then 1 else 0 end as has_return,
      count(case when scan_count > 0 then 1 end) as purchased_lines from ne group by 1""",
)
def returned_items(lines):
    return visits.returned_items(lines)
