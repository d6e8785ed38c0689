"""Profiles, sorted frequencies, limits and set operations."""

from pyspark.sql import functions as F

from basketry.catalog.base import CONFIG, EXCLUDED, FINELINES, over_lines, register, rounded
from basketry.operators import clean, profile, ranking, sets, vocabulary
from basketry.plans.workflow import write_profiles
from basketry.session import fresh_path, materialize
from basketry.sources import files
from basketry.sources.tables import star_scan_lines, scoring_lines, training_lines

DEPT, FINE = "department_description", "fineline_number"


def _describe_sql(c):
    return f"""select '{c}' as column_name, count({c}) as n, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std,
      cast(min({c}) as double) as min, round(quantile_cont(cast({c} as double), 0.25), 6) as q25,
      round(quantile_cont(cast({c} as double), 0.5), 6) as q50, round(quantile_cont(cast({c} as double), 0.75), 6) as q75,
      cast(max({c}) as double) as max from scans"""


@over_lines("describe_numeric", "\nunion all\n".join(_describe_sql(c) for c in profile.NUMERIC))
def describe_numeric(lines):
    return rounded(profile.describe_numeric(lines), "mean", "std", "q25", "q50", "q75")


def _missing(c):
    return f"max(case when {c} is null then 1 else 0 end)"


@over_lines(
    "dept_fineline_count",
    f"select {DEPT}, count(distinct {FINE}) + {_missing(FINE)} as n_members from scans where {DEPT} is not null group by 1",
)
def dept_fineline_count(lines):
    return profile.distinct_count_per(lines, DEPT, FINE)


def _packed_sql(key, member):
    return f"""select {key}, count(*) as n_members, string_agg(cast({member} as varchar), '|' order by {member}) as members,
      {_missing(member)} as has_missing from (select distinct {key}, {member} from scans where {key} is not null) d group by 1"""


@over_lines("type_departments", _packed_sql("trip_type", DEPT))
def type_departments(lines):
    return profile.packed_members(lines, "trip_type", DEPT)


@over_lines("dept_types", _packed_sql(DEPT, "trip_type"))
def dept_types(lines):
    return profile.packed_members(lines, DEPT, "trip_type")


def _members_sql(key, member):
    return f"""select {key}, {member}, count(*) over (partition by {key}) as n_members
    from (select distinct {key}, {member} from scans where {key} is not null) d"""


@over_lines("dept_finelines", _members_sql(DEPT, FINE))
def dept_finelines(lines):
    return profile.members_per(lines, DEPT, FINE)


@over_lines("upc_departments", _members_sql("upc", DEPT))
def upc_departments(lines):
    return profile.members_per(lines, "upc", DEPT)


@over_lines("fineline_departments", _members_sql(FINE, DEPT))
def fineline_departments(lines):
    return profile.members_per(lines, FINE, DEPT)


@over_lines(
    "distinct_counts",
    f"""select count(distinct upc) + {_missing("upc")} as n_upc, count(distinct {DEPT}) + {_missing(DEPT)} as n_department,
      count(distinct {FINE}) + {_missing(FINE)} as n_fineline from scans""",
)
def distinct_counts(lines):
    return profile.distinct_counts(lines)


def _counts_sql(c):
    return f"select {c}, count(*) as n from scans where {c} is not null group by 1"


@over_lines("upc_frequency", _counts_sql("upc"))
def upc_frequency(lines):
    return ranking.value_counts(lines, "upc")


@over_lines("dept_frequency", _counts_sql(DEPT))
def dept_frequency(lines):
    return ranking.value_counts(lines, DEPT)


@over_lines("fineline_frequency", _counts_sql(FINE))
def fineline_frequency(lines):
    return ranking.value_counts(lines, FINE)


def _histogram_sql(c):
    return f"""select '{c}' as column_name,
      cast(case when hi = lo then 25 else least(floor((x - lo) / nullif(hi - lo, 0) * 50), 49) end as int) as bin, count(*) as n
    from (select cast({c} as double) as x from scans where {c} is not null) v
      cross join (select cast(min({c}) as double) as lo, cast(max({c}) as double) as hi from scans) r
    group by 1, 2"""


@over_lines("histogram_50", "\nunion all\n".join(_histogram_sql(c) for c in profile.NUMERIC))
def histogram_50(lines):
    return profile.histogram(lines, profile.NUMERIC)


@over_lines(
    "distinct_column_values",
    f"""select distinct 'upc' as column_name, cast(upc as bigint) as value from scans where upc is not null
    union all select distinct '{FINE}', cast({FINE} as bigint) from scans where {FINE} is not null""",
)
def distinct_column_values(lines):
    upc = sets.distinct_values(lines, "upc").select(F.lit("upc").alias("column_name"), F.col("upc").cast("bigint").alias("value"))
    fineline = sets.distinct_values(lines, FINE)
    return upc.unionByName(fineline.select(F.lit(FINE).alias("column_name"), F.col(FINE).cast("bigint").alias("value")))


@over_lines("type_dept_frequency", f"select trip_type, {DEPT}, count(*) as n from ne group by 1, 2")
def type_dept_frequency(lines):
    return profile.class_department_counts(lines)


@over_lines("type_counts", "select trip_type, count(*) as n from scans group by 1")
def type_counts(lines):
    return profile.class_counts(lines)


# Sorts and limits -------------------------------------------------------------------------------------------------


@over_lines(
    "value_counts_sorted",
    "select upc, count(*) as n, row_number() over (order by count(*) desc, upc) as place from scans where upc is not null group by 1",
)
def value_counts_sorted(lines):
    return ranking.value_counts_ranked(lines, "upc")


@over_lines(
    "frequent_values",
    f"select {FINE}, count(*) as n from scans where {FINE} is not null group by 1 having count(*) > {FINELINES}",
)
def frequent_values(lines):
    return vocabulary.frequent(lines, FINE, FINELINES, None)


@over_lines(
    "sort_by_visit",
    """select visit_number, cast(sum(scan_count) as bigint) as scan_sum, row_number() over (order by visit_number) as place
    from scans group by 1""",
)
def sort_by_visit(lines):
    sums = lines.groupBy("visit_number").agg(F.sum("scan_count").alias("scan_sum"))
    return ranking.with_position(sums, F.asc("visit_number"), name="place", start=1)


@over_lines(
    "head_n",
    "select visit_number, cast(sum(scan_count) as bigint) as scan_sum from scans group by 1 order by visit_number limit 100",
)
def head_n(lines):
    sums = lines.groupBy("visit_number").agg(F.sum("scan_count").alias("scan_sum"))
    return ranking.first_rows(sums, 100, F.asc("visit_number"))


# Sets -------------------------------------------------------------------------------------------------------------


@over_lines(
    "upc_train_not_test",
    "select upc from train where upc is not null except select upc from test where upc is not null",
)
def upc_train_not_test(lines):
    return sets.not_in(training_lines(lines), scoring_lines(lines), "upc")


@over_lines(
    "fineline_train_not_test",
    f"select {FINE} from train where {FINE} is not null except select {FINE} from test where {FINE} is not null",
)
def fineline_train_not_test(lines):
    return sets.not_in(training_lines(lines), scoring_lines(lines), FINE)


@over_lines(
    "fineline_vocab_train",
    f"""select {FINE}, count(*) as n from train
    where {DEPT} is not null and {DEPT} <> '{EXCLUDED}' and {FINE} is not null
      and {FINE} in (select {FINE} from test where {FINE} is not null)
    group by 1 having count(*) > {FINELINES}""",
)
def fineline_vocab_train(lines):
    return vocabulary.finelines_shared_with_test(training_lines(lines), scoring_lines(lines), FINELINES, EXCLUDED)


# Files ------------------------------------------------------------------------------------------------------------


@register("profile_sinks", f"select {DEPT}, count(distinct {FINE}) + {_missing(FINE)} as n_members from scans where {DEPT} is not null group by 1")
def profile_sinks(spark, directory):
    path = fresh_path(spark, "profile")
    files.write_profile(profile.distinct_count_per(star_scan_lines(spark, directory), DEPT, FINE), path)
    return spark.read.schema(f"{DEPT} string, n_members bigint").option("header", True).csv(path)


@register(
    "diff_sink",
    "select cast(upc as varchar) as value from (select upc from train where upc is not null except select upc from test where upc is not null) d",
)
def diff_sink(spark, directory):
    lines = star_scan_lines(spark, directory)
    path = fresh_path(spark, "not-in-test")
    files.write_lines(sets.not_in(training_lines(lines), scoring_lines(lines), "upc"), path)
    return spark.read.text(path)


PLANTED_TEST = f"(select * from test where {FINE} is null or {FINE} % 7 <> 0)"  # every seventh product line is in the training lines only


def planted_test(lines):
    return scoring_lines(lines).where(F.col(FINE).isNull() | (F.col(FINE) % 7 != 0))


FINELINE_DIFF_SQL = f"select {FINE} from train where {FINE} is not null except select {FINE} from {PLANTED_TEST} t where {FINE} is not null"


@over_lines("fineline_train_only", FINELINE_DIFF_SQL)
def fineline_train_only(lines):
    """Product lines that only the training lines have, with some planted."""
    return sets.not_in(training_lines(lines), planted_test(lines), FINE)


@over_lines(
    "fineline_vocab_shared",
    f"""select {FINE}, count(*) as n from train
    where {DEPT} is not null and {DEPT} <> '{EXCLUDED}' and {FINE} not in ({FINELINE_DIFF_SQL}) and {FINE} is not null group by 1 having count(*) > {FINELINES}""",
)
def fineline_vocab_shared(lines):
    """The vocabulary without the planted product lines."""
    return vocabulary.finelines_shared_with_test(training_lines(lines), planted_test(lines), FINELINES, EXCLUDED)


@register(
    "profile_files",
    f"""select 'dept_fineline_count' as file, {DEPT} as key, count(distinct {FINE}) + {_missing(FINE)} as n from train where {DEPT} is not null group by {DEPT}
    union all select 'type_departments', cast(trip_type as varchar), count(distinct {DEPT}) + {_missing(DEPT)} from train where trip_type is not null group by trip_type
    union all select 'dept_types', {DEPT}, count(distinct trip_type) + {_missing("trip_type")} from train where {DEPT} is not null group by {DEPT}
    union all select 'upc_counts', cast(upc as varchar), count(*) from train where upc is not null group by upc
    union all select 'upc_sums', cast(visit_number as varchar), count(*) from train where upc in (select upc from train where upc is not null group by upc having count(*) > 500) group by visit_number
    union all select 'finelines_not_in_test', cast({FINE} as varchar), 1 from ({FINELINE_DIFF_SQL}) d""",
)
def profile_files(spark, directory):
    """All files of the profiling run, written and read back: a row per file and key."""
    lines, root = materialize(star_scan_lines(spark, directory), "scan-lines"), fresh_path(spark, "profiles")
    write_profiles(training_lines(lines), planted_test(lines), root)

    def read(file, schema, key, n):
        rows = spark.read.schema(schema).option("header", True).csv(f"{root}/{file}")
        return rows.select(F.lit(file).alias("file"), F.col(key).cast("string").alias("key"), n.cast("bigint").alias("n"))

    packed = "n_members bigint, members string, has_missing int"
    sums = spark.read.schema("visit_number bigint, upc bigint, n_lines bigint").option("header", True).csv(f"{root}/upc_sums")
    return (
        read("dept_fineline_count", f"{DEPT} string, n_members bigint", DEPT, F.col("n_members"))
        .unionByName(read("type_departments", f"trip_type int, {packed}", "trip_type", F.col("n_members")))
        .unionByName(read("dept_types", f"{DEPT} string, {packed}", DEPT, F.col("n_members")))
        .unionByName(read("upc_counts", "upc bigint, n bigint", "upc", F.col("n")))
        .unionByName(sums.groupBy(F.lit("upc_sums").alias("file"), F.col("visit_number").cast("string").alias("key")).agg(F.count("*").alias("n")))
        .unionByName(spark.read.text(f"{root}/finelines_not_in_test").select(F.lit("finelines_not_in_test").alias("file"), F.col("value").alias("key"), F.lit(1).cast("bigint").alias("n")))
    )


@over_lines(
    "merged_department_counts",
    f"""select case when {DEPT} = 'Brand#24' then 'Brand#25' else {DEPT} end as {DEPT}, count(*) as n from ne group by 1""",
)
def merged_department_counts(lines):
    return ranking.value_counts(clean.merge_departments(clean.nonempty_lines(lines), CONFIG.merges), DEPT)
