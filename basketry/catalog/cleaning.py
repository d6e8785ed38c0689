"""Sources, filters and scalar expressions."""

from pyspark.sql import functions as F

from basketry.catalog.base import CONFIG, EXCLUDED, fixed_probabilities, over_lines, register, rounded
from basketry.functions.columns import in_set, return_flag, strip_prefix, weekday_number
from basketry.operators import clean, metrics
from basketry.schema import TRAIN_LINES
from basketry.session import fresh_path
from basketry.sources import files
from basketry.sources.tables import star_scan_lines

LINE = "visit_number, trip_type, weekday, upc, scan_count, department_description, fineline_number"
PREFIX = "DepartmentDescription="


@over_lines("scan_lines", f"select {LINE} from scans")
def scan_lines(lines):
    return lines


@register("scan_lines_csv", f"select {LINE} from scans")
def scan_lines_csv(spark, directory):
    path = fresh_path(spark, "scan-lines-csv")
    lines = star_scan_lines(spark, directory).select(*TRAIN_LINES.fieldNames())
    lines.write.option("header", True).csv(path)
    return files.read_scan_lines(spark, path, labelled=True)


@over_lines(
    "scan_lines_limit",
    f"""select {LINE} from scans
    order by visit_number nulls first, department_description nulls first, fineline_number nulls first,
      upc nulls first, scan_count nulls first, weekday nulls first limit 22757""",
)
def scan_lines_limit(lines):
    return files.partial_lines(lines, labelled=False)


@over_lines("nonempty_lines", f"select {LINE} from scans where department_description is not null")
def nonempty_lines(lines):
    return clean.nonempty_lines(lines)


@over_lines(
    "weekday_number",
    """select visit_number, weekday, max(case weekday when 'Monday' then 1 when 'Tuesday' then 2 when 'Wednesday' then 3
      when 'Thursday' then 4 when 'Friday' then 5 when 'Saturday' then 6 when 'Sunday' then 7 end) as weekday_number,
      count(*) as n from ne group by 1, 2""",
)
def weekday_numbers(lines):
    kept = clean.nonempty_lines(lines).groupBy("visit_number", "weekday")
    return kept.agg(F.max(weekday_number()).alias("weekday_number"), F.count(F.lit(1)).alias("n"))


@over_lines(
    "weekend_flag",
    """select visit_number, upc, scan_count, case when weekday in ('Friday', 'Saturday', 'Sunday') then 1 else 0 end as day
    from ne""",
)
def weekend(lines):
    return clean.with_weekend(clean.nonempty_lines(lines)).select("visit_number", "upc", "scan_count", "day")


@over_lines(
    "rows_with_nulls",
    f"select {LINE} from scans where upc is null or department_description is null or fineline_number is null",
)
def rows_with_nulls(lines):
    return clean.rows_with_nulls(lines)


@over_lines(
    "count_rows_with_nulls",
    """select count(*) as n from scans
    where upc is null or department_description is null or fineline_number is null""",
)
def count_rows_with_nulls(lines):
    return clean.rows_with_nulls(lines).agg(F.count(F.lit(1)).alias("n"))


@over_lines(
    "fill_constants",
    """select visit_number, trip_type, weekday, coalesce(upc, 123) as upc, coalesce(scan_count, 0) as scan_count,
      coalesce(department_description, 'NA') as department_description, coalesce(fineline_number, 12345) as fineline_number
    from scans""",
)
def fill_constants(lines):
    return clean.fill_constants(lines)


@over_lines(
    "cast_ids",
    """select cast(visit_number as bigint) as visit_number, trip_type, weekday, cast(upc as bigint) as upc,
      cast(scan_count as int) as scan_count, department_description, cast(fineline_number as bigint) as fineline_number
    from scans""",
)
def cast_ids(lines):
    text = lines.withColumns({c: F.col(c).cast("string") for c in ("visit_number", "upc", "scan_count", "fineline_number")})
    return clean.cast_ids(text)


@over_lines(
    "other_fineline_zero",
    f"""select {LINE} from scans where fineline_number = 1 and trip_type <> 999
    and department_description is distinct from '{EXCLUDED}'""",
)
def other_fineline(lines):
    return clean.other_fineline(lines, fineline=1, department=EXCLUDED)


@over_lines("exclude_department", f"select {LINE} from ne where department_description <> '{EXCLUDED}'")
def exclude_department(lines):
    return clean.exclude_department(lines, EXCLUDED)


@over_lines(
    "return_flag",
    """select visit_number, sum(scan_count) <= 0 as is_return,
      case when sum(scan_count) <= 0 then -10 else 10 end as flag from ne group by 1""",
)
def flags(lines):
    net = clean.nonempty_lines(lines).groupBy("visit_number").agg(F.sum("scan_count").alias("net"))
    return net.select("visit_number", (F.col("net") <= 0).alias("is_return"), return_flag("net").alias("flag"))


@over_lines(
    "merge_departments",
    """select visit_number, trip_type, weekday, upc, scan_count,
      case when department_description = 'Brand#24' then 'Brand#25' else department_description end as department_description,
      fineline_number from scans""",
)
def merge_departments(lines):
    return clean.merge_departments(lines, CONFIG.merges)


@over_lines("drop_columns", "select visit_number, upc, scan_count, fineline_number from scans")
def drop_columns(lines):
    return clean.drop_columns(lines, "trip_type", "weekday", "department_description")


@over_lines(
    "unit_weight_scalar",
    """select visit_number, upc, scan_count,
      case when department_description in ('Brand#7', 'Brand#8') then 1 else 0 end as in_group from scans""",
)
def unit_weight(lines):
    return lines.select(
        "visit_number", "upc", "scan_count", in_set("department_description", ["Brand#7", "Brand#8"]).alias("in_group")
    )


@over_lines(
    "prefix_strip",
    f"""select distinct '{PREFIX}' || department_description as feature, department_description as stripped from ne""",
)
def prefix_strip(lines):
    names = clean.nonempty_lines(lines).select(F.concat(F.lit(PREFIX), "department_description").alias("feature")).distinct()
    return names.select("feature", strip_prefix("feature", PREFIX).alias("stripped"))


@over_lines(
    "clip_normalise",
    """select visit_number, trip_type, model_index,
      round(least(greatest(p, 0.01), 0.99) / sum(least(greatest(p, 0.01), 0.99)) over (partition by visit_number, model_index), 9)
        as p from probs""",
)
def clip_normalise(lines):
    probs = fixed_probabilities(lines)
    return rounded(metrics.clip_normalised(probs, "visit_number", "model_index", eps=0.01), "p", places=9)


@over_lines("geometric_blend", "select visit_number, trip_type, round(exp(avg(ln(p))), 6) as p from probs group by 1, 2")
def geometric_blend(lines):
    return rounded(metrics.geometric_mean(fixed_probabilities(lines)), "p")


@over_lines(
    "conform_columns",
    "select visit_number, upc, 0 as not_in_input, scan_count from scans",
)
def conform_columns(lines):
    return clean.conform_columns(lines, ["visit_number", "upc", "not_in_input", "scan_count"])
