"""Registry of queries and of the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators.labels import class_at
from basketry.operators.visits import nonempty_visits
from basketry.session import materialize
from basketry.sources.tables import STAR_CONFIG, star_scan_lines

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

CLASSES = [1, 2, 3, 4, 5, 11, 12, 13, 14, 15, 21, 22, 23, 24, 999]  # what the mapping in sources.tables can give
CONFIG = STAR_CONFIG
FINELINES = CONFIG.fineline_count
UPCS = CONFIG.upc_count
EXCLUDED = CONFIG.excluded_department
ROWS_PER_TASK = 1_000_000  # rows of a probability table that one task makes

TABLES = """
scans as (
  select l_orderkey as visit_number,
    case when o_orderstatus = 'P' and o_orderpriority like '5%' then 999
         else 10 * (case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end)
              + cast(substr(o_orderpriority, 1, 1) as int) end as trip_type,
    dayname(o_orderdate) as weekday,
    case when p_size % 7 = 0 then null else l_partkey end as upc,
    cast(case when l_returnflag = 'R' then -l_quantity else l_quantity end as int) as scan_count,
    case when p_size <= 5 then null else p_brand end as department_description,
    case when p_size <= 5 then null else l_suppkey end as fineline_number
  from lineitem
  join orders on o_orderkey = l_orderkey
  join part on p_partkey = l_partkey),
ne as (select * from scans where department_description is not null),
train as (select * from scans where visit_number % 10 <> 0),
test as (select * from scans where visit_number % 10 = 0),
classes as (
  select trip_type, cast(row_number() over (order by trip_type) as int) - 1 as class_idx
  from (select distinct trip_type from scans) u),
probs as (
  select visit_number, trip_type, model_index, q / sum(q) over (partition by visit_number, model_index) as p
  from (
    select v.visit_number, c.trip_type, m.model_index,
      cast(1 + (v.visit_number * 31 + c.class_idx * 17 + m.model_index * 7) % 97 as double) as q
    from (select distinct visit_number from ne) v cross join classes c
      cross join (select 0 as model_index union all select 1 union all select 2) m) t),
labels as (select visit_number, max(trip_type) as trip_type from ne group by 1)
"""


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Add a query; ``sql`` may use the tables above."""

    def add(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = f"with {TABLES}\nselect * from (\n{sql.strip()}\n) result"
        return query

    return add


def over_lines(name: str, sql: str | None = None, written: bool = False):
    """Register a function of the scan lines. Lines that it reads several times are ``written`` once, not joined again for each pass."""

    def add(function: Callable[[DataFrame], DataFrame]):
        def query(spark: SparkSession, directory: str) -> DataFrame:
            lines = star_scan_lines(spark, directory)
            return function(materialize(lines, "scan-lines") if written else lines)

        register(name, sql)(query)
        return function

    return add


def fixed_probabilities(lines: DataFrame, models: int = 3) -> DataFrame:
    """A probability table computed from the visit numbers, in place of trained models."""
    return dealt_probabilities(lines, models)[0]


def dealt_probabilities(lines: DataFrame, models: int = 3) -> tuple[DataFrame, int]:
    """``fixed_probabilities``, and over how many tasks they are dealt by visit.

    The probabilities of a visit come from one array per visit and model, so nothing is shuffled for their sum. The visits are written
    once and dealt by visit over as many tasks as their rows need: by the bytes of the visit numbers alone a task would get far too many.
    """
    every_model = F.explode(F.array(*[F.lit(i) for i in range(models)]))
    visits = materialize(nonempty_visits(lines), "visits")
    tasks = max(1, ceil(visits.count() * models * len(CLASSES) / ROWS_PER_TASK))
    rows = visits.repartition(tasks, "visit_number").withColumn("model_index", every_model)
    start = F.col("visit_number") * 31 + F.col("model_index") * 7
    q = F.array(*[(1 + (start + i * 17) % 97).cast("double") for i in range(len(CLASSES))])
    rows = rows.withColumn("q", q).withColumn("total", F.aggregate("q", F.lit(0.0), lambda acc, x: acc + x))
    entries = F.posexplode("q").alias("idx", "one")
    probs = rows.select("visit_number", "model_index", "total", entries).select(
        "visit_number", class_at(F.col("idx"), CLASSES).alias("trip_type"), "model_index", (F.col("one") / F.col("total")).alias("p")
    )
    return probs, tasks


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})
