"""Scan lines derived from an order star schema, for use where no scan file is at hand.

A visit is an order, the product is the part, the department its brand, the fineline the supplier. Returned
lines get a negative count. Missing values are planted by the part size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.config import OTHER_CLASS, FeatureConfig
from basketry.operators.joins import lookup_join

BRANDS = 25

STAR_CONFIG = FeatureConfig(
    excluded_department="Brand#1",
    merges={"Brand#24": "Brand#25"},
    groups={
        **{f"brand_mod_{r}": [f"Brand#{b}" for b in range(1, BRANDS + 1) if b % 5 == r] for r in range(5)},
        "brand_7_8": ["Brand#7", "Brand#8"],
    },
    share_departments=None,
    fineline_count=500,
    upc_count=35,
)


SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, l_returnflag string",
    "orders": "o_orderkey bigint, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey bigint, p_brand string, p_size int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The columns this library uses, with known types: no job has to look them up."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{directory.rstrip('/')}/{name}.parquet")


def star_scan_lines(spark: SparkSession, directory: str) -> DataFrame:
    """Scan lines from lineitem, orders and part.

    Both lookups are checked before a broadcast; beyond the bound an order that holds a large share of all lines
    is split over several tasks.
    """
    lines = table(spark, directory, "lineitem")
    part = table(spark, directory, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_brand")
    status = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    priority = F.substring("o_orderpriority", 1, 1).cast("int")
    is_other = (F.col("o_orderstatus") == "P") & (priority == 5)
    orders = table(spark, directory, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.when(is_other, OTHER_CLASS).otherwise(status * 10 + priority).alias("trip_type"),
        F.date_format("o_orderdate", "EEEE").alias("weekday"),
    )
    known = F.col("p_size") > 5
    sign = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    scans = lookup_join(lines, part, ["l_partkey"]).select(
        "l_orderkey",
        F.when(F.col("p_size") % 7 != 0, F.col("l_partkey")).alias("upc"),
        (sign * F.col("l_quantity")).cast("int").alias("scan_count"),
        F.when(known, F.col("p_brand")).alias("department_description"),
        F.when(known, F.col("l_suppkey")).alias("fineline_number"),
    )
    scans = lookup_join(scans, orders, ["l_orderkey"], row_bytes=64, keys_from=lines)
    return scans.select(
        F.col("l_orderkey").alias("visit_number"), "trip_type", "weekday", "upc", "scan_count", "department_description", "fineline_number"
    )


def training_lines(lines: DataFrame) -> DataFrame:
    """Nine visits of ten; the rest plays the part of the test file."""
    return lines.filter(F.col("visit_number") % 10 != 0)


def scoring_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("visit_number") % 10 == 0)


def planted_labels(lines: DataFrame) -> DataFrame:
    """A label that the features do explain: the brand group with most lines in the visit, ties to the lower."""
    from basketry.operators.clean import nonempty_lines

    group = (F.substring("department_description", 7, 10).cast("int") % 5).alias("grp")
    pairs = nonempty_lines(lines).groupBy("visit_number", group).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("minus_n"), F.col("grp").alias("grp")))
    return pairs.groupBy("visit_number").agg(best.alias("best")).select("visit_number", F.col("best.grp").alias("planted_label"))
