"""The visit feature matrix: vocabularies fitted once on training lines, then one pass over any lines."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.config import FeatureConfig
from basketry.functions.columns import (
    DEPARTMENT,
    FINELINE,
    VISIT,
    in_set,
    purchased,
    replace_by,
    return_flag,
    returned,
    weekend_flag,
)
from basketry.operators.clean import nonempty_lines
from basketry.operators.joins import lookup_join
from basketry.operators.ranking import with_position
from basketry.session import fresh_path, materialize

SCALARS = [
    "day_type",
    "total_unique_items",
    "total_dept_visit",
    "total_fineline_visit",
    "total_purchase",
    "total_return",
    "return_visit",
]
BLOCKS = ["dept_share", "dept_lines", "dept_scans", "fineline_scans", "upc_lines"]
UNUSED_GROUPS = ["electronics_visit"]  # computed but not part of the original matrix


def vector_struct(size: int, entries: Column) -> Column:
    """The parts of a sparse ML vector from sorted (idx, v) structs, in the form in which vectors are stored."""
    return F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(size).alias("size"),
        F.transform(entries, lambda e: e["idx"]).alias("indices"),
        F.transform(entries, lambda e: e["v"]).alias("values"),
    )


def with_vectors(matrix: DataFrame, size: int, name: str) -> DataFrame:
    """A written matrix with its entries as an ML vector column ``features``.

    The parts of the vectors are written and read back as vectors: no Python, no dense rows, no text.
    """
    path = fresh_path(matrix.sparkSession, name)
    matrix.withColumn("features", vector_struct(size, F.col("entries"))).write.parquet(path)
    schema = T.StructType([*matrix.schema.fields, T.StructField("features", VectorUDT())])
    return matrix.sparkSession.read.schema(schema).parquet(path)


@dataclass
class FeatureModel:
    """``features``: block, value, feature_idx of every encoded column, read back from the shared folder."""

    config: FeatureConfig
    features: DataFrame
    n_encoded: int

    @property
    def groups(self) -> list[str]:
        return [g for g in self.config.groups if g not in UNUSED_GROUPS]

    @property
    def fixed(self) -> list[str]:
        return [*SCALARS, *self.groups]

    @property
    def size(self) -> int:
        return len(self.fixed) + self.n_encoded

    # -- fitting --------------------------------------------------------------------------------------------

    @classmethod
    def fit(cls, lines: DataFrame, config: FeatureConfig | None = None) -> FeatureModel:
        """One pass over the lines counts every department, fineline and product; the rest works on those counts."""
        config = config or FeatureConfig()
        kinds = {"dept": F.col(DEPARTMENT), "fineline": F.col(FINELINE), "upc": F.col("upc")}
        keyed = F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("value")) for k, c in kinds.items()])
        counted = F.count_if(F.col(DEPARTMENT) != config.excluded_department).alias("n")
        counts = (
            nonempty_lines(lines).select(DEPARTMENT, F.inline(keyed)).filter(F.col("value").isNotNull())
            .groupBy("kind", "value").agg(counted)
        )
        is_dept = F.col("kind") == "dept"
        shared = F.lit(True) if config.share_departments is None else F.col("value").isin(config.share_departments)
        used = [
            is_dept & shared,
            is_dept,
            is_dept,
            (F.col("kind") == "fineline") & (F.col("n") > config.fineline_count),
            (F.col("kind") == "upc") & (F.col("n") > config.upc_count),
        ]
        values = [F.col("value")] * len(BLOCKS)
        values[BLOCKS.index("dept_lines")] = replace_by("value", config.merges)
        entries = [
            F.when(condition, F.struct(F.lit(i).alias("place"), F.lit(block).alias("block"), value.alias("value")))
            for i, (block, condition, value) in enumerate(zip(BLOCKS, used, values, strict=True))
        ]
        listed = counts.select(F.inline(F.array_compact(F.array(*entries)))).distinct()
        start = len(SCALARS) + len([g for g in config.groups if g not in UNUSED_GROUPS])
        numbered = with_position(listed, F.asc("place"), F.asc("value"), name="feature_idx", start=start)
        features = materialize(numbered.select("block", "value", F.col("feature_idx").cast("int")), "features")
        return cls(config, features, features.count())

    def save(self, path: str) -> None:
        self.features.write.parquet(f"{path}/features")
        spark = self.features.sparkSession
        spark.range(1).select(F.lit(json.dumps(asdict(self.config))).alias("value")).write.text(f"{path}/config")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeatureModel:
        config = FeatureConfig(**json.loads(spark.read.text(f"{path}/config").first()[0]))
        features = spark.read.schema("block string, value string, feature_idx int").parquet(f"{path}/features")
        return cls(config, features, features.count())

    # -- tables ---------------------------------------------------------------------------------------------

    def names(self) -> DataFrame:
        """feature_idx and feature name of every vector position."""
        spark = self.features.sparkSession
        fixed = spark.createDataFrame(list(enumerate(self.fixed)), "feature_idx int, feature string")
        return fixed.unionByName(self.features.select("feature_idx", F.concat_ws("=", "block", "value").alias("feature")))

    @property
    def _merged(self) -> list[str]:
        """Departments that are merged or merged into; their line counts are summed under the common name."""
        return sorted({*self.config.merges, *self.config.merges.values()})

    def _slots(self) -> DataFrame:
        """Vector positions per (kind, value): a department has up to three, fed by the same rows."""
        own = (F.col("block") == "dept_lines") & F.col("value").isin(self._merged)
        kind = F.when(own, "merged").otherwise(F.substring_index("block", "_", 1)).alias("kind")
        direct = self.features.select(kind, "value", "block", "feature_idx")
        slots = F.collect_list(F.struct(F.col("feature_idx").alias("idx"), "block"))
        return direct.groupBy("kind", "value").agg(slots.alias("slots"))

    # -- transforming ---------------------------------------------------------------------------------------

    def transform(self, lines: DataFrame) -> DataFrame:
        """One row per non-empty visit: label (if the lines have one), scalars, group shares, entries sorted by position.

        Lines are unpivoted to (visit, kind, value) and summed, which also counts the distinct values; a second
        aggregate per visit gathers everything. Two shuffles, both after a partial aggregate, and no join but the
        one with the vocabulary. A row gathers at most one entry per vocabulary position.
        """
        labelled = "trip_type" in lines.columns
        label = [F.max("trip_type").alias("trip_type")] if labelled else []
        kinds = {"dept": F.col(DEPARTMENT), "fineline": F.col(FINELINE), "upc": F.col("upc")}
        if self.config.merges:
            kinds["merged"] = F.when(F.col(DEPARTMENT).isin(self._merged), replace_by(DEPARTMENT, self.config.merges))
        keyed = F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("value")) for k, c in kinds.items()])
        base = [VISIT, "scan_count", weekend_flag().alias("day"), *(["trip_type"] if labelled else [])]
        unpivoted = (
            nonempty_lines(lines).select(*base, F.inline(keyed)).filter(F.col("value").isNotNull())
        )
        pairs = unpivoted.groupBy(VISIT, "kind", "value").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("scan_count").alias("scans"),
            F.sum(purchased()).alias("bought"),
            F.sum(returned()).alias("brought_back"),
            F.max("day").alias("day"),
            *label,
        )
        pairs = lookup_join(pairs, self._slots(), ["kind", "value"], how="left", keys_from=unpivoted)
        is_dept = F.col("kind") == "dept"

        def entry(slot: Column) -> Column:
            counted = slot["block"].isin("dept_share", "dept_lines", "upc_lines")
            value = F.when(counted, F.col("n")).otherwise(F.col("scans")).cast("double")
            return F.struct(slot["idx"].alias("idx"), value.alias("v"), (slot["block"] == "dept_share").alias("share"))

        def distinct(kind: str) -> Column:
            return F.count_if(F.col("kind") == kind)

        def over_lines(c: Column) -> Column:
            return F.sum(F.when(is_dept, c).otherwise(0))

        visits = pairs.withColumn("entries", F.transform("slots", entry)).groupBy(VISIT).agg(
            *label,
            F.max("day").alias("day_type"),
            distinct("upc").alias("total_unique_items"),
            distinct("dept").alias("total_dept_visit"),
            distinct("fineline").alias("total_fineline_visit"),
            over_lines(F.col("bought")).alias("total_purchase"),
            over_lines(F.col("brought_back")).alias("total_return"),
            return_flag(over_lines(F.col("scans"))).alias("return_visit"),
            over_lines(F.col("n")).alias("n_lines"),
            *[over_lines(in_set("value", self.config.groups[g]) * F.col("n")).alias(g) for g in self.groups],
            F.flatten(F.collect_list("entries")).alias("entries"),
        )
        visits = visits.withColumns({g: F.col(g).cast("double") / F.col("n_lines") for g in self.groups})
        fixed = F.array(
            *[F.struct(F.lit(i).alias("idx"), F.col(c).cast("double").alias("v")) for i, c in enumerate(self.fixed)]
        )
        encoded = F.transform(
            "entries",
            lambda e: F.struct(
                e["idx"].alias("idx"), F.when(e["share"], e["v"] / F.col("n_lines")).otherwise(e["v"]).alias("v")
            ),
        )
        nonzero = F.filter(F.concat(fixed, F.array_sort(encoded)), lambda e: e["v"] != 0)
        kept = [VISIT, *(["trip_type"] if labelled else []), *self.fixed, "n_lines"]
        return visits.select(*kept, nonzero.alias("entries"))

    def matrix(self, lines: DataFrame, name: str = "matrix") -> DataFrame:
        """``transform`` written once, with the entries also as ML vectors."""
        return with_vectors(self.transform(lines), self.size, name)


def triples(matrix: DataFrame) -> DataFrame:
    """The non-zero entries of the matrix, one per row."""
    return matrix.select(VISIT, F.explode("entries").alias("e")).select(
        VISIT, F.col("e.idx").alias("feature_idx"), F.col("e.v").alias("value")
    )


def vector_triples(matrix: DataFrame) -> DataFrame:
    """The same entries read back from the vectors."""
    parts = F.unwrap_udt("features")
    pairs = F.arrays_zip(parts["indices"].alias("idx"), parts["values"].alias("v"))
    return matrix.select(VISIT, F.explode(pairs).alias("e")).select(
        VISIT, F.col("e.idx").alias("feature_idx"), F.col("e.v").alias("value")
    )
