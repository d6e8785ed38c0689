"""Input selection and tables written between the steps of one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.session import materialize

#: Spark's setting that removes the shuffle files of an execution at its end.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *also: str) -> DataFrame:
    """The two columns an operator works on, as (doc_id bigint, text string); a null text counts as empty.

    Everything else is left out, so further columns may have any names.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *also)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage and survives lost executors.

    The shuffle files of the write are freed with it; while it runs they are kept, so lost ones are made again as usual.
    """
    conf = df.sparkSession.conf
    before = conf.get(FREE_SHUFFLES, "false")
    conf.set(FREE_SHUFFLES, "true")
    try:
        return materialize(df, f"llm-{name}")
    finally:
        conf.set(FREE_SHUFFLES, before)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote; nothing may read them afterwards."""
    for table in tables:
        for path in sorted({name.rsplit("/", 1)[0] for name in table.inputFiles() if "/basketry/llm-" in name}):
            jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)
