"""Session helpers: a local session for tests, and tables written to the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("basketry")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    known = spark.sparkContext.getCheckpointDir()
    if known is None:
        known = tempfile.mkdtemp(prefix="basketry-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has written to yet."""
    return f"{shared_dir(spark)}/basketry/{name}-{uuid.uuid4().hex}"


#: Spark's setting that removes the shuffle files of an execution at its end.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, free_shuffles: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and gives Catalyst real file sizes for the next join.
    ``free_shuffles``: the shuffle files of the write are removed with it; the setting is put back afterwards.
    """
    path, conf = fresh_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(FREE_SHUFFLES, "false")
    if free_shuffles:
        conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if free_shuffles:
            conf.set(FREE_SHUFFLES, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def over_all_cores(table: DataFrame, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A written table that is read by as many tasks as there are cores at least; if it has fewer its rows are dealt again and written once more.

    For small tables with much work per row: Spark joins their partitions by bytes, and every later pass would leave cores idle.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else write(table.repartition(cores))


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, for rounds of an iteration.

    Spark can remove those that are no longer used (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    folder, context = shared_dir(df.sparkSession), df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint()
