"""Session settings and lineage cuts shared by every job."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the plans rely on. Joins are written as plain equi-joins: the
# optimizer broadcasts a side only when its measured size is under the threshold,
# and splits a reducer partition when one key dominates it.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # what a Python worker holds at a time
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    # groups hold short bounded lists; hash them instead of sorting every row
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
}

# For a write that sorts long rows of a written table: rows sorted by their group are not hashed and sorted again, and a
# task takes what fits its memory, as such a table opens to forty times its size.
SORTING = {"spark.sql.execution.replaceHashWithSortAgg": "true", "spark.sql.files.maxPartitionBytes": "16m"}
# For a write whose table is read from then on: its shuffles go when it ends, not when the driver happens to collect its garbage.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
# Rows that a reader can take apart from others of a file.
ROW_GROUP_BYTES = 16 << 20


_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


# Python workers live on between tasks: what one frees beyond some megabytes goes back to the system
WORKER_ENVIRONMENT = {"MALLOC_MMAP_THRESHOLD_": str(8 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}


def share_code(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver did; on a cluster it is installed or sent as a py-file."""
    environment = spark.sparkContext.environment
    for name, value in WORKER_ENVIRONMENT.items():
        environment.setdefault(name, value)
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join([*filter(None, known), _ROOT])
    return spark


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", app: str = "loomgraph", shuffle_partitions: int = 8) -> SparkSession:
    """A single-JVM session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    return configure(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a temporary one only on a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if shared is None:
            # a lone JVM; local-cluster has executors of its own
            if not context.master.startswith(("local[", "local ")) and context.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder every executor can reach")
            shared = tempfile.mkdtemp(prefix="loomgraph-checkpoint-")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


@contextmanager
def settings(spark: SparkSession, changed: dict[str, str]) -> Iterator[None]:
    """The settings hold for what runs inside."""
    before = {name: spark.conf.get(name) for name in changed}
    try:
        for name, value in changed.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read it back.

    Iterative jobs call this once per round: a lost executor re-reads the last round from
    shared storage and never replays the chain, and the next plan sees real sizes. Only the
    table stays on disk: the shuffles that made it are removed.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    with settings(spark, WRITING):
        df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
