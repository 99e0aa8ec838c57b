"""Spark session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the package relies on. All are runtime settings, so they can be put on
# a session somebody else built.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rankings are cut inside each task before the shuffle up to this k.
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    # Stream state may outgrow executor memory: keep it on disk, upload changes only.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Sketch aggregates hold one object per key and fall back to sorting the raw rows
    # past this many keys per task. A full distinct-count sketch takes 16 kB, so three
    # per key bound a task at 200 MB; sketches of few values take a fraction of it.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
}


def tune(spark: SparkSession) -> SparkSession:
    """Put the package's runtime settings on a session."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(
    app: str = "auditloom", master: str | None = None, shuffle_partitions: int | None = None
) -> SparkSession:
    """Build a session; on a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config(
            "spark.ui.showConsoleProgress", "false"
        )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets a temporary folder.
    """
    context = spark.sparkContext
    setting = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if setting:
        return setting.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="auditloom-"))
    return context.getCheckpointDir()


def run_dir(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"


def forget(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application.

    For the end of a run that went well, when its results have been written: DataFrames
    that read such a table can no longer be computed. What a failed run leaves stays.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


# What the optimizer says of an input whose size nobody knows is beyond this.
_UNKNOWN_BYTES = 1 << 60


def input_bytes(df: DataFrame) -> int:
    """Size of the tables a DataFrame reads, as the optimizer sees it after pruning; inputs
    of unknown size do not count."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(size for size in sizes if size < _UNKNOWN_BYTES)


def partitions_for(df: DataFrame, bytes_per_task: int = 128 << 20) -> int:
    """Shuffle partitions that keep tasks at a size that fits in memory.

    Never below the session's setting; small partitions are put together at run time.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-input_bytes(df) // bytes_per_task))


@contextmanager
def shuffle_partitions(spark: SparkSession, count: int) -> Iterator[None]:
    """Use ``count`` shuffle partitions for the jobs started inside."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(count))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def measured(df: DataFrame, label: str) -> DataFrame:
    """A join side that should be small, written out so that its true size is known.

    The optimizer overrates an aggregate of a huge table and would shuffle the other
    side to meet it. Reading it back, it broadcasts the table if it is below the
    broadcast threshold, and otherwise joins by shuffle, splitting skewed partitions.
    """
    return materialize(df, label)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back.

    Cuts the lineage in a way that survives the loss of executors, and pins values
    that a recomputation could change, such as partition ids.
    """
    spark = df.sparkSession
    path = run_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
