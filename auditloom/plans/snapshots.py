"""Daily compliance snapshots: one folder per date, written again without harm."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: days a snapshot is kept.
RETENTION_DAYS = 90

SCHEMA = (
    "system string, metric string, window string, value double, "
    "items array<struct<item: string, count: long>>, snapshot_date date"
)


def snapshot_rows(daily: DataFrame, lists: DataFrame) -> DataFrame:
    """Snapshot rows of every date in the daily tables.

    ``daily`` has ``metric, system, bucket_start, count``; ``lists`` has
    ``metric, system, bucket_start, items``.
    """
    nothing = F.lit(None).cast("array<struct<item: string, count: long>>")
    counts = daily.select(
        "system", "metric", F.lit("1d").alias("window"), F.col("count").cast("double").alias("value"),
        nothing.alias("items"), F.to_date("bucket_start").alias("snapshot_date"),
    )
    tops = lists.select(
        "system", "metric", F.lit("1d").alias("window"), F.lit(None).cast("double").alias("value"),
        F.col("items").cast("array<struct<item: string, count: long>>").alias("items"),
        F.to_date("bucket_start").alias("snapshot_date"),
    )
    return counts.unionByName(tops)


def save(rows: DataFrame, root: str) -> None:
    """Write snapshots; only the dates in ``rows`` are replaced."""
    (
        rows.hint("rebalance", "snapshot_date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("snapshot_date")
        .parquet(root)
    )


def load(spark: SparkSession, root: str, day: date) -> DataFrame:
    """Snapshot of a date; empty means there is none."""
    return _stored(spark, root).where(F.col("snapshot_date") == F.lit(day))


def _stored(spark: SparkSession, root: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(root)


def kept(spark: SparkSession, root: str, today: date) -> DataFrame:
    """Snapshots that have not run out."""
    first = today - timedelta(days=RETENTION_DAYS)
    return _stored(spark, root).where(F.col("snapshot_date") > F.lit(first))


def expire(spark: SparkSession, root: str, today: date) -> int:
    """Delete the snapshots that have run out; tells how many dates."""
    first = today - timedelta(days=RETENTION_DAYS)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    old = [n for n in names if n.startswith("snapshot_date=") and n[14:] <= first.isoformat()]
    for name in old:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}"), True)
    return len(old)
