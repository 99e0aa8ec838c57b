"""The given tables, and the audit events they stand for."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.session import tune

# Read with a fixed schema: no inference job, and the zone-less file timestamps
# come out as UTC instants, which watermarks need and filters can push down.
EVENTS_SCHEMA = (
    "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
)


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table."""
    return tune(spark).read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet")


def raw_events_stream(spark: SparkSession, sf_dir: str, files_per_batch: int = 64) -> DataFrame:
    """The events table as a stream of files; a batch is capped by its file count."""
    reader = (
        tune(spark).readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
    )
    table = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    files = table.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.getFileStatus(table).isDirectory():
        return reader.parquet(f"{sf_dir}/events.parquet")
    # a stream reads folders: take the one file out of its folder by name
    return reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def to_audit_events(raw: DataFrame) -> DataFrame:
    """Map rows of the events table to audit events; works on batches and streams."""
    number = F.regexp_extract("props", "[0-9]+", 0)
    user = F.col("user_id").cast("string")
    is_click = F.col("event_type") == "click"
    is_error = F.col("event_type") == "error"
    kind = (
        F.when(F.col("event_type") == "signup", "user_login")
        .when(is_click, "api_access")
        .when(F.col("event_type") == "view", "file_access")
        .when(F.col("event_type") == "purchase", "database_access")
        .when(is_error, "security_event")
        .otherwise("custom")
    )
    system = (
        F.when(F.col("event_id") % 3 == 0, "production_db")
        .when(F.col("event_id") % 3 == 1, "staging_db")
        .otherwise("api_gateway")
    )
    day = F.date_format("ts", "yyyy-MM-dd")
    return raw.select(
        "event_id",
        "ts",
        kind.alias("event_type"),
        system.alias("system"),
        F.concat(F.lit("user"), user).alias("user_id"),
        F.when(~is_error, F.concat(user, F.lit("-"), day)).alias("session_id"),
        F.when(F.col("event_id") % 10 != 0, F.concat(F.lit("10.0.0."), number)).alias("ip"),
        F.when(
            is_click, F.concat(F.lit("/api/"), (number.cast("int") % 10).cast("string"))
        ).alias("endpoint"),
        F.when(is_error & (F.col("event_id") % 2 == 0), "401").alias("status_code"),
        F.col("value").alias("latency_ms"),
    )


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as audit events."""
    return to_audit_events(raw_events(spark, sf_dir))


def latest_ts(df: DataFrame, column: str = "ts") -> datetime | None:
    """Newest timestamp: one value, used as a literal so that scans can be pruned by it."""
    return df.agg(F.max(column)).first()[0]


def with_metadata(events: DataFrame) -> DataFrame:
    """Add the free-form metadata map; absent keys are left out of it."""
    pairs = F.map_from_arrays(
        F.array(F.lit("ip"), F.lit("endpoint"), F.lit("status_code")),
        F.array("ip", "endpoint", "status_code"),
    )
    return events.withColumn("metadata", F.map_filter(pairs, lambda _, v: v.isNotNull()))
