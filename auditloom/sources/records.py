"""Ingest: JSON records in, valid audit events and rejects out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.schema import EVENT_COLUMNS, EVENT_TYPES, RECORD_SCHEMA

# ISO-8601 date, optional time, optional zone
_ISO = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
)
_PARSE_SCHEMA = T.StructType(RECORD_SCHEMA.fields + [T.StructField("_broken", T.StringType())])


def parse_timestamp(text: Column) -> Column:
    """Instant of an ISO-8601 text, ``Z`` and offsets included; null if it is not one."""
    return F.when(text.rlike(_ISO), F.try_to_timestamp(text))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files of one JSON record per line."""
    return spark.read.text(path)


def stream_lines(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """The same as a stream; a batch is capped by its file count."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def unwrapped(lines: DataFrame, value: str = "value") -> DataFrame:
    """One row per record: a line is a record, or an envelope ``{"events": [...]}`` of many.

    Records stay text, so each is accepted or rejected on its own; an empty envelope has
    none. A line that is neither is one (broken) record.
    """
    envelope = F.from_json(F.col(value), "events array<string>")["events"]
    maybe = F.when(F.col(value).contains('"events"'), envelope)
    return lines.select(
        *[c for c in lines.columns if c != value],
        F.explode(F.coalesce(maybe, F.array(F.col(value)))).alias(value),
    )


def parse_records(lines: DataFrame, value: str = "value") -> DataFrame:
    """Parse JSON text into typed columns; ``value`` stays for the rejects.

    Records may come in envelopes (:func:`unwrapped`).

    The parsed struct goes through a generator. Later filters cannot be moved below
    it, where each would parse the text again for every column it mentions.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    parsed = F.from_json(F.col(value), _PARSE_SCHEMA, options)
    one = unwrapped(lines, value)
    return one.select(F.col(value).alias("value"), F.inline_outer(F.array(parsed)))


def validate(records: DataFrame, ingest_ts: Column | None = None) -> DataFrame:
    """Add ``ts``, the metadata fields with a meaning, and ``reject_reason``.

    A record without a timestamp counts as happening at ``ingest_ts``. The id it brings,
    a number or any text, becomes ``event_key``, and ``event_id`` where it is a number.
    """
    now = F.current_timestamp() if ingest_ts is None else ingest_ts
    stamp = F.when(F.col("timestamp").isNull(), now).otherwise(parse_timestamp(F.col("timestamp")))
    reason = (
        F.when(F.col("_broken").isNotNull() | F.col("value").isNull(), "broken json")
        .when(F.col("event_type").isNull() | ~F.col("event_type").isin(*EVENT_TYPES), "event_type")
        .when(F.col("system").isNull(), "system")
        .when(F.col("ts").isNull(), "timestamp")
    )
    metadata = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    out = records.withColumn("ts", stamp).withColumn("metadata", metadata).withColumns(
        {"event_key": F.col("event_id"), "event_id": F.col("event_id").try_cast("long")}
    )
    for key in ("ip", "endpoint", "status_code"):
        out = out.withColumn(key, F.col("metadata").getItem(key))
    return out.withColumn("reject_reason", reason)


def accepted(validated: DataFrame) -> DataFrame:
    """Valid events in the canonical column order."""
    return validated.where("reject_reason is null").select(*EVENT_COLUMNS)


def rejected(validated: DataFrame) -> DataFrame:
    """The rejected text with the reason."""
    return validated.where("reject_reason is not null").select("value", "reject_reason")


def batch_report(validated: DataFrame) -> DataFrame:
    """How many records of a batch were processed; rejection is per record."""
    report = validated.agg(
        F.count_if(F.col("reject_reason").isNull()).alias("processed"), F.count(F.lit(1)).alias("total")
    )
    # fixed value: the wording of the message
    text = F.format_string("Processed %d/%d events", "processed", "total")
    return report.withColumn("message", text)


def published(events: DataFrame) -> DataFrame:
    """The feed form of events, one JSON text each; it carries no session."""
    return events.select(
        F.to_json(
            F.struct(
                "event_type",
                "system",
                "user_id",
                F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
                "metadata",
            )
        ).alias("value")
    )


def read_feed(lines: DataFrame) -> DataFrame:
    """Typed columns from the feed form."""
    return validate(parse_records(lines)).select(
        "event_type", "system", "user_id", "ts", "metadata"
    )


def newest(events: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` newest events, newest first; a per-task top-n, not a full sort."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def to_records(events: DataFrame) -> DataFrame:
    """Write events as producers send them: one JSON text per row."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp")
    columns = ["event_id", "event_type", "user_id", "session_id", "system", stamp]
    return events.select(
        "event_id", F.to_json(F.struct(*columns, "latency_ms", "metadata")).alias("value")
    )
