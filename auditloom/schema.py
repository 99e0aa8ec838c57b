"""Event model, window table and rollup table schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The event types a record may carry.
EVENT_TYPES = (
    "user_login",
    "user_logout",
    "api_access",
    "database_access",
    "file_access",
    "security_event",
    "error_event",
    "admin_action",
    "custom",
)


@dataclass(frozen=True)
class WindowSpec:
    code: str
    duration_s: int
    keep: int  # how many windows a summary is kept for

    @property
    def retention_s(self) -> int:
        return self.duration_s * self.keep


# Window codes, durations in seconds, windows kept.
WINDOWS = (
    WindowSpec("1m", 60, 60),
    WindowSpec("5m", 300, 144),
    WindowSpec("15m", 900, 96),
    WindowSpec("1h", 3600, 168),
    WindowSpec("1d", 86400, 90),
    WindowSpec("1w", 604800, 52),
    WindowSpec("1M", 2592000, 24),
)
WINDOW_CODES = tuple(w.code for w in WINDOWS)


def window_spec(code: str) -> WindowSpec:
    """The row of the window table for a code; an unknown code lists the valid ones."""
    for spec in WINDOWS:
        if spec.code == code:
            return spec
    # fixed value: the wording of the message
    raise ValueError(f"Invalid window: {code}. Valid options: {', '.join(WINDOW_CODES)}")


def window_table(spark: SparkSession) -> DataFrame:
    """Window table ``(window, duration_s, retention_s)``; seven rows, safe to broadcast."""
    rows = ", ".join(f"('{w.code}', {w.duration_s}L, {w.retention_s}L)" for w in WINDOWS)
    return spark.sql(f"select * from values {rows} as t(window, duration_s, retention_s)")


# What a producer sends, before validation. The timestamp stays text so that an
# unparsable one can be told from a missing one.
RECORD_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("system", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

EVENT_COLUMNS = (
    "event_id",
    "ts",
    "event_type",
    "system",
    "user_id",
    "session_id",
    "metadata",
    "ip",
    "endpoint",
    "status_code",
    "latency_ms",
    "event_key",
)

# Rollup tables. ``window``, ``bucket_date`` and ``txn`` are folder names, and are typed here
# because guessing would read the window "1d" as a number.
_KEY = "metric string, system string, bucket_start timestamp, "
_FOLDERS = ", last_ts timestamp, expires_at timestamp, window string, bucket_date date, txn string"
# Words of a block of a stored filter: the number of hashes at its error rate.
BLOOM_WORDS = 6
ROLLUP_SCHEMAS = {
    "hll": _KEY + "sketch binary, n long" + _FOLDERS,
    "theta": _KEY + "sketch binary, n long" + _FOLDERS,
    "member": _KEY + "value string" + _FOLDERS,
    "bloom": _KEY + "blocks long, block long, " + ", ".join(f"w{i} long" for i in range(BLOOM_WORDS)) + _FOLDERS,
    "topk": _KEY + "item string, cnt long" + _FOLDERS,
    "heavy": _KEY + "item string, cnt long" + _FOLDERS,
    "kll": _KEY + "sketch binary, n long" + _FOLDERS,
    "moments": _KEY
    + "n long, m1 double, m2 double, m3 double, m4 double, lo double, hi double"
    + _FOLDERS,
}
LEDGER_SCHEMA = "event_key string, event_date date, txn string"
