"""Metric routing: which summaries an event updates. The rules are data."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.buckets import bucket_start, bucket_start_by


@dataclass(frozen=True)
class MetricRule:
    """One metric: ``value`` and ``condition`` are SQL expressions over an event."""

    structure: str
    metric: str
    value: str
    condition: str
    windows: tuple[str, ...]


_USER = "user_id is not null and user_id <> ''"
_SESSION = "session_id is not null and session_id <> ''"

RULES = (
    MetricRule("hll", "users", "user_id", _USER, ("1h", "1d", "1w")),
    MetricRule("hll", "sessions", "session_id", _SESSION, ("1h", "1d")),
    MetricRule("hll", "ips", "ip", "ip is not null", ("1h", "1d")),
    MetricRule("bloom", "user_activity", "concat_ws(':', user_id, system)", _USER, ("1d", "1w")),
    MetricRule("bloom", "ip_activity", "ip", "ip is not null", ("1d",)),
    MetricRule("topk", "active_users", "user_id", _USER, ("1h",)),
    MetricRule("topk", "active_ips", "ip", "ip is not null", ("1h",)),
    MetricRule("topk", "event_types", "event_type", "true", ("1h",)),
    MetricRule("topk", "endpoints", "endpoint", "endpoint is not null", ("1h",)),
    MetricRule(
        "topk",
        "failed_logins",
        "coalesce(ip, 'unknown')",
        "event_type = 'security_event' and status_code is not null",
        ("1h",),
    ),
)



def rules_for(structure: str, rules: Iterable[MetricRule] = RULES) -> tuple[MetricRule, ...]:
    return tuple(r for r in rules if r.structure == structure)


def _fan_out(rows: Iterable[tuple[str, ...]], names: str) -> str:
    """``stack`` over rows of SQL expressions; it stays in generated code."""
    cells = [cell for row in rows for cell in row]
    count = len(cells) // len(names.split(","))
    return f"stack({count}, {', '.join(cells)}) as ({names})"


def _value(rule: MetricRule) -> str:
    return f"case when {rule.condition} then {rule.value} end"


def route(events: DataFrame, rules: Iterable[MetricRule] = RULES) -> DataFrame:
    """All updates of all events: one scan and one generator, however many the rules."""
    rows = [
        (f"'{rule.structure}'", f"'{rule.metric}'", f"'{window}'", _value(rule))
        for rule in rules
        for window in rule.windows
    ]
    updates = F.expr(_fan_out(rows, "structure, metric, window, value"))
    return (
        events.select("event_id", "system", "ts", updates)
        .where("value is not null")
        .withColumn("bucket_start", bucket_start_by(F.col("ts"), F.col("window")))
    )


def value_counts(
    events: DataFrame, rules: Iterable[MetricRule], window: str = "1h"
) -> DataFrame:
    """Rows per ``(metric, system, bucket, value)``, the base of every exact operator.

    The count is partial inside each task, so a hot value crosses the network once per
    task however many rows it has, and the shuffle key includes the value.
    """
    rows = [(f"'{rule.metric}'", _value(rule)) for rule in rules]
    updates = F.expr(_fan_out(rows, "metric, value"))
    start = bucket_start(F.col("ts"), window).alias("bucket_start")
    return (
        events.select("system", "ts", start, updates)
        .where("value is not null")
        .groupBy("metric", "system", "bucket_start", "value")
        .agg(F.count(F.lit(1)).alias("cnt"), F.max("ts").alias("last_ts"))
        .withColumn("window", F.lit(window))
    )
