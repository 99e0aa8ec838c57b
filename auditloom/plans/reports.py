"""Compliance reports. Each takes rollup tables and gives one flat DataFrame.

Reports answer for all systems at once; filter the result or the rollup for one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.buckets import bucket_start
from auditloom.functions.numbers import percentile_label, tidy
from auditloom.operators.bloom import contains_any
from auditloom.operators.distinct import LG_K
from auditloom.operators.heavy import top_lists
from auditloom.operators.mergeable import relative_error
from auditloom.operators.quantiles import percentiles

DEFAULT_PERCENTILES = (50.0, 95.0, 99.0)
SUMMARY_PERCENTILES = (50.0, 90.0, 95.0, 99.0, 99.9)


def distinct_counts(hll_rollup: DataFrame) -> DataFrame:
    """Distinct count per key, with the relative error of the sketch (two sigma)."""
    return hll_rollup.select(
        "metric",
        "system",
        "window",
        "bucket_start",
        F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).alias("count"),
        F.lit(round(2 * relative_error(LG_K), 4)).alias("accuracy"),
    )


def top_items(topk_rollup: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most frequent items per key, as an array."""
    return top_lists(topk_rollup, ["metric", "system", "window", "bucket_start"], k)


def activity_from_filters(filters: DataFrame, asked: DataFrame, window: str, metric: str = "user_activity") -> DataFrame:
    """Whether users were active, from stored filters: adds ``accessed`` and ``probability``.

    ``asked`` has ``user_id, system, bucket_start`` of buckets of ``window``; ``filters`` are
    stored rows of that window and shorter ones. Every filter of the bucket is asked on its
    own, as merging the days of a week would fill one filter with seven days. A no is
    certain; the probability of a yes follows from the bits that are set.
    """
    own = filters.where(F.col("metric") == metric).select(
        "system", bucket_start(F.col("bucket_start"), window).alias("bucket_start"),
        F.concat_ws(" ", "window", F.col("bucket_start").cast("string")).alias("part"),
        "blocks", "block", *[c for c in filters.columns if c[0] == "w" and c[1:].isdigit()],
    )
    value = F.concat_ws(":", "user_id", "system")
    return contains_any(asked.withColumn("value", value), own, ["system", "bucket_start"], ["part"]).drop("value")


def _pivoted(rows: DataFrame, names: Mapping[str, str], value: str) -> DataFrame:
    picks = [
        F.coalesce(F.max(F.when(F.col("metric") == m, F.col(value))), F.lit(0)).alias(name)
        for m, name in names.items()
    ]
    return rows.groupBy("system").agg(*picks)


def system_summary(
    hourly: DataFrame, daily: DataFrame, hourly_counts: DataFrame, as_of: datetime, k: int = 10
) -> DataFrame:
    """Summary of every system for the hour and the day that hold ``as_of``.

    ``hourly`` and ``daily`` have ``metric, system, bucket_start, count``;
    ``hourly_counts`` is a topk rollup. One conditional aggregation per table, for
    all systems together; the sides joined have one row per system.
    """
    moment = F.lit(as_of).cast("timestamp")
    hour, day = bucket_start(moment, "1h"), bucket_start(moment, "1d")
    distinct = {"users": "unique_users", "sessions": "unique_sessions", "ips": "unique_ips"}
    by_hour = _pivoted(
        hourly.where(F.col("bucket_start") == hour),
        {m: f"hourly_{n}" for m, n in distinct.items()},
        "count",
    )
    by_day = _pivoted(
        daily.where(F.col("bucket_start") == day),
        {m: f"daily_{n}" for m, n in distinct.items()},
        "count",
    )
    wanted = hourly_counts.where(
        (F.col("bucket_start") == hour) & F.col("metric").isin("active_users", "active_ips")
    )
    lists = top_lists(wanted, ["metric", "system"], k)
    tops = lists.groupBy("system").agg(
        F.max(F.when(F.col("metric") == "active_users", F.col("items"))).alias("top_users"),
        F.max(F.when(F.col("metric") == "active_ips", F.col("items"))).alias("top_ips"),
    )
    joined = by_day.join(by_hour, "system", "left").join(tops, "system", "left")
    filled = joined.fillna(0, [c for c in joined.columns if c.startswith("hourly_")])
    return filled.withColumn("as_of", moment)


def percentile_report(
    kll_rollup: DataFrame, ps: Sequence[float] = DEFAULT_PERCENTILES
) -> DataFrame:
    """Map of percentile label to value per key, unlike percentiles under unlike labels."""
    keys = ["metric", "system", "window", "bucket_start"]
    values = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(p / 100.0) for p in ps]))
    labels = F.array(*[F.lit(percentile_label(p)) for p in ps])
    return kll_rollup.select(
        *keys, F.map_from_arrays(labels, values).alias("percentiles"), F.lit("milliseconds").alias("unit")
    )


def _verdict(value: Column, threshold: Column) -> Column:
    return F.when(value < threshold, "PASS").otherwise("FAIL")


def sla_check(values: DataFrame, thresholds: DataFrame | float) -> DataFrame:
    """Judge percentile values (rows with ``value``) against a threshold.

    Below the threshold passes, equal fails. Keys without data have no row.
    ``thresholds`` is a number or a table ``(system, threshold)``.
    """
    if isinstance(thresholds, DataFrame):
        judged = values.join(thresholds, "system")
    else:
        judged = values.withColumn("threshold", F.lit(float(thresholds)))
    return (
        judged.where(F.col("value").isNotNull())
        .withColumn("status", _verdict(F.col("value"), F.col("threshold")))
        .withColumn("margin", tidy(F.col("threshold") - F.col("value"), 2))
        .withColumn("value", tidy(F.col("value"), 2))
    )


def sla_from_rollup(kll_rollup: DataFrame, p: float, thresholds: DataFrame | float) -> DataFrame:
    """:func:`sla_check` on one percentile of the digests."""
    keys = ["metric", "system", "window", "bucket_start"]
    return sla_check(percentiles(kll_rollup, keys, [p]), thresholds)


def latency_summary(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key from rows ``p, value``: five percentiles and two verdicts."""
    picks = [
        F.max(F.when(F.col("p") == p, F.col("value"))).alias(percentile_label(p))
        for p in SUMMARY_PERCENTILES
    ]
    wide = values.groupBy(*keys).agg(*picks)
    # fixed thresholds of the report, in milliseconds
    p95 = F.when(F.col("p95").isNotNull(), _verdict(F.col("p95"), F.lit(200.0)))
    p99 = F.when(F.col("p99").isNotNull(), _verdict(F.col("p99"), F.lit(500.0)))
    return wide.withColumn("p95_under_200ms", p95).withColumn("p99_under_500ms", p99).select(
        *keys,
        *[tidy(F.col(percentile_label(p)), 2).alias(percentile_label(p)) for p in SUMMARY_PERCENTILES],
        "p95_under_200ms",
        "p99_under_500ms",
    )


def failed_logins(topk_rollup: DataFrame, keys: Sequence[str], k: int = 10) -> DataFrame:
    """Addresses with the most failed logins."""
    return top_lists(topk_rollup.where("metric = 'failed_logins'"), keys, k)


def dashboard_cards(summary: DataFrame) -> DataFrame:
    """Four numbers per system; "24h" is the calendar day."""
    return summary.select(
        "system",
        F.col("daily_unique_users").alias("users_24h"),
        F.col("hourly_unique_users").alias("users_1h"),
        F.col("daily_unique_ips").alias("ips_24h"),
        F.col("hourly_unique_sessions").alias("sessions_1h"),
    )
