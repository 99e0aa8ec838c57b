"""Exact membership: who was active where and when, as a table of values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.buckets import bucket_start, bucket_start_by, expires_at
from auditloom.operators.routing import RULES, rules_for, value_counts


def member_rollup(events: DataFrame, window: str = "1h") -> DataFrame:
    """Distinct values per metric, system and bucket."""
    counted = value_counts(events, rules_for("bloom", RULES), window)
    return counted.select(
        "metric", "system", "window", "bucket_start", "value", "last_ts",
        expires_at(F.col("last_ts"), window).alias("expires_at"),
    )


def coarsen_members(members: DataFrame, window: str) -> DataFrame:
    """Members of longer windows from members of shorter ones."""
    return (
        members.groupBy(
            "metric", "system", bucket_start(F.col("bucket_start"), window).alias("bucket_start"), "value"
        )
        .agg(F.max("last_ts").alias("last_ts"))
        .withColumn("window", F.lit(window))
    )


def check_activity(questions: DataFrame, members: DataFrame) -> DataFrame:
    """Answer ``(user_id, system, ts, window)`` questions from the member table.

    The join key ends in the asked value, so it spreads; which side moves is left to
    the adaptive planner. Members have one row per key and cannot multiply questions.
    """
    asked = questions.select(
        "*",
        bucket_start_by(F.col("ts"), F.col("window")).alias("bucket_start"),
        F.concat_ws(":", "user_id", "system").alias("value"),
    )
    known = members.where("metric = 'user_activity'").select(
        "system", "window", "bucket_start", "value", F.lit(True).alias("found")
    )
    keys = ["system", "window", "bucket_start", "value"]
    return asked.join(known, keys, "left").select(
        *questions.columns, F.coalesce("found", F.lit(False)).alias("accessed")
    )


def seen_before(events: DataFrame, reference: DataFrame) -> DataFrame:
    """Events of users who occur in the reference events."""
    return events.join(reference.select("user_id").distinct(), "user_id", "left_semi")


def never_seen(events: DataFrame, reference: DataFrame) -> DataFrame:
    """Events of users who do not occur in the reference events."""
    return events.join(reference.select("user_id").distinct(), "user_id", "left_anti")


def in_any(members: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Union of memberships: values active in any of the groups left out of ``keys``."""
    return members.select(*keys, value).distinct()


def in_all(
    members: DataFrame, group: str, keys: Sequence[str] = (), value: str = "value"
) -> DataFrame:
    """Intersection of memberships: values active in every group there is."""
    pairs = members.select(*keys, value, group).distinct()
    groups = members.select(group).distinct().agg(F.count(F.lit(1)).alias("n_groups"))
    per_value = pairs.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    # one row with the number of groups
    return per_value.join(F.broadcast(groups), F.col("n") == F.col("n_groups")).select(*keys, value)
