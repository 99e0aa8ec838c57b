"""Distinct counts: sketch per bucket, merges, and the exact counterpart."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.buckets import bucket_start, expires_at
from auditloom.operators.mergeable import hll, theta
from auditloom.operators.routing import RULES, MetricRule, rules_for

KEY = ("metric", "system", "window", "bucket_start")
LG_K = 14


def hll_rollup(
    events: DataFrame,
    window: str = "1h",
    rules: Iterable[MetricRule] = RULES,
    lg_k: int = LG_K,
) -> DataFrame:
    """Sketch of every hll metric per system and bucket.

    All metrics are columns of one aggregation over the raw rows; they become rows
    only afterwards, so no event is ever multiplied.
    """
    rules = rules_for("hll", rules)
    aggs, parts = [], []
    for i, rule in enumerate(rules):
        value = f"case when {rule.condition} then {rule.value} end"
        aggs += [
            F.expr(f"hll_sketch_agg({value}, {lg_k})").alias(f"s{i}"),
            F.expr(f"count({value})").alias(f"n{i}"),
            F.expr(f"max(case when {rule.condition} then ts end)").alias(f"t{i}"),
        ]
        parts.append(f"'{rule.metric}', s{i}, n{i}, t{i}")
    wide = events.groupBy(
        "system", bucket_start(F.col("ts"), window).alias("bucket_start")
    ).agg(*aggs)
    stacked = F.expr(f"stack({len(rules)}, {', '.join(parts)}) as (metric, sketch, n, last_ts)")
    return (
        wide.select("system", "bucket_start", stacked)
        .where("n > 0")
        .withColumn("window", F.lit(window))
        .select(*KEY, "sketch", "n", "last_ts", expires_at(F.col("last_ts"), window).alias("expires_at"))
    )


def merge_hll(rollup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merge sketches of one size over everything that is not in ``keys``."""
    return hll(lg_k=LG_K).merge(rollup, keys)


def estimate(rollup: DataFrame, keys: Sequence[str]) -> DataFrame:
    return hll().present(rollup, keys)


def exact_distinct(base: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact distinct values per key, from value counts.

    Spark first removes duplicates under ``(keys, value)``, then counts, so one hot
    key is spread over all tasks.
    """
    return base.groupBy(*keys).agg(
        F.count_distinct("value").alias("exact"),
        F.sum("cnt").alias("n"),
        F.max("last_ts").alias("last_ts"),
    )


def present_in_all(events: DataFrame, group: str, value: str, lg_k: int = LG_K) -> DataFrame:
    """Estimated number of values present in every group, without keeping raw values."""
    per_group = theta(value, lg_k).partial(events, [group])
    return per_group.agg(
        F.theta_sketch_estimate(F.theta_intersection_agg("sketch")).alias("estimate"),
        F.count(F.lit(1)).alias("groups"),
    )


def present_in_all_stored(sketches: DataFrame, group: str, keys: Sequence[str], groups: int) -> DataFrame:
    """Estimated values present in all ``groups``, from stored theta sketches.

    Sketches of one group are first united over whatever is not in ``keys`` (buckets of a
    time range, windows), then intersected. A key that lacks a group has nothing in common.
    """
    lg_k = LG_K
    united = sketches.groupBy(*keys, group).agg(F.expr(f"theta_union_agg(sketch, {lg_k})").alias("sketch"))
    common = united.groupBy(*keys).agg(
        F.theta_sketch_estimate(F.theta_intersection_agg("sketch")).alias("estimate"),
        F.count(F.lit(1)).alias("groups"),
    )
    return common.where(F.col("groups") == groups)


def checked(
    sketch: DataFrame, exact: DataFrame, keys: Sequence[str], bound: float
) -> DataFrame:
    """Estimates next to exact counts: keys, exact value, and whether they agree."""
    joined = sketch.select(*keys, "estimate").join(
        exact.select(*keys, "exact"), list(keys), "full_outer"
    )
    gap = F.abs(F.col("estimate") - F.col("exact"))
    # the half allows for rounding of tiny counts
    within = gap <= F.greatest(F.lit(bound) * F.col("exact"), F.lit(0.5))
    return joined.select(*keys, "exact", F.coalesce(within, F.lit(False)).alias("within_bound"))
