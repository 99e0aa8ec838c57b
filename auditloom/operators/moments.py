"""Count, mean and central moment sums: from rows, merged, presented, running."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.buckets import bucket_start, expires_at
from auditloom.functions.joins import join_groups
from auditloom.operators.ordered import running_sums
from auditloom.session import measured

STATE = ("n", "m1", "m2", "m3", "m4", "lo", "hi")


def partial(df: DataFrame, keys: Sequence[str], value: str, *extra: Column) -> DataFrame:
    """State per key: ``n``, mean ``m1`` and the sums of squared, cubed and fourth
    powers of the distance from the mean, and any ``extra`` aggregates. One pass."""
    x = F.col(value)
    out = df.where(x.isNotNull()).groupBy(*keys).agg(
        F.count(x).alias("n"),
        F.avg(x).alias("m1"),
        F.var_pop(x).alias("__v"),
        F.skewness(x).alias("__s"),
        F.kurtosis(x).alias("__k"),
        F.min(x).alias("lo"),
        F.max(x).alias("hi"),
        *extra,
    )
    more = [c for c in out.columns if c not in (*keys, "n", "m1", "__v", "__s", "__k", "lo", "hi")]
    n, m2 = F.col("n"), F.col("__v") * F.col("n")
    m3 = F.coalesce(F.col("__s") * F.pow(m2, F.lit(1.5)) / F.sqrt(n), F.lit(0.0))
    m4 = F.coalesce((F.col("__k") + 3) * m2 * m2 / n, F.lit(0.0))
    return out.select(
        *keys, "n", "m1", m2.alias("m2"), m3.alias("m3"), m4.alias("m4"), "lo", "hi", *more
    )


def merge(states: DataFrame, keys: Sequence[str], *extra: Column) -> DataFrame:
    """Merge any number of states per key at once: common mean, then shifted sums.

    States of no rows are neutral. Both steps combine inside the tasks first. The
    states are read twice, so they should be a stored table, not a plan over raw rows.
    """
    keys = list(keys)
    n, d = F.col("n"), F.col("m1") - F.col("__mean")
    live = states.where("n > 0")
    mean = (F.sum(n * F.col("m1")) / F.sum(n)).alias("__mean")
    if keys:
        shifted = join_groups(live, live.groupBy(*keys).agg(mean), keys)
    else:
        # a single number for the whole table
        shifted = live.withColumn("__mean", F.lit(live.agg(mean).first()[0]).cast("double"))
    m2, m3, m4 = F.col("m2"), F.col("m3"), F.col("m4")
    return shifted.groupBy(*keys).agg(
        F.sum(n).alias("n"),
        F.max("__mean").alias("m1"),
        F.sum(m2 + n * d * d).alias("m2"),
        F.sum(m3 + 3 * d * m2 + n * d * d * d).alias("m3"),
        F.sum(m4 + 4 * d * m3 + 6 * d * d * m2 + n * d * d * d * d).alias("m4"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        *extra,
    )


def _guarded(value: Column, at_least: int) -> Column:
    n, m2 = F.col("n"), F.col("m2")
    return F.when((n >= at_least) & (m2 > 0), value).otherwise(F.lit(0.0))


def present(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Readable statistics; 0.0 where there are too few rows or no spread."""
    n, m2 = F.col("n"), F.col("m2")
    return states.select(
        *keys,
        "n",
        F.col("m1").alias("mean"),
        _guarded(m2 / n, 2).alias("var_pop"),
        _guarded(m2 / (n - 1), 2).alias("var_samp"),
        _guarded(F.sqrt(m2 / n), 2).alias("stddev_pop"),
        _guarded(F.sqrt(m2 / (n - 1)), 2).alias("stddev_samp"),
        _guarded(F.sqrt(n) * F.col("m3") / F.pow(m2, F.lit(1.5)), 3).alias("skewness"),
        _guarded(n * F.col("m4") / (m2 * m2) - 3, 4).alias("kurtosis"),
        *[c for c in ("lo", "hi") if c in states.columns],
    )


def moments_rollup(events: DataFrame, window: str = "1h", metric: str = "api_latency") -> DataFrame:
    """Latency moments per system and bucket."""
    timed = events.withColumn("bucket_start", bucket_start(F.col("ts"), window))
    last = F.max("ts").alias("last_ts")
    return partial(timed, ["system", "bucket_start"], "latency_ms", last).select(
        F.lit(metric).alias("metric"), "system", F.lit(window).alias("window"), "bucket_start",
        *STATE, "last_ts", expires_at(F.col("last_ts"), window).alias("expires_at"),
    )


def band(states: DataFrame, keys: Sequence[str], width: float = 2.0) -> DataFrame:
    """Mean plus and minus ``width`` standard deviations."""
    stats = present(states, keys)
    spread = F.lit(width) * F.col("stddev_pop")
    return stats.select(
        *keys, "n", "mean", (F.col("mean") - spread).alias("low"), (F.col("mean") + spread).alias("high")
    )


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Statistics after every row, per key in the given order.

    Powers are summed around the mean of the whole key, which keeps them small, so
    the running sums lose no precision that matters.
    """
    keys = list(keys)
    centre = measured(df.groupBy(*keys).agg(F.avg(value).alias("__centre")), "centres")
    rows = join_groups(df.where(F.col(value).isNotNull()), centre, keys)
    d = f"({value} - __centre)"
    sums = {"n": "1L", "s1": d, "s2": f"{d}*{d}", "s3": f"{d}*{d}*{d}", "s4": f"{d}*{d}*{d}*{d}"}
    out = running_sums(rows, keys, order, sums)
    n, s1, s2, s3, s4 = (F.col(c) for c in sums)
    mean = s1 / n
    m2 = s2 - s1 * mean
    # what is left of equal values is rounding, not spread
    m2 = F.when(m2 > 1e-12 * s2, m2).otherwise(F.lit(0.0))
    m3 = s3 - 3 * mean * s2 + 2 * n * mean * mean * mean
    m4 = s4 - 4 * mean * s3 + 6 * mean * mean * s2 - 3 * n * mean * mean * mean * mean
    states = out.select(
        *df.columns, "n", (F.col("__centre") + mean).alias("m1"), m2.alias("m2"), m3.alias("m3"), m4.alias("m4")
    )
    return present(states, df.columns)
