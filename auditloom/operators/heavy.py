"""Heavy hitters: exact counts per item, cut to k only when read; and bounded counters.

Bounded counters keep ``slots`` items per key. What does not fit is cut as in the summary of
Misra and Gries: the count of the first item left out is taken off every counter, and added
to the key's error, which is a row of its own (the one without item). Tables of counters of
any number of batches, windows and systems add up row by row and are cut again. An item of
true count f is shown with ``low <= f <= low + error``, and the error of a key of N events
is at most N / (slots + 1); so every item above the error is there.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.joins import join_groups
from auditloom.functions.buckets import bucket_start, expires_at
from auditloom.operators.routing import RULES, MetricRule, rules_for, value_counts


def topk_rollup(
    events: DataFrame, window: str = "1h", rules: Iterable[MetricRule] = RULES
) -> DataFrame:
    """Counts of every item of every topk metric per system and bucket."""
    counted = value_counts(events, rules_for("topk", rules), window)
    return counted.select(
        "metric", "system", "window", "bucket_start", F.col("value").alias("item"), "cnt", "last_ts",
        expires_at(F.col("last_ts"), window).alias("expires_at"),
    )


def merge_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add counts of equal items over everything that is not in ``keys``."""
    return counts.groupBy(*keys, "item").agg(F.sum("cnt").alias("cnt"))


def coarsen_counts(counts: DataFrame, window: str) -> DataFrame:
    """Counts of longer windows from counts of shorter ones."""
    return (
        counts.withColumn("bucket_start", bucket_start(F.col("bucket_start"), window))
        .groupBy("metric", "system", "bucket_start", "item")
        .agg(F.sum("cnt").alias("cnt"), F.max("last_ts").alias("last_ts"))
        .withColumn("window", F.lit(window))
    )


def top_k(counts: DataFrame, keys: Sequence[str], k: int = 10) -> DataFrame:
    """The ``k`` largest items per key, ties broken by item, with their rank.

    Spark keeps ``k`` rows per key in every task before the shuffle, so a hot key
    never meets in one task whole.
    """
    order = [F.desc("cnt"), F.asc("item")]
    if not keys:
        best = counts.orderBy(*order).limit(k)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    ranked = counts.withColumn(
        "rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    )
    return ranked.where(F.col("rank") <= k)


def top_lists(counts: DataFrame, keys: Sequence[str], k: int = 10) -> DataFrame:
    """The same as one array of ``(item, count)`` per key; arrays hold at most ``k``."""
    cell = F.struct("rank", F.struct("item", F.col("cnt").alias("count")).alias("x"))
    return (
        top_k(counts, keys, k)
        .groupBy(*keys)
        .agg(F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["x"]).alias("items"))
    )


def count_of(counts: DataFrame, questions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count of asked items, 0 if absent. ``counts`` has one row per key and item."""
    on = [*keys, "item"]
    joined = join_groups(questions, counts.select(*on, "cnt"), on, "left")
    return joined.select(*questions.columns, F.coalesce("cnt", F.lit(0)).alias("cnt"))


# Counters kept per key: errors are below a thousandth of the events of the key.
SLOTS = 1000


def counter_rollup(
    events: DataFrame, window: str = "1h", rules: Iterable[MetricRule] = RULES, slots: int = SLOTS
) -> DataFrame:
    """Bounded counters of every heavy metric per system and bucket."""
    counted = value_counts(events, rules_for("heavy", rules), window)
    return counter_cut(counted.withColumnRenamed("value", "item"), ["metric", "system", "window", "bucket_start"], slots)


def counter_cut(counts: DataFrame, keys: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """Counters from exact counts, or from counters that were added up: ``item, cnt, last_ts``.

    ``counts`` has one row per key and item; the row without item holds the error so far.
    Spark keeps ``slots + 1`` rows per key in every task before they meet.
    """
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy(F.desc("cnt"), F.asc("item"))
    named = counts.where("item is not null").select(*keys, "item", "cnt", "last_ts")
    first = named.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= slots + 1)
    # what the first counter left out holds goes off all others of its key
    over = Window.partitionBy(*keys)
    left = F.coalesce(F.max(F.when(F.col("__rank") == slots + 1, F.col("cnt"))).over(over), F.lit(0).cast("long"))
    cut = first.withColumn("__cut", left)
    kept = cut.where((F.col("__rank") <= slots) & (F.col("cnt") > F.col("__cut"))).select(
        *keys, "item", (F.col("cnt") - F.col("__cut")).alias("cnt"), "last_ts"
    )
    none = F.lit(None).cast("string").alias("item")
    added = cut.where("__rank = 1").select(*keys, none, F.col("__cut").alias("cnt"), "last_ts")
    errors = counts.where("item is null").select(*keys, none, "cnt", "last_ts").unionByName(added)
    total = errors.groupBy(*keys, "item").agg(F.sum("cnt").alias("cnt"), F.max("last_ts").alias("last_ts"))
    return kept.unionByName(total)


def counter_merge(counters: DataFrame, keys: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """Add counters over everything that is not in ``keys`` and cut them again."""
    added = counters.groupBy(*keys, "item").agg(F.sum("cnt").alias("cnt"), F.max("last_ts").alias("last_ts"))
    return counter_cut(added, keys, slots)


def counter_bounds(counters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items with the least and the most they can have been counted: ``item, low, high``."""
    errors = counters.where("item is null").select(*keys, F.col("cnt").alias("error"))
    items = counters.where("item is not null").select(*keys, "item", F.col("cnt").alias("low"))
    return join_groups(items, errors, keys).select(
        *keys, "item", "low", (F.col("low") + F.col("error")).alias("high"), "error"
    )


def bounded_partial(events: DataFrame, keys: Sequence[str], item: str, tracked: int) -> DataFrame:
    """Bounded-memory heavy-hitter state: at most ``tracked`` items per key."""
    return events.groupBy(*keys).agg(F.expr(f"approx_top_k_accumulate({item}, {tracked})").alias("state"))


def bounded_merge(states: DataFrame, keys: Sequence[str], tracked: int) -> DataFrame:
    return states.groupBy(*keys).agg(F.expr(f"approx_top_k_combine(state, {tracked})").alias("state"))


def bounded_top(states: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Items and counts of a bounded state; the order of ties is not fixed."""
    found = F.explode(F.expr(f"approx_top_k_estimate(state, {k})")).alias("x")
    return states.select(*keys, found).select(*keys, "x.item", F.col("x.count").alias("cnt"))
