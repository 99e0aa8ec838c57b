"""Roll-up patterns over rollup tables of any mergeable aggregate."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.buckets import bucket_start, shift_back
from auditloom.functions.joins import join_groups
from auditloom.operators.mergeable import ExprAgg
from auditloom.schema import window_spec
from auditloom.session import measured


def coarsen(agg: ExprAgg, rollup: DataFrame, window: str) -> DataFrame:
    """Longer windows from shorter ones: hours to days, days to weeks or months."""
    moved = rollup.withColumn("bucket_start", bucket_start(F.col("bucket_start"), window))
    return agg.merge(moved, ["metric", "system", "bucket_start"]).withColumn("window", F.lit(window))


def in_range(rollup: DataFrame, window: str, start: datetime, end: datetime) -> DataFrame:
    """Buckets from the one holding ``start`` to the one holding ``end``, both included."""
    first = bucket_start(F.lit(start).cast("timestamp"), window)
    last = bucket_start(F.lit(end).cast("timestamp"), window)
    return rollup.where(F.col("bucket_start").between(first, last))


def last_existing(rollup: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Rows of the ``n`` newest buckets that exist per key; none for ``n`` below 1.

    Only the distinct buckets are ranked, of which the calendar allows few per key;
    the rows themselves just meet the result.
    """
    on = [*keys, "bucket_start"]
    newest = Window.partitionBy(*keys).orderBy(F.desc("bucket_start"))
    ranked = rollup.select(*on).distinct().withColumn("_age", F.row_number().over(newest))
    wanted = measured(ranked.where(F.col("_age") <= n).select(*on), "newest")
    return join_groups(rollup, wanted, on, "left_semi")


def last_calendar(rollup: DataFrame, window: str, end: Column, n: int) -> DataFrame:
    """Rows of the ``n`` calendar buckets ending with the one that holds ``end``."""
    last = bucket_start(end, window)
    first = shift_back(last, window, F.lit(n - 1))
    return rollup.where(F.col("bucket_start").between(first, last))


def of_systems(rollup: DataFrame, systems: Sequence[str]) -> DataFrame:
    """Rows of the named systems; names without rows are ignored."""
    return rollup.where(F.col("system").isin(list(systems)))


def of_buckets(rollup: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose bucket is in the wanted list; an empty list gives nothing."""
    buckets = measured(wanted.select("bucket_start").distinct(), "buckets")
    return rollup.join(buckets, "bucket_start", "left_semi")


def with_sources(agg: ExprAgg, partials: DataFrame, keys: Sequence[str], source: str) -> DataFrame:
    """Merge partial states and tell from how many sources they came.

    Which ones is a table of its own, :func:`source_names`: a merge may have any number.
    """
    merged = [F.expr(text).alias(name) for name, text in agg.merge_exprs]
    counted = partials.select(*keys, source).distinct().groupBy(*keys).agg(F.count(source).alias("source_count"))
    return join_groups(partials.groupBy(*keys).agg(*merged), counted, keys)


def source_names(partials: DataFrame, keys: Sequence[str], source: str) -> DataFrame:
    """The sources that took part in a merge, one row each."""
    return partials.where(F.col(source).isNotNull()).select(*keys, source).distinct()


def bucket_number(start: Column, window: str) -> Column:
    """Buckets counted by the calendar: neighbours differ by one."""
    if window == "1M":
        return F.year(start) * F.lit(12).cast("long") + F.month(start)
    return F.floor(F.unix_seconds(start) / F.lit(window_spec(window).duration_s)).cast("long")


def rolling_distinct(rollup: DataFrame, window: str, n: int) -> DataFrame:
    """Distinct count over the ``n`` buckets up to each bucket, by the calendar.

    ``rollup`` has one row per key and bucket. The calendar is cut into chunks of ``n``
    buckets, so a look-back touches the end of one chunk and the beginning of the next.
    In every chunk the sketches are united forward from its beginning and backward from
    its end, each row taken once; an answer is one forward and one backward union. A chunk
    is a window group of its own, so a long history is spread over as many tasks as it has
    chunks.
    """
    key = ["metric", "system"]
    at = bucket_number(F.col("bucket_start"), window)
    rows = rollup.select(
        *key, "bucket_start", at.alias("at"), "sketch", F.lit(0).alias("ask")
    )
    # a bucket asks the chunk before its own for what is united from here to the chunk's end
    first = F.col("at") - (n - 1)
    asks = rows.where(first % n != 0).select(
        *key, "bucket_start", first.alias("at"), F.lit(None).cast("binary").alias("sketch"), F.lit(1).alias("ask")
    )
    both = rows.unionByName(asks).withColumn("chunk", F.floor(F.col("at") / n).cast("long"))
    chunk = Window.partitionBy(*key, "chunk")
    growing = (Window.unboundedPreceding, Window.currentRow)
    united = F.hll_union_agg("sketch", F.lit(False))
    parts = both.select(
        *key, "bucket_start", "ask",
        F.when(F.col("ask") == 0, united.over(chunk.orderBy("at", "ask").rowsBetween(*growing))).alias("forward"),
        F.when(F.col("ask") == 1, united.over(chunk.orderBy(F.desc("at"), "ask").rowsBetween(*growing))).alias("backward"),
        F.count("sketch").over(chunk.orderBy(F.desc("at"), "ask").rowsBetween(*growing)).alias("united"),
    ).where("ask = 0 or united > 0")
    halves = parts.select(*key, "bucket_start", F.coalesce("forward", "backward").alias("sketch"))
    return halves.groupBy(*key, "bucket_start").agg(F.hll_sketch_estimate(united).alias("estimate"))


def exact_rolling_distinct(values: DataFrame, window: str, n: int) -> DataFrame:
    """Exact form of :func:`rolling_distinct`, without copying rows into every window.

    An occurrence counts from its bucket until it leaves the look-back or the value
    occurs again, so it adds one at the first and takes one away at the second. The
    running total of these changes is the number of values in sight.
    """
    key, step = ["metric", "system", "bucket_start"], window_spec(window).duration_s
    again = F.lead("bucket_start").over(
        Window.partitionBy("metric", "system", "value").orderBy("bucket_start")
    )
    gone = F.timestamp_seconds(F.unix_seconds("bucket_start") + F.lit(n * step))
    spans = values.select(*key, "value").distinct().select(
        *key, F.least(gone, F.coalesce(again, gone)).alias("until")
    )
    changes = spans.select(
        "metric", "system", F.expr("stack(2, bucket_start, 1L, until, -1L) as (bucket_start, change)")
    )
    per_bucket = changes.groupBy(*key).agg(F.sum("change").alias("change"))
    so_far = (
        Window.partitionBy("metric", "system")
        .orderBy("bucket_start")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    totals = per_bucket.select(*key, F.sum("change").over(so_far).alias("exact"))
    return join_groups(totals, values.select(*key).distinct(), key, "left_semi")

