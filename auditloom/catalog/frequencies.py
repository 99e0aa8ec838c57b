"""Frequencies and heavy hitters: D21 to D32 of the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.catalog.common import AUDIT, DAY, HOUR, RANKED_VALUES, at_window, labelled, tidy_sql
from auditloom.catalog.distincts import _IN_SPAN, _span
from auditloom.catalog.registry import query
from auditloom.functions.buckets import bucket_start
from auditloom.functions.numbers import tidy
from auditloom.operators import countmin, heavy
from auditloom.operators.rollup import in_range
from auditloom.session import materialize
from auditloom.sources.tables import audit_events

_HEAD = f"with {AUDIT}, {RANKED_VALUES}"
_ALL = "counts as (select metric, system, value as item, count(*) as cnt from vals group by all)"
_W, _D = countmin.WIDTH, countmin.DEPTH


def _cells_sql(source: str, keys: str) -> str:
    cell = f"(('0x' || substr(md5(r || ':' || item), 1, 15))::bigint % {_W})"
    return f"""select {keys}, cast(r as integer) as r, {cell} as c, cast(sum(cnt) as bigint) as cnt
      from {source}, range({_D}) as t(r) group by all"""


_CELLS = f"cells as ({_cells_sql('counts', 'metric, system')})"
_EST = f"""est as (select p.metric, p.system, p.item, min(cells.cnt) as est
      from (select metric, system, item, r, (('0x' || substr(md5(r || ':' || item), 1, 15))::bigint % {_W}) as c
        from counts, range({_D}) as t(r)) p
      join cells on cells.metric = p.metric and cells.system = p.system and cells.r = p.r and cells.c = p.c group by all)"""
_TOTAL = "total as (select metric, system, cast(sum(cnt) as bigint) as total from counts group by all)"
KEYS = ["metric", "system"]


def _counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts per metric, system and item over all time, from the hourly roll-up."""
    counts = heavy.merge_counts(heavy.topk_rollup(audit_events(spark, d), "1h"), KEYS)
    return materialize(counts, "counts")


def _cells(counts: DataFrame) -> DataFrame:
    return countmin.build(counts, KEYS, hash="md5")


@query("d21_cms_build", f"{_HEAD}, {_ALL}, {_CELLS} select metric, system, r, c, cnt from cells")
def d21(spark: SparkSession, d: str) -> DataFrame:
    return _cells(_counts(spark, d)).drop("depth", "width")


@query(
    "d22_cms_query",
    f"""{_HEAD}, {_ALL}, {_CELLS}, {_EST}
    select est.metric, est.system, est.item, est, est >= cnt as never_below
    from est join counts on counts.metric = est.metric and counts.system = est.system and counts.item = est.item""",
)
def d22(spark: SparkSession, d: str) -> DataFrame:
    counts = _counts(spark, d)
    answered = countmin.query(counts, _cells(counts), KEYS, hash="md5")
    both = answered.join(counts, [*KEYS, "item"])
    return both.select(*KEYS, "item", "est", (F.col("est") >= F.col("cnt")).alias("never_below"))


@query("d23_cms_merge", f"{_HEAD}, {_ALL}, {_CELLS} select metric, system, r, c, cnt from cells")
def d23(spark: SparkSession, d: str) -> DataFrame:
    daily = heavy.coarsen_counts(heavy.topk_rollup(audit_events(spark, d), "1h"), "1d")
    sketches = countmin.build(daily, [*KEYS, "bucket_start"], hash="md5")
    return countmin.merge(sketches, KEYS).drop("depth", "width")


@query(
    "d24_cms_heavy_cells",
    f"""{_HEAD}, {_ALL}, {_CELLS}, {_TOTAL}, h as (
      select cells.*, cnt / total::double as ratio, row_number() over (partition by cells.metric, cells.system
        order by cnt desc, r, c) as rank
      from cells join total on total.metric = cells.metric and total.system = cells.system where cnt >= 0.01 * total)
    select metric, system, r, c, cnt, {tidy_sql('ratio', 6)} as ratio, cast(rank as integer) as rank from h where rank <= 100""",
)
def d24(spark: SparkSession, d: str) -> DataFrame:
    cells = materialize(_cells(_counts(spark, d)), "cells")
    cells = countmin.heavy_cells(cells, KEYS, 0.01, 100)
    return cells.select(*KEYS, "r", "c", "cnt", tidy(F.col("ratio"), 6).alias("ratio"), "rank")


@query(
    "d25_cms_heavy_items",
    f"""{_HEAD}, {_ALL}, {_CELLS}, {_EST}, {_TOTAL}
    select est.metric, est.system, item, est from est join total on total.metric = est.metric and total.system = est.system
    where est >= 0.01 * total""",
)
def d25(spark: SparkSession, d: str) -> DataFrame:
    counts = _counts(spark, d)
    cells = materialize(_cells(counts), "cells")
    return countmin.heavy_items(counts, cells, KEYS, 0.01, hash="md5").drop("total")


@query(
    "d26_topk_add_weighted",
    f"""with {AUDIT} select system, {DAY} as bucket, user_id as item, cast(sum(floor(latency_ms)) as bigint) as cnt
    from audit group by all""",
)
def d26(spark: SparkSession, d: str) -> DataFrame:
    weighted = audit_events(spark, d).select(
        "system", bucket_start(F.col("ts"), "1d").alias("bucket_start"), F.col("user_id").alias("item"),
        F.floor("latency_ms").cast("long").alias("cnt"),
    )
    return labelled(heavy.merge_counts(weighted, ["system", "bucket_start"]), "1d")


@query(
    "d27_topk_query",
    f"""{_HEAD}, c as (select metric, system, {HOUR} as bucket, value as item, count(*) as cnt from vals group by all)
    select metric, system, bucket, item, cnt, cast(rank as integer) as rank from (
      select *, row_number() over (partition by metric, system, bucket order by cnt desc, item) as rank from c)
    where rank <= 10""",
)
def d27(spark: SparkSession, d: str) -> DataFrame:
    hourly = heavy.topk_rollup(audit_events(spark, d), "1h")
    keys = ["metric", "system", "bucket_start"]
    return labelled(heavy.top_k(hourly.select(*keys, "item", "cnt"), keys, 10), "1h")


@query(
    "d28_topk_merge",
    f"""{_HEAD}, c as (select metric, system, {DAY} as bucket, value as item, count(*) as cnt from vals group by all)
    select metric, system, bucket, item, cnt, cast(rank as integer) as rank from (
      select *, row_number() over (partition by metric, system, bucket order by cnt desc, item) as rank from c)
    where rank <= 10""",
)
def d28(spark: SparkSession, d: str) -> DataFrame:
    # full counts are merged, the cut comes last
    daily = heavy.coarsen_counts(heavy.topk_rollup(audit_events(spark, d), "1h"), "1d")
    keys = ["metric", "system", "bucket_start"]
    return labelled(heavy.top_k(daily.select(*keys, "item", "cnt"), keys, 10), "1d")


@query(
    "d28_topk_bounded_merge",
    f"""with {AUDIT}, c as (select system, event_type as item, count(*) as cnt from audit group by all)
    select system, item, cnt from c""",
)
def d28_bounded(spark: SparkSession, d: str) -> DataFrame:
    # bounded state: event types are few, so the state holds them all and counts are exact
    timed = audit_events(spark, d).withColumn("bucket_start", bucket_start(F.col("ts"), "1d"))
    states = heavy.bounded_partial(timed, ["system", "bucket_start"], "event_type", 1000)
    return heavy.bounded_top(heavy.bounded_merge(states, ["system"], 1000), ["system"], 100)


@query(
    "d29_topk_time_range",
    f"""{_HEAD}, c as (select metric, system, value as item, count(*) as cnt from vals where {_IN_SPAN} group by all)
    select metric, system, item, cnt, cast(rank as integer) as rank from (
      select *, row_number() over (partition by metric, system order by cnt desc, item) as rank from c)
    where rank <= 10""",
)
def d29(spark: SparkSession, d: str) -> DataFrame:
    low, high = _span(spark, d)
    hourly = in_range(heavy.topk_rollup(audit_events(spark, d), "1h"), "1h", low, high)
    return heavy.top_k(heavy.merge_counts(hourly, KEYS), KEYS, 10)


@query(
    "d30_topk_across_systems",
    f"""{_HEAD}, c as (select metric, {DAY} as bucket, value as item, count(*) as cnt from vals group by all)
    select metric, bucket, item, cnt, cast(rank as integer) as rank from (
      select *, row_number() over (partition by metric, bucket order by cnt desc, item) as rank from c)
    where rank <= 10""",
)
def d30(spark: SparkSession, d: str) -> DataFrame:
    keys = ["metric", "bucket_start"]
    hourly = at_window(heavy.topk_rollup(audit_events(spark, d), "1h"), "1d")
    return labelled(heavy.top_k(heavy.merge_counts(hourly, keys), keys, 10), "1d")


@query(
    "d31_topk_item_count",
    f"""with {AUDIT}, c as (select system, date_trunc('hour', ts) as h, user_id, count(*) as cnt from audit group by all)
    select a.event_id, coalesce(c.cnt, 0) as cnt from audit a left join c
      on c.system = a.system and c.user_id = a.user_id and c.h = date_trunc('hour', a.ts) - interval 1 hour""",
)
def d31(spark: SparkSession, d: str) -> DataFrame:
    # for every event: how often was its user seen on its system in the hour before?
    events = audit_events(spark, d)
    before = bucket_start(F.col("ts"), "1h") - F.expr("interval 1 hour")
    asked = events.select("event_id", "system", before.alias("bucket_start"), F.col("user_id").alias("item"))
    counts = heavy.topk_rollup(events, "1h").where("metric = 'active_users'")
    return heavy.count_of(counts, asked, ["system", "bucket_start"]).select("event_id", "cnt")


@query(
    "d32_heavy_hitter_hybrid",
    f"""{_HEAD}, {_ALL}, {_CELLS}, {_EST}, r as (
      select *, row_number() over (partition by metric, system order by cnt desc, item) as rank from counts)
    select est.metric, est.system, est.item, case when rank <= 10 then cnt else est end as cnt,
      case when rank <= 10 then 'exact' else 'estimate' end as source
    from est join r on r.metric = est.metric and r.system = est.system and r.item = est.item""",
)
def d32(spark: SparkSession, d: str) -> DataFrame:
    counts = _counts(spark, d)
    return countmin.hybrid(counts, counts, _cells(counts), KEYS, 10, hash="md5")
