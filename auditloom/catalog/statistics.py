"""Quantiles, moments, plain monoids: D33 to D48 of the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.catalog.common import AUDIT, DAY, RANKED_VALUES, at_window, labelled, tidy_sql
from auditloom.catalog.distincts import _IN_SPAN, _span
from auditloom.catalog.registry import query
from auditloom.functions.buckets import bucket_label, bucket_start
from auditloom.functions.numbers import tidy
from auditloom.operators import moments, plain
from auditloom.operators.heavy import topk_rollup
from auditloom.operators.mergeable import kll
from auditloom.operators.quantiles import (
    exact_percentiles, kll_rollup, merge_kll, percentiles, within_rank_error,
)
from auditloom.operators.rollup import coarsen, in_range
from auditloom.session import materialize, measured, run_dir
from auditloom.sources.store import RollupStore
from auditloom.sources.tables import audit_events

DAILY = ["system", "bucket_start"]


def _timed(spark: SparkSession, d: str, window: str = "1d") -> DataFrame:
    return audit_events(spark, d).select(
        "event_id", "ts", "system", "latency_ms", bucket_start(F.col("ts"), window).alias("bucket_start")
    )


def _daily_kll(spark: SparkSession, d: str) -> DataFrame:
    return coarsen(kll(), kll_rollup(audit_events(spark, d), "1h"), "1d")


@query(
    "d33_quantile_add",
    f"""with {AUDIT} select system, {DAY} as bucket, count(latency_ms) as n, quantile_disc(latency_ms, 0.5) as exact,
      true as within_bound from audit group by all""",
)
def d33(spark: SparkSession, d: str) -> DataFrame:
    direct = kll_rollup(audit_events(spark, d), "1d")
    checked = within_rank_error(_timed(spark, d), DAILY, "latency_ms", [50], percentiles(direct, DAILY, [50]))
    return labelled(checked.join(direct.select(*DAILY, "n"), DAILY).drop("p"), "1d")


@query(
    "d34_percentile",
    f"""with {AUDIT} select system, {DAY} as bucket, {tidy_sql('quantile_cont(latency_ms, 0.95)', 4)} as p95_cont,
      quantile_disc(latency_ms, 0.95) as p95_disc from audit group by all""",
)
def d34(spark: SparkSession, d: str) -> DataFrame:
    rows = _timed(spark, d)
    cont = exact_percentiles(rows, DAILY, "latency_ms", [95], "cont")
    disc = exact_percentiles(rows, DAILY, "latency_ms", [95], "disc")
    both = cont.select(*DAILY, tidy(F.col("value"), 4).alias("p95_cont")).join(
        disc.select(*DAILY, F.col("value").alias("p95_disc")), DAILY
    )
    return labelled(both, "1d")


@query(
    "d35_percentiles",
    f"""with {AUDIT} select system, {DAY} as bucket, p, {tidy_sql('v', 4)} as value from (
      select system, date_trunc('day', ts) as ts, unnest([50.0::double, 95.0::double, 99.0::double]) as p,
        unnest(quantile_cont(latency_ms, [0.5, 0.95, 0.99])) as v from audit group by 1, 2)""",
)
def d35(spark: SparkSession, d: str) -> DataFrame:
    found = exact_percentiles(_timed(spark, d), DAILY, "latency_ms", [50, 95, 99], "cont")
    return labelled(found.withColumn("value", tidy(F.col("value"), 4)), "1d")


@query(
    "d35_percentiles_by_endpoint",
    f"""with {AUDIT} select endpoint, p, {tidy_sql('v', 4)} as value from (
      select endpoint, unnest([50.0::double, 95.0::double, 99.0::double]) as p,
        unnest(quantile_cont(latency_ms, [0.5, 0.95, 0.99])) as v from audit group by 1)""",
)
def d35_by_endpoint(spark: SparkSession, d: str) -> DataFrame:
    """Most events have no endpoint: null is a group too, and the largest."""
    found = exact_percentiles(audit_events(spark, d), ["endpoint"], "latency_ms", [50, 95, 99], "cont")
    return found.withColumn("value", tidy(F.col("value"), 4))


@query(
    "d36_quantile_merge_range",
    f"""with {AUDIT}, c as (select system, quantile_disc(latency_ms, [0.5, 0.95, 0.99]) as q from audit where {_IN_SPAN} group by 1)
    select system, unnest([50.0::double, 95.0::double, 99.0::double]) as p, unnest(q) as exact, true as within_bound from c""",
)
def d36(spark: SparkSession, d: str) -> DataFrame:
    low, high = _span(spark, d)
    hourly = in_range(kll_rollup(audit_events(spark, d), "1h"), "1h", low, high)
    sketch = percentiles(merge_kll(hourly, ["system"]), ["system"], [50, 95, 99])
    rows = in_range(_timed(spark, d, "1h"), "1h", low, high)
    return within_rank_error(rows, ["system"], "latency_ms", [50, 95, 99], sketch)


# ---- moments ---------------------------------------------------------------------------
def _central_sql(keys: str, bucket: str) -> str:
    """SQL rows of central moment sums per key, the plain two-pass way."""
    return f"""m as (select {keys}, {bucket} as bucket, avg(latency_ms) as m1 from audit group by all),
    s as (select m.*, count(*) as n, sum((latency_ms - m1)^2) as m2, sum((latency_ms - m1)^3) as m3,
        sum((latency_ms - m1)^4) as m4, min(latency_ms) as lo, max(latency_ms) as hi
      from (select *, {bucket} as bucket from audit) a join m using ({keys}, bucket) group by all)"""


_STATS_SQL = ", ".join(
    f"{tidy_sql(text, places)} as {name}"
    for name, text, places in (
        ("mean", "m1", 6),
        ("var_pop", "case when n >= 2 then m2 / n else 0 end", 6),
        ("var_samp", "case when n >= 2 then m2 / (n - 1) else 0 end", 6),
        ("stddev_pop", "case when n >= 2 then sqrt(m2 / n) else 0 end", 6),
        ("stddev_samp", "case when n >= 2 then sqrt(m2 / (n - 1)) else 0 end", 6),
        ("skewness", "case when n >= 3 and m2 > 0 then sqrt(n) * m3 / power(m2, 1.5) else 0 end", 6),
        ("kurtosis", "case when n >= 4 and m2 > 0 then n * m4 / (m2 * m2) - 3 else 0 end", 6),
    )
)


def _shown(stats: DataFrame, places: int = 6) -> DataFrame:
    names = ("mean", "var_pop", "var_samp", "stddev_pop", "stddev_samp", "skewness", "kurtosis")
    return stats.select(
        *[tidy(F.col(c), places).alias(c) if c in names else c for c in stats.columns]
    )


@query(
    "d37_moments_state",
    f"""with {AUDIT}, {_central_sql('system', DAY)}
    select system, bucket, n, {tidy_sql('m1', 6)} as m1, {tidy_sql('m2 / n', 4)} as m2_per_row,
      {tidy_sql('m3 / n', 2)} as m3_per_row, {tidy_sql('m4 / n', 0)} as m4_per_row, lo, hi from s""",
)
def d37(spark: SparkSession, d: str) -> DataFrame:
    state = moments.partial(_timed(spark, d), DAILY, "latency_ms")
    n = F.col("n")
    return labelled(
        state.select(
            *DAILY, "n", tidy(F.col("m1"), 6).alias("m1"), tidy(F.col("m2") / n, 4).alias("m2_per_row"),
            tidy(F.col("m3") / n, 2).alias("m3_per_row"), tidy(F.col("m4") / n, 0).alias("m4_per_row"), "lo", "hi",
        ),
        "1d",
    )


@query(
    "d38_moments_present",
    f"with {AUDIT}, {_central_sql('system, event_type', DAY)} select system, event_type, bucket, n, {_STATS_SQL}, lo, hi from s",
)
def d38(spark: SparkSession, d: str) -> DataFrame:
    rows = audit_events(spark, d).withColumn("bucket_start", bucket_start(F.col("ts"), "1d"))
    keys = ["system", "event_type", "bucket_start"]
    return labelled(_shown(moments.present(moments.partial(rows, keys, "latency_ms"), keys)), "1d")


@query(
    "d39_moments_merge",
    f"""with {AUDIT}, {_central_sql('system', "'all'")} select system, n, {_STATS_SQL}, lo, hi from s
    union all select 'all systems', n, {_STATS_SQL}, lo, hi from (
      select count(*) as n, any_value(mu) as m1, sum((latency_ms - mu)^2) as m2, sum((latency_ms - mu)^3) as m3,
        sum((latency_ms - mu)^4) as m4, min(latency_ms) as lo, max(latency_ms) as hi
      from audit, (select avg(latency_ms) as mu from audit))""",
)
def d39(spark: SparkSession, d: str) -> DataFrame:
    hourly = materialize(moments.partial(_timed(spark, d, "1h"), DAILY, "latency_ms"), "moments")
    by_system = moments.merge(hourly, ["system"])
    total = moments.merge(by_system, []).withColumn("system", F.lit("all systems"))
    return _shown(moments.present(by_system.unionByName(total), ["system"]))


@query(
    "d39_moments_by_endpoint",
    f"""with {AUDIT}, s as (select endpoint, count(latency_ms) as n, avg(latency_ms) as mean, var_pop(latency_ms) as var_pop,
        min(latency_ms) as lo, max(latency_ms) as hi from audit group by 1)
    select endpoint, n, {tidy_sql('mean', 6)} as mean, {tidy_sql('var_pop', 4)} as var_pop, lo, hi from s""",
)
def d39_by_endpoint(spark: SparkSession, d: str) -> DataFrame:
    rows = audit_events(spark, d).withColumn("bucket_start", bucket_start(F.col("ts"), "1h"))
    hourly = materialize(moments.partial(rows, ["endpoint", "bucket_start"], "latency_ms"), "moments")
    merged = moments.present(moments.merge(hourly, ["endpoint"]), ["endpoint"])
    return merged.select(
        "endpoint", "n", tidy(F.col("mean"), 6).alias("mean"), tidy(F.col("var_pop"), 4).alias("var_pop"), "lo", "hi"
    )


@query(
    "d40_moments_hours_to_day",
    f"with {AUDIT}, {_central_sql('system', DAY)} select system, bucket, n, {_STATS_SQL}, lo, hi from s",
)
def d40(spark: SparkSession, d: str) -> DataFrame:
    hourly = materialize(moments.moments_rollup(audit_events(spark, d), "1h"), "moments")
    return labelled(_shown(moments.present(moments.merge(at_window(hourly, "1d"), DAILY), DAILY)), "1d")


_RUNNING_SQL = f"""c as (select *, latency_ms - avg(latency_ms) over (partition by system) as x,
        avg(latency_ms) over (partition by system) as mu from audit),
    p as (select event_id, system, mu, count(*) over w as n, sum(x) over w as s1, sum(x^2) over w as s2,
        sum(x^3) over w as s3, sum(x^4) over w as s4 from c
      window w as (partition by system order by ts, event_id rows unbounded preceding)),
    q as (select *, s1 / n as a from p),
    s as (select event_id, system, n, mu + a as m1, s2 - n * a^2 as m2, s3 - 3 * a * s2 + 3 * a^2 * s1 - n * a^3 as m3,
        s4 - 4 * a * s3 + 6 * a^2 * s2 - 4 * a^3 * s1 + n * a^4 as m4 from q)"""
_RUNNING_STATS = ", ".join(
    f"{tidy_sql(text, 4)} as {name}"
    for name, text in (
        ("mean", "m1"),
        ("var_pop", "case when n >= 2 then m2 / n else 0 end"),
        ("stddev_pop", "case when n >= 2 then sqrt(m2 / n) else 0 end"),
        ("skewness", "case when n >= 3 and m2 > 0 then sqrt(n) * m3 / power(m2, 1.5) else 0 end"),
        ("kurtosis", "case when n >= 4 and m2 > 0 then n * m4 / (m2 * m2) - 3 else 0 end"),
    )
)


@query(
    "d41_running_statistics",
    f"with {AUDIT}, {_RUNNING_SQL} select event_id, system, n, {_RUNNING_STATS} from s",
)
def d41(spark: SparkSession, d: str) -> DataFrame:
    rows = audit_events(spark, d).select("system", "ts", "event_id", "latency_ms")
    run = moments.running(rows, ["system"], ["ts", "event_id"], "latency_ms")
    names = ("mean", "var_pop", "stddev_pop", "skewness", "kurtosis")
    return run.select("event_id", "system", "n", *[tidy(F.col(c), 4).alias(c) for c in names])


@query(
    "d42_two_sigma_band",
    f"""with {AUDIT}, b as (select system, avg(latency_ms) - 2 * stddev_pop(latency_ms) as low,
        avg(latency_ms) + 2 * stddev_pop(latency_ms) as high from audit group by 1)
    select a.system, {tidy_sql('low', 6)} as low, {tidy_sql('high', 6)} as high,
      count(*) filter (where latency_ms not between low and high) as outside
    from audit a join b on b.system = a.system group by all""",
)
def d42(spark: SparkSession, d: str) -> DataFrame:
    hourly = materialize(moments.partial(_timed(spark, d, "1h"), DAILY, "latency_ms"), "moments")
    bands = measured(moments.band(moments.merge(hourly, ["system"]), ["system"], 2.0), "bands")
    judged = audit_events(spark, d).select("system", "latency_ms").join(bands, "system")
    return judged.groupBy(
        "system", tidy(F.col("low"), 6).alias("low"), tidy(F.col("high"), 6).alias("high")
    ).agg(F.count_if(~F.col("latency_ms").between(F.col("low"), F.col("high"))).alias("outside"))


# ---- plain monoids -----------------------------------------------------------------------
_RARE = "case when event_type = 'custom' then latency_ms end"


@query(
    "d43_sum_product_max_min",
    f"""with {AUDIT} select system, {DAY} as bucket, {tidy_sql('sum(latency_ms)', 4)} as total,
      {tidy_sql('product(1 + latency_ms / 1e6)', 8)} as product, max(latency_ms) as largest, min(latency_ms) as smallest,
      cast(0 as double) as empty_sum, cast(1 as double) as empty_product, true as empty_max_is_low, true as empty_min_is_high
    from audit group by all""",
)
def d43(spark: SparkSession, d: str) -> DataFrame:
    rows = audit_events(spark, d).withColumn("bucket_start", bucket_start(F.col("ts"), "1d"))
    # no event has this type: the group is there, its values are not
    none = F.expr(_RARE)
    out = rows.groupBy(*DAILY).agg(
        tidy(plain.total(F.col("latency_ms")), 4).alias("total"),
        tidy(plain.product(1 + F.col("latency_ms") / 1e6), 8).alias("product"),
        plain.largest(F.col("latency_ms")).alias("largest"),
        plain.smallest(F.col("latency_ms")).alias("smallest"),
        plain.total(none).cast("double").alias("empty_sum"),
        plain.product(none).alias("empty_product"),
        (plain.largest(none) == float("-inf")).alias("empty_max_is_low"),
        (plain.smallest(none) == float("inf")).alias("empty_min_is_high"),
    )
    return labelled(out, "1d")


@query(
    "d44_concat_and_union",
    f"""with {AUDIT}, daily as (select system, {DAY} as day, list_sort(list(distinct event_type)) as kinds from audit group by all)
    select system, string_agg(day, ',' order by day) as days, cast(sum(len(kinds)) as bigint) as list_length,
      (select string_agg(k, ',' order by k) from (select distinct unnest(kinds) as k from daily x where x.system = d.system)) as kinds
    from daily d group by system""",
)
def d44(spark: SparkSession, d: str) -> DataFrame:
    rows = audit_events(spark, d).withColumn("bucket_start", bucket_start(F.col("ts"), "1d"))
    # per day the set is bounded by the event types, per system by the calendar
    daily = rows.groupBy(*DAILY).agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))
    day = bucket_label(F.col("bucket_start"), "1d")
    return daily.groupBy("system").agg(
        plain.joined_text(day, F.col("bucket_start"), ",").alias("days"),
        F.size(plain.joined_lists(F.col("kinds"), F.col("bucket_start"))).cast("long").alias("list_length"),
        F.array_join(plain.merged_set(F.col("kinds")), ",").alias("kinds"),
    )


@query(
    "d44_list_chunks",
    f"""with {AUDIT}, r as (select system, event_id, row_number() over (partition by system order by ts, event_id) - 1 as pos from audit),
      u as (select system, user_id, row_number() over (partition by system order by user_id) - 1 as pos
        from (select distinct system, user_id from audit))
    select 'list' as kind, system, pos // 100 as chunk, count(*) as n, md5(string_agg(cast(event_id as varchar), ',' order by pos)) as items from r group by all
    union all select 'set', system, pos // 50, count(*), md5(string_agg(user_id, ',' order by pos)) from u group by all""",
)
def d44_chunks(spark: SparkSession, d: str) -> DataFrame:
    """All events of a system in order, and all its users, as lists of bounded length."""
    rows = audit_events(spark, d).withColumn("id", F.col("event_id").cast("string"))
    lists = plain.list_chunks(rows, ["system"], "id", ["ts", "event_id"], 100)
    sets = plain.set_chunks(rows, ["system"], "user_id", 50)
    shown = [F.size("items").cast("long").alias("n"), F.md5(F.array_join("items", ",")).alias("items")]
    return lists.select(F.lit("list").alias("kind"), "system", "chunk", *shown).unionByName(
        sets.select(F.lit("set").alias("kind"), "system", "chunk", *shown)
    )


@query(
    "d45_sum_option",
    f"""with {AUDIT} select system, {DAY} as bucket, cast(sum(cast(status_code as integer)) as bigint) as codes,
      sum({_RARE}) as none from audit group by all""",
)
def d45(spark: SparkSession, d: str) -> DataFrame:
    rows = audit_events(spark, d).withColumn("bucket_start", bucket_start(F.col("ts"), "1d"))
    # aggregates skip nulls, and give null if there is nothing else
    out = rows.groupBy(*DAILY).agg(
        F.sum(F.col("status_code").cast("int")).alias("codes"), F.sum(F.expr(_RARE)).alias("none")
    )
    return labelled(out, "1d")


@query(
    "d46_sum_nonempty",
    f"""with {AUDIT} select system, user_id, max(endpoint) as last_endpoint, min(endpoint) as first_endpoint
    from audit group by all""",
)
def d46(spark: SparkSession, d: str) -> DataFrame:
    # texts are compared by sorting; few are left once repetitions are gone
    rows = audit_events(spark, d).select("system", "user_id", "endpoint").distinct()
    return rows.groupBy("system", "user_id").agg(
        F.max("endpoint").alias("last_endpoint"), F.min("endpoint").alias("first_endpoint")
    )


@query(
    "d47_merge_maps",
    f"""with {AUDIT}, c as (select system, {DAY} as bucket, event_type, count(*) as n from audit group by all)
    select system, bucket, string_agg(event_type || '=' || n, ';' order by event_type) as counts from c group by all""",
)
def d47(spark: SparkSession, d: str) -> DataFrame:
    timed = audit_events(spark, d).withColumn("bucket_start", bucket_start(F.col("ts"), "1h"))
    counts = timed.groupBy(*DAILY, "event_type").agg(F.count(F.lit(1)).alias("n"))
    # one map per hour, bounded by the event types
    hourly = counts.groupBy(*DAILY).agg(
        F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("counts")
    )
    daily = plain.merge_maps(at_window(hourly, "1d"), DAILY, "counts", "sum")
    text = F.array_join(
        F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";"
    )
    return labelled(daily.select(*DAILY, text.alias("counts")), "1d")


@query(
    "d48_incremental_accumulator",
    f"""with {AUDIT}, {RANKED_VALUES}
    select metric, system, {DAY} as bucket, value as item, count(*) as cnt from vals group by all""",
)
def d48(spark: SparkSession, d: str) -> DataFrame:
    store = RollupStore(spark, run_dir(spark, "accumulator"))
    events = audit_events(spark, d)
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    middle = F.lit(low + (high - low) / 2)
    # what is there, then what came since; in between everything is compacted
    store.write("topk", topk_rollup(events.where(F.col("ts") < middle), "1d"), 0)
    store.compact("topk")
    store.write("topk", topk_rollup(events.where(F.col("ts") >= middle), "1d"), 1)
    merged = store.merged("topk", "1d").select("metric", "system", "bucket_start", "item", "cnt")
    return labelled(merged, "1d")
