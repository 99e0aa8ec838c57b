"""Roll-up patterns, windows, sorts, sets, scalars, extension points: D49 to J02."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.catalog.common import (
    AUDIT, DAY, DISTINCT_VALUES, HOUR, MEMBER_VALUES, MONTH, RANKED_VALUES, STAMP, WEEK, at_window,
    hourly_values, labelled, stamp, stored_values, tidy_sql,
)
from auditloom.catalog.distincts import BOUND, _check
from auditloom.catalog.registry import query
from auditloom.catalog.statistics import _RUNNING_SQL, _RUNNING_STATS
from auditloom.functions.buckets import bucket_label, bucket_start
from auditloom.functions.hashing import seeded_bucket
from auditloom.functions.numbers import percentile_label_col, tidy
from auditloom.operators import heavy, members, moments, plain, rollup
from auditloom.operators.distinct import (
    LG_K, checked, exact_distinct, hll_rollup, merge_hll,
)
from auditloom.operators.mergeable import ExprAgg, PythonAgg, hll
from auditloom.operators.routing import MetricRule, value_counts
from auditloom.sources.records import newest, parse_timestamp
from auditloom.sources.tables import audit_events, latest_ts, with_metadata
from auditloom.session import materialize, tune

_HEAD = f"with {AUDIT}, {DISTINCT_VALUES}"
KEY = ["metric", "system", "bucket_start"]


@query(
    "d49_aggregate_windows",
    f"""{_HEAD} select metric, system, 'all' as chosen, count(distinct value) as exact, true as within_bound from vals group by all
    union all select metric, system, 'mondays', count(distinct value), true from vals where isodow(ts) = 1 group by all""",
)
def d49(spark: SparkSession, d: str) -> DataFrame:
    daily = materialize(rollup.coarsen(hll(), hll_rollup(audit_events(spark, d), "1h"), "1d"), "sketches")
    base = at_window(stored_values(spark, d, "hll"), "1d")
    mondays = base.select("bucket_start").distinct().where(F.weekday("bucket_start") == 0)
    keys = ["metric", "system"]
    whole = _check(merge_hll(daily, keys), exact_distinct(base, keys), keys)
    part = _check(
        merge_hll(rollup.of_buckets(daily, mondays), keys),
        exact_distinct(rollup.of_buckets(base, mondays), keys),
        keys,
    )
    return whole.withColumn("chosen", F.lit("all")).unionByName(part.withColumn("chosen", F.lit("mondays")))


@query(
    "d50_last_n_windows",
    f"""{_HEAD}, b as (select metric, system, date_trunc('hour', ts) as h, value,
        dense_rank() over (partition by metric, system order by date_trunc('hour', ts) desc) as age from vals)
    select metric, system, 'existing' as variant, count(distinct value) as exact, true as within_bound from b where age <= 24 group by all
    union all
    select metric, system, 'calendar', count(distinct value), true from b
    where h > (select date_trunc('hour', max(ts)) - interval 24 hour from audit) group by all""",
)
def d50(spark: SparkSession, d: str) -> DataFrame:
    events = audit_events(spark, d)
    end = F.lit(latest_ts(events))
    sketch = materialize(hll_rollup(events, "1h"), "sketches")
    base = stored_values(spark, d, "hll")
    keys = ["metric", "system"]

    def variant(name: str, cut) -> DataFrame:
        return _check(merge_hll(cut(sketch), keys), exact_distinct(cut(base), keys), keys).withColumn(
            "variant", F.lit(name)
        )

    existing = variant("existing", lambda rows: rollup.last_existing(rows, keys, 24))
    calendar = variant("calendar", lambda rows: rollup.last_calendar(rows, "1h", end, 24))
    return existing.unionByName(calendar)


def _coarser(spark: SparkSession, d: str, window: str) -> DataFrame:
    sketch = rollup.coarsen(hll(), hll_rollup(audit_events(spark, d), "1h"), "1d")
    if window != "1d":
        sketch = rollup.coarsen(hll(), sketch, window)
    exact = exact_distinct(at_window(hourly_values(spark, d, "hll"), window), KEY)
    return labelled(_check(sketch, exact, KEY), window)


@query(
    "d51_hourly_to_daily",
    f"{_HEAD} select metric, system, {DAY} as bucket, count(distinct value) as exact, true as within_bound from vals group by all",
)
def d51(spark: SparkSession, d: str) -> DataFrame:
    return _coarser(spark, d, "1d")


@query(
    "d52_daily_to_weekly",
    f"{_HEAD} select metric, system, {WEEK} as bucket, count(distinct value) as exact, true as within_bound from vals group by all",
)
def d52(spark: SparkSession, d: str) -> DataFrame:
    return _coarser(spark, d, "1w")


@query(
    "d52_daily_to_monthly",
    f"{_HEAD} select metric, system, {MONTH} as bucket, count(distinct value) as exact, true as within_bound from vals group by all",
)
def d52_month(spark: SparkSession, d: str) -> DataFrame:
    return _coarser(spark, d, "1M")


@query(
    "d53_aggregate_systems",
    f"""{_HEAD} select metric, {DAY} as bucket, 'all' as chosen, count(distinct value) as exact, true as within_bound from vals group by all
    union all select metric, {DAY}, 'databases', count(distinct value), true from vals
    where system in ('production_db', 'staging_db') group by all""",
)
def d53(spark: SparkSession, d: str) -> DataFrame:
    daily = materialize(rollup.coarsen(hll(), hll_rollup(audit_events(spark, d), "1h"), "1d"), "sketches")
    base = at_window(stored_values(spark, d, "hll"), "1d")
    keys = ["metric", "bucket_start"]
    whole = _check(merge_hll(daily, keys), exact_distinct(base, keys), keys)
    names = ["production_db", "staging_db"]
    part = _check(
        merge_hll(rollup.of_systems(daily, names), keys),
        exact_distinct(rollup.of_systems(base, names), keys), keys,
    )
    both = whole.withColumn("chosen", F.lit("all")).unionByName(part.withColumn("chosen", F.lit("databases")))
    return labelled(both, "1d")


@query(
    "d54_merge_workers",
    f"""with {AUDIT} select system, count(distinct user_id) as exact, true as within_bound,
      count(distinct event_id % 8) as source_count,
      (select string_agg(w, ',' order by w) from (select distinct 'w' || event_id % 8 as w from audit x where x.system = a.system)) as sources
    from audit a group by system""",
)
def d54(spark: SparkSession, d: str) -> DataFrame:
    # eight workers, each with a sketch of the events it was sent
    shared = audit_events(spark, d).withColumn(
        "worker", F.concat(F.lit("w"), (F.col("event_id") % 8).cast("string"))
    )
    partials = materialize(hll("user_id", LG_K).partial(shared, ["system", "worker"]), "partials")
    merged = rollup.with_sources(hll(lg_k=LG_K), partials, ["system"], "worker")
    exact = shared.groupBy("system").agg(F.count_distinct("user_id").alias("exact"))
    result = _check(merged, exact, ["system"])
    names = rollup.source_names(partials, ["system"], "worker").groupBy("system").agg(  # eight at most
        plain.joined_text(F.col("worker"), F.col("worker"), ",").alias("sources")
    )
    return result.join(merged.select("system", "source_count"), "system").join(names, "system")


@query(
    "d55_composite_cube",
    f"""{_HEAD}, v as (select metric, system, {DAY} as bucket, value from vals)
    select metric, coalesce(system, '*') as system, coalesce(bucket, '*') as bucket,
      cast(grouping(system) * 2 + grouping(bucket) as bigint) as level, count(distinct value) as exact, true as within_bound
    from v group by grouping sets ((metric), (metric, system), (metric, bucket), (metric, system, bucket))""",
)
def d55(spark: SparkSession, d: str) -> DataFrame:
    sets = [["metric"], ["metric", "system"], ["metric", "bucket_start"], ["metric", "system", "bucket_start"]]
    daily = rollup.coarsen(hll(), hll_rollup(audit_events(spark, d), "1h"), "1d")
    cube = hll(lg_k=LG_K).cube(daily, sets)
    base = at_window(hourly_values(spark, d, "hll"), "1d")
    exact = base.groupingSets([[F.col(c) for c in s] for s in sets], *KEY).agg(
        F.grouping_id().alias("level"), F.count_distinct("value").alias("exact")
    )

    def named(df: DataFrame) -> DataFrame:
        label = F.coalesce(bucket_label(F.col("bucket_start"), "1d"), F.lit("*"))
        return df.withColumn("system", F.coalesce("system", F.lit("*"))).withColumn("bucket", label)

    keys = ["metric", "system", "bucket", "level"]
    estimates = named(cube).withColumn("estimate", F.hll_sketch_estimate("sketch"))
    return checked(estimates, named(exact), keys, BOUND)


# ---- window functions ---------------------------------------------------------------------
@query(
    "e01_rolling_distinct",
    f"""{_HEAD}, v as (select distinct metric, system, date_trunc('hour', ts) as h, value from vals),
    h as (select distinct metric, system, h from v)
    select h.metric, h.system, strftime(h.h, '%Y-%m-%dT%H:00:00') as bucket, count(distinct value) as exact, true as within_bound
    from h join v on v.metric = h.metric and v.system = h.system and v.h between h.h - interval 23 hour and h.h
    group by all""",
)
def e01(spark: SparkSession, d: str) -> DataFrame:
    sketch = rollup.rolling_distinct(hll_rollup(audit_events(spark, d), "1h"), "1h", 24)
    exact = rollup.exact_rolling_distinct(stored_values(spark, d, "hll"), "1h", 24)
    return labelled(checked(sketch, exact, KEY, BOUND), "1h")


@query(
    "e02_rank_within_key",
    f"""with {AUDIT}, {RANKED_VALUES}, c as (select metric, system, value as item, count(*) as cnt from vals group by all)
    select metric, system, item, cnt, cast(rank as integer) as rank from (
      select *, row_number() over (partition by metric, system order by cnt desc, item) as rank from c) where rank <= 100""",
)
def e02(spark: SparkSession, d: str) -> DataFrame:
    counts = heavy.merge_counts(heavy.topk_rollup(audit_events(spark, d), "1h"), ["metric", "system"])
    return heavy.top_k(counts, ["metric", "system"], 100)


@query(
    "e03_running_moments",
    f"with {AUDIT}, {_RUNNING_SQL.replace('partition by system', 'partition by system, event_type')} select event_id, n, {_RUNNING_STATS} from s",
)
def e03(spark: SparkSession, d: str) -> DataFrame:
    rows = audit_events(spark, d).select("system", "event_type", "ts", "event_id", "latency_ms")
    run = moments.running(rows, ["system", "event_type"], ["ts", "event_id"], "latency_ms")
    names = ("mean", "var_pop", "stddev_pop", "skewness", "kurtosis")
    return run.select("event_id", "n", *[tidy(F.col(c), 4).alias(c) for c in names])


@query(
    "e03_running_by_endpoint",
    f"with {AUDIT}, {_RUNNING_SQL.replace('partition by system', 'partition by endpoint')} select event_id, n, {_RUNNING_STATS} from s",
)
def e03_by_endpoint(spark: SparkSession, d: str) -> DataFrame:
    rows = audit_events(spark, d).select("endpoint", "ts", "event_id", "latency_ms")
    run = moments.running(rows, ["endpoint"], ["ts", "event_id"], "latency_ms")
    names = ("mean", "var_pop", "stddev_pop", "skewness", "kurtosis")
    return run.select("event_id", "n", *[tidy(F.col(c), 4).alias(c) for c in names])


@query(
    "e04_most_recent_buckets",
    f"""with {AUDIT}, {RANKED_VALUES}, b as (select metric, system, {HOUR} as bucket, count(*) as cnt from vals group by all)
    select metric, system, bucket, cnt from b
    qualify dense_rank() over (partition by metric, system order by bucket desc) <= 5""",
)
def e04(spark: SparkSession, d: str) -> DataFrame:
    hourly = heavy.topk_rollup(audit_events(spark, d), "1h").groupBy(*KEY).agg(F.sum("cnt").alias("cnt"))
    hourly = materialize(hourly, "hourly")
    return labelled(rollup.last_existing(hourly, ["metric", "system"], 5), "1h")


# ---- sorts, limits, sets --------------------------------------------------------------------
@query(
    "f01_sort_and_cut",
    f"""with {AUDIT}, c as (select user_id as item, count(*) as cnt from audit group by 1)
    select item, cnt, cast(row_number() over (order by cnt desc, item) as integer) as rank from c order by cnt desc, item limit 10""",
)
def f01(spark: SparkSession, d: str) -> DataFrame:
    counts = heavy.topk_rollup(audit_events(spark, d), "1h").where("metric = 'active_users'")
    return heavy.top_k(heavy.merge_counts(counts, []), [], 10)


@query(
    "f02_sort_buckets",
    f"with {AUDIT} select {HOUR} as bucket, count(*) as n from audit group by 1 order by 1 desc",
)
def f02(spark: SparkSession, d: str) -> DataFrame:
    hours = audit_events(spark, d).groupBy(bucket_start(F.col("ts"), "1h").alias("bucket_start")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return labelled(hours, "1h").orderBy(F.desc("bucket"))


@query(
    "f03_newest_events",
    f"""with {AUDIT}
    select event_id, {STAMP} as ts, event_type, system, user_id from audit
    where event_type = 'security_event' order by audit.ts desc, event_id desc limit 50""",
)
def f03(spark: SparkSession, d: str) -> DataFrame:
    alarms = audit_events(spark, d).where("event_type = 'security_event'")
    return newest(alarms, 50).select("event_id", stamp().alias("ts"), "event_type", "system", "user_id")


@query(
    "g01_union_of_members",
    f"""with {AUDIT}, {MEMBER_VALUES} select distinct metric, {DAY} as bucket, split_part(value, ':', 1) as value from vals""",
)
def g01(spark: SparkSession, d: str) -> DataFrame:
    daily = at_window(members.member_rollup(audit_events(spark, d)), "1d")
    users = daily.withColumn("value", F.element_at(F.split("value", ":"), 1))
    return labelled(members.in_any(users, ["metric", "bucket_start"]), "1d")


@query(
    "g02_intersection_of_members",
    f"""with {AUDIT}, {MEMBER_VALUES} select metric, {DAY} as bucket, split_part(value, ':', 1) as value
    from vals group by all having count(distinct system) = 3""",
)
def g02(spark: SparkSession, d: str) -> DataFrame:
    daily = at_window(members.member_rollup(audit_events(spark, d)), "1d")
    users = daily.withColumn("value", F.element_at(F.split("value", ":"), 1))
    return labelled(members.in_all(users, "system", ["metric", "bucket_start"]), "1d")


# ---- scalar functions -------------------------------------------------------------------------
@query(
    "h01_bucket_labels",
    """select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:00:00') as hour, strftime(o_orderdate, '%Y-%m-%d') as day,
      strftime(o_orderdate, '%G-W%V') as week, strftime(o_orderdate, '%Y-%m') as month from orders""",
)
def h01(spark: SparkSession, d: str) -> DataFrame:
    # order dates span years, so every edge of the ISO calendar is met
    orders = tune(spark).read.schema("o_orderkey long, o_orderdate timestamp").parquet(f"{d}/orders.parquet")
    names = {"1h": "hour", "1d": "day", "1w": "week", "1M": "month"}
    ts = F.col("o_orderdate")
    return orders.select(
        "o_orderkey", *[bucket_label(bucket_start(ts, w), w).alias(n) for w, n in names.items()]
    )


@query("h02_concat", f"with {AUDIT} select event_id, user_id || ':' || system as member from audit")
def h02(spark: SparkSession, d: str) -> DataFrame:
    return audit_events(spark, d).select("event_id", F.concat_ws(":", "user_id", "system").alias("member"))


@query(
    "h03_seeded_hash",
    f"""with {AUDIT} select event_id, r as seed, ('0x' || substr(md5(r || ':' || user_id), 1, 15))::bigint % 1000 as slot
    from (select event_id, user_id, unnest([0, 1, 2]) as r from audit)""",
)
def h03(spark: SparkSession, d: str) -> DataFrame:
    seeds = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("seed")
    rows = audit_events(spark, d).select("event_id", "user_id", seeds)
    return rows.select("event_id", "seed", seeded_bucket(F.col("user_id"), F.col("seed"), 1000, "md5").alias("slot"))


@query(
    "h04_field_or_default",
    f"with {AUDIT} select event_id, coalesce(ip, 'unknown') as ip, coalesce(endpoint, '-') as endpoint from audit",
)
def h04(spark: SparkSession, d: str) -> DataFrame:
    field = F.col("metadata").getItem
    return with_metadata(audit_events(spark, d)).select(
        "event_id", F.coalesce(field("ip"), F.lit("unknown")).alias("ip"),
        F.coalesce(field("endpoint"), F.lit("-")).alias("endpoint"),
    )


@query(
    "h05_round_and_compare",
    f"""select event_id, case when value < 50 then 'PASS' else 'FAIL' end as status,
      {tidy_sql('50 - value', 2)} as margin, {tidy_sql('value / 7', 2)} as rounded from events""",
)
def h05(spark: SparkSession, d: str) -> DataFrame:
    value = F.col("latency_ms")
    return audit_events(spark, d).select(
        "event_id", F.when(value < 50, "PASS").otherwise("FAIL").alias("status"),
        tidy(50 - value, 2).alias("margin"), tidy(value / 7, 2).alias("rounded"),
    )


@query(
    "h06_percentile_label",
    """select p, 'p' || replace(case when p = floor(p) then cast(cast(p as integer) as varchar) else cast(p as varchar) end, '.', '') as label,
      count(*) as n from (select [50.0, 90.0, 95.0, 99.0, 99.9]::double[] as ps, event_id from events) e,
      lateral (select ps[event_id % 5 + 1] as p) group by all""",
)
def h06(spark: SparkSession, d: str) -> DataFrame:
    ps = F.array(*[F.lit(p) for p in (50.0, 90.0, 95.0, 99.0, 99.9)])
    rows = audit_events(spark, d).select(F.element_at(ps, (F.col("event_id") % 5 + 1).cast("int")).alias("p"))
    return rows.groupBy("p", percentile_label_col(F.col("p")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "h07_iso_timestamps",
    f"select event_id, {STAMP} as utc, {STAMP} as from_offset, strftime(ts, '%Y-%m-%dT%H:%M:%S') as seconds from events",
)
def h07(spark: SparkSession, d: str) -> DataFrame:
    ahead = F.date_format(F.col("ts") + F.expr("interval 330 minutes"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    texts = audit_events(spark, d).select(
        "event_id", F.concat(stamp(), F.lit("Z")).alias("a"), F.concat(ahead, F.lit("+05:30")).alias("b")
    )
    parsed = texts.select("event_id", parse_timestamp(F.col("a")).alias("a"), parse_timestamp(F.col("b")).alias("b"))
    return parsed.select(
        "event_id", stamp("a").alias("utc"), stamp("b").alias("from_offset"),
        F.date_format("a", "yyyy-MM-dd'T'HH:mm:ss").alias("seconds"),
    )


@query(
    "h08_ln_exp_pow_sqrt",
    f"""select event_id, {tidy_sql('ln(value + 1)', 6)} as ln, {tidy_sql('exp(-value / 100)', 6)} as exp,
      {tidy_sql('power(value / 100, 1.5)', 6)} as pow, {tidy_sql('sqrt(value)', 6)} as sqrt from events""",
)
def h08(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("latency_ms")
    return audit_events(spark, d).select(
        "event_id", tidy(F.ln(v + 1), 6).alias("ln"), tidy(F.exp(-v / 100), 6).alias("exp"),
        tidy(F.pow(v / 100, F.lit(1.5)), 6).alias("pow"), tidy(F.sqrt(v), 6).alias("sqrt"),
    )


# ---- extension points ---------------------------------------------------------------------------
# A user's own aggregate: range and total of a measure, all roll-ups for free.
SPREAD = ExprAgg(
    (("low", "min(latency_ms)"), ("high", "max(latency_ms)"), ("cents", "sum(cast(round(latency_ms * 100) as bigint))")),
    (("low", "min(low)"), ("high", "max(high)"), ("cents", "sum(cents)")),
    (("spread", "round(high - low, 2)"), ("cents", "cents")),
)


def _longer(a: dict, b: dict) -> dict:
    """A merge that no built-in aggregate has: keep the state of the busier hour."""
    keep = a if (a["cnt"], str(a["bucket_start"])) >= (b["cnt"], str(b["bucket_start"])) else b
    return {**keep, "total": a["total"] + b["total"]}


@query(
    "j01_custom_aggregate",
    f"""with {AUDIT} select coalesce(system, '*') as system, coalesce({DAY}, '*') as bucket,
      {tidy_sql('max(latency_ms) - min(latency_ms)', 2)} as spread, cast(sum(cast(round(latency_ms * 100) as bigint)) as bigint) as cents
    from audit group by grouping sets ((), (system), ({DAY}), (system, {DAY}))""",
)
def j01(spark: SparkSession, d: str) -> DataFrame:
    timed = audit_events(spark, d).withColumn("bucket_start", bucket_start(F.col("ts"), "1h"))
    daily = rollup.coarsen(
        SPREAD, SPREAD.partial(timed.withColumn("metric", F.lit("latency")), KEY), "1d"
    )
    cube = SPREAD.cube(daily, [[], ["system"], ["bucket_start"], ["system", "bucket_start"]])
    shown = SPREAD.present(cube, ["system", "bucket_start"])
    return shown.select(
        F.coalesce("system", F.lit("*")).alias("system"),
        F.coalesce(bucket_label(F.col("bucket_start"), "1d"), F.lit("*")).alias("bucket"),
        tidy(F.col("spread"), 2).alias("spread"), "cents",
    )


@query(
    "j01_python_merge",
    f"""with {AUDIT}, h as (select system, date_trunc('hour', ts) as h, count(*) as cnt from audit group by all)
    select system, strftime(arg_max(h, cnt * 1e7 + epoch(h) / 1e4), '%Y-%m-%dT%H:00:00') as bucket, max(cnt) as cnt,
      cast(sum(cnt) as bigint) as total from h group by system""",
)
def j01_python(spark: SparkSession, d: str) -> DataFrame:
    timed = audit_events(spark, d).groupBy("system", bucket_start(F.col("ts"), "1h").alias("bucket_start"))
    hours = timed.agg(F.count(F.lit(1)).alias("cnt")).withColumn("total", F.col("cnt"))
    return labelled(PythonAgg(_longer).merge(hours, ["system"]), "1h")


@query(
    "j02_custom_metric",
    f"""with {AUDIT} select 'slow_endpoints' as metric, system, {HOUR} as bucket, endpoint as value, count(*) as cnt
    from audit where endpoint is not null and latency_ms > 50 group by all""",
)
def j02(spark: SparkSession, d: str) -> DataFrame:
    # a new metric is one more rule; nothing else changes
    rule = MetricRule("topk", "slow_endpoints", "endpoint", "endpoint is not null and latency_ms > 50", ("1h",))
    return labelled(value_counts(audit_events(spark, d), [rule]).drop("last_ts", "window"), "1h")
