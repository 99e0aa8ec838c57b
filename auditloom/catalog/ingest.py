"""Ingest, routing, buckets, retention and lookups: A, B and C of the inventory."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.catalog.common import (
    AUDIT, DAY, DISTINCT_VALUES, HOUR, INGEST_TS, INGESTED, MEMBER_VALUES, MONTH, RANKED_VALUES,
    STAMP, WEEK, hourly_values, labelled, raw_records, stamp,
)
from auditloom.catalog.registry import query
from auditloom.functions.buckets import (
    bucket_end, bucket_label, bucket_label_by, bucket_series, bucket_start, bucket_start_by,
    expires_at, last_buckets,
)
from auditloom.operators import bloom, members
from auditloom.operators.distinct import exact_distinct
from auditloom.operators.heavy import topk_rollup
from auditloom.operators.requests import check_windows
from auditloom.operators.rollup import of_buckets, of_systems
from auditloom.operators.routing import RULES, route
from auditloom.plans import reports, snapshots
from auditloom.schema import WINDOW_CODES, WINDOWS
from auditloom.session import materialize, run_dir
from auditloom.sources import records
from auditloom.sources.store import RollupStore
from auditloom.sources.tables import audit_events, latest_ts, with_metadata


def _validated(spark: SparkSession, d: str) -> DataFrame:
    parsed = records.parse_records(raw_records(spark, d))
    return records.validate(parsed, F.lit(INGEST_TS).cast("timestamp"))


# ---- A: scans, sources, sinks ---------------------------------------------------
@query(
    "a01_ingest_events",
    f"""with {AUDIT}, {INGESTED}
    select event_id, event_type, system, user_id, session_id, {STAMP} as ts, ip, endpoint,
      status_code, latency_ms
    from ingested where reject_reason is null""",
)
def a01(spark: SparkSession, d: str) -> DataFrame:
    return (
        records.accepted(_validated(spark, d)).withColumn("ts", stamp()).drop("metadata", "event_key")
    )


@query(
    "a02_ingest_batch_report",
    f"""with {AUDIT}, {INGESTED}, n as (
      select count(*) filter (where reject_reason is null) as processed, count(*) as total from ingested)
    select processed, total, 'Processed ' || processed || '/' || total || ' events' as message from n""",
)
def a02(spark: SparkSession, d: str) -> DataFrame:
    return records.batch_report(_validated(spark, d))


@query(
    "a02_batch_envelope",
    f"""with {AUDIT}, {INGESTED}, e as (select * from ingested where event_id % 50 <> 7)
    select reject_reason, count(*) as n, cast(sum(count(*)) over () as bigint) as total,
      'Processed ' || sum(count(*) filter (where reject_reason is null)) over () || '/' || sum(count(*)) over () || ' events' as message
    from e group by reject_reason""",
)
def a02_envelope(spark: SparkSession, d: str) -> DataFrame:
    """The same records in envelopes of up to twenty, each accepted or rejected on its own."""
    whole = raw_records(spark, d).where("event_id % 50 <> 7")  # a broken record breaks its envelope
    envelopes = whole.groupBy(F.expr("event_id div 20").alias("post")).agg(
        F.concat(F.lit('{"events":['), F.array_join(F.collect_list("value"), ","), F.lit("]}")).alias("value")
    )
    checked = materialize(
        records.validate(records.parse_records(envelopes), F.lit(INGEST_TS).cast("timestamp")), "checked"
    )
    reasons = checked.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))
    report = records.batch_report(checked).first()  # one row of two counts
    return reasons.select(
        "reject_reason", "n", F.lit(report["total"]).cast("long").alias("total"), F.lit(report["message"]).alias("message")
    )


@query(
    "a03_validation_split",
    f"""with {AUDIT}, {INGESTED}
    select coalesce(reject_reason, 'accepted') as outcome, count(*) as n from ingested group by 1""",
)
def a03(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")
    return _validated(spark, d).groupBy(outcome).agg(F.count(F.lit(1)).alias("n"))


@query(
    "a04_timestamp_parse",
    f"""with {AUDIT}, {INGESTED}
    select event_id, {STAMP} as ts, event_id % 50 = 19 as defaulted from ingested
    where event_id % 50 not in (7, 17)""",
)
def a04(spark: SparkSession, d: str) -> DataFrame:
    parsed = _validated(spark, d).where("_broken is null and ts is not null")
    return parsed.select("event_id", stamp().alias("ts"), F.col("timestamp").isNull().alias("defaulted"))


def _stored(spark: SparkSession, d: str) -> RollupStore:
    """All events written to a store in two batches, the second of them twice."""
    store = RollupStore(spark, run_dir(spark, "store"))
    events = audit_events(spark, d)
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    middle = F.lit(low + (high - low) / 2)
    store.write("topk", topk_rollup(events.where(F.col("ts") < middle)), 0)
    later = topk_rollup(events.where(F.col("ts") >= middle))
    store.write("topk", later, 1)
    store.write("topk", later, 1)
    return store


@query(
    "a05_write_summary_state",
    f"""with {AUDIT}, {RANKED_VALUES}
    select metric, system, {HOUR} as bucket, count(distinct value) as items, count(*) as cnt
    from vals group by 1, 2, 3""",
)
def a05(spark: SparkSession, d: str) -> DataFrame:
    merged = _stored(spark, d).merged("topk")
    totals = merged.groupBy("metric", "system", "bucket_start").agg(
        F.count(F.lit(1)).alias("items"), F.sum("cnt").alias("cnt")
    )
    return labelled(totals, "1h")


@query(
    "a06_read_summary_state",
    f"""with {AUDIT}, {RANKED_VALUES}
    select metric, system, {HOUR} as bucket, value as item, count(*) as cnt from vals
    where ts >= (select date_trunc('day', max(ts)) from audit)
    group by 1, 2, 3, 4""",
)
def a06(spark: SparkSession, d: str) -> DataFrame:
    end = latest_ts(audit_events(spark, d))
    store = _stored(spark, d)
    start = end.replace(hour=0, minute=0, second=0, microsecond=0)
    found = store.merged("topk", "1h", start=start, end=end)
    return labelled(found.select("metric", "system", "bucket_start", "item", "cnt"), "1h")


@query(
    "a07_publish_events",
    f"""with {AUDIT}
    select '{{"event_type":"' || event_type || '","system":"' || system || '","user_id":"' || user_id
      || '","timestamp":"' || {STAMP} || '","metadata":{{'
      || concat_ws(',', '"ip":"' || ip || '"', '"endpoint":"' || endpoint || '"',
                   '"status_code":"' || status_code || '"') || '}}}}' as value
    from audit""",
)
def a07(spark: SparkSession, d: str) -> DataFrame:
    return records.published(with_metadata(audit_events(spark, d)))


@query(
    "a09_recent_events",
    f"""with {AUDIT}
    select event_id, {STAMP} as ts, event_type, system, user_id from audit
    order by audit.ts desc, event_id desc limit 50""",
)
def a09(spark: SparkSession, d: str) -> DataFrame:
    newest = records.newest(audit_events(spark, d), 50)
    return newest.select("event_id", stamp().alias("ts"), "event_type", "system", "user_id")


def _snapshot_root(spark: SparkSession, d: str) -> str:
    root = run_dir(spark, "snapshots")
    events = audit_events(spark, d)
    daily = exact_distinct(
        hourly_values(spark, d, "hll").withColumn("bucket_start", bucket_start(F.col("bucket_start"), "1d")),
        ["metric", "system", "bucket_start"],
    ).withColumnRenamed("exact", "count")
    counts = topk_rollup(events, "1d").where(F.col("metric").isin("active_users", "active_ips"))
    rows = snapshots.snapshot_rows(daily, reports.top_items(counts, 10))
    snapshots.save(rows, root)
    snapshots.save(rows, root)  # writing a date again replaces it
    return root


_SNAPSHOT_SQL = f"""with {AUDIT}, {DISTINCT_VALUES}, ranked_vals as (
      select 'active_users' as metric, system, ts, user_id as value from audit
      union all select 'active_ips', system, ts, ip from audit where ip is not null),
    c as (select metric, system, {DAY} as day, value, count(*) as cnt from ranked_vals group by all),
    r as (select *, row_number() over (partition by metric, system, day order by cnt desc, value) as rank from c)
    select * from (
      select {DAY} as snapshot_date, system, metric, '1d' as "window",
        cast(count(distinct value) as double) as value, cast(null as varchar) as items
      from vals group by 1, 2, 3
      union all
      select day, system, metric, '1d', null, string_agg(value || '=' || cnt, ';' order by rank)
      from r where rank <= 10 group by 1, 2, 3)"""


def _snapshot_view(rows: DataFrame) -> DataFrame:
    text = F.array_join(
        F.transform("items", lambda i: F.concat_ws("=", i["item"], i["count"])), ";"
    )
    return rows.select(
        F.date_format("snapshot_date", "yyyy-MM-dd").alias("snapshot_date"),
        "system", "metric", "window", "value", text.alias("items"),
    )


@query("a10_save_snapshots", _SNAPSHOT_SQL)
def a10(spark: SparkSession, d: str) -> DataFrame:
    today = latest_ts(audit_events(spark, d)).date()
    return _snapshot_view(snapshots.kept(spark, _snapshot_root(spark, d), today))


@query(
    "a11_read_snapshot",
    _SNAPSHOT_SQL + " where snapshot_date = (select strftime(max(ts), '%Y-%m-%d') from audit)",
)
def a11(spark: SparkSession, d: str) -> DataFrame:
    day = latest_ts(audit_events(spark, d)).date()
    return _snapshot_view(snapshots.load(spark, _snapshot_root(spark, d), day))


# ---- B: routing, buckets, retention ----------------------------------------------
_ROUTED = f"""routed as (
      select 'hll' as structure, * from (with {DISTINCT_VALUES} select metric, system, ts, w as "window" from vals,
        unnest(['1h', '1d', '1w']) as t(w) where not (w = '1w' and metric <> 'users'))
      union all
      select 'bloom', * from (with {MEMBER_VALUES} select metric, system, ts, w from vals,
        unnest(['1d', '1w']) as t(w) where not (w = '1w' and metric <> 'user_activity'))
      union all
      select 'topk', * from (with {RANKED_VALUES} select metric, system, ts, '1h' from vals))"""


@query(
    "b01_metric_fanout",
    f"""with {AUDIT}, {_ROUTED}
    select structure, metric, system, "window",
      case "window" when '1h' then {HOUR} when '1d' then {DAY} else {WEEK} end as bucket,
      count(*) as updates
    from routed group by all""",
)
def b01(spark: SparkSession, d: str) -> DataFrame:
    routed = route(audit_events(spark, d), RULES)
    counted = routed.groupBy("structure", "metric", "system", "window", "bucket_start").agg(
        F.count(F.lit(1)).alias("updates")
    )
    return counted.withColumn(
        "bucket", bucket_label_by(F.col("bucket_start"), F.col("window"))
    ).drop("bucket_start")


_MINUTE = "strftime(ts, '%Y-%m-%dT%H:%M:00')"


def _minutes(n: int) -> str:
    return f"strftime(time_bucket(interval '{n} minutes', ts), '%Y-%m-%dT%H:%M:00')"


@query(
    "b02_bucket_timestamp",
    f"""select event_id, {_MINUTE} as b_1m, {_minutes(5)} as b_5m, {_minutes(15)} as b_15m,
      {HOUR} as b_1h, {DAY} as b_1d, {WEEK} as b_1w, {MONTH} as b_mon
    from events""",
)
def b02(spark: SparkSession, d: str) -> DataFrame:
    names = {"1m": "b_1m", "5m": "b_5m", "15m": "b_15m", "1h": "b_1h", "1d": "b_1d", "1w": "b_1w", "1M": "b_mon"}
    return audit_events(spark, d).select(
        "event_id",
        *[bucket_label(bucket_start(F.col("ts"), w), w).alias(n) for w, n in names.items()],
    )


_REQUESTS = """requests as (
      select event_id, ts, ['1m', '5m', '15m', '1h', '1d', '1w', '1M', '2h', 'day'][event_id % 9 + 1] as "window"
      from events)"""
_SPEC = """spec("window", duration_s, retention_s) as (values
      ('1m', 60, 3600), ('5m', 300, 43200), ('15m', 900, 86400), ('1h', 3600, 604800),
      ('1d', 86400, 7776000), ('1w', 604800, 31449600), ('1M', 2592000, 62208000))"""


def _requests(spark: SparkSession, d: str) -> DataFrame:
    codes = F.array(*[F.lit(c) for c in (*WINDOW_CODES, "2h", "day")])
    code = F.element_at(codes, (F.col("event_id") % 9 + 1).cast("int"))
    return audit_events(spark, d).select("event_id", "ts", code.alias("window"))


@query(
    "b03_validate_window",
    f"""with {_REQUESTS}, {_SPEC}
    select r."window", case when s.duration_s is null then 'Invalid window: ' || r."window"
      || '. Valid options: 1m, 5m, 15m, 1h, 1d, 1w, 1M' end as reject_reason, count(*) as n
    from requests r left join spec s on r."window" = s."window" group by all""",
)
def b03(spark: SparkSession, d: str) -> DataFrame:
    checked = check_windows(_requests(spark, d))
    return checked.groupBy("window", "reject_reason").agg(F.count(F.lit(1)).alias("n"))


_ALL_BUCKETS = f"""buckets as (
      select w as "window", ts, case w when '1m' then date_trunc('minute', ts)
        when '5m' then time_bucket(interval '5 minutes', ts) when '15m' then time_bucket(interval '15 minutes', ts)
        when '1h' then date_trunc('hour', ts) when '1d' then date_trunc('day', ts)
        when '1w' then date_trunc('week', ts) else date_trunc('month', ts) end as bucket_start
      from events, unnest(['1m', '5m', '15m', '1h', '1d', '1w', '1M']) as t(w))"""
_SECOND = "'%Y-%m-%dT%H:%M:%S'"


def _all_buckets(spark: SparkSession, d: str) -> DataFrame:
    codes = F.explode(F.array(*[F.lit(c) for c in WINDOW_CODES])).alias("window")
    rows = audit_events(spark, d).select("ts", codes)
    rows = rows.withColumn("bucket_start", bucket_start_by(F.col("ts"), F.col("window")))
    return rows.groupBy("window", "bucket_start").agg(F.max("ts").alias("last_ts"))


def _by_window(make):
    out = F.lit(None).cast("timestamp")
    for spec in WINDOWS:
        out = F.when(F.col("window") == spec.code, make(spec.code)).otherwise(out)
    return out


def _second(column):
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")


@query(
    "b04_window_duration",
    f"""with {_ALL_BUCKETS}, {_SPEC}
    select b."window", strftime(bucket_start, {_SECOND}) as bucket_start,
      strftime(case b."window" when '1M' then bucket_start + interval 1 month
        else bucket_start + to_seconds(duration_s) end, {_SECOND}) as bucket_end,
      cast(duration_s as bigint) as duration_s
    from (select distinct "window", bucket_start from buckets) b join spec s on b."window" = s."window" """,
)
def b04(spark: SparkSession, d: str) -> DataFrame:
    end = _by_window(lambda code: bucket_end(F.col("bucket_start"), code))
    return check_windows(_all_buckets(spark, d)).select(
        "window", _second("bucket_start").alias("bucket_start"), _second(end).alias("bucket_end"), "duration_s"
    )


_EXPIRY = f"""expiry as (
      select b."window", bucket_start, date_trunc('second', max(ts)) + to_seconds(max(retention_s)) as expires_at
      from buckets b join spec s on b."window" = s."window" group by 1, 2)"""


@query(
    "b05_retention_seconds",
    f"""with {_ALL_BUCKETS}, {_SPEC}, {_EXPIRY}
    select e."window", strftime(bucket_start, {_SECOND}) as bucket_start,
      strftime(expires_at, {_SECOND}) as expires_at, cast(retention_s as bigint) as retention_s
    from expiry e join spec s on e."window" = s."window" """,
)
def b05(spark: SparkSession, d: str) -> DataFrame:
    until = _by_window(lambda code: expires_at(F.col("last_ts"), code))
    return check_windows(_all_buckets(spark, d)).select(
        "window", _second("bucket_start").alias("bucket_start"), _second(until).alias("expires_at"), "retention_s"
    )


@query(
    "b06_retention_filter",
    f"""with {_ALL_BUCKETS}, {_SPEC}, {_EXPIRY}
    select "window", strftime(bucket_start, {_SECOND}) as bucket_start from expiry
    where expires_at > (select max(ts) from events)""",
)
def b06(spark: SparkSession, d: str) -> DataFrame:
    as_of = latest_ts(audit_events(spark, d))
    until = _by_window(lambda code: expires_at(F.col("last_ts"), code))
    kept = _all_buckets(spark, d).where(until > F.lit(as_of))
    return kept.select("window", _second("bucket_start").alias("bucket_start"))


@query(
    "b06_days_after_hours_expired",
    f"""with {AUDIT}, {RANKED_VALUES}
    select '1d' as "window", metric, system, {DAY} as bucket, value as item, count(*) as cnt from vals group by all
    union all select '1w', metric, system, {WEEK}, value, count(*) from vals group by all
    union all select '1M', metric, system, {MONTH}, value, count(*) from vals group by all""",
)
def b06_days(spark: SparkSession, d: str) -> DataFrame:
    """Thirty days on no hour is left, and days, weeks and months still answer in full."""
    store = RollupStore(spark, run_dir(spark, "lifetimes"))
    events = audit_events(spark, d)
    store.write("topk", topk_rollup(events), 0)
    store.expire("topk", latest_ts(events) + timedelta(days=30))
    out = None
    for window in ("1d", "1w", "1M"):
        rows = store.at("topk", window).select("metric", "system", "window", "bucket_start", "item", "cnt")
        part = labelled(rows, window)
        out = part if out is None else out.unionByName(part)
    return out.unionByName(labelled(store.merged("topk", "1h").select(*rows.columns), "1h"))


@query(
    "b07_last_bucket_labels",
    f"""with {AUDIT}, e as (select system, max(ts) as t from audit group by 1),
    s as (select system, w as "window", i, case w
        when '1m' then date_trunc('minute', t) - to_minutes(i)
        when '5m' then time_bucket(interval '5 minutes', t) - to_minutes(5 * i)
        when '15m' then time_bucket(interval '15 minutes', t) - to_minutes(15 * i)
        when '1h' then date_trunc('hour', t) - to_hours(i)
        when '1d' then date_trunc('day', t) - to_days(cast(i as integer))
        when '1w' then date_trunc('week', t) - to_days(cast(7 * i as integer))
        else date_trunc('month', t) - to_months(cast(i as integer)) end as ts
      from e, unnest(['1m', '5m', '15m', '1h', '1d', '1w', '1M']) as x(w), range(5) as y(i))
    select system, "window", cast(i as integer) as back, case "window" when '1d' then {DAY} when '1w' then {WEEK}
      when '1M' then {MONTH} else {_MINUTE} end as bucket from s""",
)
def b07(spark: SparkSession, d: str) -> DataFrame:
    ends = audit_events(spark, d).groupBy("system").agg(F.max("ts").alias("t"))
    lists = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("window"), last_buckets(F.col("t"), c, 5).alias("starts"))
                for c in WINDOW_CODES
            ]
        )
    ).alias("x")
    rows = ends.select("system", lists).select("system", "x.window", F.posexplode("x.starts").alias("back", "start"))
    return rows.select("system", "window", "back", bucket_label_by(F.col("start"), F.col("window")).alias("bucket"))


@query(
    "b08_bucket_range",
    f"""with {AUDIT}, r as (select date_trunc('hour', min(ts)) as a, date_trunc('hour', max(ts)) as b from audit),
    grid as (select system, ts from (select distinct system from audit), (select unnest(range(a, b + interval 1 hour, interval 1 hour)) as ts from r)),
    n as (select system, date_trunc('hour', ts) as h, count(*) as n from audit group by 1, 2)
    select grid.system, {HOUR} as bucket, coalesce(n, 0) as n
    from grid left join n on n.system = grid.system and n.h = grid.ts""",
)
def b08(spark: SparkSession, d: str) -> DataFrame:
    events = audit_events(spark, d)
    # one row: the range of the data
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    series = bucket_series(F.lit(low), F.lit(high), "1h")
    grid = events.select("system").distinct().select("system", F.explode(series).alias("bucket_start"))
    counted = events.groupBy("system", bucket_start(F.col("ts"), "1h").alias("bucket_start")).agg(
        F.count(F.lit(1)).alias("n")
    )
    full = grid.join(counted, ["system", "bucket_start"], "left")
    return labelled(full.withColumn("n", F.coalesce("n", F.lit(0))), "1h")


@query(
    "b09_point_lookup",
    f"""with {AUDIT}, {DISTINCT_VALUES}
    select metric, system, {HOUR} as bucket, count(distinct value) as exact from vals
    where date_trunc('hour', ts) = (select date_trunc('hour', max(ts)) from audit) group by all""",
)
def b09(spark: SparkSession, d: str) -> DataFrame:
    as_of = latest_ts(audit_events(spark, d))
    hour = bucket_start(F.lit(as_of), "1h")
    base = hourly_values(spark, d, "hll").where(F.col("bucket_start") == hour)
    return labelled(exact_distinct(base, ["metric", "system", "bucket_start"]).drop("n", "last_ts"), "1h")


@query(
    "b10_presence",
    f"""with {AUDIT}
    select system, count(*) filter (where user_id <> '') as users, count(*) filter (where session_id <> '') as sessions,
      count(ip) as ips, count(endpoint) as endpoints, count(status_code) as status_codes
    from audit group by 1""",
)
def b10(spark: SparkSession, d: str) -> DataFrame:
    def has(key: str):
        return F.map_contains_key("metadata", key) & F.col("metadata").getItem(key).isNotNull()

    return with_metadata(audit_events(spark, d)).groupBy("system").agg(
        F.count_if(F.expr("user_id is not null and user_id <> ''")).alias("users"),
        F.count_if(F.expr("session_id is not null and session_id <> ''")).alias("sessions"),
        F.count_if(has("ip")).alias("ips"),
        F.count_if(has("endpoint")).alias("endpoints"),
        F.count_if(has("status_code")).alias("status_codes"),
    )


@query(
    "b11_failed_login_rule",
    f"""with {AUDIT}
    select event_id, system, coalesce(ip, 'unknown') as value from audit
    where event_type = 'security_event' and status_code is not null""",
)
def b11(spark: SparkSession, d: str) -> DataFrame:
    rules = [r for r in RULES if r.metric == "failed_logins"]
    return route(audit_events(spark, d), rules).select("event_id", "system", "value")


@query(
    "b12_system_subset",
    f"""with {AUDIT}, {DISTINCT_VALUES}
    select metric, {DAY} as bucket, count(distinct value) as exact from vals
    where system in ('production_db', 'api_gateway', 'no_such_system') group by all""",
)
def b12(spark: SparkSession, d: str) -> DataFrame:
    base = of_systems(hourly_values(spark, d, "hll"), ["production_db", "api_gateway", "no_such_system"])
    daily = base.withColumn("bucket_start", bucket_start(F.col("bucket_start"), "1d"))
    return labelled(exact_distinct(daily, ["metric", "bucket_start"]).drop("n", "last_ts"), "1d")


@query(
    "b13_bucket_subset",
    f"""with {AUDIT}, {DISTINCT_VALUES}, wanted as (
      select distinct date_trunc('hour', ts) as h from audit where event_type = 'security_event' and status_code is not null)
    select metric, system, count(distinct value) as exact from vals
    where date_trunc('hour', ts) in (select h from wanted) group by all""",
)
def b13(spark: SparkSession, d: str) -> DataFrame:
    failed = audit_events(spark, d).where("event_type = 'security_event' and status_code is not null")
    wanted = failed.select(bucket_start(F.col("ts"), "1h").alias("bucket_start"))
    base = of_buckets(hourly_values(spark, d, "hll"), wanted)
    return exact_distinct(base, ["metric", "system"]).drop("n", "last_ts")


# ---- C: membership questions -------------------------------------------------------
# Every event asks: was this user also on the next system that day, and that week?
_QUESTIONS = """questions as (
      select event_id, ts, user_id, w as "window", case system when 'production_db' then 'staging_db'
        when 'staging_db' then 'api_gateway' else 'production_db' end as system
      from audit, unnest(['1d', '1w']) as t(w))"""
_ANSWERS = f"""answers as (
      select q.event_id, q.system, q."window", q.ts, m.system is not null as accessed
      from questions q left join (
        select distinct system, user_id, w as "window", case w when '1d' then date_trunc('day', ts)
          else date_trunc('week', ts) end as b from audit, unnest(['1d', '1w']) as t(w)) m
      on m.system = q.system and m.user_id = q.user_id and m."window" = q."window"
        and m.b = case q."window" when '1d' then date_trunc('day', q.ts) else date_trunc('week', q.ts) end)"""


def questions(events: DataFrame) -> DataFrame:
    other = (
        F.when(F.col("system") == "production_db", "staging_db")
        .when(F.col("system") == "staging_db", "api_gateway")
        .otherwise("production_db")
    )
    windows = F.explode(F.array(F.lit("1d"), F.lit("1w"))).alias("window")
    return events.select("event_id", "ts", "user_id", other.alias("system"), windows)


def known_members(events: DataFrame) -> DataFrame:
    hourly = members.member_rollup(events).where("metric = 'user_activity'")
    daily = materialize(members.coarsen_members(hourly, "1d"), "members")
    return daily.unionByName(members.coarsen_members(daily, "1w"))


@query(
    "c01_activity_check",
    f"""with {AUDIT}, {_QUESTIONS}, {_ANSWERS}
    select event_id, system, "window", accessed from answers""",
)
def c01(spark: SparkSession, d: str) -> DataFrame:
    events = audit_events(spark, d)
    answered = members.check_activity(questions(events), known_members(events))
    return answered.select("event_id", "system", "window", "accessed")


@query(
    "c02_activity_check_bloom",
    f"""with {AUDIT}, {_QUESTIONS}, {_ANSWERS}
    select "window", count(*) as questions, count(*) filter (where accessed) as exact_yes,
      cast(0 as bigint) as false_no, true as false_yes_within_bound, true as probability_ok
    from answers group by 1""",
)
def c02(spark: SparkSession, d: str) -> DataFrame:
    events = audit_events(spark, d)
    known = materialize(known_members(events), "members")
    keys = ["system", "window", "bucket_start"]
    asked = questions(events).select(
        "*",
        bucket_start_by(F.col("ts"), F.col("window")).alias("bucket_start"),
        F.concat_ws(":", "user_id", "system").alias("value"),
    )
    sizes = bloom.auto_capacity(known, keys, "value", 1000, 4)
    filters = materialize(bloom.build_sized(known, sizes, keys, "value", 0.001), "filters")
    answered = bloom.with_probability(
        bloom.contains_sized(asked, filters, keys, "value"), filters, keys
    )
    truth = known.select(*keys, "value", F.lit(True).alias("found"))
    both = answered.join(truth, [*keys, "value"], "left").withColumn(
        "exact", F.coalesce("found", F.lit(False))
    )
    wrong = F.count_if(F.col("accessed") & ~F.col("exact"))
    return both.groupBy("window").agg(
        F.count(F.lit(1)).alias("questions"),
        F.count_if("exact").alias("exact_yes"),
        F.count_if(~F.col("accessed") & F.col("exact")).alias("false_no"),
        # ten times the designed rate leaves room for chance
        (wrong <= F.greatest(F.lit(1.0), 0.01 * F.count_if(~F.col("exact")))).alias("false_yes_within_bound"),
        F.bool_and(
            F.when(F.col("accessed"), F.col("probability").between(0.999, 1.0)).otherwise(
                F.col("probability") == 1.0
            )
        ).alias("probability_ok"),
    )


@query(
    "c03_seen_and_never_seen",
    f"""with {AUDIT}, ref as (
      select distinct user_id from audit where date_trunc('day', ts) = (select date_trunc('day', min(ts)) from audit))
    select system, {DAY} as bucket, user_id in (select user_id from ref) as seen, count(*) as n
    from audit group by all""",
)
def c03(spark: SparkSession, d: str) -> DataFrame:
    events = audit_events(spark, d)
    first = events.agg(F.min("ts")).first()[0]
    day = F.lit(first.replace(hour=0, minute=0, second=0, microsecond=0))
    first_day = events.where((F.col("ts") >= day) & (F.col("ts") < day + F.expr("interval 1 day")))
    reference = materialize(first_day.select("user_id").distinct(), "reference")

    def counted(part: DataFrame, seen: bool) -> DataFrame:
        day = bucket_start(F.col("ts"), "1d").alias("bucket_start")
        return part.groupBy("system", day).agg(F.count(F.lit(1)).alias("n")).withColumn("seen", F.lit(seen))

    both = counted(members.seen_before(events, reference), True).unionByName(
        counted(members.never_seen(events, reference), False)
    )
    return labelled(both, "1d")
