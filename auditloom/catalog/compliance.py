"""Compliance reports over all systems: K01 to K11 of the inventory."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.catalog.common import (
    AUDIT, DAY, DISTINCT_VALUES, HOUR, MEMBER_VALUES, MONTH, RANKED_VALUES, WEEK, at_window,
    hourly_values, labelled, tidy_sql,
)
from auditloom.catalog.distincts import BOUND
from auditloom.catalog.ingest import _ANSWERS, _QUESTIONS, known_members, questions
from auditloom.catalog.registry import ORACLES, QUERIES, query
from auditloom.catalog.streams import resent
from auditloom.functions.buckets import bucket_label_by, bucket_start, bucket_start_by
from auditloom.functions.numbers import percentile_label, percentile_label_col, ranked_text, tidy
from auditloom.operators import members, moments
from auditloom.operators.distinct import checked, exact_distinct, hll_rollup
from auditloom.operators.heavy import coarsen_counts, topk_rollup
from auditloom.operators.mergeable import hll, kll
from auditloom.operators.quantiles import (
    RANK_ERROR, exact_percentiles, kll_rollup, percentiles, within_rank_error,
)
from auditloom.operators.rollup import coarsen
from auditloom.operators.routing import rules_for, value_counts
from auditloom.plans import reports
from auditloom.session import materialize, run_dir
from auditloom.sources.store import RollupStore
from auditloom.sources.tables import audit_events, latest_ts
from auditloom.streaming import jobs

DAILY = ["system", "bucket_start"]


@query(
    "k01_distinct_count_report",
    f"""with {AUDIT}, {DISTINCT_VALUES} select metric, system, '1d' as "window", {DAY} as bucket, count(distinct value) as exact,
      true as within_bound, cast(0.0163 as double) as accuracy from vals group by all""",
)
def k01(spark: SparkSession, d: str) -> DataFrame:
    daily = materialize(coarsen(hll(), hll_rollup(audit_events(spark, d), "1h"), "1d"), "sketches")
    report = reports.distinct_counts(daily).withColumnRenamed("count", "estimate")
    keys = ["metric", "system", "window", "bucket_start"]
    base = at_window(hourly_values(spark, d, "hll"), "1d").withColumn("window", F.lit("1d"))
    result = checked(report, exact_distinct(base, keys), keys, BOUND)
    return labelled(result.join(report.select(*keys, "accuracy"), keys), "1d")


@query(
    "k01_distinct_any_window",
    f"""with {AUDIT}, {DISTINCT_VALUES} select metric, system, w as "window",
      case w when '15m' then strftime(time_bucket(interval '15 minutes', ts), '%Y-%m-%dT%H:%M:00') when '1h' then {HOUR}
        when '1d' then {DAY} when '1w' then {WEEK} else {MONTH} end as bucket, count(distinct value) as exact, true as within_bound
    from vals, unnest(['15m', '1h', '1d', '1w', '1M']) as t(w) group by all""",
)
def k01_any(spark: SparkSession, d: str) -> DataFrame:
    # one window is stored, and all longer ones are answered from it
    store = RollupStore(spark, run_dir(spark, "windows"))
    events = audit_events(spark, d)
    store.write("hll", hll_rollup(events, "15m"), 0)
    base = materialize(value_counts(events, rules_for("hll"), "15m"), "values")
    keys = ["metric", "system", "window", "bucket_start"]
    out = None
    for window in ("15m", "1h", "1d", "1w", "1M"):
        report = reports.distinct_counts(store.at("hll", window)).withColumnRenamed("count", "estimate")
        exact = exact_distinct(at_window(base, window).withColumn("window", F.lit(window)), keys)
        part = labelled(checked(report, exact, keys, BOUND), window)
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "k02_activity_report",
    f"""with {AUDIT}, {_QUESTIONS}, {_ANSWERS}
    select distinct q.user_id, q.system, q."window", case q."window" when '1d' then strftime(q.ts, '%Y-%m-%d') else strftime(q.ts, '%G-W%V') end as bucket,
      accessed, cast(1 as double) as probability
    from questions q join answers a on a.event_id = q.event_id and a."window" = q."window" """,
)
def k02(spark: SparkSession, d: str) -> DataFrame:
    events = audit_events(spark, d)
    start = bucket_start_by(F.col("ts"), F.col("window")).alias("ts")
    asked = questions(events).select("user_id", "system", "window", start).distinct()
    answered = members.check_activity(asked, known_members(events))
    # the member table is exact, so every answer is certain
    return answered.withColumn("probability", F.lit(1.0)).withColumn(
        "bucket", bucket_label_by(F.col("ts"), F.col("window"))
    ).drop("ts")


_RANKED = """c as (select metric, system, {bucket} as bucket, value as item, count(*) as cnt from vals group by all),
    r as (select *, row_number() over (partition by metric, system, bucket order by cnt desc, item) as rank from c)"""


@query(
    "k03_top_k_report",
    f"""with {AUDIT}, {RANKED_VALUES}, {_RANKED.format(bucket=HOUR)}
    select metric, system, bucket, '1h' as "window", string_agg(item || '=' || cnt, ';' order by rank) as items
    from r where rank <= 10 group by all""",
)
def k03(spark: SparkSession, d: str) -> DataFrame:
    report = reports.top_items(topk_rollup(audit_events(spark, d), "1h"), 10)
    return labelled(report.withColumn("items", ranked_text(F.col("items"))), "1h")


def _summary(spark: SparkSession, d: str) -> DataFrame:
    events = audit_events(spark, d)
    as_of = latest_ts(events)
    day = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    # the filter reaches the scan: only files and row groups of that day are read
    today = events.where((F.col("ts") >= F.lit(day)) & (F.col("ts") < F.lit(day + timedelta(days=1))))
    # one pass over the day feeds all parts of the summary
    tops = [r for r in rules_for("topk") if r.metric in ("active_users", "active_ips")]
    base = materialize(value_counts(today, [*rules_for("hll"), *tops], "1h"), "values")
    keys = ["metric", "system", "bucket_start"]
    distinct = base.where(F.col("metric").isin([r.metric for r in rules_for("hll")]))
    hourly = exact_distinct(distinct, keys).withColumnRenamed("exact", "count")
    daily = exact_distinct(at_window(distinct, "1d"), keys).withColumnRenamed("exact", "count")
    counts = base.withColumnRenamed("value", "item")
    return reports.system_summary(hourly, daily, counts, as_of, 10)


_SUMMARY_SQL = f"""with {AUDIT}, edge as (select max(ts) as t from audit),
    d as (select system, count(distinct user_id) as daily_unique_users, count(distinct session_id) as daily_unique_sessions,
      count(distinct ip) as daily_unique_ips from audit, edge where date_trunc('day', ts) = date_trunc('day', t) group by 1),
    h as (select system, count(distinct user_id) as hourly_unique_users, count(distinct session_id) as hourly_unique_sessions,
      count(distinct ip) as hourly_unique_ips from audit, edge where date_trunc('hour', ts) = date_trunc('hour', t) group by 1),
    u as (select system, user_id as item, count(*) as cnt from audit, edge where date_trunc('hour', ts) = date_trunc('hour', t) group by all),
    i as (select system, ip as item, count(*) as cnt from audit, edge where date_trunc('hour', ts) = date_trunc('hour', t) and ip is not null group by all),
    tu as (select system, string_agg(item || '=' || cnt, ';' order by cnt desc, item) as top_users from (
      select *, row_number() over (partition by system order by cnt desc, item) as r from u) where r <= 10 group by 1),
    ti as (select system, string_agg(item || '=' || cnt, ';' order by cnt desc, item) as top_ips from (
      select *, row_number() over (partition by system order by cnt desc, item) as r from i) where r <= 10 group by 1)"""


@query(
    "k04_system_summary",
    f"""{_SUMMARY_SQL}
    select d.system, daily_unique_users, daily_unique_sessions, daily_unique_ips, coalesce(hourly_unique_users, 0) as hourly_unique_users,
      coalesce(hourly_unique_sessions, 0) as hourly_unique_sessions, coalesce(hourly_unique_ips, 0) as hourly_unique_ips,
      top_users, top_ips, strftime(t, '%Y-%m-%dT%H:%M:%S.%f') as as_of
    from d left join h using (system) left join tu using (system) left join ti using (system), edge""",
)
def k04(spark: SparkSession, d: str) -> DataFrame:
    summary = _summary(spark, d)
    return (
        summary.withColumn("top_users", ranked_text(F.col("top_users")))
        .withColumn("top_ips", ranked_text(F.col("top_ips")))
        .withColumn("as_of", F.date_format("as_of", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    )


@query(
    "k05_percentile_report",
    f"""with {AUDIT}, c as (select system, {DAY} as bucket, quantile_cont(latency_ms, [0.5, 0.95, 0.99]) as q from audit group by all)
    select 'api_latency' as metric, system, '1d' as "window", bucket, unnest(['p50', 'p95', 'p99']) as label,
      {tidy_sql('unnest(q)', 4)} as value, 'milliseconds' as unit from c""",
)
def k05(spark: SparkSession, d: str) -> DataFrame:
    rows = audit_events(spark, d).withColumn("bucket_start", bucket_start(F.col("ts"), "1d"))
    found = exact_percentiles(rows, DAILY, "latency_ms", reports.DEFAULT_PERCENTILES, "cont")
    shown = found.select(
        F.lit("api_latency").alias("metric"), "system", F.lit("1d").alias("window"), "bucket_start",
        percentile_label_col(F.col("p")).alias("label"), tidy(F.col("value"), 4).alias("value"),
        F.lit("milliseconds").alias("unit"),
    )
    return labelled(shown, "1d")


@query(
    "k05_percentile_report_digest",
    f"""with {AUDIT}, c as (select system, {DAY} as bucket, quantile_disc(latency_ms, [0.5, 0.95, 0.99]) as q from audit group by all)
    select system, bucket, unnest(['p50', 'p95', 'p99']) as label, unnest(q) as exact, true as within_bound from c""",
)
def k05_digest(spark: SparkSession, d: str) -> DataFrame:
    events = audit_events(spark, d)
    report = reports.percentile_report(coarsen(kll(), kll_rollup(events, "1h"), "1d").withColumn("window", F.lit("1d")))
    values = report.select(*DAILY, F.explode("percentiles").alias("label", "value"))
    p = F.substring("label", 2, 9).cast("double")
    rows = events.withColumn("bucket_start", bucket_start(F.col("ts"), "1d"))
    checked_rows = within_rank_error(
        rows, DAILY, "latency_ms", reports.DEFAULT_PERCENTILES, values.withColumn("p", p)
    )
    return labelled(checked_rows.withColumn("label", percentile_label_col(F.col("p"))).drop("p"), "1d")


@query(
    "k06_sla_check",
    f"""with {AUDIT}, c as (select system, {DAY} as bucket, quantile_disc(latency_ms, 0.95) as v from audit group by all),
    t as (select system, 3 * avg(latency_ms) as threshold from audit group by 1)
    select system, bucket, cast(95 as double) as percentile, {tidy_sql('v', 2)} as value, {tidy_sql('threshold', 4)} as threshold,
      case when v < threshold then 'PASS' else 'FAIL' end as status, {tidy_sql('threshold - v', 2)} as margin
    from c join t using (system)""",
)
def k06(spark: SparkSession, d: str) -> DataFrame:
    rows = audit_events(spark, d).withColumn("bucket_start", bucket_start(F.col("ts"), "1d"))
    # every system has its own threshold: three times its average latency
    thresholds = rows.groupBy("system").agg((3 * F.avg("latency_ms")).alias("threshold"))
    values = exact_percentiles(rows, DAILY, "latency_ms", [95], "disc")
    judged = reports.sla_check(values, thresholds)
    shown = judged.withColumnRenamed("p", "percentile").withColumn("threshold", tidy(F.col("threshold"), 4))
    return labelled(shown, "1d")


@query(
    "k06_sla_check_digest",
    f"""with {AUDIT} select system, {DAY} as bucket, true as judged_within_rank_error from audit group by all""",
)
def k06_digest(spark: SparkSession, d: str) -> DataFrame:
    events = audit_events(spark, d)
    daily = coarsen(kll(), kll_rollup(events, "1h"), "1d").withColumn("window", F.lit("1d"))
    judged = reports.sla_from_rollup(daily, 95, 200.0)
    # the verdict must be that of the exact value a rank error below or above
    rows = events.withColumn("bucket_start", bucket_start(F.col("ts"), "1d"))
    around = exact_percentiles(
        rows, DAILY, "latency_ms", [95 - 100 * RANK_ERROR, 95 + 100 * RANK_ERROR], "disc"
    )
    verdicts = reports.sla_check(around, 200.0).groupBy(*DAILY).agg(F.collect_set("status").alias("allowed"))
    both = judged.join(verdicts, DAILY, "full_outer")
    ok = F.coalesce(F.array_contains("allowed", F.col("status")), F.lit(False))
    return labelled(both.select(*DAILY, ok.alias("judged_within_rank_error")), "1d")


_FIVE = [("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99), ("p999", 0.999)]


@query(
    "k07_latency_summary",
    f"""with {AUDIT}, c as (select system, {DAY} as bucket, {', '.join(f'quantile_disc(latency_ms, {q}) as {n}' for n, q in _FIVE)}
      from audit group by all)
    select 'api_latency' as metric, '1d' as "window", system, bucket, {', '.join(f'{tidy_sql(n, 2)} as {n}' for n, _ in _FIVE)},
      case when p95 < 200 then 'PASS' else 'FAIL' end as p95_under_200ms,
      case when p99 < 500 then 'PASS' else 'FAIL' end as p99_under_500ms from c""",
)
def k07(spark: SparkSession, d: str) -> DataFrame:
    rows = audit_events(spark, d).withColumn("bucket_start", bucket_start(F.col("ts"), "1d"))
    values = exact_percentiles(rows, DAILY, "latency_ms", reports.SUMMARY_PERCENTILES, "disc")
    summary = reports.latency_summary(values, DAILY)
    return labelled(
        summary.withColumn("metric", F.lit("api_latency")).withColumn("window", F.lit("1d")), "1d"
    )


_FIVE_NEAR = f"""with {AUDIT}, c as (select system, {DAY} as bucket,
      quantile_disc(latency_ms, [{', '.join(str(q) for _, q in _FIVE)}]) as q from audit group by all)
    select system, bucket, unnest([{', '.join(f"'{n}'" for n, _ in _FIVE)}]) as label, unnest(q) as exact, true as within_bound from c"""


def _five_near(spark: SparkSession, d: str, daily: DataFrame) -> DataFrame:
    """All five percentiles of the summary by digest, each held against the exact value."""
    summary = reports.latency_summary(percentiles(daily, DAILY, reports.SUMMARY_PERCENTILES), DAILY)
    names = ", ".join(f"{p}D, {percentile_label(p)}" for p in reports.SUMMARY_PERCENTILES)
    values = summary.selectExpr(*DAILY, f"stack({len(reports.SUMMARY_PERCENTILES)}, {names}) as (p, value)")
    rows = audit_events(spark, d).withColumn("bucket_start", bucket_start(F.col("ts"), "1d"))
    near = within_rank_error(rows, DAILY, "latency_ms", reports.SUMMARY_PERCENTILES, values)
    return labelled(near.withColumn("label", percentile_label_col(F.col("p"))).drop("p"), "1d")


@query("k07_latency_summary_digest", _FIVE_NEAR)
def k07_digest(spark: SparkSession, d: str) -> DataFrame:
    return _five_near(spark, d, coarsen(kll(), kll_rollup(audit_events(spark, d), "1h"), "1d"))


def _maintained(spark: SparkSession, d: str, structures: tuple[str, ...]) -> RollupStore:
    """A store that a stream of repeated, unordered events filled, compacted in between."""
    path = run_dir(spark, "reports")
    store = RollupStore(spark, f"{path}/store")
    for turn in (0, 1):
        jobs.maintain(resent(spark, d), store, f"{path}/checkpoint-{turn}")
        for structure in structures:
            store.compact(structure)
    return store


@query("k03_top_k_stored", ORACLES["k03_top_k_report"])
def k03_stored(spark: SparkSession, d: str) -> DataFrame:
    report = reports.top_items(_maintained(spark, d, ("topk",)).at("topk", "1h"), 10)
    return labelled(report.withColumn("items", ranked_text(F.col("items"))), "1h")


@query("k07_latency_stored", _FIVE_NEAR)
def k07_stored(spark: SparkSession, d: str) -> DataFrame:
    return _five_near(spark, d, _maintained(spark, d, ("kll",)).at("kll", "1d"))


@query("k08_snapshot_by_date", ORACLES["a11_read_snapshot"])
def k08(spark: SparkSession, d: str) -> DataFrame:
    """Snapshot of the newest date; a date without one gives no rows."""
    return QUERIES["a11_read_snapshot"](spark, d)


@query(
    "k09_dashboard_cards",
    f"""{_SUMMARY_SQL}
    select d.system, daily_unique_users as users_24h, coalesce(hourly_unique_users, 0) as users_1h,
      daily_unique_ips as ips_24h, coalesce(hourly_unique_sessions, 0) as sessions_1h from d left join h using (system)""",
)
def k09(spark: SparkSession, d: str) -> DataFrame:
    return reports.dashboard_cards(_summary(spark, d))


@query(
    "k10_failed_logins",
    f"""with {AUDIT}, {RANKED_VALUES}, {_RANKED.format(bucket=DAY)}
    select system, bucket, string_agg(item || '=' || cnt, ';' order by rank) as items
    from r where metric = 'failed_logins' and rank <= 10 group by all""",
)
def k10(spark: SparkSession, d: str) -> DataFrame:
    daily = coarsen_counts(topk_rollup(audit_events(spark, d), "1h"), "1d")
    report = reports.failed_logins(daily, DAILY, 10)
    return labelled(report.withColumn("items", ranked_text(F.col("items"))), "1d")


@query(
    "k11_storage_footprint",
    f"""with {AUDIT}, m as (with {MEMBER_VALUES} select * from vals), h as (with {DISTINCT_VALUES} select * from vals),
    t as (with {RANKED_VALUES} select * from vals)
    select 'hll' as structure, '1h' as "window", count(distinct metric || system || {HOUR}) as keys, count(distinct metric || system || {HOUR}) as rows, true as has_bytes from h
    union all select 'topk', '1h', count(distinct metric || system || {HOUR}), count(distinct metric || system || {HOUR} || value), true from t
    union all select 'member', '1h', count(distinct metric || system || {HOUR}), count(distinct metric || system || {HOUR} || value), true from m
    union all select 'kll', '1h', count(distinct system || {HOUR}), count(distinct system || {HOUR}), true from audit
    union all select 'moments', '1h', count(distinct system || {HOUR}), count(distinct system || {HOUR}), true from audit""",
)
def k11(spark: SparkSession, d: str) -> DataFrame:
    store = RollupStore(spark, run_dir(spark, "footprint"))
    events = audit_events(spark, d)
    store.write("hll", hll_rollup(events), 0)
    store.write("topk", topk_rollup(events), 0)
    store.write("member", members.member_rollup(events), 0)
    store.write("kll", kll_rollup(events), 0)
    store.write("moments", moments.moments_rollup(events), 0)
    return store.footprint().withColumn("has_bytes", F.col("bytes") > 0).drop("bytes")
