"""Answers from a store that batches and streams keep up to date, held against the raw events."""

from __future__ import annotations

from datetime import timedelta

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.catalog.common import AUDIT, DAY, HOUR, RANKED_VALUES, labelled, tidy_sql
from auditloom.catalog.compliance import _FIVE, _SUMMARY_SQL, DAILY, _maintained, _summary
from auditloom.catalog.distincts import BOUND
from auditloom.catalog.ingest import _ANSWERS, _QUESTIONS, known_members, questions
from auditloom.catalog.registry import ORACLES, query
from auditloom.catalog.streams import _CONTENT, _content, resent
from auditloom.functions.buckets import bucket_start, bucket_start_by
from auditloom.functions.numbers import percentile_label_col, ranked_text, tidy
from auditloom.operators import heavy
from auditloom.operators.compiled import MAINTAINED
from auditloom.operators.distinct import checked, exact_distinct, hll_rollup, present_in_all_stored
from auditloom.operators.heavy import topk_rollup
from auditloom.operators.quantiles import kll_rollup, percentiles, within_rank_error
from auditloom.operators.routing import RULES, MetricRule, rules_for, value_counts
from auditloom.plans import reports
from auditloom.schema import ROLLUP_SCHEMAS
from auditloom.session import materialize, run_dir, tune
from auditloom.sources.store import RollupStore
from auditloom.sources.tables import audit_events, latest_ts
from auditloom.streaming import jobs

STRUCTURES = tuple(ROLLUP_SCHEMAS)


def _middle(events: DataFrame):
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    return F.lit(low + (high - low) / 2)


# ---- batches that were cut short -----------------------------------------------------------
@query(
    "a06_read_ignores_half_batch",
    f"""with {AUDIT}, {RANKED_VALUES}, edge as (select min(ts) + (max(ts) - min(ts)) / 2 as middle from audit)
    select metric, system, {HOUR} as bucket, value as item, count(*) as cnt from vals, edge where ts < middle group by all""",
)
def a06_half(spark: SparkSession, d: str) -> DataFrame:
    """The second batch dies in one of its tables: what it wrote to the other is not seen."""
    store, events = RollupStore(spark, run_dir(spark, "half")), audit_events(spark, d)
    middle = _middle(events)
    store.write("topk", topk_rollup(events.where(F.col("ts") < middle)), 0)
    later = events.where(F.col("ts") >= middle)
    dies = hll_rollup(later).withColumn("n", F.when(F.col("n") > 0, F.raise_error(F.lit("crash")).cast("long")))
    try:
        store.write_batch({"topk": topk_rollup(later), "hll": dies}, 1)
    except PySparkException:
        pass
    else:
        raise AssertionError("the batch was to be cut short")
    return labelled(store.merged("topk").select("metric", "system", "bucket_start", "item", "cnt"), "1h")


@query("i04_crash_then_lost_checkpoint", f"with {AUDIT}, {_CONTENT}")
def i04_crash(spark: SparkSession, d: str) -> DataFrame:
    """A batch dies half-way, then its stream loses its checkpoint and sends all again."""
    store, events = RollupStore(spark, run_dir(spark, "crash")), audit_events(spark, d)
    parts = [events.where(F.col("event_id") % 3 == i) for i in range(3)]
    jobs.apply_batch(store, parts[0], 0, "first")
    # the moments of this batch cannot be computed; the other tables are written by then
    dies = MetricRule("moments", "broken", "raise_error('crash')", "true", ("1h",))
    try:
        jobs.apply_batch(store, parts[1], 1, "first", [*MAINTAINED, dies])
    except PySparkException:
        pass
    else:
        raise AssertionError("the batch was to be cut short")
    for batch in (1, 0, 2):
        jobs.apply_batch(store, parts[batch], batch, "second")
    return _content(spark, d, store)


# ---- filters -----------------------------------------------------------------------------
@query(
    "k02_activity_report_filter",
    f"""with {AUDIT}, {_QUESTIONS}, {_ANSWERS}
    select "window", system, count(*) as questions, count(*) filter (where accessed) as exact_yes, cast(0 as bigint) as false_no,
      true as false_yes_within_bound, true as probability_ok, cast(0 as bigint) as raw_values_stored
    from (select distinct a."window", a.system, q.user_id,
        case a."window" when '1d' then date_trunc('day', a.ts) else date_trunc('week', a.ts) end as b, accessed
      from answers a join questions q on q.event_id = a.event_id and q."window" = a."window") group by 1, 2""",
)
def k02_filter(spark: SparkSession, d: str) -> DataFrame:
    """Activity of a user, from filters that batches keep up to date and no stored ids."""
    store, events = RollupStore(spark, run_dir(spark, "filters")), audit_events(spark, d)
    rules = [r for r in rules_for("bloom", RULES) if r.metric == "user_activity"]
    for batch in range(2):
        jobs.apply_batch(store, events.where(F.col("event_id") % 2 == batch), batch, rules=rules)
    store.compact("bloom")
    asked = questions(events).select(
        F.lit("user_activity").alias("metric"), "system", "window", "user_id",
        bucket_start_by(F.col("ts"), F.col("window")).alias("bucket_start"),
    ).distinct()
    answered = None
    for window in ("1d", "1w"):
        part = reports.activity_from_filters(store.tiles("bloom", window), asked.where(F.col("window") == window), window)
        answered = part if answered is None else answered.unionByName(part)
    keys = ["system", "window", "bucket_start", "value"]
    truth = known_members(events).select(*keys, F.lit(True).alias("found"))
    both = answered.withColumn("value", F.concat_ws(":", "user_id", "system")).join(truth, keys, "left")
    exact = F.coalesce("found", F.lit(False))
    wrong = F.count_if(F.col("accessed") & ~exact)
    return both.groupBy("window", "system").agg(
        F.count(F.lit(1)).alias("questions"),
        F.count_if(exact).alias("exact_yes"),
        F.count_if(~F.col("accessed") & exact).alias("false_no"),
        # a week asks seven days of filters; ten times their rate leaves room for chance
        (wrong <= F.greatest(F.lit(2.0), 0.7 * F.count_if(~exact))).alias("false_yes_within_bound"),
        F.bool_and(
            F.when(F.col("accessed"), F.col("probability").between(0.9, 1.0)).otherwise(F.col("probability") == 1.0)
        ).alias("probability_ok"),
        F.lit(store.read("member", "1h").count() + store.read("topk", "1h").count()).cast("long").alias("raw_values_stored"),
    )


# ---- bounded counters ----------------------------------------------------------------------
_SLOTS = 15
# half of the events are of a few kinds, the others of a kind of their own
_ITEM = "case when event_id % 2 = 0 then event_type else concat('one-', cast(event_id as varchar(20))) end"


@query(
    "d28_bounded_with_error",
    f"""with {AUDIT}, c as (select system, {_ITEM} as item, count(*) as exact from audit group by all),
      n as (select system, sum(exact) as n from c group by 1)
    select system, item, exact, true as found, true as count_within_error, true as error_within_bound, true as state_bounded
    from c join n using (system) where exact * {_SLOTS + 1} > n""",
)
def d28_error(spark: SparkSession, d: str) -> DataFrame:
    """Far more items than counters (a hundred times from sf0.01 on), kept by day and added up."""
    store, events = RollupStore(spark, run_dir(spark, "counters")), audit_events(spark, d)
    rule = MetricRule("heavy", "kinds", _ITEM, "true", ("1d",))
    for batch in range(3):
        part = events.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == batch)
        store.write("heavy", heavy.counter_rollup(part, "1d", [rule], _SLOTS), batch)
    store.compact("heavy")
    keys = ["metric", "system"]
    total = materialize(heavy.counter_merge(store.merged("heavy", "1d"), keys, _SLOTS), "counters")
    bounds = heavy.counter_bounds(total, keys)
    exact = materialize(
        events.groupBy("system", F.expr(_ITEM).alias("item")).agg(F.count(F.lit(1)).alias("exact")), "exact"
    )
    sizes = exact.groupBy("system").agg(F.sum("exact").alias("n"))
    state = total.groupBy("system").agg(
        F.count("item").alias("kept"), F.max(F.when(F.col("item").isNull(), F.col("cnt"))).alias("left_out")
    )
    wanted = exact.join(sizes, "system").where(F.col("exact") * (_SLOTS + 1) > F.col("n"))
    found = wanted.join(bounds.drop("metric"), ["system", "item"], "left").join(state, "system")
    inside = F.col("exact").between(F.col("low"), F.col("high"))
    return found.select(
        "system", "item", "exact", F.col("low").isNotNull().alias("found"),
        F.coalesce(inside, F.lit(False)).alias("count_within_error"),
        (F.col("left_out") * (_SLOTS + 1) <= F.col("n")).alias("error_within_bound"),
        (F.col("kept") <= _SLOTS).alias("state_bounded"),
    )


@query(
    "i02_stream_bounded_counters",
    f"""with {AUDIT}, c as (select system, {DAY} as bucket, user_id as item, count(*) as exact from audit group by all),
      n as (select system, bucket, sum(exact) as n from c group by all)
    select system, bucket, item, exact, true as within_error from c join n using (system, bucket) where exact * {heavy.SLOTS + 1} > n""",
)
def i02_counters(spark: SparkSession, d: str) -> DataFrame:
    """Heavy users by day from counters that a stream of repeated events keeps up to date."""
    path = run_dir(spark, "heavy")
    store = RollupStore(spark, f"{path}/store")
    rule = MetricRule("heavy", "users", "user_id", "user_id is not null", ("1h", "1d"))
    jobs.maintain(resent(spark, d), store, f"{path}/checkpoint", [rule])
    bounds = heavy.counter_bounds(store.at("heavy", "1d"), ["system", "bucket_start"])
    rows = audit_events(spark, d).withColumn("bucket_start", bucket_start(F.col("ts"), "1d"))
    exact = materialize(
        rows.groupBy("system", "bucket_start", F.col("user_id").alias("item")).agg(F.count(F.lit(1)).alias("exact")), "exact"
    )
    sizes = exact.groupBy("system", "bucket_start").agg(F.sum("exact").alias("n"))
    wanted = exact.join(sizes, ["system", "bucket_start"]).where(F.col("exact") * (heavy.SLOTS + 1) > F.col("n"))
    both = wanted.join(bounds, ["system", "bucket_start", "item"], "left")
    inside = F.coalesce(F.col("exact").between(F.col("low"), F.col("high")), F.lit(False))
    return labelled(both.select("system", "bucket_start", "item", "exact", inside.alias("within_error")), "1d")


# ---- reset ---------------------------------------------------------------------------------
@query(
    "d48_reset",
    f"""with {AUDIT}, {RANKED_VALUES}, edge as (select min(ts) + (max(ts) - min(ts)) / 2 as middle from audit)
    select metric, system, {DAY} as bucket, value as item, count(*) as cnt from vals, edge
    where ts >= middle or metric <> 'active_users' and system <> 'staging_db' group by all""",
)
def d48_reset(spark: SparkSession, d: str) -> DataFrame:
    """One metric and one system start anew; the old batch, sent again, adds nothing."""
    store, events = RollupStore(spark, run_dir(spark, "reset")), audit_events(spark, d)
    middle = _middle(events)
    early, late = topk_rollup(events.where(F.col("ts") < middle), "1d"), topk_rollup(events.where(F.col("ts") >= middle), "1d")
    store.write("topk", early, 0)
    store.reset("topk", metric="active_users")
    store.reset("topk", system="staging_db")
    store.write("topk", early, 0)
    store.write("topk", late, 1)
    store.compact("topk")
    store.write("topk", early, 0)
    return labelled(store.merged("topk", "1d").select("metric", "system", "bucket_start", "item", "cnt"), "1d")


# ---- rules of any structure ------------------------------------------------------------------
_SLOW, _API = "latency_ms > 50", "event_type = 'api_access'"
CUSTOM = (
    MetricRule("topk", "slow_endpoints", "endpoint", f"endpoint is not null and {_SLOW}", ("1h", "1d")),
    MetricRule("heavy", "slow_users", "user_id", _SLOW, ("1h", "1d")),
    MetricRule("member", "slow_ips", "ip", f"ip is not null and {_SLOW}", ("1d",)),
    MetricRule("hll", "slow_sessions", "session_id", f"session_id is not null and {_SLOW}", ("1h", "1d")),
    MetricRule("theta", "api_users", "user_id", _API, ("1h", "1d")),
    MetricRule("kll", "api_latency", "latency_ms", _API, ("1h", "1d")),
    MetricRule("kll", "slow_latency", "latency_ms", _SLOW, ("1h", "1d")),
    MetricRule("moments", "excess", "latency_ms - 50", _SLOW, ("1h", "1d")),
)


@query(
    "j02_custom_metric_maintained",
    f"""with {AUDIT}
    select 'topk' as structure, 'slow_endpoints' as metric, system, {DAY} as bucket, endpoint as item, cast(count(*) as double) as number, true as near
      from audit where endpoint is not null and {_SLOW} group by all
    union all select 'heavy', 'slow_users', system, {DAY}, user_id, cast(count(*) as double), true from audit where {_SLOW} group by all
    union all select 'member', 'slow_ips', system, {DAY}, '', cast(count(distinct ip) as double), true from audit where ip is not null and {_SLOW} group by all
    union all select 'hll', 'slow_sessions', system, {DAY}, '', cast(count(distinct session_id) as double), true
      from audit where session_id is not null and {_SLOW} group by all
    union all select 'theta', 'api_users', system, {DAY}, '', cast(count(distinct user_id) as double), true from audit where {_API} group by all
    union all select 'kll', 'api_latency', system, {DAY}, 'n', cast(count(*) as double), true from audit where {_API} group by all
    union all select 'kll', 'slow_latency', system, {DAY}, 'n', cast(count(*) as double), true from audit where {_SLOW} group by all
    union all select 'moments', 'excess', system, {DAY}, 'n', cast(count(*) as double), true from audit where {_SLOW} group by all
    union all select 'moments', 'excess', system, {DAY}, 'mean', {tidy_sql('avg(latency_ms - 50)', 6)}, true from audit where {_SLOW} group by all
    union all select 'moments', 'excess', system, {DAY}, 'var_pop', {tidy_sql('var_pop(latency_ms)', 4)}, true from audit where {_SLOW} group by all""",
)
def j02_maintained(spark: SparkSession, d: str) -> DataFrame:
    """New metrics of every structure are rules; batches carry them, days add up the hours."""
    store, events = RollupStore(spark, run_dir(spark, "custom")), audit_events(spark, d)
    for batch in (0, 1, 0):
        jobs.apply_batch(store, events.where(F.col("event_id") % 2 == batch), batch, rules=CUSTOM)
        for structure in STRUCTURES[batch::2]:
            store.compact(structure)
    keys = ["metric", "system", "bucket_start"]
    day = {structure: store.at(structure, "1d") for structure in ("topk", "member", "kll", "moments")}
    distinct = value_counts(events, [MetricRule("hll", r.metric, r.value, r.condition, r.windows) for r in CUSTOM if r.structure in ("hll", "theta")], "1d")
    truth = materialize(distinct.groupBy(*keys).agg(F.count_distinct("value").alias("exact")), "truth")
    sketched = {
        "hll": store.at("hll", "1d").withColumn("estimate", F.hll_sketch_estimate("sketch")),
        "theta": store.at("theta", "1d").withColumn("estimate", F.theta_sketch_estimate("sketch")),
    }
    counters = heavy.counter_bounds(store.at("heavy", "1d"), keys)
    spread = heavy_free = F.lit(True)
    number = lambda c: F.col(c).cast("double").alias("number")
    states = day["moments"].withColumn("var", tidy(F.col("m2") / F.col("n"), 4)).withColumn("mean", tidy(F.col("m1"), 6))
    parts = [
        ("topk", day["topk"].select(*keys, "item", number("cnt"), spread.alias("near"))),
        ("heavy", counters.select(*keys, "item", number("low"), (F.col("low") == F.col("high")).alias("near"))),
        ("member", day["member"].groupBy(*keys).agg(F.sum(F.lit(1.0)).alias("number")).select(*keys, F.lit("").alias("item"), "number", heavy_free.alias("near"))),
        ("kll", day["kll"].select(*keys, F.lit("n").alias("item"), number("n"), spread.alias("near"))),
    ]
    for structure, rows in sketched.items():
        found = checked(rows, truth.join(rows.select("metric").distinct(), "metric", "left_semi"), keys, BOUND)
        parts.append((structure, found.select(*keys, F.lit("").alias("item"), number("exact"), F.col("within_bound").alias("near"))))
    for item, column in (("n", "n"), ("mean", "mean"), ("var_pop", "var")):
        parts.append(("moments", states.select(*keys, F.lit(item).alias("item"), number(column), spread.alias("near"))))
    out = None
    for structure, rows in parts:
        part = rows.select(F.lit(structure).alias("structure"), *keys, "item", "number", "near")
        out = part if out is None else out.unionByName(part)
    return labelled(out, "1d")


# ---- intersections ---------------------------------------------------------------------------
@query(
    "d11_present_in_all_stored",
    f"""with {AUDIT}, w as (select *, {DAY} as bucket from audit where user_id <> ''),
      c as (select bucket, user_id from w group by 1, 2 having count(distinct system) = 3),
      s as (select system, user_id from w group by 1, 2 having count(distinct bucket) >= 1),
      a as (select user_id from s group by 1 having count(*) = 3)
    select bucket, count(*) as exact, true as within_bound, cast(3 as bigint) as groups from c group by 1
    union all select 'all', count(*), true, 3 from a""",
)
def d11_stored(spark: SparkSession, d: str) -> DataFrame:
    """Users seen on every system, by day and over all days, from stored sketches."""
    store, events = RollupStore(spark, run_dir(spark, "theta")), audit_events(spark, d)
    rule = MetricRule("theta", "users", "user_id", "user_id is not null and user_id <> ''", ("1h",))
    for batch in range(2):
        jobs.apply_batch(store, events.where(F.col("event_id") % 2 == batch), batch, rules=[rule])
    store.compact("theta")
    daily = materialize(store.at("theta", "1d"), "daily")
    n = daily.select("system").distinct().count()
    by_day = present_in_all_stored(daily, "system", ["bucket_start"], n)
    over_all = present_in_all_stored(daily, "system", [], n)
    bucket = F.date_format("bucket_start", "yyyy-MM-dd").alias("bucket")
    found = by_day.select(bucket, "estimate", "groups").unionByName(over_all.select(F.lit("all").alias("bucket"), "estimate", "groups"))
    users = events.where("user_id <> ''").select("system", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("bucket"))
    everywhere = lambda df, *k: df.groupBy(*k, "user_id").agg(F.count_distinct("system").alias("c")).where(F.col("c") == n)
    exact = everywhere(users, "bucket").groupBy("bucket").agg(F.count(F.lit(1)).alias("exact")).unionByName(
        everywhere(users).agg(F.count(F.lit(1)).alias("exact")).withColumn("bucket", F.lit("all"))
    )
    both = checked(found, exact, ["bucket"], BOUND)
    return both.where("exact is not null").join(found.select("bucket", "groups"), "bucket", "left")


# ---- reports from a maintained store -----------------------------------------------------------
_TIMES = ("users", "sessions", "ips")


def _summary_stored(spark: SparkSession, d: str) -> DataFrame:
    """The summary from a store that a stream filled; only the asked hour and day are opened."""
    store = _maintained(spark, d, ("hll", "topk"))
    as_of = latest_ts(audit_events(spark, d))
    day = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    hours = reports.distinct_counts(store.merged("hll", "1h", start=as_of, end=as_of))
    days = reports.distinct_counts(store.at("hll", "1d", start=day, end=day))
    return reports.system_summary(hours, days, store.merged("topk", "1h", start=as_of, end=as_of), as_of, 10)


def _near(column: str, exact: str):
    gap = F.abs(F.col(column) - F.col(exact))
    return gap <= F.greatest(F.lit(BOUND) * F.col(exact), F.lit(0.5))


@query(
    "k04_system_summary_stored",
    f"""{_SUMMARY_SQL}
    select d.system, daily_unique_users, daily_unique_sessions, daily_unique_ips, coalesce(hourly_unique_users, 0) as hourly_unique_users,
      coalesce(hourly_unique_sessions, 0) as hourly_unique_sessions, coalesce(hourly_unique_ips, 0) as hourly_unique_ips,
      top_users, top_ips, true as within_bound
    from d left join h using (system) left join tu using (system) left join ti using (system), edge""",
)
def k04_stored(spark: SparkSession, d: str) -> DataFrame:
    """The summary from the store, each count held against the exact one."""
    stored, exact = _summary_stored(spark, d), _summary(spark, d)
    counts = [f"{span}_unique_{what}" for span in ("daily", "hourly") for what in _TIMES]
    both = stored.withColumnsRenamed({c: f"s_{c}" for c in counts}).drop("as_of").join(
        exact.select("system", *counts), "system", "full_outer"
    )
    near = F.lit(True)
    for c in counts:
        near &= F.coalesce(_near(f"s_{c}", c), F.lit(False))
    return both.select(
        "system", *counts, ranked_text(F.col("top_users")).alias("top_users"),
        ranked_text(F.col("top_ips")).alias("top_ips"), near.alias("within_bound"),
    )


@query("k09_dashboard_cards_stored", ORACLES["k09_dashboard_cards"].replace("as sessions_1h", "as sessions_1h, true as within_bound"))
def k09_stored(spark: SparkSession, d: str) -> DataFrame:
    """The four numbers of a card from the store, each held against the exact one."""
    cards = [reports.dashboard_cards(s) for s in (_summary_stored(spark, d), _summary(spark, d))]
    names = [c for c in cards[0].columns if c != "system"]
    both = cards[0].withColumnsRenamed({c: f"s_{c}" for c in names}).join(cards[1], "system", "full_outer")
    near = F.lit(True)
    for c in names:
        near &= F.coalesce(_near(f"s_{c}", c), F.lit(False))
    return both.select("system", *names, near.alias("within_bound"))


@query("k10_failed_logins_stored", ORACLES["k10_failed_logins"])
def k10_stored(spark: SparkSession, d: str) -> DataFrame:
    """Failed logins by day from the hours of a maintained store."""
    report = reports.failed_logins(_maintained(spark, d, ("topk",)).at("topk", "1d"), DAILY, 10)
    return labelled(report.withColumn("items", ranked_text(F.col("items"))), "1d")


@query("k01_distinct_count_stored", ORACLES["k01_distinct_count_report"])
def k01_stored(spark: SparkSession, d: str) -> DataFrame:
    """Distinct counts by day from the hours of a maintained store."""
    report = reports.distinct_counts(_maintained(spark, d, ("hll",)).at("hll", "1d")).withColumnRenamed("count", "estimate")
    keys = ["metric", "system", "window", "bucket_start"]
    base = value_counts(audit_events(spark, d), rules_for("hll"), "1d")
    result = checked(report, exact_distinct(base, keys), keys, BOUND)
    return labelled(result.join(report.select(*keys, "accuracy"), keys), "1d")


@query("k05_percentile_report_stored", ORACLES["k05_percentile_report_digest"])
def k05_stored(spark: SparkSession, d: str) -> DataFrame:
    """The percentile report by day from the hours of a maintained store."""
    report = reports.percentile_report(_maintained(spark, d, ("kll",)).at("kll", "1d"))
    values = report.select(*DAILY, F.explode("percentiles").alias("label", "value"))
    values = values.withColumn("p", F.substring("label", 2, 9).cast("double"))
    rows = audit_events(spark, d).withColumn("bucket_start", bucket_start(F.col("ts"), "1d"))
    near = within_rank_error(rows, DAILY, "latency_ms", reports.DEFAULT_PERCENTILES, values)
    return labelled(near.withColumn("label", percentile_label_col(F.col("p"))).drop("p"), "1d")


# every line item is an event of one day: many more values a key than a digest has room for

@query(
    "k07_latency_stored_large",
    f"""with c as (select l_returnflag as system, quantile_disc(l_extendedprice, [{', '.join(str(q) for _, q in _FIVE)}]) as q,
        count(*) as n from lineitem group by 1)
    select system, unnest([{', '.join(f"'{n}'" for n, _ in _FIVE)}]) as label, unnest(q) as exact, n, true as within_bound from c""",
)
def k07_large(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of large keys after batches were merged, compacted and moved to days."""
    lines = tune(spark).read.parquet(f"{d}/lineitem.parquet").select(
        F.col("l_returnflag").alias("system"), F.col("l_extendedprice").alias("latency_ms"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("l_orderkey") % 24 * 3600).alias("ts"),
        F.pmod(F.xxhash64("l_orderkey"), F.lit(2)).alias("half"),
    )
    store = RollupStore(spark, run_dir(spark, "large"))
    for batch in range(2):
        store.write("kll", kll_rollup(lines.where(F.col("half") == batch)), batch)
    store.compact("kll")
    store.expire("kll", latest_ts(lines) + timedelta(days=30))
    daily = store.at("kll", "1d")
    rows = lines.withColumn("bucket_start", bucket_start(F.col("ts"), "1d"))
    values = percentiles(daily, DAILY, reports.SUMMARY_PERCENTILES)
    near = within_rank_error(rows, DAILY, "latency_ms", reports.SUMMARY_PERCENTILES, values)
    return near.join(daily.select(*DAILY, "n"), DAILY).select(
        "system", percentile_label_col(F.col("p")).alias("label"), "exact", "n", "within_bound"
    )
