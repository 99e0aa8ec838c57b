"""Continuous operators, run over all events until nothing is left: A08, I01 to I07."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.catalog.common import (
    AUDIT, DAY, DISTINCT_VALUES, HOUR, INGESTED, MEMBER_VALUES, RANKED_VALUES, STAMP, at_window,
    labelled, raw_records, stamp, tidy_sql,
)
from auditloom.catalog.distincts import BOUND
from auditloom.catalog.registry import query
from auditloom.functions.buckets import bucket_start
from auditloom.functions.numbers import tidy
from auditloom.operators.distinct import checked, exact_distinct
from auditloom.operators.heavy import top_k
from auditloom.operators.routing import RULES, rules_for, value_counts
from auditloom.schema import ROLLUP_SCHEMAS
from auditloom.session import run_dir, tune
from auditloom.sources.records import stream_lines
from auditloom.sources.store import RollupStore
from auditloom.sources.tables import (
    EVENTS_SCHEMA, audit_events, raw_events, raw_events_stream, to_audit_events, with_metadata,
)
from auditloom.streaming import jobs

DELAY = "10 minutes"
STRUCTURES = tuple(ROLLUP_SCHEMAS)


def _closed(window: str) -> str:
    """SQL filter: the window ended before the final watermark."""
    return (
        f"date_trunc('{window}', ts) + interval 1 {window} <= "
        "(select date_trunc('milliseconds', max(ts)) - interval 10 minutes from events)"
    )


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return to_audit_events(raw_events_stream(spark, d))


def resent(spark: SparkSession, d: str) -> DataFrame:
    """All events as a stream of several files, out of order, and everything sent twice."""
    root = run_dir(spark, "feed")
    for attempt in (0, 1):
        raw_events(spark, d).repartition(F.col("event_id")).write.parquet(f"{root}/attempt={attempt}")
    # about four batches, however much data there is
    files = len(spark.read.schema(EVENTS_SCHEMA).parquet(root).inputFiles())
    raw = (
        tune(spark).readStream.schema(EVENTS_SCHEMA).option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", -(-files // 4)).parquet(root)
    )
    return to_audit_events(raw)


def _exact_users(spark: SparkSession, d: str, window: str) -> DataFrame:
    rows = audit_events(spark, d).withColumn("bucket_start", bucket_start(F.col("ts"), window))
    return rows.groupBy("system", "bucket_start").agg(F.count_distinct("user_id").alias("exact"))


def _checked_stream(spark: SparkSession, d: str, rows: DataFrame, window: str) -> DataFrame:
    keys = ["system", "bucket_start"]
    found = rows.withColumn("estimate", F.hll_sketch_estimate("users"))
    # the batch side answers for the windows the stream has closed
    exact = _exact_users(spark, d, window).join(rows.select(*keys), keys, "left_semi")
    return labelled(checked(found, exact, keys, BOUND).join(found.select(*keys, "n"), keys), window)


@query(
    "a08_subscribe_feed",
    f"with {AUDIT} select event_type, system, user_id, {STAMP} as ts, ip, endpoint from audit",
)
def a08(spark: SparkSession, d: str) -> DataFrame:
    path = run_dir(spark, "live")
    jobs.publish(with_metadata(_stream(spark, d)), f"{path}/feed", f"{path}/checkpoint")
    rows = jobs.to_table(jobs.subscribe(spark, f"{path}/feed"), "subscriber")
    field = F.col("metadata").getItem
    return rows.select(
        "event_type", "system", "user_id", stamp().alias("ts"),
        field("ip").alias("ip"), field("endpoint").alias("endpoint"),
    )


@query(
    "a01_ingest_stream",
    f"""with {AUDIT}, {INGESTED}
    select event_id, event_type, system, user_id, ip, latency_ms, coalesce(reject_reason, 'accepted') as outcome
    from ingested where reject_reason is null
    union all
    select null, null, null, null, null, cast(count(*) as double), reject_reason from ingested
    where reject_reason is not null group by reject_reason""",
)
def a01_stream(spark: SparkSession, d: str) -> DataFrame:
    path = run_dir(spark, "ingest")
    raw_records(spark, d).select("value").write.text(f"{path}/lines")
    jobs.ingest(stream_lines(spark, f"{path}/lines"), path, f"{path}/checkpoint")
    valid = spark.read.parquet(f"{path}/events").select(
        "event_id", "event_type", "system", "user_id", "ip", "latency_ms", F.lit("accepted").alias("outcome")
    )
    bad = spark.read.parquet(f"{path}/rejects").groupBy(F.col("reject_reason").alias("outcome")).agg(
        F.count(F.lit(1)).cast("double").alias("latency_ms")
    )
    return valid.unionByName(bad, allowMissingColumns=True)


@query(
    "i01_stream_tumbling",
    f"""with {AUDIT} select system, {HOUR} as bucket, count(distinct user_id) as exact, count(*) as n, true as within_bound
    from audit where {_closed('hour')} group by all""",
)
def i01(spark: SparkSession, d: str) -> DataFrame:
    rows = jobs.to_table(jobs.tumbling(_stream(spark, d), "1h", DELAY), "tumbling")
    return _checked_stream(spark, d, rows, "1h")


@query(
    "i01_stream_tumbling_weeks",
    f"""with {AUDIT} select system, strftime(ts, '%G-W%V') as bucket, count(distinct user_id) as exact, count(*) as n, true as within_bound
    from audit where {_closed('week')} group by all""",
)
def i01_weeks(spark: SparkSession, d: str) -> DataFrame:
    rows = jobs.to_table(jobs.tumbling(_stream(spark, d), "1w", DELAY), "tumbling")
    return _checked_stream(spark, d, rows, "1w")


@query(
    "i02_stream_heavy_hitters",
    f"""with {AUDIT}, c as (select system, {DAY} as bucket, user_id as item, count(*) as cnt from audit where {_closed('day')} group by all)
    select system, bucket, item, cnt, cast(rank as integer) as rank from (
      select *, row_number() over (partition by system, bucket order by cnt desc, item) as rank from c) where rank <= 10""",
)
def i02(spark: SparkSession, d: str) -> DataFrame:
    counts = jobs.to_table(jobs.item_counts(_stream(spark, d), "user_id", "1d", DELAY), "items")
    return labelled(top_k(counts, ["system", "bucket_start"], 10), "1d")


@query(
    "i03_stream_hours_to_days",
    f"""with {AUDIT} select system, {DAY} as bucket, count(distinct user_id) as exact, count(*) as n, true as within_bound
    from audit where {_closed('day')} group by all""",
)
def i03(spark: SparkSession, d: str) -> DataFrame:
    rows = jobs.to_table(jobs.hours_to_days(_stream(spark, d), DELAY), "days")
    return _checked_stream(spark, d, rows, "1d")


@query(
    "i04_stream_rollup_maintenance",
    f"""with {AUDIT}, m as (with {MEMBER_VALUES} select * from vals), h as (with {DISTINCT_VALUES} select * from vals),
    t as (with {RANKED_VALUES} select * from vals)
    select 'hll' as structure, metric, system, {DAY} as bucket, count(*) as n from h group by all
    union all select 'topk', metric, system, {DAY}, count(*) from t group by all
    union all select 'member', metric, system, {DAY}, count(distinct value || ' ' || {HOUR}) from m group by all
    union all select 'kll', 'api_latency', system, {DAY}, count(latency_ms) from audit group by all
    union all select 'moments', 'api_latency', system, {DAY}, count(latency_ms) from audit group by all""",
)
def i04(spark: SparkSession, d: str) -> DataFrame:
    path = run_dir(spark, "maintained")
    store = RollupStore(spark, f"{path}/store")
    jobs.maintain(resent(spark, d), store, f"{path}/checkpoint")
    parts = []
    for structure, n in (
        ("hll", "n"), ("topk", "cnt"), ("member", "1"), ("kll", "n"), ("moments", "n"),
    ):
        daily = at_window(store.merged(structure), "1d")
        parts.append(
            daily.groupBy("metric", "system", "bucket_start").agg(F.sum(F.expr(n)).alias("n"))
            .withColumn("structure", F.lit(structure))
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return labelled(out, "1d")


@query(
    "i05_stream_running_statistics",
    f"""with {AUDIT}, s as (select system, count(*) as n, avg(latency_ms) as mean, var_pop(latency_ms) as var_pop,
        kurtosis_pop(latency_ms) as kurtosis from audit group by 1)
    select system, n, {tidy_sql('mean', 6)} as mean, {tidy_sql('var_pop', 6)} as var_pop, {tidy_sql('kurtosis', 6)} as kurtosis from s""",
)
def i05(spark: SparkSession, d: str) -> DataFrame:
    path = run_dir(spark, "running")
    stats = jobs.running_statistics(_stream(spark, d), f"{path}/states", f"{path}/checkpoint")
    return stats.select("system", "n", *[tidy(F.col(c), 6).alias(c) for c in ("mean", "var_pop", "kurtosis")])


@query(
    "i06_stream_deduplication",
    f"with {AUDIT} select event_id, system, user_id from audit",
)
def i06(spark: SparkSession, d: str) -> DataFrame:
    rows = jobs.to_table(
        jobs.deduplicated(resent(spark, d), "90 days").select("event_id", "system", "user_id"), "unique"
    )
    return rows


@query(
    "i07_stream_live_feed",
    f"""with {AUDIT}
    select '{{"event_type":"' || event_type || '","system":"' || system || '","user_id":"' || user_id
      || '","timestamp":"' || {STAMP} || '","metadata":{{'
      || concat_ws(',', '"ip":"' || ip || '"', '"endpoint":"' || endpoint || '"',
                   '"status_code":"' || status_code || '"') || '}}}}' as value
    from audit""",
)
def i07(spark: SparkSession, d: str) -> DataFrame:
    path = run_dir(spark, "live")
    jobs.publish(with_metadata(_stream(spark, d)), f"{path}/feed", f"{path}/checkpoint")
    return spark.read.text(f"{path}/feed")


# What a maintained store answers for days: item counts, numbers of members, moments and
# distinct counts (the exact number, and whether the sketch is near it).
_CONTENT = f"""m as (with {MEMBER_VALUES} select * from vals), h as (with {DISTINCT_VALUES} select * from vals),
    t as (with {RANKED_VALUES} select * from vals)
    select 'topk' as structure, metric, system, {DAY} as bucket, value as item, cast(count(*) as double) as number, true as near
      from t group by all
    union all select 'member', metric, system, {DAY}, '', cast(count(distinct value) as double), true from m group by all
    union all select 'hll', metric, system, {DAY}, '', cast(count(distinct value) as double), true from h group by all
    union all select 'moments', 'api_latency', system, {DAY}, 'n', cast(count(latency_ms) as double), true from audit group by all
    union all select 'moments', 'api_latency', system, {DAY}, 'mean', {tidy_sql('avg(latency_ms)', 6)}, true from audit group by all"""


def _content(spark: SparkSession, d: str, store: RollupStore) -> DataFrame:
    keys = ["metric", "system", "bucket_start"]
    truth = exact_distinct(value_counts(audit_events(spark, d), rules_for("hll", RULES), "1d"), keys)
    sketches = store.at("hll", "1d").withColumn("estimate", F.hll_sketch_estimate("sketch"))
    hll = checked(sketches, truth, keys, BOUND)
    one = F.lit(1.0)
    moments = store.at("moments", "1d")
    parts = [
        ("topk", store.at("topk", "1d").select(*keys, "item", F.col("cnt").cast("double").alias("number"))),
        ("member", store.at("member", "1d").groupBy(*keys).agg(F.sum(one).alias("number"))),
        ("hll", hll.select(*keys, F.col("exact").cast("double").alias("number"), F.col("within_bound").alias("near"))),
        ("moments", moments.select(*keys, F.lit("n").alias("item"), F.col("n").cast("double").alias("number"))),
        ("moments", moments.select(*keys, F.lit("mean").alias("item"), tidy(F.col("m1"), 6).alias("number"))),
    ]
    out = None
    for structure, rows in parts:
        item = F.col("item") if "item" in rows.columns else F.lit("")
        near = F.coalesce("near", F.lit(False)) if "near" in rows.columns else F.lit(True)
        part = rows.select(F.lit(structure).alias("structure"), *keys, item.alias("item"), "number", near.alias("near"))
        out = part if out is None else out.unionByName(part)
    return labelled(out, "1d")


@query("i04_stream_null_ids", f"with {AUDIT}, {_CONTENT}")
def i04_null_ids(spark: SparkSession, d: str) -> DataFrame:
    """A third of the events bring no id: all of them count."""
    path = run_dir(spark, "null-ids")
    store = RollupStore(spark, f"{path}/store")
    some = F.when(F.col("event_id") % 3 != 1, F.col("event_id"))
    jobs.maintain(_stream(spark, d).withColumn("event_id", some), store, f"{path}/checkpoint")
    return _content(spark, d, store)


@query("i04_stream_two_sources", f"with {AUDIT}, {_CONTENT}")
def i04_two_sources(spark: SparkSession, d: str) -> DataFrame:
    """Two streams feed one store; then one of them loses its checkpoint and starts again."""
    path = run_dir(spark, "two-sources")
    store = RollupStore(spark, f"{path}/store")
    for name, half in (("a", 0), ("b", 1), ("a-again", 0)):
        part = _stream(spark, d).where(F.col("event_id") % 2 == half)
        jobs.maintain(part, store, f"{path}/checkpoint-{name}")
    return _content(spark, d, store)


@query("i04_retry_after_compaction", f"with {AUDIT}, {_CONTENT}")
def i04_retry(spark: SparkSession, d: str) -> DataFrame:
    """Batches run again after a compaction has folded them change nothing."""
    store = RollupStore(spark, run_dir(spark, "retry"))
    events = audit_events(spark, d)
    parts = [events.where(F.col("event_id") % 3 == i) for i in range(3)]
    for batch in (0, 1):
        jobs.apply_batch(store, parts[batch], batch)
    for structure in STRUCTURES:
        store.compact(structure)
    for batch in (1, 0, 2):
        jobs.apply_batch(store, parts[batch], batch)
    return _content(spark, d, store)
