"""Inputs and SQL fragments that several registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.buckets import bucket_label, bucket_start
from auditloom.operators.routing import RULES, rules_for, value_counts
from auditloom.session import materialize
from auditloom.sources.records import to_records
from auditloom.sources.tables import audit_events, with_metadata

# ---- SQL: the audit events of the events table ---------------------------------
AUDIT = """audit as (
  select event_id, ts,
    case event_type when 'signup' then 'user_login' when 'click' then 'api_access'
      when 'view' then 'file_access' when 'purchase' then 'database_access'
      when 'error' then 'security_event' else 'custom' end as event_type,
    concat('user', cast(user_id as varchar)) as user_id,
    case when event_type = 'error' then null
      else concat(cast(user_id as varchar), '-', strftime(ts, '%Y-%m-%d')) end as session_id,
    case event_id % 3 when 0 then 'production_db' when 1 then 'staging_db'
      else 'api_gateway' end as system,
    case when event_id % 10 = 0 then null
      else concat('10.0.0.', regexp_extract(props, '[0-9]+', 0)) end as ip,
    case when event_type = 'click'
      then concat('/api/', cast(cast(regexp_extract(props, '[0-9]+', 0) as integer) % 10 as varchar)) end as endpoint,
    case when event_type = 'error' and event_id % 2 = 0 then '401' end as status_code,
    value as latency_ms
  from events)"""

# values of the distinct metrics, of the membership metrics and of the ranked metrics
DISTINCT_VALUES = """vals as (
  select 'users' as metric, system, ts, user_id as value from audit where user_id <> ''
  union all select 'sessions', system, ts, session_id from audit where session_id <> ''
  union all select 'ips', system, ts, ip from audit where ip is not null)"""
MEMBER_VALUES = """vals as (
  select 'user_activity' as metric, system, ts, user_id || ':' || system as value from audit where user_id <> ''
  union all select 'ip_activity', system, ts, ip from audit where ip is not null)"""
RANKED_VALUES = """vals as (
  select 'active_users' as metric, system, ts, user_id as value from audit where user_id <> ''
  union all select 'active_ips', system, ts, ip from audit where ip is not null
  union all select 'event_types', system, ts, event_type from audit
  union all select 'endpoints', system, ts, endpoint from audit where endpoint is not null
  union all select 'failed_logins', system, ts, coalesce(ip, 'unknown') from audit
    where event_type = 'security_event' and status_code is not null)"""

HOUR = "strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:00:00')"
DAY = "strftime(ts, '%Y-%m-%d')"
WEEK = "strftime(ts, '%G-W%V')"
MONTH = "strftime(ts, '%Y-%m')"


def tidy_sql(value: str, places: int) -> str:
    """SQL twin of ``functions.numbers.tidy``."""
    return f"cast(round(cast(round({value}, 9) as decimal(30, 9)), {places}) as double)"


def md5_bits_sql(source: str, keys: str, value: str, hashes: int, blocks: int) -> str:
    """SQL rows ``(keys, block, lane, bit)``: what each value of a relation sets in a filter."""
    block = f"('0x' || substr(md5({value}), 1, 15))::bigint % {blocks}"
    bit = f"(('0x' || substr(md5({value}), 16, 15))::bigint >> (6 * lane)) & 63"
    return (
        f"select {keys}, {block} as block, lane, {bit} as bit "
        f"from {source}, (select unnest(range({hashes})) as lane)"
    )


# ---- Spark inputs ---------------------------------------------------------------
def hourly_values(spark: SparkSession, sf_dir: str, structure: str) -> DataFrame:
    """Value counts per metric, system and hour."""
    return value_counts(audit_events(spark, sf_dir), rules_for(structure, RULES), "1h")


def stored_values(spark: SparkSession, sf_dir: str, structure: str) -> DataFrame:
    """:func:`hourly_values` as a table, for queries that read it more than once."""
    return materialize(hourly_values(spark, sf_dir, structure), "values")


def labelled(df: DataFrame, window: str, column: str = "bucket_start") -> DataFrame:
    """Replace the bucket start by its text name."""
    return df.withColumn("bucket", bucket_label(F.col(column), window)).drop(column)


def at_window(df: DataFrame, window: str) -> DataFrame:
    """Move hourly rows to the start of a longer window."""
    return df.withColumn("bucket_start", bucket_start(F.col("bucket_start"), window))


def stamp(column: str = "ts"):
    """Timestamp as text with microseconds."""
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


STAMP = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')"


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as the JSON text a producer would send, some of it damaged.

    The damage depends on ``event_id % 50``: 7 broken text, 11 unknown event type,
    13 no system, 17 no usable timestamp, 19 timestamp left out, 23 zone +02:00.
    """
    kind = F.col("event_id") % 50
    events = with_metadata(audit_events(spark, sf_dir))
    damaged = events.withColumn(
        "event_type", F.when(kind == 11, "no_such_type").otherwise(F.col("event_type"))
    ).withColumn("system", F.when(kind != 13, F.col("system")))
    # an instant two hours on, written with a zone two hours ahead, is the same instant
    shifted = damaged.withColumn(
        "ts", F.when(kind == 23, F.col("ts") + F.expr("interval 2 hours")).otherwise(F.col("ts"))
    )
    text = F.col("value")
    stamp_text = F.lit('"timestamp":"[^"]*"')
    broken = F.expr("substring(value, 1, length(value) - 9)")
    value = (
        F.when(kind == 7, broken)
        .when(kind == 17, F.regexp_replace(text, stamp_text, F.lit('"timestamp":"yesterday"')))
        .when(kind == 19, F.regexp_replace(text, F.lit('"timestamp":"[^"]*",'), F.lit("")))
        .when(kind == 23, F.regexp_replace(text, F.lit('Z"'), F.lit('+02:00"')))
        .otherwise(text)
    )
    return to_records(shifted).select("event_id", value.alias("value"))


# SQL twin: what becomes of each record; a record without a timestamp happens at INGEST_TS
INGEST_TS = "2024-02-01 00:00:00"
INGESTED = f"""ingested as (
  select event_id, event_type, user_id, session_id, system, ip, endpoint, status_code, latency_ms,
    case when event_id % 50 = 19 then timestamp '{INGEST_TS}' else ts end as ts,
    case event_id % 50 when 7 then 'broken json' when 11 then 'event_type' when 13 then 'system'
      when 17 then 'timestamp' end as reject_reason
  from audit)"""
