import datetime as dt

from pyspark.sql import functions as F

from auditloom.operators.routing import RULES, MetricRule, route, value_counts
from auditloom.sources import records

NOW = "2024-01-01 00:00:00"

GOOD = [
    '{"event_type":"user_login","user_id":"mira","system":"vault","metadata":{"ip":"203.0.113.9"}}',
    '{"event_id":"6f1c-77","event_type":"api_access","user_id":"ivo","system":"edge","metadata":{"endpoint":"/v2/items"}}',
    '{"event_id":41,"event_type":"database_access","user_id":"noor","system":"vault","metadata":{"rows":{"read":3}}}',
    '{"event_type":"security_event","system":"s","timestamp":"2025-10-16T10:30:00Z","metadata":{"status_code":"401"}}',
    '{"event_type":"custom","user_id":"","system":"s","timestamp":"2025-10-16T12:30:00+02:00"}',
    '{"event_type":"user_logout","session_id":"x","system":"s","timestamp":"2025-10-16","metadata":{"ip":null}}',
]
BAD = {
    '{"event_type":"dance","system":"s"}': "event_type",
    '{"system":"s"}': "event_type",
    '{"event_type":"custom"}': "system",
    '{"event_type":"custom","system":"s","timestamp":"yesterday"}': "timestamp",
    '{"event_type":"custom","system":"s","timestamp":"2025"}': "timestamp",
    '{"event_type":"custom","system":"s","timestamp":"2025-13-40T00:00:00"}': "timestamp",
    '{"event_type":"custom","sys': "broken json",
    "not json": "broken json",
}


def validated(spark, lines):
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    return records.validate(records.parse_records(df), F.lit(NOW).cast("timestamp"))


def test_accepts_and_rejects(spark):
    both = validated(spark, GOOD + list(BAD))
    assert records.accepted(both).count() == len(GOOD)
    assert {r.value: r.reject_reason for r in records.rejected(both).collect()} == BAD
    report = records.batch_report(both).first()
    assert (report.processed, report.total) == (len(GOOD), len(GOOD) + len(BAD))


def test_timestamps(spark):
    rows = records.accepted(validated(spark, GOOD)).select("ts").collect()
    same = dt.datetime(2025, 10, 16, 10, 30)
    assert [r.ts for r in rows] == [dt.datetime(2024, 1, 1)] * 3 + [same, same, dt.datetime(2025, 10, 16)]


def test_routing_rules(spark):
    events = records.accepted(validated(spark, GOOD))
    routed = route(events.withColumn("event_id", F.monotonically_increasing_id()), RULES)
    counts = {
        (r.structure, r.metric, r.window): r.n
        for r in routed.groupBy("structure", "metric", "window").agg(F.count("*").alias("n")).collect()
    }
    assert counts[("hll", "users", "1w")] == 3  # the empty user does not count
    assert counts[("hll", "sessions", "1d")] == 1
    assert counts[("hll", "ips", "1h")] == 1  # nor does a null ip
    assert counts[("topk", "event_types", "1h")] == 6
    assert counts[("topk", "failed_logins", "1h")] == 1
    assert routed.where("metric = 'failed_logins'").first().value == "unknown"
    assert routed.where("metric = 'user_activity'").first().value == "mira:vault"


def test_full_event_makes_fifteen_updates(spark):
    line = (
        '{"event_type":"security_event","user_id":"u","session_id":"s","system":"x",'
        '"metadata":{"ip":"1","endpoint":"/e","status_code":"401"}}'
    )
    events = records.accepted(validated(spark, [line])).withColumn("event_id", F.lit(1))
    assert route(events, RULES).count() == 15


def test_a_metric_is_one_more_rule(spark):
    rule = MetricRule("topk", "logins", "user_id", "event_type = 'user_login'", ("1h",))
    rows = value_counts(records.accepted(validated(spark, GOOD)), [rule]).collect()
    assert [(r.metric, r.value, r.cnt) for r in rows] == [("logins", "mira", 1)]


def test_feed_leaves_the_session_out(spark):
    events = records.accepted(validated(spark, GOOD))
    lines = records.published(events)
    assert lines.where("value like '%session%'").count() == 0
    back = records.read_feed(lines)
    assert back.count() == len(GOOD)
    assert {r.user_id for r in back.collect()} == {r.user_id for r in events.collect()}


def test_newest(spark):
    df = spark.range(100).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") % 10).alias("ts"))
    top = records.newest(df, 3).collect()
    assert [r.event_id for r in top] == [99, 89, 79]


def test_records_come_in_envelopes(spark):
    one = '{"event_type":"custom","system":"s","user_id":"u%d"}'
    lines = [
        one % 1,
        '{"events": [%s, %s, {"system":"s"}, {"event_type":"custom","system":"s","metadata":{"ip":"1"}}]}' % (one % 2, one % 3),
        '{"events": []}',
        '{ "batch": 7, "events" : [%s]}' % (one % 4),
        '{"events": "none"}',
        '{"events": [1, ',
        None,
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    checked = records.validate(records.parse_records(df))
    assert sorted(r.user_id or "-" for r in records.accepted(checked).collect()) == ["-", "u1", "u2", "u3", "u4"]
    assert sorted(r.reject_reason for r in records.rejected(checked).collect()) == ["broken json"] * 2 + ["event_type"] * 2
    report = records.batch_report(checked).first()
    assert (report.processed, report.total) == (5, 9)
