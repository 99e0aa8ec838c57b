"""Streams give what the batch gives; late, repeated and replayed events included."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from auditloom.operators.distinct import exact_distinct, hll_rollup
from auditloom.operators.heavy import topk_rollup
from auditloom.operators import moments
from auditloom.sources.records import stream_lines
from auditloom.sources.store import RollupStore
from auditloom.streaming import jobs

COLUMNS = (
    "event_id long, ts timestamp, event_type string, system string, user_id string, session_id string, "
    "ip string, endpoint string, status_code string, latency_ms double"
)


def make(spark, low, high, start=1_704_067_200, step=600):
    return spark.range(low, high).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(start) + F.col("id") * step).alias("ts"),
        F.lit("api_access").alias("event_type"), F.concat(F.lit("s"), F.col("id") % 2).alias("system"),
        F.concat(F.lit("u"), F.col("id") % 13).alias("user_id"), F.lit(None).cast("string").alias("session_id"),
        F.lit("ip").alias("ip"), F.lit("/e").alias("endpoint"), F.lit(None).cast("string").alias("status_code"),
        (F.col("id") % 50).cast("double").alias("latency_ms"),
    )


def stream(spark, path):
    return (
        spark.readStream.schema(COLUMNS).option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", 1).parquet(str(path))
    )


def put(df, path, name):
    df.coalesce(1).write.parquet(str(path / name))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_maintained_tables_take_late_and_repeated_events(spark, tmp_path):
    feed = tmp_path / "feed"
    put(make(spark, 300, 600), feed, "b0")
    put(make(spark, 0, 310), feed, "b1")  # days late, and partly a repetition
    put(make(spark, 0, 600).unionByName(make(spark, 590, 700)), feed, "b2")
    store = RollupStore(spark, str(tmp_path / "store"))
    jobs.maintain(stream(spark, feed), store, str(tmp_path / "cp"))
    whole = make(spark, 0, 700)
    key = ["metric", "system", "bucket_start"]
    assert rows(store.merged("topk").select(*key, "item", "cnt")) == rows(topk_rollup(whole).select(*key, "item", "cnt"))
    estimates = [*key, F.hll_sketch_estimate("sketch"), "n"]
    assert rows(store.merged("hll").select(*estimates)) == rows(hll_rollup(whole).select(*estimates))
    states = [*key, "n", F.round("m1", 6), F.round("m2", 6)]
    assert rows(store.merged("moments").select(*states)) == rows(moments.moments_rollup(whole).select(*states))

    # more arrives later; the query goes on where it stopped
    put(make(spark, 650, 800), feed, "b3")
    jobs.maintain(stream(spark, feed), store, str(tmp_path / "cp"))
    whole = make(spark, 0, 800)
    assert rows(store.merged("topk").select(*key, "item", "cnt")) == rows(topk_rollup(whole).select(*key, "item", "cnt"))


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    store = RollupStore(spark, str(tmp_path / "store"))
    jobs.apply_batch(store, make(spark, 0, 200), 0)
    jobs.apply_batch(store, make(spark, 100, 300), 1)
    before = rows(store.merged("topk"))
    for batch, low, high in ((1, 100, 300), (0, 0, 200), (1, 100, 300)):
        jobs.apply_batch(store, make(spark, low, high), batch)
    assert rows(store.merged("topk")) == before
    assert store.merged("topk").where("metric = 'event_types'").agg(F.sum("cnt")).first()[0] == 300


def test_ledger_expiry_forgets_old_days(spark, tmp_path):
    store = RollupStore(spark, str(tmp_path / "store"))
    assert store.expire_ledger(dt.date(2024, 1, 2)) == 0
    jobs.apply_batch(store, make(spark, 0, 300), 0)  # two days and a bit
    assert store.expire_ledger(dt.date(2024, 1, 2)) == 1
    jobs.apply_batch(store, make(spark, 0, 300), 1)
    n = store.merged("topk").where("metric = 'event_types'").agg(F.sum("cnt")).first()[0]
    assert n == 300 + 144  # the first day was counted again, the rest was still known


def test_ingest_stream_splits_and_replays(spark, tmp_path):
    lines = ['{"event_type":"custom","system":"s","user_id":"u%d"}' % i for i in range(5)] + ["broken", '{"system":"s"}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(str(tmp_path / "in"))
    path = str(tmp_path / "out")
    jobs.ingest(stream_lines(spark, str(tmp_path / "in")), path, str(tmp_path / "cp"))
    assert spark.read.parquet(f"{path}/events").count() == 5
    assert {r.reject_reason for r in spark.read.parquet(f"{path}/rejects").collect()} == {"broken json", "event_type"}
    jobs.ingest(stream_lines(spark, str(tmp_path / "in")), path, str(tmp_path / "cp2"))
    assert spark.read.parquet(f"{path}/events").count() == 5


def test_tumbling_equals_batch_on_closed_windows(spark, tmp_path):
    put(make(spark, 0, 500), tmp_path / "feed", "b0")
    put(make(spark, 500, 900), tmp_path / "feed", "b1")
    out = jobs.to_table(jobs.tumbling(stream(spark, tmp_path / "feed"), "1h", "10 minutes"), "t")
    got = {(r.system, r.bucket_start): (r.u, r.n) for r in out.withColumn("u", F.hll_sketch_estimate("users")).collect()}
    last = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=600 * 899 - 600)
    want = {
        (r.system, r.b): (r.u, r.n)
        for r in make(spark, 0, 900).groupBy("system", F.date_trunc("hour", "ts").alias("b"))
        .agg(F.count_distinct("user_id").alias("u"), F.count("*").alias("n")).collect()
        if r.b + dt.timedelta(hours=1) <= last
    }
    assert got == want and len(got) > 200


def test_weeks_start_on_monday_and_months_are_refused(spark, tmp_path):
    put(make(spark, 0, 900, step=3600), tmp_path / "feed", "b0")
    out = jobs.to_table(jobs.tumbling(stream(spark, tmp_path / "feed"), "1w", "1 hour"), "w")
    starts = {r.bucket_start for r in out.collect()}
    assert starts and all(s.weekday() == 0 and s.hour == 0 for s in starts)
    with pytest.raises(ValueError, match="months"):
        jobs.tumbling(stream(spark, tmp_path / "feed"), "1M", "1 hour")


def test_running_statistics_end_at_the_batch_result(spark, tmp_path):
    put(make(spark, 0, 100), tmp_path / "feed", "b0")
    put(make(spark, 100, 333), tmp_path / "feed", "b1")
    got = jobs.running_statistics(stream(spark, tmp_path / "feed"), str(tmp_path / "s"), str(tmp_path / "cp"))
    want = moments.present(moments.partial(make(spark, 0, 333), ["system"], "latency_ms"), ["system"])
    want = {r.system: r for r in want.collect()}
    for r in got.collect():
        w = want[r.system]
        assert r.n == w.n
        assert r["mean"] == pytest.approx(w["mean"]) and r.var_pop == pytest.approx(w.var_pop)
        assert r.kurtosis == pytest.approx(w.kurtosis)


def test_repeated_events_are_dropped(spark, tmp_path):
    put(make(spark, 0, 100), tmp_path / "feed", "b0")
    put(make(spark, 50, 150), tmp_path / "feed", "b1")
    out = jobs.to_table(jobs.deduplicated(stream(spark, tmp_path / "feed"), "30 days").select("event_id"), "d")
    assert sorted(r.event_id for r in out.collect()) == list(range(150))


def test_exact_distinct_ignores_repetition(spark):
    from auditloom.operators.routing import RULES, rules_for, value_counts

    once, twice = make(spark, 0, 100), make(spark, 0, 100).unionByName(make(spark, 0, 100))
    keys = ["metric", "system", "bucket_start"]

    def counted(df):
        return rows(exact_distinct(value_counts(df, rules_for("hll", RULES)), keys).select(*keys, "exact"))

    assert counted(once) == counted(twice)


def test_events_without_an_id_all_count(spark, tmp_path):
    bare = make(spark, 0, 100).withColumn("event_id", F.lit(None).cast("long"))
    store = RollupStore(spark, str(tmp_path / "store"))
    jobs.apply_batch(store, bare, 0)
    jobs.apply_batch(store, bare, 0)  # a retry
    n = store.merged("topk").where("metric = 'event_types'").agg(F.sum("cnt")).first()[0]
    assert n == 100
    put(bare, tmp_path / "feed", "b0")
    out = jobs.to_table(jobs.deduplicated(stream(spark, tmp_path / "feed"), "30 days").select("system"), "bare")
    assert out.count() == 100


def test_a_lost_checkpoint_loses_nothing(spark, tmp_path):
    store = RollupStore(spark, str(tmp_path / "store"))
    put(make(spark, 0, 100), tmp_path / "feed", "b0")
    jobs.maintain(stream(spark, tmp_path / "feed"), store, str(tmp_path / "cp1"))
    put(make(spark, 100, 200), tmp_path / "feed", "b1")
    jobs.maintain(stream(spark, tmp_path / "feed"), store, str(tmp_path / "cp2"))
    n = store.merged("topk").where("metric = 'event_types'").agg(F.sum("cnt")).first()[0]
    assert n == 200


STORED = ("hll", "kll", "ledger", "member", "moments", "topk")


def counted(store):
    return store.merged("topk").where("metric = 'event_types'").agg(F.sum("cnt")).first()[0] or 0


@pytest.mark.parametrize("broken", STORED)
def test_a_batch_cut_short_was_never_there(spark, tmp_path, monkeypatch, broken):
    """The writer dies in any of the tables, then the stream loses its checkpoint."""
    store = RollupStore(spark, str(tmp_path / "store"))
    put(make(spark, 0, 60), tmp_path / "feed", "b0")
    real = RollupStore._write

    def dies(self, table, rows, txn):
        if table == broken:
            raise RuntimeError("lost")
        return real(self, table, rows, txn)

    monkeypatch.setattr(RollupStore, "_write", dies)
    with pytest.raises(Exception, match="lost"):
        jobs.maintain(stream(spark, tmp_path / "feed"), store, str(tmp_path / "cp1"))
    monkeypatch.undo()
    for structure in ("hll", "kll", "member", "moments", "topk"):
        assert store.merged(structure).count() == 0
    jobs.maintain(stream(spark, tmp_path / "feed"), store, str(tmp_path / "cp2"))
    assert counted(store) == 60
    assert store.merged("moments").agg(F.sum("n")).first()[0] == 60
    jobs.maintain(stream(spark, tmp_path / "feed"), store, str(tmp_path / "cp1"))  # the first one comes back
    assert counted(store) == 60


def test_a_batch_cut_short_before_its_commit(spark, tmp_path, monkeypatch):
    from auditloom.sources.log import Log

    store = RollupStore(spark, str(tmp_path / "store"))
    monkeypatch.setattr(Log, "commit", lambda *a, **b: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        jobs.apply_batch(store, make(spark, 0, 60), 0)
    monkeypatch.undo()
    assert counted(store) == 0
    assert jobs.apply_batch(store, make(spark, 0, 60), 5, "other") and not jobs.apply_batch(store, make(spark, 0, 60), 5, "other")
    assert counted(store) == 60
    assert sum(store.drop_old_versions(t) for t in STORED) > 0
    assert counted(store) == 60


def test_running_statistics_go_on_and_forget(spark, tmp_path):
    """A restart goes on from the state; a system that falls silent is forgotten, and starts anew."""
    feed, out, cp = tmp_path / "feed", str(tmp_path / "s"), str(tmp_path / "cp")
    day = 86_400

    def at(first, n, system):
        return make(spark, 0, n, start=1_704_067_200 + first * day, step=60).withColumn("system", F.lit(system))

    def numbers():
        stats = jobs.running_statistics(stream(spark, feed), out, cp, keep="30 days")
        return {r.system: (r.n, round(r["mean"], 6), round(r.kurtosis, 6)) for r in stats.collect()}

    def want(*parts):
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        stats = moments.present(moments.partial(whole, ["system"], "latency_ms"), ["system"])
        return {r.system: (r.n, round(r["mean"], 6), round(r.kurtosis, 6)) for r in stats.collect()}

    first, second = at(0, 300, "a"), at(1, 77, "a")
    put(first.unionByName(at(0, 40, None)), feed, "b0")
    assert numbers() == want(first, at(0, 40, None))
    put(second, feed, "b1")
    assert numbers() == want(first, second, at(0, 40, None))
    put(at(50, 60, "b"), feed, "b2")
    put(at(51, 60, "b"), feed, "b3")  # the watermark has passed the timers of the others
    assert numbers() == want(at(50, 60, "b"), at(51, 60, "b"))
    put(at(52, 9, "a"), feed, "b4")
    assert numbers() == want(at(50, 60, "b"), at(51, 60, "b"), at(52, 9, "a"))


def test_newest_states_are_folded(spark, tmp_path):
    from auditloom.streaming.state import NewestStates

    (tmp_path / "t").mkdir()
    schema = spark.createDataFrame([], "k string, v long, gone boolean").schema
    table = NewestStates(spark, str(tmp_path / "t"), schema, ["k"])
    assert table.read().count() == 0
    for batch in range(35):
        rows = [(f"k{batch % 4}", batch, False), ("end", batch, batch >= 31)]
        table.add(spark.createDataFrame(rows, schema).coalesce(1), batch)
        if batch == 12:
            table.add(spark.createDataFrame(rows, schema).coalesce(1), batch)  # run again
    assert sorted((r.k, r.v) for r in table.read().collect()) == [("k0", 32), ("k1", 33), ("k2", 34), ("k3", 31)]
    assert len(list((tmp_path / "t").iterdir())) < 20


def test_merged_states_are_those_of_all_values():
    import numpy as np

    from auditloom.streaming.state import merged, summed

    x = np.random.default_rng(1).gamma(2.0, 30.0, 500)
    state = (0,)
    for part in np.split(x, [1, 2, 50, 51, 300]):
        state = merged(state, summed(part, len(part)))
    assert state[:7] == pytest.approx(summed(x, 0)[:7], rel=1e-9) and state[7] == 249


def test_events_without_id_stay_out_of_the_state(spark, tmp_path):
    mixed = make(spark, 0, 100).withColumn("event_id", F.when(F.col("event_id") % 2 == 0, F.col("event_id")))
    put(mixed, tmp_path / "feed", "b0")
    put(mixed, tmp_path / "feed", "b1")
    rows = jobs.deduplicated(stream(spark, tmp_path / "feed"), "30 days").select("event_id")
    query = jobs.run(rows.writeStream.format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "cp"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.where("event_id is null").count() == 100 and out.where("event_id is not null").count() == 50
    state = [p["stateOperators"] for p in query.recentProgress if p["stateOperators"]]
    assert state and max(s["numRowsTotal"] for ops in state for s in ops) == 50


def test_a_running_subscription(spark, tmp_path):
    """Queries that go on: what is published while they run arrives, until they are stopped."""
    import time

    from auditloom.sources.tables import with_metadata

    put(make(spark, 0, 20), tmp_path / "feed", "b0")
    every = {"processingTime": "0 seconds"}
    feed, got = str(tmp_path / "live"), []
    (tmp_path / "live").mkdir()
    live = with_metadata(stream(spark, tmp_path / "feed"))
    queries = [
        jobs.publish(live, feed, str(tmp_path / "cp-a"), trigger=every),
        jobs.follow(jobs.subscribe(spark, feed), lambda df, i: got.append(df.count()), str(tmp_path / "cp-b"), trigger=every),
    ]
    try:
        put(make(spark, 20, 50), tmp_path / "feed", "b1")
        end = time.time() + 60
        while sum(got) < 50 and time.time() < end:
            time.sleep(0.3)
        assert sum(got) == 50 and all(q.isActive for q in queries)
    finally:
        for q in queries:
            q.stop()
