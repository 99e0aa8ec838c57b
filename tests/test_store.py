"""Deltas, replays, compaction, expiry, snapshots."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from auditloom.operators import moments
from auditloom.operators.distinct import hll_rollup
from auditloom.operators.heavy import topk_rollup
from auditloom.operators.members import member_rollup
from auditloom.operators.quantiles import kll_rollup
from auditloom.plans import reports, snapshots
from auditloom.sources.store import RollupStore, coarser

START = 1_704_067_200  # 2024-01-01


@pytest.fixture(scope="module")
def events(spark):
    return spark.range(3000).select(
        F.col("id").alias("event_id"),
        F.timestamp_seconds(F.lit(START) + F.col("id") * 97).alias("ts"),
        F.lit("api_access").alias("event_type"),
        F.concat(F.lit("s"), F.col("id") % 2).alias("system"),
        F.concat(F.lit("u"), F.pmod(F.xxhash64("id"), F.lit(40))).alias("user_id"),
        F.lit(None).cast("string").alias("session_id"),
        F.concat(F.lit("ip"), F.col("id") % 9).alias("ip"),
        F.lit(None).cast("string").alias("endpoint"),
        F.lit(None).cast("string").alias("status_code"),
        (F.col("id") % 100 + 0.5).alias("latency_ms"),
    ).cache()


MAKE = {
    "hll": hll_rollup, "topk": topk_rollup, "member": member_rollup, "kll": kll_rollup,
    "moments": moments.moments_rollup,
}
KEY = ["metric", "system", "window", "bucket_start"]


def comparable(structure, df):
    """Rows as plain values; sketches as what they answer."""
    if structure == "hll":
        df = df.select(*KEY, F.hll_sketch_estimate("sketch").alias("v"), "n", "expires_at")
    elif structure == "kll":
        df = df.select(*KEY, "n", "expires_at")
    elif structure == "moments":
        df = df.select(*KEY, "n", *[F.round(c, 4).alias(c) for c in ("m1", "m2", "m3")], "lo", "hi", "expires_at")
    elif structure == "topk":
        df = df.select(*KEY, "item", "cnt", "expires_at")
    else:
        df = df.select(*KEY, "value", "expires_at")
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("structure", list(MAKE))
def test_replayed_deltas_merge_to_the_whole(spark, events, tmp_path, structure):
    store = RollupStore(spark, str(tmp_path))
    make = MAKE[structure]
    parts = [events.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == i) for i in range(3)]
    for batch, part in enumerate(parts):
        store.write(structure, make(part), batch)
    store.write(structure, make(parts[1]), 1)  # the same batch again
    whole = comparable(structure, make(events))
    assert comparable(structure, store.merged(structure)) == whole
    store.compact(structure)
    assert len(set(store.state().live(structure))) == len({(f.window, f.day) for f in store.state().live(structure)})
    assert store.read(structure).count() == len(whole)
    assert comparable(structure, store.merged(structure)) == whole
    store.write(structure, make(parts[0]), 7)
    store.compact(structure)
    assert store.drop_old_versions(structure) > 0 and store.drop_old_versions(structure) == 0
    daily = coarser(structure, store.merged(structure), "1d")
    assert {r.window for r in daily.select("window").distinct().collect()} == {"1d"}


def test_reads_open_only_the_days_asked_for(spark, events, tmp_path):
    store = RollupStore(spark, str(tmp_path))
    store.write("topk", topk_rollup(events), 0)
    day = dt.datetime(2024, 1, 2)
    rows = store.read("topk", "1h", start=day, end=day + dt.timedelta(hours=23))
    assert {r.d for r in rows.select(F.to_date("bucket_start").alias("d")).distinct().collect()} == {day.date()}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket_date" in plan.split("PartitionFilters")[1][:300]
    assert store.read("topk", "1d").count() == 0
    with pytest.raises(ValueError, match="Valid options"):
        store.read("topk", "2h")


def test_any_window_is_answered_from_a_shorter_one(spark, events, tmp_path):
    store = RollupStore(spark, str(tmp_path))
    store.write("topk", topk_rollup(events), 0)
    for window in ("1h", "1d", "1w", "1M"):
        assert comparable("topk", store.at("topk", window)) == comparable("topk", topk_rollup(events, window))
    span = {"start": dt.datetime(2024, 1, 2, 5), "end": dt.datetime(2024, 1, 3, 1)}
    days = store.at("topk", "1d", **span)
    want = topk_rollup(events, "1d").where("to_date(bucket_start) in ('2024-01-02', '2024-01-03')")
    assert comparable("topk", days) == comparable("topk", want)
    assert store.at("topk", "5m").count() == 0  # hours do not tell about minutes


def test_absent_table_is_empty(spark, tmp_path):
    store = RollupStore(spark, str(tmp_path))
    assert store.merged("hll").count() == 0
    assert reports.distinct_counts(store.merged("hll")).count() == 0


def test_expiry(spark, events, tmp_path):
    store = RollupStore(spark, str(tmp_path))
    store.write("topk", topk_rollup(events), 0)
    as_of = dt.datetime(2024, 1, 9, 12)  # hours are kept for seven days
    alive = store.live("topk", "1h", as_of)
    oldest = alive.agg(F.min("bucket_start")).first()[0]
    assert oldest == dt.datetime(2024, 1, 2, 12)
    before = comparable("topk", alive)
    assert store.expire("topk", as_of) == 1  # the whole of January 1st
    assert comparable("topk", store.live("topk", "1h", as_of)) == before
    assert store.read("topk").agg(F.min("bucket_start")).first()[0] == dt.datetime(2024, 1, 2)


def test_footprint(spark, events, tmp_path):
    store = RollupStore(spark, str(tmp_path))
    store.write("hll", hll_rollup(events), 0)
    store.write("topk", topk_rollup(events), 0)
    rows = {r.structure: r for r in store.footprint().collect()}
    assert rows["hll"]["keys"] == rows["hll"]["rows"] > 0 and rows["hll"]["bytes"] > 0
    assert rows["topk"]["rows"] > rows["topk"]["keys"]


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "snap")
    daily = spark.createDataFrame(
        [("users", "s", dt.datetime(2024, 1, d), d) for d in (1, 2)],
        "metric string, system string, bucket_start timestamp, count long",
    )
    lists = spark.createDataFrame(
        [("active_users", "s", dt.datetime(2024, 1, 2), [("a", 3)])],
        "metric string, system string, bucket_start timestamp, items array<struct<item: string, count: long>>",
    )
    snapshots.save(snapshots.snapshot_rows(daily, lists), root)
    # one date again, with another value; the other date stays
    second = daily.where(F.dayofmonth("bucket_start") == 2).withColumn("count", F.lit(20).cast("long"))
    snapshots.save(snapshots.snapshot_rows(second, lists.where("false")), root)
    assert snapshots.load(spark, root, dt.date(2024, 1, 1)).first().value == 1.0
    assert [r.value for r in snapshots.load(spark, root, dt.date(2024, 1, 2)).collect()] == [20.0]
    assert snapshots.load(spark, root, dt.date(2023, 1, 2)).count() == 0
    assert snapshots.kept(spark, root, dt.date(2024, 3, 31)).count() == 1


def test_sla_is_strict(spark):
    rows = spark.createDataFrame([("a", 199.999), ("b", 200.0), ("c", None)], "system string, value double")
    got = {r.system: (r.status, r.margin) for r in reports.sla_check(rows, 200.0).collect()}
    assert got == {"a": ("PASS", 0.0), "b": ("FAIL", 0.0)}
    own = spark.createDataFrame([("a", 100.0), ("b", 300.0)], "system string, threshold double")
    assert {r.system: r.status for r in reports.sla_check(rows, own).collect()} == {"a": "FAIL", "b": "PASS"}


def test_a_batch_is_told_by_its_source_and_number(spark, events, tmp_path):
    store = RollupStore(spark, str(tmp_path))
    halves = [events.where(F.col("event_id") % 2 == i) for i in range(2)]
    store.write("topk", topk_rollup(halves[0]), 0, "a")
    store.write("topk", topk_rollup(halves[1]), 0, "b")
    whole = comparable("topk", topk_rollup(events))
    assert comparable("topk", store.merged("topk")) == whole
    store.compact("topk")
    store.write("topk", topk_rollup(halves[1]), 0, "b")  # a retry after the compaction
    assert comparable("topk", store.merged("topk")) == whole
    with pytest.raises(ValueError, match="source"):
        store.write("topk", topk_rollup(events), 0, "a/b")


def test_a_compaction_cut_short_changes_nothing(spark, events, tmp_path, monkeypatch):
    store = RollupStore(spark, str(tmp_path))
    store.write("topk", topk_rollup(events.where("event_id % 2 = 0")), 0)
    store.write("topk", topk_rollup(events.where("event_id % 2 = 1")), 2)
    whole = comparable("topk", topk_rollup(events))
    real = RollupStore._write

    def broken(self, table, rows, txn):
        real(self, table, rows, txn)
        raise RuntimeError("lost")

    monkeypatch.setattr(RollupStore, "_write", broken)
    with pytest.raises(RuntimeError):
        store.compact("topk")
    with pytest.raises(RuntimeError):  # and a delta that was written but not committed
        store.write("topk", topk_rollup(events), 1)
    monkeypatch.undo()
    assert comparable("topk", store.merged("topk")) == whole  # nobody has seen it
    store.compact("topk")
    assert store.write("topk", topk_rollup(events), 1)  # its retry
    assert store.drop_old_versions("topk") > 0
    double = {r.item: r.cnt for r in store.merged("topk").groupBy("item").agg(F.sum("cnt").alias("cnt")).collect()}
    once = {r.item: r.cnt for r in topk_rollup(events).groupBy("item").agg(F.sum("cnt").alias("cnt")).collect()}
    assert double == {k: 2 * v for k, v in once.items()} and whole


@pytest.mark.parametrize("structure", list(MAKE))
def test_longer_windows_outlive_the_hours(spark, events, tmp_path, structure):
    store, make = RollupStore(spark, str(tmp_path)), MAKE[structure]
    store.write(structure, make(events), 0)
    assert store.expire(structure, dt.datetime(2024, 1, 9, 12)) == 1
    late = events.where("event_id < 10")  # events of the day that has moved, once more
    store.write(structure, make(late), 1)
    both = events.unionByName(late)
    for window in ("1d", "1w", "1M"):
        assert comparable(structure, store.at(structure, window)) == comparable(structure, make(both, window))
    store.expire(structure, dt.datetime(2024, 2, 20))
    assert store.read(structure, "1h").count() == 0
    for window in ("1d", "1w", "1M"):
        assert comparable(structure, store.at(structure, window)) == comparable(structure, make(both, window))
    assert store.expire(structure, dt.datetime(2030, 1, 1)) > 0
    store.expire(structure, dt.datetime(2030, 1, 1))
    assert store.at(structure, "1M").count() == 0


def test_empty_stores_answer(spark, tmp_path):
    store = RollupStore(spark, str(tmp_path))
    assert store.footprint().count() == 0
    assert store.expire("topk", dt.datetime(2024, 1, 1)) == 0
    store.compact("topk")
    assert snapshots.load(spark, str(tmp_path / "none"), dt.date(2024, 1, 1)).count() == 0
    assert snapshots.expire(spark, str(tmp_path / "none"), dt.date(2024, 1, 1)) == 0


def test_compaction_leaves_single_folders_alone(spark, events, tmp_path):
    store = RollupStore(spark, str(tmp_path))
    store.write("topk", topk_rollup(events), 0)
    late = events.where("to_date(ts) = '2024-01-02'")
    store.write("topk", topk_rollup(late), 1)
    before = set(store.state().live("topk"))
    assert store.compact("topk") == 2
    after = set(store.state().live("topk"))
    assert {f.day for f in before - after} == {f.day for f in after - before} == {"2024-01-02"}
    assert comparable("topk", store.merged("topk")) == comparable("topk", topk_rollup(events.unionByName(late)))
    assert store.compact("topk") == 0 and set(store.state().live("topk")) == after


def test_readers_keep_the_state_they_took(spark, events, tmp_path):
    store = RollupStore(spark, str(tmp_path))
    half = events.where("event_id % 2 = 0")
    store.write("topk", topk_rollup(half), 0)
    seen = store.merged("topk")
    store.write("topk", topk_rollup(events.where("event_id % 2 = 1")), 1)
    store.compact("topk")
    assert comparable("topk", seen) == comparable("topk", topk_rollup(half))
    assert comparable("topk", RollupStore(spark, str(tmp_path)).merged("topk")) == comparable("topk", topk_rollup(events))


def test_the_log_is_replayed_from_a_written_state(spark, events, tmp_path):
    store, few = RollupStore(spark, str(tmp_path)), topk_rollup(events.where("event_id < 5"))
    for batch in range(23):
        store.write("topk", few, batch)
    names = sorted(p.name for p in (tmp_path / "log").iterdir() if not p.name.startswith("."))
    assert sum(n.endswith(".state.json") for n in names) == 1
    again = RollupStore(spark, str(tmp_path))
    assert again.state() == store.state() and again.state().version == 23
    assert again.state().done["topk"]["main"] == [[0, 22]]
    store.drop_old_versions("topk")
    assert RollupStore(spark, str(tmp_path)).state() == store.state()
    other = RollupStore(spark, str(tmp_path))
    stale = other.state()
    store.write("topk", few, 23)
    with pytest.raises(RuntimeError, match="another writer"):
        other.log.commit(stale)


@pytest.mark.parametrize("scope", [{}, {"metric": "active_users"}, {"system": "s1"}, {"metric": "active_ips", "system": "s0"}])
def test_reset_starts_anew(spark, events, tmp_path, scope):
    store = RollupStore(spark, str(tmp_path))
    halves = [events.where(F.col("event_id") % 2 == i) for i in range(2)]
    store.write("topk", topk_rollup(halves[0]), 0)
    store.reset("topk", **scope)
    assert not store.write("topk", topk_rollup(halves[0]), 0)  # a retry of what was reset

    def outside(df):
        gone = F.lit(True)
        for column, value in scope.items():
            gone &= F.col(column) == value
        return df.where(~gone)

    first = topk_rollup(halves[0])
    assert comparable("topk", store.merged("topk")) == comparable("topk", outside(first))
    store.write("topk", topk_rollup(halves[1]), 1)
    both = outside(first).unionByName(topk_rollup(halves[1]))
    want = comparable("topk", both.groupBy(*KEY, "item").agg(F.sum("cnt").alias("cnt"), F.max("expires_at").alias("expires_at")))
    assert comparable("topk", store.merged("topk")) == want
    store.compact("topk")
    assert comparable("topk", store.merged("topk")) == want
    assert store.state().resets == []
    assert not store.write("topk", topk_rollup(halves[0]), 0)
    assert comparable("topk", store.at("topk", "1h")) == want


def test_large_digests_keep_their_size(spark, tmp_path):
    """A million values a day: the promised rank error holds after merge, compact and expire."""
    from auditloom.operators.quantiles import RANK_ERROR

    n = 1_200_000
    rows = spark.range(n, numPartitions=8).select(
        F.timestamp_seconds(F.lit(START) + F.col("id") % 86_400).alias("ts"), F.lit("s").alias("system"),
        (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / (1 << 20)).alias("latency_ms"),
    ).cache()
    store = RollupStore(spark, str(tmp_path))
    for batch in range(3):
        store.write("kll", kll_rollup(rows.where(F.pmod(F.xxhash64("ts", "latency_ms"), F.lit(3)) == batch)), batch)

    def worst(digests):
        assert digests.count() == 1
        ps = [0.05, 0.5, 0.9, 0.95, 0.99, 0.999]
        values = digests.select(F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(p) for p in ps])).alias("v")).first().v
        below = rows.agg(*[F.count_if(F.col("latency_ms") <= v) for v in values]).first()
        return max(abs(b / n - p) for b, p in zip(below, ps))

    assert worst(store.at("kll", "1d")) <= RANK_ERROR
    store.compact("kll")
    assert worst(store.at("kll", "1d")) <= RANK_ERROR
    assert store.expire("kll", dt.datetime(2024, 1, 20)) == 1
    assert store.read("kll", "1d").agg(F.max(F.length("sketch"))).first()[0] > 100_000
    assert worst(store.merged("kll", "1d")) <= RANK_ERROR


def test_intermediate_tables_can_be_forgotten(spark):
    from pathlib import Path

    from auditloom.session import forget, materialize, run_dir

    df = materialize(spark.range(10).toDF("id"), "some")
    assert df.count() == 10
    folder = Path(run_dir(spark, "x").removeprefix("file:")).parent
    assert list(folder.glob("some-*"))
    forget(spark)
    assert not folder.exists()
    assert materialize(spark.range(3).toDF("id"), "some").count() == 3


def asked_of(spark, n):
    """Who was there (user < n), and as many who were not."""
    return spark.range(2 * n).select(
        F.concat(F.lit("u"), F.col("id")).alias("user_id"), F.lit("s").alias("system"),
        F.lit(dt.datetime(2024, 1, 2)).cast("timestamp").alias("bucket_start"), (F.col("id") < n).alias("there"),
    )


def test_stored_filters_grow_and_keep_their_rate(spark, tmp_path, monkeypatch):
    """Many batches into filters that begin small: no value is lost, and few are made up."""
    from auditloom.operators import bloom
    from auditloom.operators.routing import RULES
    from auditloom.streaming.jobs import apply_batch

    monkeypatch.setattr(bloom, "_FIRST", 64)
    n, store = 4000, RollupStore(spark, str(tmp_path))
    rules = [r for r in RULES if r.metric == "user_activity"]
    people = spark.range(n).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(START + 86_400) + F.col("id") * 20).alias("ts"),
        F.lit("api_access").alias("event_type"), F.lit("s").alias("system"), F.concat(F.lit("u"), F.col("id")).alias("user_id"),
        *[F.lit(None).cast("string").alias(c) for c in ("session_id", "ip", "endpoint", "status_code")], F.lit(1.0).alias("latency_ms"),
    )
    for batch in range(6):
        part = people.where(F.pmod(F.xxhash64("event_id"), F.lit(6)) == batch)
        apply_batch(store, part, batch, rules=rules)
        if batch == 3:
            store.compact("bloom")
        assert not apply_batch(store, part, batch, rules=rules)

    def answers(window, bucket):
        asked = asked_of(spark, n).withColumn("bucket_start", F.lit(bucket).cast("timestamp"))
        rows = reports.activity_from_filters(store.tiles("bloom", window), asked, window).collect()
        assert len(rows) == 2 * n and all(r.accessed for r in rows if r.there)
        assert all(0.9 < r.probability <= 1 for r in rows if r.accessed) and all(r.probability == 1 for r in rows if not r.accessed)
        return sum(r.accessed for r in rows if not r.there) / n

    day, week = dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 1)
    sizes = {r.blocks for r in store.read("bloom", "1d").select("blocks").distinct().collect()}
    assert len(sizes) >= 2  # it has grown
    assert answers("1d", day) < 0.04 and answers("1w", week) < 0.04
    assert store.compact("bloom") > 0
    assert answers("1d", day) < 0.04
    held = bloom.held(store.read("bloom", "1d"), KEY).collect()
    assert all(h["items"] <= h.blocks * bloom._room() * 1.1 for h in held)
    assert store.expire("bloom", dt.datetime(2024, 6, 1)) == 1
    assert store.read("bloom", "1d").count() == 0 and answers("1w", week) < 0.04
    assert store.footprint(["bloom"]).count() == 2  # weeks and months
    assert store.expire("bloom", dt.datetime(2027, 1, 1)) > 0 and store.tiles("bloom", "1w").count() == 0


def test_counters_hold_their_bounds(spark, events, tmp_path):
    """Counters of any batches, added in any order and cut again, bound every true count."""
    import random

    from auditloom.operators import heavy

    random.seed(4)
    rows = [("m", "s", f"i{int(random.paretovariate(0.7)) % 400}") for _ in range(6000)]
    truth = {}
    for _, _, i in rows:
        truth[i] = truth.get(i, 0) + 1
    last = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp").alias("last_ts")
    df = spark.createDataFrame([(*r, n % 7) for n, r in enumerate(rows)], "metric string, system string, item string, part int")
    keys = ["metric", "system"]
    counts = df.groupBy(*keys, "part", "item").agg(F.count("*").alias("cnt")).select("*", last)
    for slots in (3, 10, 60):
        parts = heavy.counter_cut(counts, [*keys, "part"], slots)
        some = heavy.counter_merge(parts.withColumn("half", F.col("part") % 2), [*keys, "half"], slots)
        total = heavy.counter_merge(some, keys, slots)
        got = {r["item"]: r for r in heavy.counter_bounds(total, keys).collect()}
        error = total.where("item is null").first().cnt
        assert len(got) <= slots and error * (slots + 1) <= len(rows)
        assert all(r.low <= truth[i] <= r.high for i, r in got.items())
        assert all(i in got for i, n in truth.items() if n > error)
    empty = heavy.counter_merge(counts.where("false").drop("part"), keys)
    assert empty.count() == 0


def test_theta_sketches_are_stored(spark, events, tmp_path):
    from auditloom.operators.distinct import present_in_all_stored
    from auditloom.operators.routing import MetricRule
    from auditloom.streaming.jobs import apply_batch

    store = RollupStore(spark, str(tmp_path))
    rule = MetricRule("theta", "users", "user_id", "true", ("1h", "1d"))
    for batch in range(2):
        apply_batch(store, events.where(F.col("event_id") % 3 == batch), batch, rules=[rule])
    store.compact("theta")
    seen = events.where("event_id % 3 < 2")
    both = seen.groupBy("user_id").agg(F.count_distinct("system").alias("n")).where("n = 2").count()
    found = present_in_all_stored(store.at("theta", "1d"), "system", [], 2).first()
    assert found.estimate == both  # few values: exact
    assert store.expire("theta", dt.datetime(2024, 1, 9, 12)) >= 1
    assert present_in_all_stored(store.at("theta", "1w"), "system", [], 2).first().estimate == both
    with pytest.raises(ValueError, match="unknown structure"):
        apply_batch(store, events, 9, rules=[MetricRule("nothing", "m", "user_id", "true", ("1h",))])
