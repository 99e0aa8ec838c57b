"""Headline timings. Prints one JSON line; each query runs once to warm up."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from auditloom.functions.buckets import bucket_start, bucket_start_by  # noqa: E402
from auditloom.operators import bloom, countmin, heavy, members, moments, rollup  # noqa: E402
from auditloom.operators.compiled import rollups  # noqa: E402
from auditloom.operators.distinct import estimate, hll_rollup, merge_hll  # noqa: E402
from auditloom.operators.mergeable import hll, kll  # noqa: E402
from auditloom.operators.quantiles import exact_percentiles, kll_rollup, percentiles  # noqa: E402
from auditloom.plans import reports  # noqa: E402
from auditloom.session import RUNTIME_CONF, materialize, run_dir  # noqa: E402
from auditloom.sources import records  # noqa: E402
from auditloom.sources.store import RollupStore, coarser  # noqa: E402
from auditloom.sources.tables import audit_events, latest_ts, with_metadata  # noqa: E402
from auditloom.streaming import jobs  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3


def session() -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", CPUS)
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def sink(df: DataFrame) -> None:
    """Compute every row and column, keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def cases(spark: SparkSession) -> tuple[dict[str, Callable[[], None]], int, dict[str, float]]:
    events = audit_events(spark, SF_DIR)
    n_events = events.count()
    as_of = latest_ts(events)
    day = ["metric", "system", "bucket_start"]

    # feeds arrive as many files
    raw = records.to_records(with_metadata(events)).select("value")
    lines = materialize(raw.repartition(int(CPUS)), "lines")
    store = RollupStore(spark, run_dir(spark, "bench-store"))
    built: dict[str, Callable[[DataFrame], DataFrame]] = {
        "hll": hll_rollup,
        "topk": heavy.topk_rollup,
        "member": members.member_rollup,
        "kll": kll_rollup,
        "moments": moments.moments_rollup,
    }
    for structure, make in built.items():
        store.write(structure, make(events), 0)
    for structure in ("hll", "topk", "member", "kll"):
        store.write(structure, coarser(structure, store.read(structure, "1h"), "1d"), 1)
    hours, days = store.read("hll", "1h"), store.read("hll", "1d")

    asked = events.select(
        "user_id", "system", "ts", F.lit("1d").alias("window"),
        bucket_start_by(F.col("ts"), F.lit("1d")).alias("bucket_start"),
        F.concat_ws(":", "user_id", "system").alias("value"),
    )
    known = store.read("member", "1d").where("metric = 'user_activity'")
    filter_keys = ["system", "bucket_start"]
    size = bloom.shape_for(known, filter_keys, "value", 0.001)
    filters = materialize(bloom.build(known, filter_keys, "value", size), "filters")
    counts = materialize(heavy.merge_counts(store.read("topk"), ["metric", "system"]), "counts")
    cells = materialize(countmin.build(counts, ["metric", "system"]), "cells")

    def ingest() -> None:
        valid = records.accepted(records.validate(records.parse_records(lines)))
        sink(valid)

    def ingest_and_rollup() -> None:
        # the valid events are a table of their own, and the roll-ups read it
        valid = records.accepted(records.validate(records.parse_records(lines)))
        valid = materialize(valid.drop("metadata"), "valid")
        tables = rollups(valid)
        with ThreadPoolExecutor(len(tables)) as pool:
            list(pool.map(sink, tables.values()))

    def summary() -> None:
        hourly = reports.distinct_counts(store.read("hll", "1h", start=as_of, end=as_of))
        daily = reports.distinct_counts(store.read("hll", "1d", start=as_of, end=as_of))
        top = store.read("topk", "1h", start=as_of, end=as_of)
        sink(reports.system_summary(hourly, daily, top, as_of, 10))

    def maintain() -> None:
        # one batch of all events into a store: every table and the ledger, by one commit
        jobs.apply_batch(RollupStore(spark, run_dir(spark, "bench-batch")), events, 0)

    deltas = RollupStore(spark, run_dir(spark, "bench-deltas"))
    for part in range(2):
        deltas.write("topk", heavy.topk_rollup(events.where(F.col("event_id") % 2 == part)), part)

    def compaction() -> None:
        # the commit after it is taken back, so that it can be repeated
        before = set(deltas.state().live("topk"))
        deltas.compact("topk")
        state = deltas.state()
        after = set(state.live("topk"))
        deltas.log.commit(state, add=before - after, remove=after - before)

    timed = events.withColumn("bucket_start", bucket_start(F.col("ts"), "1d"))
    sets = [[], ["system"], ["bucket_start"], ["system", "bucket_start"]]
    out = {
        "ingest_validate": ingest,
        "ingest_all_rollups": ingest_and_rollup,
        "apply_batch": maintain,
        "store_compact": compaction,
        "store_at_days": lambda: sink(deltas.at("topk", "1d")),
        "rollup_hll": lambda: sink(hll_rollup(events)),
        "rollup_topk": lambda: sink(heavy.topk_rollup(events)),
        "rollup_member": lambda: sink(members.member_rollup(events)),
        "rollup_kll": lambda: sink(kll_rollup(events)),
        "rollup_moments": lambda: sink(moments.moments_rollup(events)),
        "hours_to_days": lambda: sink(estimate(rollup.coarsen(hll(), hours, "1d"), day)),
        "merge_all_systems": lambda: sink(estimate(merge_hll(hours, ["metric"]), ["metric"])),
        "cube_time_and_system": lambda: sink(hll().cube(days, sets)),
        "rolling_24h": lambda: sink(rollup.rolling_distinct(hours, "1h", 24)),
        "report_distinct_point": lambda: reports.distinct_counts(
            store.read("hll", "1d", start=as_of, end=as_of)
        ).collect(),
        "report_system_summary": summary,
        "report_top10_all_hours": lambda: sink(reports.top_items(store.read("topk", "1h"), 10)),
        "report_percentiles_days": lambda: sink(
            percentiles(store.read("kll", "1d"), day, reports.DEFAULT_PERCENTILES)
        ),
        "report_sla_days": lambda: sink(
            reports.sla_from_rollup(rollup.coarsen(kll(), store.read("kll"), "1d").withColumn("window", F.lit("1d")), 95, 200.0)
        ),
        "exact_percentiles_days": lambda: sink(
            exact_percentiles(timed, filter_keys, "latency_ms", [50, 95, 99])
        ),
        "running_statistics": lambda: sink(
            moments.running(
                events.select("system", "ts", "event_id", "latency_ms"), ["system"], ["ts", "event_id"], "latency_ms"
            )
        ),
        "activity_check_exact": lambda: sink(
            members.check_activity(asked.drop("bucket_start", "value"), known)
        ),
        "activity_check_bloom": lambda: sink(bloom.contains(asked, filters, filter_keys, "value", size)),
        "bloom_build": lambda: sink(bloom.build(known, filter_keys, "value", size)),
        "cms_build": lambda: sink(countmin.build(counts, ["metric", "system"])),
        "cms_query": lambda: sink(countmin.query(counts, cells, ["metric", "system"])),
    }
    sizes = hours.agg(F.avg(F.length("sketch")), F.max(F.length("sketch"))).first()
    facts = {"hll_bytes_avg": round(sizes[0], 1), "hll_bytes_max": sizes[1]}
    return out, n_events, facts


def main() -> None:
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    queries, n_events, facts = cases(spark)
    times: dict[str, float] = {}
    for name, run in queries.items():
        run()
        taken = []
        for _ in range(RUNS):
            start = time.perf_counter()
            run()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
    result = {
        "metric": "audit_analytics_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(SF_DIR).name.removeprefix("sf"),
        "cpus": int(CPUS),
        "events": n_events,
        "events_per_s_validate": round(n_events / times["ingest_validate"]),
        "events_per_s_all_rollups": round(n_events / times["ingest_all_rollups"]),
        **facts,
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
