"""Continuous forms of the batch jobs. On closed windows they give the same rows.

Two families: low-latency windows that drop what comes behind the watermark, and
:func:`maintain`, which keeps rollup tables up to date and takes late events until the
summary they belong to has run out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from auditloom.operators.compiled import MAINTAINED, base_window, rollups
from auditloom.operators.distinct import LG_K
from auditloom.operators.mergeable import KLL_K
from auditloom.operators.routing import MetricRule
from auditloom.schema import window_spec
from auditloom.session import run_dir, shuffle_partitions
from auditloom.sources.records import (
    accepted, parse_records, published, read_feed, rejected, validate,
)
from auditloom.sources.store import LEDGER, RollupStore
from auditloom.streaming.state import NewestStates, moments_states, presented


def run(
    writer: DataStreamWriter,
    checkpoint: str,
    trigger: Mapping[str, Any] | None = None,
    state_partitions: int | None = None,
) -> StreamingQuery:
    """Start a stream; progress is kept under ``checkpoint``.

    Without ``trigger`` all there is gets processed before this returns. With one, such as
    ``{"processingTime": "10 seconds"}``, the query goes on until it is stopped. A stateful
    query keeps the number of its state partitions for life: ``state_partitions`` at its
    first start, the session's shuffle partitions by default (on one machine two per core
    at most, as each is paid for in every batch).
    """
    spark = writer._spark
    if state_partitions is None:
        state_partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        if spark.sparkContext.master.startswith("local"):
            state_partitions = min(state_partitions, 2 * spark.sparkContext.defaultParallelism)
    options = dict(trigger) if trigger is not None else {"availableNow": True}
    # a query takes the session's settings with it when it starts
    with shuffle_partitions(spark, state_partitions):
        query = writer.option("checkpointLocation", checkpoint).trigger(**options).start()
    if trigger is None:
        query.awaitTermination()
    return query


def to_table(stream: DataFrame, label: str, state_partitions: int | None = None) -> DataFrame:
    """Run a stream into a Parquet table in the shared folder and read it."""
    spark = stream.sparkSession
    path = run_dir(spark, label)
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/data")
    run(writer, f"{path}/checkpoint", state_partitions=state_partitions)
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def _window(window: str) -> Column:
    spec = window_spec(window)
    if window == "1M":
        raise ValueError("months have no fixed length: roll them up from days")
    length = f"{spec.duration_s} seconds"
    # windows count from Thursday 1970-01-01; weeks start on Monday
    return F.window("ts", length, length, "4 days" if window == "1w" else "0 seconds").alias("w")


def tumbling(events: DataFrame, window: str, delay: str) -> DataFrame:
    """Distinct users, latency digest and row count per system and window."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(_window(window), "system")
        .agg(
            F.hll_sketch_agg("user_id", LG_K).alias("users"),
            F.kll_sketch_agg_double("latency_ms", KLL_K).alias("latency"),
            F.count(F.lit(1)).alias("n"),
        )
        .select(F.col("w.start").alias("bucket_start"), "system", "users", "latency", "n")
    )


def item_counts(events: DataFrame, item: str, window: str, delay: str) -> DataFrame:
    """Counts per system, window and item; rank them when reading."""
    return (
        events.where(F.col(item).isNotNull())
        .withWatermark("ts", delay)
        .groupBy(_window(window), "system", F.col(item).alias("item"))
        .agg(F.count(F.lit(1)).alias("cnt"))
        .select(F.col("w.start").alias("bucket_start"), "system", "item", "cnt")
    )


def hours_to_days(events: DataFrame, delay: str) -> DataFrame:
    """Hourly sketches merged to days inside one stream."""
    hourly = (
        events.withWatermark("ts", delay)
        .groupBy(_window("1h"), "system")
        .agg(F.hll_sketch_agg("user_id", LG_K).alias("users"), F.count(F.lit(1)).alias("n"))
    )
    return (
        hourly.groupBy(F.window(F.window_time("w"), "1 day").alias("day"), "system")
        .agg(F.hll_union_agg("users", F.lit(False)).alias("users"), F.sum("n").alias("n"))
        .select(F.col("day.start").alias("bucket_start"), "system", "users", "n")
    )


def deduplicated(events: DataFrame, horizon: str) -> DataFrame:
    """Drop events sent again within the horizon; events without an id all stay.

    Only events with an id enter the state.
    """
    keyed = events.withColumn("_key", _key(events)).withWatermark("ts", horizon)
    once = keyed.where("_key is not null").dropDuplicatesWithinWatermark(["_key"])
    return once.unionByName(keyed.where("_key is null")).drop("_key")


def running_statistics(
    events: DataFrame,
    path: str,
    checkpoint: str,
    keep: str = "90 days",
    delay: str = "10 minutes",
    trigger: Mapping[str, Any] | None = None,
) -> DataFrame:
    """Moments per system, kept up to date in state; gives the newest (see :mod:`.state`).

    A system from which nothing has come for ``keep`` (of event time) is forgotten.
    """
    spark = events.sparkSession
    states = moments_states(events.withWatermark("ts", delay), "system", "latency_ms", keep)
    table = NewestStates(spark, path, states.schema, ["system", "salt"])
    run(states.writeStream.outputMode("update").foreachBatch(table.add), checkpoint, trigger)
    return presented(table.read(), ["system"])


def _key(events: DataFrame) -> Column:
    """What tells events apart: the id their producer gave them, or null."""
    number = F.col("event_id").cast("string")
    return F.coalesce(F.col("event_key"), number) if "event_key" in events.columns else number


def _unseen(batch: DataFrame, store: RollupStore) -> DataFrame:
    """Events of a batch that no committed batch held; those without an id are all kept.

    Only the ledger days the batch touches are read. ``batch`` is read several times:
    persist it.
    """
    keyed = batch.where("event_key is not null").dropDuplicates(["event_key"])
    bare = batch.where("event_key is null")
    days = [r[0] for r in batch.where("event_key is not null").select("event_date").distinct().collect()]
    seen = store.seen([d for d in days if d is not None])  # days are bounded by the calendar
    keyed = keyed.join(seen.select("event_date", "event_key"), ["event_date", "event_key"], "left_anti")
    return keyed.select(*batch.columns).unionByName(bare)


def apply_batch(
    store: RollupStore,
    batch: DataFrame,
    batch_id: int,
    source: str = "main",
    rules: Iterable[MetricRule] = MAINTAINED,
) -> bool:
    """Add one batch of events to the rollup tables of the rules, each event once.

    All tables and the ledger of events get the batch by one commit. So a batch that is cut
    short at any point was never there, and one that was committed is skipped when it is
    run again, also after a compaction or a reset. Events that bring no id count as often
    as they are sent. Tells whether the batch was new.
    """
    rules = list(rules)
    structures = sorted({r.structure for r in rules})
    if store.has_batch([*structures, LEDGER], batch_id, source):
        return False
    dated = batch.withColumns({"event_key": _key(batch), "event_date": F.to_date("ts")}).persist()
    fresh = _unseen(dated, store).persist()
    try:
        stored = {}
        if "bloom" in structures:
            # filters of the buckets this batch touches, to see how full they are
            low, high = fresh.agg(F.min("ts"), F.max("ts")).first()
            windows = {base_window(r) for r in rules if r.structure == "bloom"}
            if low is not None:
                for window in sorted(windows):
                    rows = store.read("bloom", window, start=low, end=high)
                    stored["bloom"] = stored["bloom"].unionByName(rows) if "bloom" in stored else rows
        ledger = fresh.where("event_key is not null").select("event_key", "event_date")
        return store.write_batch(rollups(fresh, rules, stored), batch_id, source, ledger)
    finally:
        fresh.unpersist()
        dated.unpersist()


def _stream_name(spark: SparkSession, checkpoint: str) -> str:
    """A name kept next to the checkpoint: a stream that lost it is another source, whose
    batches, numbered from 0 again, do not replace the old ones."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/source_name")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        out = fs.create(path, False)
        out.writeBytes(uuid.uuid4().hex)
        out.close()
    stream = fs.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def maintain(
    events: DataFrame,
    store: RollupStore,
    checkpoint: str,
    rules: Iterable[MetricRule] = MAINTAINED,
    trigger: Mapping[str, Any] | None = None,
) -> StreamingQuery:
    """Keep the rollup tables of the rules up to date from a stream, late and repeated events
    included. The triggers are those of :func:`run`.

    Several streams may feed one store, one at a time.
    """
    source, rules = _stream_name(store.spark, checkpoint), list(rules)

    def step(batch: DataFrame, batch_id: int) -> None:
        apply_batch(store, batch, batch_id, source, rules)

    return run(events.writeStream.foreachBatch(step), checkpoint, trigger)


def ingest(
    lines: DataFrame, path: str, checkpoint: str, trigger: Mapping[str, Any] | None = None
) -> StreamingQuery:
    """Validate a stream of JSON lines into two tables, ``events`` and ``rejects``.

    Both are partitioned by batch, so a batch run again replaces its own rows only.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        # a record without a timestamp happens now: pinned once, so both tables agree
        checked = validate(parse_records(batch)).persist()
        try:
            for name, part in (("events", accepted(checked)), ("rejects", rejected(checked))):
                (
                    part.withColumn("batch_id", F.lit(batch_id).cast("long"))
                    .write.mode("overwrite")
                    .option("partitionOverwriteMode", "dynamic")
                    .partitionBy("batch_id")
                    .parquet(f"{path}/{name}")
                )
        finally:
            checked.unpersist()

    return run(lines.writeStream.foreachBatch(step), checkpoint, trigger)


def publish(
    events: DataFrame, path: str, checkpoint: str, trigger: Mapping[str, Any] | None = None
) -> StreamingQuery:
    """Write the live feed as text files, one JSON record per line."""
    writer = published(events).writeStream.format("text").option("path", path)
    return run(writer, checkpoint, trigger)


def subscribe(spark: SparkSession, path: str) -> DataFrame:
    """The live feed as a stream of typed rows."""
    return read_feed(spark.readStream.text(path))


def follow(
    rows: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str, trigger: Mapping[str, Any] | None = None
) -> StreamingQuery:
    """Hand every batch of a subscription to ``act``, which gets its rows and number.

    The subscriber goes on where it stopped; a batch may come again after a failure, under
    the same number.
    """
    return run(rows.writeStream.foreachBatch(act), checkpoint, trigger)
