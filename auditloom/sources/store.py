"""Rollup tables on shared storage: append batches, merge on read, compact, expire, reset.

Layout: ``root/data/table/txn=../window=../bucket_date=../*.parquet``, and the commit log of
:mod:`auditloom.sources.log`, which says what of that counts. A batch is one commit over all
the tables it touches: readers see all of it or nothing, a batch cut short was never there,
and one that is committed is skipped when it comes again, whatever has been compacted,
expired or reset since. One writer per store; readers are free.

What an event adds to a structure is stored once, in one window: in the window it was
written in until that has run out, then (:meth:`RollupStore.expire`) in the next longer
ones. Answers for a window add up what is stored in it and in all shorter ones.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.buckets import bucket_end, bucket_start, bucket_start_by, expires_at
from auditloom.operators import bloom, heavy, moments
from auditloom.operators.mergeable import hll, kll, theta_rows
from auditloom.schema import LEDGER_SCHEMA, ROLLUP_SCHEMAS, WINDOW_CODES, window_spec
from auditloom.session import materialize
from auditloom.sources.log import Folder, Log, Reset, State

# Longer windows and the shorter ones that tile them, best first.
TILES = {
    "5m": ("1m",),
    "15m": ("5m", "1m"),
    "1h": ("15m", "5m", "1m"),
    "1d": ("1h", "15m", "5m", "1m"),
    "1w": ("1d", "1h", "15m", "5m", "1m"),
    "1M": ("1d", "1h", "15m", "5m", "1m"),
}
# Where rows go when their window has run out; weeks and months both come from days.
NEXT = {"1m": ("1h",), "5m": ("1h",), "15m": ("1h",), "1h": ("1d",), "1d": ("1w", "1M"), "1w": (), "1M": ()}
LEDGER = "ledger"
KEY = ["metric", "system", "window", "bucket_start"]
# What a row of each structure weighs, for the footprint.
_PAYLOAD = {
    "hll": "length(sketch)", "theta": "length(sketch)", "kll": "length(sketch)", "moments": "56",
    "member": "length(value)", "topk": "length(item) + 8", "heavy": "coalesce(length(item), 0) + 8",
    "bloom": "64",
}


def _day(value: date | datetime) -> str:
    return value.strftime("%Y-%m-%d")


@dataclass(frozen=True)
class RollupStore:
    spark: SparkSession
    root: str
    _held: dict[str, Log] = field(default_factory=dict, compare=False, repr=False)

    @property
    def log(self) -> Log:
        return self._held.setdefault("log", Log(self.spark, self.root))

    def state(self) -> State:
        return self.log.state()

    # ---- writing ----------------------------------------------------------------------
    def write(self, structure: str, rows: DataFrame, batch_id: int, source: str = "main") -> bool:
        """Append one batch of summary rows of a source (a stable name of who writes).

        A batch that has been committed is skipped; tells whether it was written.
        """
        return self.write_batch({structure: rows}, batch_id, source)

    def write_batch(
        self, tables: Mapping[str, DataFrame], batch_id: int, source: str = "main", ledger: DataFrame | None = None
    ) -> bool:
        """Append one batch to several tables at once: all of it counts, or none of it.

        ``ledger`` has ``event_key, event_date`` of the events the batch brings. Tells
        whether anything was written; tables that have taken the batch before are skipped.
        """
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", source):
            raise ValueError(f"not a source name: {source}")
        before = self.state()
        todo = {t: rows for t, rows in tables.items() if not before.has(t, source, batch_id)}
        if ledger is not None and not before.has(LEDGER, source, batch_id):
            todo[LEDGER] = ledger
        if not todo:
            return False
        txn = uuid.uuid4().hex
        # independent tables: their jobs share the cluster instead of queueing
        with ThreadPoolExecutor(len(todo)) as pool:
            written = [pool.submit(self._write, t, rows, txn) for t, rows in todo.items()]
        add = [folder for one in written for folder in one.result()]
        self.log.commit(before, add=add, done=[(t, source, batch_id) for t in todo])
        return True

    def has_batch(self, tables: Sequence[str], batch_id: int, source: str = "main") -> bool:
        """Whether all these tables have taken a batch."""
        state = self.state()
        return all(state.has(t, source, batch_id) for t in tables)

    def _write(self, table: str, rows: DataFrame, txn: str) -> list[Folder]:
        """Write files that do not count yet; tells their folders."""
        path = f"{self.root}/data/{table}/txn={txn}"
        if table == LEDGER:
            rows.select("event_key", "event_date").hint("rebalance", "event_date").write.partitionBy(
                "event_date"
            ).parquet(path)
            days = [name.rpartition("event_date=")[2] for name in self.log.files.glob(f"{path}/event_date=*")]
            return [Folder(table, txn, "", day) for day in days]
        expiry = None
        for code in WINDOW_CODES:
            one = F.when(F.col("window") == code, expires_at(F.col("last_ts"), code))
            expiry = one if expiry is None else F.coalesce(expiry, one)
        names = [f.strip().split(" ")[0] for f in ROLLUP_SCHEMAS[table].split(",")]
        full = (
            rows.withColumn("expires_at", expiry)
            .withColumn("bucket_date", F.to_date("bucket_start"))
            .select(*[n for n in names if n != "txn"])
        )
        # even files per folder: small folders get one task, big ones are split
        full.hint("rebalance", "window", "bucket_date").write.partitionBy("window", "bucket_date").parquet(path)
        found = [re.search(r"window=([^/]+)/bucket_date=([^/]+)$", n) for n in self.log.files.glob(f"{path}/window=*/bucket_date=*")]
        return [Folder(table, txn, m[1], m[2]) for m in found if m]

    # ---- reading ----------------------------------------------------------------------
    def _rows(self, state: State, folders: Sequence[Folder]) -> DataFrame:
        """Rows of folders of one table, without what resets took away."""
        table = folders[0].table
        schema, base = ROLLUP_SCHEMAS[table], f"{self.root}/data/{table}"
        groups: dict[tuple[Reset, ...], list[str]] = {}
        for f in folders:
            path = f"{base}/txn={f.txn}/window={f.window}/bucket_date={f.day}"
            groups.setdefault(state.resets_of(f), []).append(path)
        out = None
        for resets, paths in groups.items():
            rows = self.spark.read.schema(schema).option("basePath", base).parquet(*paths)
            for r in resets:
                gone = F.lit(True)
                for column, value in (("metric", r.metric), ("system", r.system)):
                    if value is not None:
                        gone &= F.col(column).eqNullSafe(F.lit(value))
                rows = rows.where(~gone)
            out = rows if out is None else out.unionByName(rows)
        return out

    def _empty(self, structure: str) -> DataFrame:
        return self.spark.createDataFrame([], ROLLUP_SCHEMAS[structure])

    def read(
        self,
        structure: str,
        window: str = "1h",
        start: datetime | None = None,
        end: datetime | None = None,
    ) -> DataFrame:
        """Stored rows of a window and range of buckets, batches not yet merged.

        The log knows the folders of the range, so others are neither listed nor opened.
        """
        window_spec(window)
        # the bucket that holds ``start`` may begin up to a month before it
        first = _day(start - timedelta(days=31)) if start is not None else ""
        state = self.state()
        folders = state.live(structure, window, first, _day(end) if end is not None else "9999")
        if not folders:
            return self._empty(structure)
        rows = self._rows(state, folders)
        if start is not None:
            bucket = bucket_start(F.lit(start).cast("timestamp"), window)
            rows = rows.where((F.col("bucket_date") >= F.to_date(bucket)) & (F.col("bucket_start") >= bucket))
        if end is not None:
            bucket = bucket_start(F.lit(end).cast("timestamp"), window)
            rows = rows.where((F.col("bucket_date") <= F.to_date(bucket)) & (F.col("bucket_start") <= bucket))
        return rows

    def merged(self, structure: str, window: str = "1h", **span: Any) -> DataFrame:
        """One row per key (and item): all batches merged."""
        return merge_rows(structure, self.read(structure, window, **span))

    def tiles(
        self,
        structure: str,
        window: str,
        start: datetime | None = None,
        end: datetime | None = None,
    ) -> DataFrame:
        """Stored rows of a window and of the windows that tile it, as they are stored."""
        window_spec(window)
        state = self.state()
        first = _day(start - timedelta(days=31)) if start is not None else ""
        last = _day(end + timedelta(days=31)) if end is not None else "9999"
        folders = [f for w in (window, *TILES.get(window, ())) for f in state.live(structure, w, first, last)]
        if not folders:
            return self._empty(structure)
        rows = self._rows(state, folders)
        if start is not None:
            low = bucket_start(F.lit(start).cast("timestamp"), window)
            rows = rows.where((F.col("bucket_date") >= F.to_date(low)) & (F.col("bucket_start") >= low))
        if end is not None:
            stop = bucket_end(bucket_start(F.lit(end).cast("timestamp"), window), window)
            rows = rows.where((F.col("bucket_date") <= F.to_date(stop)) & (F.col("bucket_start") < stop))
        return rows

    def at(
        self,
        structure: str,
        window: str,
        start: datetime | None = None,
        end: datetime | None = None,
    ) -> DataFrame:
        """Merged rows for any window: what is stored in it and in the windows that tile it."""
        return coarser(structure, self.tiles(structure, window, start, end), window)

    def live(self, structure: str, window: str, as_of: datetime) -> DataFrame:
        """Merged rows that have not run out at ``as_of``."""
        return self.merged(structure, window).where(F.col("expires_at") > F.lit(as_of))

    def seen(self, days: Sequence[date]) -> DataFrame:
        """The ledger of these days: ``event_key, event_date`` of the events that were counted."""
        wanted = {_day(d) for d in days}
        folders = [f for f in self.state().live(LEDGER) if f.day in wanted]
        if not folders:
            return self.spark.createDataFrame([], LEDGER_SCHEMA)
        base = f"{self.root}/data/{LEDGER}"
        paths = [f"{base}/txn={f.txn}/event_date={f.day}" for f in folders]
        return self.spark.read.schema(LEDGER_SCHEMA).option("basePath", base).parquet(*paths)

    # ---- upkeep -----------------------------------------------------------------------
    def compact(self, structure: str) -> int:
        """Merge the batches of every window and day that has several; others keep their files.

        Readers that started before keep what they see until :meth:`drop_old_versions`.
        Tells how many folders were merged.
        """
        state = self.state()
        groups: dict[tuple[str, str], list[Folder]] = {}
        for f in state.live(structure):
            groups.setdefault((f.window, f.day), []).append(f)
        old = [f for fs in groups.values() if len(fs) > 1 or state.resets_of(fs[0]) for f in fs]
        if old:
            self._replace(state, structure, old, merge_rows(structure, self._rows(state, old)))
        return len(old)

    def expire(self, structure: str, as_of: datetime) -> int:
        """Move the days all of whose rows have run out to the next longer windows.

        Hours go to days, days to weeks and months, and weeks and months go for good. Only
        the folders of these days are read and written. Tells how many days of how many
        windows were moved.
        """
        state = self.state()
        # a row runs out no earlier than its day and its window's lifetime say
        old = [
            f for f in state.live(structure)
            if datetime.fromisoformat(f.day) + timedelta(seconds=window_spec(f.window).retention_s) <= as_of
        ]
        if not old:
            return 0
        rows = self._rows(state, old)
        until = rows.groupBy("window", F.date_format("bucket_date", "yyyy-MM-dd").alias("day")).agg(
            F.max("expires_at").alias("until")
        )
        # one row per window and day, so the list is bounded by the calendar
        kept = {(r["window"], r["day"]) for r in until.where(F.col("until") > F.lit(as_of)).collect()}
        old = [f for f in old if (f.window, f.day) not in kept]
        if not old:
            return 0
        parts = None
        merged = materialize(merge_rows(structure, self._rows(state, old)), "expired")
        for code in sorted({f.window for f in old}):
            for longer in NEXT[code]:
                part = coarser(structure, merged.where(F.col("window") == code), longer)
                parts = part if parts is None else parts.unionByName(part)
        self._replace(state, structure, old, parts)
        return len({(f.window, f.day) for f in old})

    def _replace(self, state: State, structure: str, old: Sequence[Folder], rows: DataFrame | None) -> None:
        new = [] if rows is None else self._write(structure, rows, uuid.uuid4().hex)
        self.log.commit(state, add=new, remove=old)

    def reset(self, structure: str, metric: str | None = None, system: str | None = None) -> None:
        """Start a structure anew, or one metric or system of it.

        What was committed before no longer counts; batches from before that come again add
        nothing, as they have been taken; later batches count from zero.
        """
        state = self.state()
        if metric is None and system is None:
            self.log.commit(state, remove=state.live(structure))
        else:
            self.log.commit(state, resets=[(structure, metric, system)])

    def expire_ledger(self, before: date) -> int:
        """Forget which events were seen on days before ``before``; tells how many days.

        An event sent again after that would be counted again.
        """
        state = self.state()
        old = [f for f in state.live(LEDGER) if f.day < _day(before)]
        if old:
            self.log.commit(state, remove=old)
        return len({f.day for f in old})

    def drop_old_versions(self, structure: str) -> int:
        """Delete files that no longer count: replaced, run out, reset or cut short.

        For the writer, when nobody reads an old state any more. Tells how many folders.
        """
        state, files = self.state(), self.log.files
        base = f"{self.root}/data/{structure}"
        live = {f.txn for f in state.live(structure)}
        gone = [n for n in files.names(base) if n.startswith("txn=") and n[4:] not in live]
        for name in gone:
            files.delete(f"{base}/{name}")
        # a folder of a commit of which other days still count
        count = len(gone)
        kept = {(f.txn, f.window, f.day) for f in state.live(structure)}
        pattern = "event_date=*" if structure == LEDGER else "window=*/bucket_date=*"
        for name in files.glob(f"{base}/txn=*/{pattern}"):
            found = re.search(r"txn=([^/]+)/(?:window=([^/]+)/)?(?:bucket|event)_date=([^/]+)$", name)
            if found and (found[1], found[2] or "", found[3]) not in kept:
                files.delete(name)
                count += 1
        self.log.trim()
        return count

    def footprint(self, structures: Sequence[str] = tuple(ROLLUP_SCHEMAS)) -> DataFrame:
        """Keys, rows and bytes of payload per structure and window."""
        state, out = self.state(), None
        for structure in structures:
            folders = state.live(structure)
            if not folders:
                continue
            part = (
                self._rows(state, folders)
                .groupBy("window", *[k for k in KEY if k != "window"])
                .agg(F.count(F.lit(1)).alias("r"), F.sum(F.expr(_PAYLOAD[structure])).alias("b"))
                .groupBy(F.lit(structure).alias("structure"), "window")
                .agg(
                    F.count(F.lit(1)).alias("keys"),
                    F.sum("r").alias("rows"),
                    F.sum("b").cast("long").alias("bytes"),
                )
            )
            out = part if out is None else out.unionByName(part)
        if out is None:
            return self.spark.createDataFrame([], "structure string, window string, keys long, rows long, bytes long")
        return out


def merge_rows(structure: str, rows: DataFrame) -> DataFrame:
    """Merge rows of a structure: one row per key (and item, value or block)."""
    last = F.max("last_ts").alias("last_ts")
    if structure == "hll":
        out = hll().merge(rows, KEY)
    elif structure == "theta":
        out = theta_rows().merge(rows, KEY)
    elif structure == "kll":
        out = kll().merge(rows, KEY)
    elif structure == "topk":
        out = rows.groupBy(*KEY, "item").agg(F.sum("cnt").alias("cnt"), last)
    elif structure == "heavy":
        out = heavy.counter_merge(rows, KEY)
    elif structure == "member":
        out = rows.groupBy(*KEY, "value").agg(last)
    elif structure == "bloom":
        out = bloom.merge_shapes(rows, KEY, last)
    elif structure == "moments":
        out = moments.merge(rows, KEY, last)
    else:
        raise ValueError(f"unknown structure {structure}; valid: {', '.join(ROLLUP_SCHEMAS)}")
    expiry = None
    for code in WINDOW_CODES:
        one = F.when(F.col("window") == code, expires_at(F.col("last_ts"), code))
        expiry = one if expiry is None else F.coalesce(expiry, one)
    return out.withColumn("expires_at", expiry)


def coarser(structure: str, rows: DataFrame, window: str) -> DataFrame:
    """Rows of a longer window from rows of a shorter one."""
    window_spec(window)
    moved = rows.withColumn("window", F.lit(window)).withColumn(
        "bucket_start", bucket_start_by(F.col("bucket_start"), F.col("window"))
    )
    return merge_rows(structure, moved)
