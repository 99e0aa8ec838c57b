"""Running sums in a total order, spread over the cluster.

A window over one key puts the key into one task. Here rows are range-partitioned by
key and order instead, so a hot key is cut into many chunks. One pass over the sorted
chunks adds the sums inside each chunk and writes, beside the rows, one row of totals for
every key and chunk; only these totals are summed in order, and then the rows are read
once.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.functions.joins import join_groups
from auditloom.session import partitions_for, run_dir

_ROWS, _TOTALS = 0, 1


def _changes(columns: Sequence[pa.Array], n: int) -> np.ndarray:
    """Where a row differs in one of the columns from the row before; null equals null."""
    out = np.zeros(n, bool)
    for c in columns:
        a, b = c.slice(1), c.slice(0, n - 1)
        unlike = pc.fill_null(pc.not_equal(a, b), pc.xor(pc.is_null(a), pc.is_null(b)))
        out[1:] |= np.asarray(unlike.to_numpy(zero_copy_only=False), bool)
    return out


def _chunk_sums(keys: Sequence[str], sums: Sequence[str]):
    """Adds sums along sorted rows, per key; a row of totals follows every key of the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId()
        held: tuple | None = None  # key and totals that the rows so far have left
        totals: dict[str, object] = {}
        schema: pa.Schema | None = None

        def closed(ended: list[tuple[tuple, dict]]) -> pa.RecordBatch:
            named = [dict(zip(keys, key, strict=True)) | values for key, values in ended]
            arrays = [
                pa.array([row.get(f.name) for row in named], f.type) if f.name in (*keys, *sums)
                else pa.nulls(len(named), f.type)
                for f in schema
            ]
            return out_batch(arrays, len(named), _TOTALS)

        def out_batch(arrays: list[pa.Array], n: int, kind: int) -> pa.RecordBatch:
            more = [pa.array(np.full(n, chunk, np.int32)), pa.array(np.full(n, kind, np.int32))]
            return pa.RecordBatch.from_arrays([*arrays, *more], names=[*schema.names, "__chunk", "__kind"])

        for batch in batches:
            n, schema = batch.num_rows, batch.schema
            if not n:
                continue
            change = _changes([batch.column(k) for k in keys], n)
            first = tuple(batch.column(k)[0].as_py() for k in keys)
            ended = []
            if held is not None and held != first:
                ended.append((held, totals))
                held = None
            starts = np.flatnonzero(change)
            group = np.cumsum(change)
            summed = {}
            for name in sums:
                values = batch.column(name)
                values = pc.fill_null(values, pa.scalar(0, values.type)).to_numpy(zero_copy_only=False)
                before = totals[name] if held is not None else values.dtype.type(0)
                run_up = np.cumsum(values) + before
                # what had been summed up when each later key began is taken off again
                base = np.concatenate([[values.dtype.type(0)], run_up[starts - 1]]) if len(starts) else None
                if base is not None and values.dtype.kind == "f":
                    # floats are summed key by key: nothing large is added and taken away
                    parts = np.split(values, starts)
                    parts[0] = np.cumsum(parts[0]) + before
                    run_up = np.concatenate([parts[0], *[np.cumsum(p) for p in parts[1:]]])
                elif base is not None:
                    run_up = run_up - base[group]
                summed[name] = run_up
            for i, start in enumerate(starts):
                key = tuple(batch.column(k)[int(start) - 1].as_py() for k in keys)
                ended.append((key, {name: summed[name][start - 1].item() for name in sums}))
            held = tuple(batch.column(k)[n - 1].as_py() for k in keys)
            totals = {name: summed[name][n - 1].item() for name in sums}
            arrays = [pa.array(summed[f.name], f.type) if f.name in sums else batch.column(f.name) for f in schema]
            yield out_batch(arrays, n, _ROWS)
            if ended:
                yield closed(ended)
        if held is not None:
            yield closed([(held, totals)])

    return run


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, str]
) -> DataFrame:
    """Add to every row the sums, per key, of all rows up to and including it.

    ``sums`` maps new column names to SQL expressions over a row, whole numbers or doubles
    (null counts as 0); the sum over the whole key is added under the same name with
    ``_total``. ``order`` should tell rows apart; equal rows are summed in no fixed order
    and cannot be split.
    """
    keys, order, names = list(keys), list(order), list(sums)
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    plain = df.select("*", *[F.expr(e).alias(n) for n, e in sums.items()])
    typed = {n: "long" if isinstance(plain.schema[n].dataType, whole) else "double" for n in names}
    plain = plain.withColumns({n: F.col(n).cast(t) for n, t in typed.items()})
    by = [F.col(c) for c in keys + order]
    chunks = plain.repartitionByRange(partitions_for(df), *by).sortWithinPartitions(*by)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in plain.schema])
    schema = schema.add("__chunk", T.IntegerType()).add("__kind", T.IntegerType())
    # the chunk numbers must not change between the two uses below
    path = run_dir(df.sparkSession, "ordered")
    chunks.mapInArrow(_chunk_sums(keys, names), schema).write.partitionBy("__kind").parquet(path)
    written = df.sparkSession.read.schema(schema).parquet(path)
    # one row per key and chunk: even a single key has no more rows than there are chunks
    totals = written.where(F.col("__kind") == _TOTALS).select(*keys, "__chunk", *names)
    every = Window.partitionBy(*keys)
    earlier = every.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        *keys,
        "__chunk",
        *[F.sum(n).over(earlier).alias(f"_{n}") for n in names],
        *[F.sum(n).over(every).alias(f"{n}_total") for n in names],
    )
    rows = written.where(F.col("__kind") == _ROWS).drop("__kind")
    joined = join_groups(rows, before, [*keys, "__chunk"])
    zero = F.lit(0)
    total = [(F.col(n) + F.coalesce(F.col(f"_{n}"), zero)).alias(n) for n in names]
    return joined.select(*df.columns, *total, *[f"{n}_total" for n in names])
