"""SimHash fingerprints and the groups of documents whose fingerprints nearly agree.

Fingerprints within ``radius`` bits are found exactly. Cut into ``radius + 2`` blocks of
bits, two such fingerprints agree in at least two blocks; so each pair of blocks names a
bucket, and only fingerprints of one bucket are compared. A bucket is a grid of tiles of
bounded size, dealt out one grid cell at a time; within a cell, tiles ordered by their
number of ones are compared by exclusive-or and bit counts, and pairs of tiles whose
numbers of ones differ by more than the radius are passed over. A cell reports a
spanning forest of its links and not every pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.components import components
from auditloom.llm.text import offsets, pieces, unused
from auditloom.session import materialize

#: Fingerprints on one side of a grid cell, about.
CELL_ROWS = 2048
_TILE = 256
_SEED = 42


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of a text: majority bits of the XXH64 values of its word shingles."""
    words = b" ".join(text.lower().split())
    if not words:
        return 0
    starts, ends = offsets(np.frombuffer(words, np.uint8), np.array([0, len(words)]))
    if len(starts) <= shingle:
        digests, n = xxhash.xxh64_digest(words, _SEED), 1
    else:
        n = len(starts) - shingle + 1
        spans = zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(words[a:b], _SEED) for a, b in spans])
    rows = np.frombuffer(digests, np.uint8).reshape(n, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(rows[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for low, high in pieces(column):
                prints = [fingerprint((v.as_py() or "").encode(), shingle) for v in column[low:high]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[low:high],
                        batch.column("mark")[low:high],
                        pa.array(np.array(prints, np.uint64).view(np.int64)),
                    ],
                    names=["doc_id", "mark", "fp"],
                )

    return run


def block_masks(radius: int) -> list[int]:
    """Bits that two fingerprints within ``radius`` must share under one mask at least."""
    cuts = [64 * i // (radius + 2) for i in range(radius + 3)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [x | y for x, y in combinations(blocks, 2)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all values within ``radius`` of each other, across two sides.

    With ``right`` None, links inside ``left``. Returns pairs of values, at most one less
    than there are values.
    """
    values = left if right is None else np.concatenate([left, right])
    label = np.arange(len(values))
    sides = [np.arange(len(left))] if right is None else [np.arange(len(left)), np.arange(len(left), len(values))]
    ones = np.bitwise_count(values).astype(np.int64)
    tiles = []
    for side in sides:
        side = side[np.argsort(ones[side], kind="stable")]
        tiles.append([side[i : i + _TILE] for i in range(0, len(side), _TILE)])
    for i, a in enumerate(tiles[0]):
        for b in tiles[0][i:] if right is None else tiles[1]:
            if ones[b[0]] - ones[a[-1]] > radius or ones[a[0]] - ones[b[-1]] > radius:
                continue
            near = np.bitwise_count(values[a][:, None] ^ values[b][None, :]) <= radius
            x, y = np.nonzero(near)
            x, y = a[x], b[y]
            while True:
                p, q = label[x], label[y]
                apart = p != q
                if not apart.any():
                    break
                x, y, p, q = x[apart], y[apart], p[apart], q[apart]
                np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
                while (label[label] != label).any():
                    label = label[label]
    member = np.flatnonzero(label != np.arange(len(values)))
    return values[label[member]], values[member]


def _cells(radius: int):
    """Links of the grid cells of a partition; rows of one cell come together."""

    def links(fp: np.ndarray, side: np.ndarray, low: int, high: int):
        if low == high:
            return forest(fp, None, radius)
        mine = side == low
        return forest(fp[mine], fp[~mine], radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        names = ["band", "key", "low", "high"]

        def flush(table: pa.Table, last: bool):
            cols = {n: table.column(n).to_numpy() for n in [*names, "fp", "side"]}
            change = np.zeros(table.num_rows, bool)
            for n in names:
                change[1:] |= cols[n][1:] != cols[n][:-1]
            cuts = [0, *np.flatnonzero(change).tolist()]
            if last:
                cuts.append(table.num_rows)
            a, b = [], []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if j - i > 1:
                    x, y = links(
                        cols["fp"][i:j].view(np.uint64), cols["side"][i:j], cols["low"][i], cols["high"][i]
                    )
                    a.append(x)
                    b.append(y)
            out = None
            if a:
                x, y = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
                out = pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"]
                )
            return out, table.slice(cuts[-1])

        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part]).combine_chunks()
            out, held = flush(held, False)
            if out is not None and out.num_rows:
                yield out
        if held is not None and held.num_rows:
            out, _ = flush(held, True)
            if out is not None and out.num_rows:
                yield out

    return run


def near_links(prints: DataFrame, radius: int = 3, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links ``a < b`` that connect all distinct ``fp`` within ``radius`` bits of each other."""
    keys = F.array(*[F.lit(_signed(m)).bitwiseAND(F.col("fp")) for m in block_masks(radius)])
    banded = prints.select("fp", F.posexplode(keys).alias("band", "key"))
    crowded = materialize(
        banded.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets"
    ).select(F.col("band").alias("b"), F.col("key").alias("k"), "n")
    tiles = F.ceil(F.col("n") / cell_rows)
    in_grid = (
        banded.join(crowded, (F.col("band") == F.col("b")) & (F.col("key") == F.col("k")))
        .withColumn("tiles", tiles.cast("long"))
        .withColumn("side", F.pmod(F.xxhash64("fp", F.lit("tile")), F.col("tiles")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    )
    cells = in_grid.select(
        "band", "key", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"),
        "fp", "side",
    )
    order = ["band", "key", "low", "high"]
    return (
        cells.repartition(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(_cells(radius), "a long, b long")
        .distinct()
    )


def simhash_groups(documents: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """Fingerprint and near-duplicate group of every document.

    Returns ``doc_id, fingerprint, component_id, component, mark`` for every input row. The
    component is named by a fingerprint in it, and by the smallest doc_id that links of at
    most ``radius`` differing bits reach; ``mark`` is the XXH64 of the text, which tells
    rows of one doc_id apart. A null or empty text has fingerprint zero and is linked like
    any other; a null doc_id counts as no doc_id (a component without any has none);
    repeated rows fall into one component; a very long text is hashed in steps; an empty
    table gives no rows; other columns are not read.
    """
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark")
    )
    prints = materialize(docs.mapInArrow(_fingerprints(shingle), "doc_id long, mark long, fp long"), "prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("lead")), "nodes")
    roots = components(near_links(nodes, radius)).select("node", "root")
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "lead"
    )
    rooted = materialize(rooted, "rooted")
    leads = materialize(
        rooted.groupBy("root").agg(F.min("lead").alias("component_id")), "leads"
    ).select(F.col("root").alias("r"), "component_id")
    named = materialize(
        rooted.join(leads, F.col("root") == F.col("r")).select(F.col("fp").alias("p"), "root", "component_id"),
        "named",
    )
    return prints.join(named, F.col("fp") == F.col("p")).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.col("root").alias("component"),
        "mark",
    )


def near_dedup(documents: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """One document of each near-duplicate group, with all its columns.

    The one with the smallest doc_id stays (null comes last); of several texts under that
    doc_id the one with the smallest XXH64, and of rows equal in both any one. Null and
    empty texts form one group; an empty table gives no rows; other columns are kept,
    whatever their names.
    """
    groups = simhash_groups(documents, shingle, radius)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    leads = groups.groupBy("component", "doc_id", "mark").agg(F.count("*").alias("n"))
    leads = leads.groupBy("component").agg(F.min(F.struct(order.alias("o"), "n")).alias("first"))
    lead, mark, rows = unused(documents.columns, "lead", "mark", "rows")
    leads = materialize(
        leads.select(
            F.col("first.o.doc_id").alias(lead), F.col("first.o.mark").alias(mark), F.col("first.n").alias(rows)
        ),
        "leads",
    )
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(lead)) & (F.xxhash64("text") == F.col(mark))
    kept = documents.join(leads, same)
    once = kept.where(F.col(rows) == 1)
    # only rows that are repeated as a whole need another shuffle
    repeated = kept.where(F.col(rows) > 1).dropDuplicates([lead, mark])
    return once.union(repeated).drop(lead, mark, rows)
