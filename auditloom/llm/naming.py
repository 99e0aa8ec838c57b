"""Exact copies of texts by deterministic block naming.

A text, without its white space, is cut into blocks of a fixed number of bytes. Equal blocks
get the same integer name and unlike blocks unlike ones: the distinct blocks are sorted, and
each gets the number of its place. Then adjacent names of a document are paired, the
distinct pairs sorted and named in the same way, and so on until every document has one
name. By induction two documents that have the same name after the same number of rounds
are the same text; no hash decides anything.

A task first names the blocks it meets on its own and sends each of them on once, so a
block that a third of all documents share is sorted once for every task, and a text is
shuffled once at most. All later rounds move integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.session import materialize

BLOCK_BYTES = 4096
_WHITE = bytes([0x20, *range(0x09, 0x0E)])
#: Bytes of blocks that a task remembers; it starts anew beyond that.
_HELD = 64 << 20
#: Bytes of blocks in one batch of a result.
_BATCH = 4 << 20
#: Numbers of a task start at its partition's number shifted by this.
_SHIFT = 40

_BLOCKS = pa.schema(
    [
        ("row", pa.int64()), ("at", pa.int32()), ("parts", pa.int32()), ("code", pa.int64()),
        ("block", pa.binary()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("digest", pa.binary()),
    ]
)


def normal(text: str | None) -> bytes:
    """The text as UTF-8 without white space; null is empty."""
    return (text or "").encode().translate(None, _WHITE)


def _cut(size: int):
    """Rows of :data:`_BLOCKS`: a document's blocks under task-wide codes. The first row of a
    document has its figures, and the first row of a code (in a task) the block itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[bytes, int] = {}
        held, code = 0, TaskContext.get().partitionId() << _SHIFT
        out, waiting = [], 0
        for batch in batches:
            columns = [batch.column(c) for c in ("row", "doc_id", "n_chars", "text")]
            for row, doc_id, n_chars, text in zip(*columns, strict=True):
                data = normal(text.as_py())
                figures = (doc_id.as_py(), n_chars.as_py(), hashlib.sha256(data).digest())
                parts = max(1, -(-len(data) // size))
                for at in range(parts):
                    block = data[at * size : (at + 1) * size]
                    known = codes.get(block)
                    if known is None:
                        if held > _HELD:
                            codes, held = {}, 0
                        known = codes[block] = code
                        code, held, waiting = code + 1, held + len(block) + 100, waiting + len(block)
                        shown = block
                    else:
                        shown = None
                    out.append((row.as_py(), at, parts, known, shown, *figures))
                    figures = (None, None, None)
                    waiting += 100
                    if waiting > _BATCH:
                        yield _batch(out)
                        out, waiting = [], 0
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _BLOCKS, strict=True)], schema=_BLOCKS
    )


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Name of every code, from sorted blocks: equal blocks stand together and get one name."""
    name, last = (TaskContext.get().partitionId() << _SHIFT) - 1, None
    for batch in batches:
        names = []
        for value in batch.column("block"):
            block = value.as_py()
            if block != last:
                name, last = name + 1, block
            names.append(name)
        yield pa.RecordBatch.from_arrays([batch.column("code"), pa.array(names, pa.int64())], names=["code", "name"])


def _pair_round(names: DataFrame) -> DataFrame:
    """Names of adjacent pairs: half as many ``row, at, parts, name``; -1 stands for no partner."""
    half = F.expr("cast(at div 2 as int)")
    side = lambda k: F.max(F.when(F.col("at") % 2 == k, F.col("name")))
    pairs = names.groupBy("row", "parts", half.alias("at")).agg(
        side(0).alias("a"), F.coalesce(side(1), F.lit(-1).cast("long")).alias("b")
    )
    # sorted inside a task, numbered on from the task's own first number
    sorted_pairs = pairs.select("a", "b").distinct().sortWithinPartitions("a", "b")
    numbered = materialize(
        sorted_pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), F.monotonically_increasing_id().alias("name")),
        "pairs",
    )
    return pairs.join(numbered, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y"))).select(
        "row", "at", F.expr("cast((parts + 1) div 2 as int)").alias("parts"), "name"
    )


def name_documents(documents: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One collision-free identity for every row: ``row, doc_id, n_chars, digest, rounds, name``.

    Rows have the same ``rounds`` and ``name`` if and only if their texts agree without
    white space. ``row`` tells rows apart, ``n_chars`` counts the code points of the text
    as given, ``digest`` is the SHA-256 of the normal text. Names hold within one call.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = documents.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.length(text).cast("long").alias("n_chars"),
        text.alias("text"),
    )
    schema = "row long, at int, parts int, code long, block binary, doc_id long, n_chars long, digest binary"
    blocks = materialize(docs.mapInArrow(_cut(block_bytes), schema), "blocks")
    distinct = blocks.where("block is not null").select("block", "code")
    numbered = materialize(
        distinct.repartition("block").sortWithinPartitions("block").mapInArrow(_number, "code long, name long"), "names"
    ).select(F.col("code").alias("c"), "name")
    named = materialize(
        blocks.select("row", "at", "parts", "code").join(numbered, F.col("code") == F.col("c")).drop("code", "c"), "named"
    )
    done, rounds = [], 0
    while True:
        done.append(named.where("parts = 1").select("row", F.lit(rounds).alias("rounds"), "name"))
        longer = named.where("parts > 1")
        if longer.isEmpty():  # after as many rounds as the longest text's blocks can be halved
            break
        named, rounds = materialize(_pair_round(longer), "named"), rounds + 1
    identity = done[0]
    for part in done[1:]:
        identity = identity.union(part)
    heads = blocks.where("at = 0").select(F.col("row").alias("r"), "doc_id", "n_chars", "digest")
    return heads.join(identity, F.col("r") == F.col("row")).select(
        "row", "doc_id", "n_chars", "digest", "rounds", "name"
    )


def exact_dedup(documents: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Groups of equal texts, and the row of each that stays.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256`` for every input row. White
    space does not count; of equal texts the row with most code points as given stays, then
    the smallest doc_id (null comes last), then any one, so exactly one row of a group is
    ``kept``. Null and empty texts and texts of white space are one group, whose digest is
    that of no bytes; ``keep_id`` is null where the row that stays has no doc_id; repeated
    rows count as often as they come; very long texts take more rounds, not more memory
    than a text and its blocks; an empty table gives no rows; other columns are not read.
    """
    named = materialize(name_documents(documents, block_bytes), "identities")
    best = F.struct((-F.col("n_chars")).alias("size"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    groups = named.groupBy("rounds", "name").agg(F.min(best).alias("best"), F.count("*").alias("group_size"))
    groups = groups.select(
        F.col("rounds").alias("k"), F.col("name").alias("n"), "group_size",
        F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"),
    )
    return named.join(groups, (F.col("rounds") == F.col("k")) & (F.col("name") == F.col("n"))).select(
        "doc_id", "keep_id", "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
