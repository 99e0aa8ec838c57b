"""Removal of passages that occur earlier in the corpus, by FM-indexes over content shards.

A window is ``width`` consecutive words of one document. Two windows with the same words
also have the same *anchor*, the smallest hash of their ``gram``-word runs. So

1. anchors are counted over the corpus; a window whose anchor is not found twice
   cannot occur twice and is left alone;
2. runs of remaining windows with one anchor become *segments*; equal segments are folded
   into their first owner, by each task before the shuffle and then by their shard, and all
   later owners lose all their windows;
3. first owners go to the shard their anchor names. A shard builds a compressed FM-index
   of its segments in blocks of bounded size, streams the segments through it by backward
   search, and reports for every window whether an earlier one exists;
4. documents lose the words of their repeated windows, less those reported to be first.

An anchor with ``hot`` or more occurrences would fill one shard, so its windows travel
alone and are dealt out by their own hash. That changes the route and no result.

Order of documents: by doc_id (null first), then by the text's CRC-32, so rows that
share a doc_id but not a text have a defined order; rows equal in both are one document
and give equal results. Words are compared as UTF-8 text, not as hashes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.fmindex import FMIndex
from auditloom.llm.text import hashes, offsets, pieces, rolling, sliding, utf8
from auditloom.session import materialize

#: Words of segments that one FM-index holds at most (plus one anchor's own).
BLOCK_WORDS = 1 << 20
#: Different segments that a task folds at a time, and about their bytes.
_SEGMENT_ROWS = 20_000
_SEGMENT_BYTES = 16 << 20


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, bytes]]:
    for i, value in enumerate(batch.column(column)):
        yield i, value.as_py() or b""


def _tidy(text: bytes) -> bytes:
    return b" ".join(text.split())


def _word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buf = np.frombuffer(text, np.uint8)
    starts, ends = offsets(buf, np.array([0, len(buf)]))
    return starts, ends, hashes(buf, starts, ends)


def _least(grams: np.ndarray, span: int) -> np.ndarray:
    """The anchor of every window."""
    return sliding(np.minimum, grams, span) if len(grams) >= span else np.zeros(0, np.uint64)


def _anchors(h: np.ndarray, width: int, gram: int):
    """Gram hashes, the anchor of every window, and which grams are an anchor of some window."""
    grams = rolling(h, gram)
    span = width - gram + 1
    least = _least(grams, span)
    if not len(least):
        return grams, least, np.zeros(len(grams), bool)
    around = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    return grams, least, sliding(np.maximum, around, span) == grams


def _signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def _pack(width: int, gram: int):
    """Rows ``doc_id, mark, anchor, n``: the anchors of every document with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for low, high in pieces(batch.column("text")):
                rows, marks, keys, ns = [], [], [], []
                for i in range(low, high):
                    text = (batch.column("text")[i].as_py() or "").encode()
                    grams, _, chosen = _anchors(_word_hashes(text)[2], width, gram)
                    if not chosen.any():
                        continue
                    key, n = np.unique(grams[chosen], return_counts=True)
                    rows.append(np.full(len(key), i, np.int64))
                    marks.append(np.full(len(key), _mark(text), np.int32))
                    keys.append(key)
                    ns.append(n)
                if rows:
                    take = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(take),
                            pa.array(np.concatenate(marks)),
                            pa.array(_signed(np.concatenate(keys))),
                            pa.array(np.concatenate(ns).astype(np.int64)),
                        ],
                        names=["doc_id", "mark", "anchor", "n"],
                    )

    return run


def _mark(text: bytes) -> int:
    return zlib.crc32(text) - (1 << 31)


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts packed for a shuffle, with the mark that tells texts of one doc_id apart."""
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for low, high in pieces(batch.column("text"), 8 << 20):
            texts = [(v.as_py() or "").encode() for v in batch.column("text")[low:high]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id")[low:high],
                    pa.array([_mark(t) for t in texts], pa.int32()),
                    pa.array([packer.compress(t) for t in texts], pa.binary()),
                ],
                names=["doc_id", "mark", "packed"],
            )


def _known(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Repeated anchors of a row, sorted, and which of them are hot."""
    known = batch.column("known")
    if not known[i].is_valid or not len(known[i]):
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    values = known[i].values
    anchor = np.asarray(values.field("anchor").to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
    hot = values.field("hot").to_numpy(zero_copy_only=False).astype(bool)
    order = np.argsort(anchor)
    return anchor[order], hot[order]


def _find(values: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    """Place of each value in the keys, or -1."""
    if not len(sorted_keys):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == values, at, -1)


def _candidates(h: np.ndarray, anchor: np.ndarray, hot: np.ndarray, width: int, gram: int):
    """Windows that may be repeated (a mask), and the route of every window."""
    least = _least(rolling(h, gram), width - gram + 1)
    if not len(least) or not len(anchor):
        return np.zeros(len(least), bool), least
    at = _find(least, anchor)
    maybe = at >= 0
    alone = maybe & hot[np.maximum(at, 0)]
    return maybe, np.where(alone, rolling(h, width), least) if alone.any() else least


def _segments(width: int, gram: int):
    """Rows ``doc_id, mark, start, route, words``: runs of candidate windows with one route.

    Of equal runs that a task meets close together only the first owner's comes out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        out: dict[tuple[int, bytes], tuple] = {}
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                anchor, hot = _known(batch, i)
                text = _tidy(unpack.decompress(batch.column("packed")[i].as_py()))
                starts, ends, h = _word_hashes(text)
                maybe, route = _candidates(h, anchor, hot, width, gram)
                if not maybe.any():
                    continue
                new = np.empty(len(maybe), bool)
                new[0] = True
                new[1:] = ~maybe[:-1] | (route[1:] != route[:-1])
                first = np.flatnonzero(maybe & new)
                stop = np.flatnonzero(maybe & np.append(new[1:] | ~maybe[1:], True))
                doc, mark = batch.column("doc_id")[i].as_py(), batch.column("mark")[i].as_py()
                for a, b, r in zip(first.tolist(), stop.tolist(), _signed(route[first]).tolist(), strict=True):
                    key = (r, text[starts[a] : ends[b + width - 1]])
                    place = (doc is not None, doc or 0, mark, a)  # null comes first
                    have = out.get(key)
                    if have is None:
                        size += len(key[1])
                    if have is None or place < have:
                        out[key] = place
                    if len(out) >= _SEGMENT_ROWS or size >= _SEGMENT_BYTES:
                        yield _segment_batch(out)
                        out, size = {}, 0
        if out:
            yield _segment_batch(out)

    return run


def _segment_batch(rows: dict[tuple[int, bytes], tuple]) -> pa.RecordBatch:
    route, words = zip(*rows, strict=True)
    known, doc, mark, start = zip(*rows.values(), strict=True)
    doc = [d if k else None for k, d in zip(known, doc, strict=True)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc, pa.int64()),
            pa.array(mark, pa.int32()),
            pa.array(start, pa.int64()),
            pa.array(route, pa.int64()),
            pa.array(words, pa.binary()),
        ],
        names=["doc_id", "mark", "start", "route", "words"],
    )


def _shard(width: int, block_words: int):
    """First windows of the segments of a shard, as runs ``doc_id, mark, start, n``.

    Rows come sorted by route, document and place; a block ends between two routes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, last = [], 0, None
        for batch in batches:
            while batch.num_rows:
                routes = batch.column("route").to_numpy()
                # about six bytes a word
                total = words + np.cumsum(np.diff(utf8(batch.column("words"))[1])) // 6
                new = np.append(routes[0] != last if held else False, routes[1:] != routes[:-1])
                full = np.flatnonzero(new & (np.append(words, total[:-1]) >= block_words))
                cut = int(full[0]) if len(full) else batch.num_rows
                if cut:
                    held.append(batch.slice(0, cut))
                    words, last = int(total[cut - 1]), routes[cut - 1]
                if len(full):
                    yield from _first_windows(pa.Table.from_batches(held), width)
                    held, words, last = [], 0, None
                batch = batch.slice(cut)
        if held:
            yield from _first_windows(pa.Table.from_batches(held), width)

    return run


def _first_windows(block: pa.Table, width: int) -> Iterator[pa.RecordBatch]:
    block = block.combine_chunks().sort_by(
        [("doc_id", "ascending"), ("mark", "ascending"), ("start", "ascending")]
    )
    ids = block.column("doc_id").combine_chunks()
    if ids.null_count:  # nulls come first
        nulls = pa.compute.indices_nonzero(ids.is_null())
        rest = pa.compute.indices_nonzero(ids.is_valid())
        block = block.take(pa.concat_arrays([nulls, rest]))
    buf, bounds = utf8(block.column("words"))
    starts, ends = offsets(buf, bounds)
    lengths = np.diff(np.searchsorted(starts, bounds))
    symbols = np.unique(hashes(buf, starts, ends), return_inverse=True)[1] + 1
    # one closing 0 after every segment
    rows = len(lengths)
    places = np.arange(len(symbols)) + np.repeat(np.arange(rows), lengths)
    text = np.zeros(len(symbols) + rows, np.int64)
    text[places] = symbols
    closes = np.cumsum(lengths + 1) - 1
    begins = closes - lengths
    index = FMIndex(text, width)
    first = np.zeros(len(text), bool)
    for at, low in index.statistics(text, begins, closes):
        first[at] = index.earliest[low] == at
    edge = np.diff(np.concatenate([[0], first.astype(np.int8), [0]]))
    run_at, run_end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(begins, run_at, side="right") - 1
    if len(owner):
        take = pa.array(owner)
        start = block.column("start").to_numpy()[owner] + run_at - begins[owner]
        yield pa.RecordBatch.from_arrays(
            [
                block.column("doc_id").take(take).combine_chunks(),
                block.column("mark").take(take).combine_chunks(),
                pa.array(start),
                pa.array(run_end - run_at),
            ],
            names=["doc_id", "mark", "start", "n"],
        )


def removed_words(h: np.ndarray, anchor, hot, kept, width: int, gram: int) -> np.ndarray:
    """Mask of the words that repeated windows cover, given the runs of windows that stay."""
    # routes are not needed here, so no anchor counts as hot
    gone, _ = _candidates(h, anchor, np.zeros_like(hot), width, gram)
    for start, n in kept:
        gone[start : start + n] = False
    cover = np.zeros(len(h) + 1, np.int64)
    at = np.flatnonzero(gone)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return np.cumsum(cover[:-1]) > 0


def _cut(width: int, gram: int):
    """Rows ``doc_id, n_words, n_removed, kept_text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            n_words, n_removed, kept_text, low, size = [], [], [], 0, 0
            for i in range(batch.num_rows):
                raw = unpack.decompress(batch.column("packed")[i].as_py())
                words = raw.split()
                anchor, hot = _known(batch, i)
                gone = 0
                if len(anchor):
                    kept = [(k["start"], k["n"]) for k in batch.column("kept")[i].as_py() or []]
                    mask = removed_words(_word_hashes(raw)[2], anchor, hot, kept, width, gram)
                    gone = int(mask.sum())
                    if gone:
                        words_kept = [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
                n_words.append(len(words))
                n_removed.append(gone)
                kept_text.append(b" ".join(words_kept if gone else words))
                size += len(raw)
                if size > 8 << 20 or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id")[low : i + 1],
                            pa.array(n_words, pa.int64()),
                            pa.array(n_removed, pa.int64()),
                            pa.array(kept_text, pa.binary()).cast(pa.string()),
                            pa.array([hashlib.sha256(t).hexdigest() for t in kept_text], pa.string()),
                        ],
                        names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"],
                    )
                    n_words, n_removed, kept_text, low, size = [], [], [], i + 1, 0

    return run


def substring_dedup(
    documents: DataFrame,
    width: int = 20,
    gram: int = 8,
    hot: int = 64,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Remove every word covered by a window whose words also start earlier in the corpus.

    Returns ``doc_id, n_words, n_removed, kept_text, kept_sha256`` with a row for every
    input row. Windows are judged on the input. A null text has no words; a text below
    ``width`` words keeps them all; a very long text is routed window by window, and a task
    holds its words; an empty table gives no rows; other columns are not read.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    anchors = docs.mapInArrow(_pack(width, gram), "doc_id long, mark int, anchor long, n long")
    repeated = materialize(
        anchors.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1"), "anchors"
    ).select(F.col("anchor").alias("a"), (F.col("n") >= hot).alias("hot"))
    known = materialize(
        anchors.join(repeated, F.col("anchor") == F.col("a"))
        .groupBy("doc_id", "mark")
        .agg(F.collect_set(F.struct("anchor", "hot")).alias("known")),
        "known",
    )
    packed = docs.mapInArrow(_shrink, "doc_id long, mark int, packed binary")
    k = known.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "known")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m"))
    segments = packed.join(k, same).drop("d", "m").mapInArrow(
        _segments(width, gram), "doc_id long, mark int, start long, route long, words binary"
    )
    # one shuffle: rows of one route are together, so equal segments among them are too
    firsts = segments.repartition("route").groupBy("route", "words").agg(
        F.min(F.struct("doc_id", "mark", "start")).alias("first")
    )
    shards = firsts.select("first.*", "route", "words").sortWithinPartitions("route")
    kept = materialize(
        shards.mapInArrow(_shard(width, block_words), "doc_id long, mark int, start long, n long"),
        "kept",
    )
    runs = kept.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "n")).alias("kept"))
    marks = known.join(
        runs.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "kept"), same, "left"
    ).select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "known", "kept")
    return packed.join(marks, same, "left").drop("d", "m").mapInArrow(
        _cut(width, gram),
        "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string",
    )
