"""Benchmark decontamination by templates.

Words are lower-cased and stripped of ASCII punctuation; numbers, names and units become
typed placeholders whose values are kept as slots. Windows of template words are joined by
hash to the windows of the benchmark. For a document and an item, the slots of all joined
windows must agree on one-to-one substitutions (an item's "7" always became "12"); windows
that do not fit are not counted. Windows with too few literals for a template are joined by
the hash of all their words as written, so they fit only what is equal to them. A document
that covers enough of an item's words, or a long run of them, is contaminated by it,
verbatim or with changed parameters.

Benchmarks share passages, such as the heads of their prompts. With ``few_items=None`` every
window proposes pairs with all items that carry it, and every pair is told. Otherwise a
window that more items carry only adds to pairs that a rarer window has proposed, and a
document that is left without a pair is judged on all its windows against all items that
carry them, and told once: the same documents are found, with fewer pairs.

Documents with the same windows fare alike, so one of them is judged for all. Pairs whose
windows could not cover enough even if all of them fit are not judged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.joins import join_groups
from auditloom.llm.text import hashes, mix, offsets, pieces, rolling, unused, utf8
from auditloom.session import materialize

#: Units of measure that follow a number.
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg lb lbs oz gram grams ton tons "
    "ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hour hours "
    "day days week weeks month months year years percent degree degrees euro euros dollar dollars cent "
    "cents pound pounds mph kmh hz w kw v"
).split()

#: Items that may carry a window before it counts as shared, unless all pairs are asked for.
FEW_ITEMS = 8

#: Benchmark windows up to this number are sent to every task as a filter (8 bytes each);
#: beyond it all windows of the documents go through the join instead, with equal results.
FILTER_WINDOWS = 2_000_000

_LITERAL, _NUMBER, _NAME, _UNIT = 0, 1, 2, 3
_TEMPLATE, _EXACT, _NAMED = 0, 1, 2  # forms of a window
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_CORE = np.zeros(256, bool)
_CORE[0x80:] = True
_DIGIT, _CAPITAL, _STOP = (np.zeros(256, bool) for _ in range(3))
_DIGIT[ord("0") : ord("9") + 1] = True
_CAPITAL[ord("A") : ord("Z") + 1] = True
_CORE |= _DIGIT | _CAPITAL | np.isin(np.arange(256), np.arange(ord("a"), ord("z") + 1))
_STOP[[ord(c) for c in ".!?:"]] = True
_MARKS = mix(np.arange(1, 4, dtype=np.uint64) + np.uint64(77))


def _hash_words(words: list[str]) -> np.ndarray:
    buf = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    return hashes(buf, np.concatenate([[0], ends[:-1]]), ends)


_UNIT_HASHES = np.sort(_hash_words(UNITS))


def template(buf: np.ndarray, bounds: np.ndarray):
    """Template words of several texts: core start, core end, kind, hash, folded hash, and text bounds.

    ``bounds`` are the offsets at which texts begin and end; the last result holds the
    number of template words before each of them. The folded hash is that of the lower-cased
    word whatever its kind.
    """
    starts, ends = offsets(buf, bounds)
    first_of_text = np.searchsorted(starts, bounds[:-1])
    core = _CORE[buf]
    at = np.arange(len(buf))
    last = np.maximum.accumulate(np.where(core, at, -1))
    following = np.minimum.accumulate(np.where(core, at, len(buf))[::-1])[::-1]
    opens = np.zeros(len(starts), bool)  # words that begin a sentence
    if len(starts):
        opens[1:] = _STOP[buf[ends[:-1] - 1]]
        breaks = np.concatenate([[0], np.cumsum(buf == 10)])
        opens[1:] |= breaks[starts[1:]] > breaks[ends[:-1]]
        opens[first_of_text[first_of_text < len(starts)]] = True
        begin, end = following[starts], last[ends - 1] + 1
        keep = begin < end
        begin, end, opens = begin[keep], end[keep], opens[keep]
        words_before = np.concatenate([[0], np.cumsum(keep)])
    else:
        begin = end = starts
        words_before = np.zeros(1, np.int64)
    places = words_before[np.searchsorted(starts, bounds)]
    h = folded = hashes(_FOLD[buf], begin, end)
    kind = np.zeros(len(begin), np.int8)
    head = buf[begin]
    kind[_CAPITAL[head] & ~opens] = _NAME
    kind[_DIGIT[head]] = _NUMBER
    if len(kind) > 1:
        unit = np.zeros(len(kind), bool)
        spot = np.minimum(np.searchsorted(_UNIT_HASHES, h[1:]), len(_UNIT_HASHES) - 1)
        unit[1:] = (kind[:-1] == _NUMBER) & (_UNIT_HASHES[spot] == h[1:])
        unit[places[:-1][places[:-1] < len(unit)]] = False
        kind[unit & (kind != _NUMBER)] = _UNIT
    h = np.where(kind > 0, _MARKS[np.maximum(kind, 1) - 1], h)
    return begin, end, kind, h, folded, places


def _windows(width: int, least_literals: int, wanted, whole_short: bool, any_case: bool):
    """Rows ``id, mark, at, n, window, slots`` of a table ``id, mark, text``.

    Texts of fewer than ``width`` template words are one window in the benchmark
    (``whole_short``); ``wanted`` is None, or the sorted hashes to report, with the lengths
    that occur.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, keys = ([width], None) if wanted is None else wanted
        for batch in batches:
            column = batch.column("text")
            for low, high in pieces(column):
                buf, bounds = utf8(column[low:high])
                begin, end, kind, h, folded, places = template(buf, bounds)
                forms = [(h, kind > 0), (folded if any_case else hashes(buf, begin, end), kind < 0)]  # word hashes, and words that are slots
                literal = np.concatenate([[0], np.cumsum(kind == _LITERAL)])
                if any_case:  # names are words like others, and stay slots in a form of their own
                    value = (kind == _NUMBER) | (kind == _UNIT)
                    forms = [(np.where(value, h, folded), value), forms[_EXACT], forms[_TEMPLATE]]
                    named, literal = literal, np.concatenate([[0], np.cumsum(~value)])
                    names = np.concatenate([[0], np.cumsum(kind == _NAME)])
                doc = np.repeat(np.arange(high - low), np.diff(places))
                lengths = np.diff(places)
                rows, lower = [], _FOLD[buf]
                todo = sizes
                if whole_short:
                    todo = sorted({width, *np.minimum(lengths[lengths > 0], width).tolist()})
                for n, form in product(todo, range(len(forms))):
                    grams = rolling(forms[form][0], n)
                    if not len(grams):
                        continue
                    at = np.arange(len(grams))
                    ok = doc[at] == doc[at + n - 1]
                    counted = named if form == _NAMED else literal
                    enough = counted[at + n] - counted[at] >= min(least_literals, max(1, n - 2))
                    ok &= ~enough if form == _EXACT else enough
                    if form == _NAMED:
                        ok &= names[at + n] > names[at]
                    if whole_short and n < width:
                        ok &= lengths[doc[at]] == n
                    if keys is not None and len(keys):
                        spot = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
                        ok &= keys[spot] == grams
                    elif keys is not None:
                        ok &= False
                    rows.append((np.full(int(ok.sum()), n), at[ok], grams[ok], np.full(int(ok.sum()), form)))
                if not rows or not sum(len(r[1]) for r in rows):
                    continue
                n, at, grams, form = (np.concatenate(c) for c in zip(*rows, strict=True))
                slots = []

                def shown(w: int) -> str:
                    word = (buf if kind[w] == _NAME else lower)[begin[w] : end[w]]
                    return word.tobytes().decode(errors="replace")

                if (kind > 0).any():
                    for a, k, f in zip(at.tolist(), n.tolist(), form.tolist(), strict=True):
                        where = a + np.flatnonzero(forms[f][1][a : a + k])
                        slots.append(
                            [f"{kind[w]}:{shown(w)}" for w in where]
                        )
                else:
                    slots = [[]] * len(at)
                take = pa.array(doc[at] + low)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(take),
                        batch.column("mark").take(take),
                        pa.array((at - places[doc[at]]).astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                        pa.array(lengths[doc[at]].astype(np.int32)),
                        pa.array(grams.view(np.int64)),
                        pa.array(slots, pa.list_(pa.string())),
                    ],
                    names=["id", "mark", "at", "n", "total", "window", "slots"],
                )

    return run


_WINDOW_SCHEMA = "id long, mark long, at int, n int, total int, window long, slots array<string>"


def _longest_run(covered: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return int((edges[1::2] - edges[::2]).max(initial=0))


def _judge(pair: pd.DataFrame) -> pd.DataFrame:
    """One document and one item: windows that fit a one-to-one substitution of slots.

    A row is a window of both with the number ``c`` of times the document has it. The
    longest run counts rows that are ``own``.
    """
    votes: dict[str, Counter] = {}
    back: dict[str, Counter] = {}
    for mine, theirs, c in zip(pair["slots"], pair["item_slots"], pair["c"], strict=True):
        for a, b in zip(theirs, mine, strict=True):
            votes.setdefault(a, Counter())[b] += c
            back.setdefault(b, Counter())[a] += c
    to = {a: min(c.items(), key=lambda x: (-x[1], x[0]))[0] for a, c in votes.items()}
    of = {b: min(c.items(), key=lambda x: (-x[1], x[0]))[0] for b, c in back.items()}
    total = int(pair["total"].iloc[0])
    covered, alone, fitting, used = np.zeros(total, bool), np.zeros(total, bool), set(), {}
    columns = [pair[c] for c in ("slots", "item_slots", "item_at", "n", "own")]
    for mine, theirs, at, n, own in zip(*columns, strict=True):
        if all(to[a] == b and of[b] == a for a, b in zip(theirs, mine, strict=True)):
            covered[at : at + n] = True
            if own:
                alone[at : at + n] = True
            fitting.add(at)
            used.update(zip(theirs, mine, strict=True))
    changed = sum(a != b for a, b in used.items())
    return pd.DataFrame(
        {
            "doc_id": pd.array([pair["id"].iloc[0]], "Int64"),
            "mark": [pair["mark"].iloc[0]],
            "item_id": pd.array([pair["item_id"].iloc[0]], "Int64"),
            "coverage": [float(covered.mean())],
            "longest": [_longest_run(alone)],
            "n_windows": [len(fitting)],
            "n_slots": [len(used)],
            "n_changed": [changed],
        }
    )


def _keyed(table: DataFrame, key: str) -> DataFrame:
    return table.select(
        F.col(key).cast("long").alias("id"), F.xxhash64("text").alias("mark"), F.coalesce("text", F.lit("")).alias("text")
    )


def _classes(hits: DataFrame, doc: list[str]) -> tuple[DataFrame, DataFrame]:
    """Hits of one document for all that have the same, and the members of every such class.

    Classes are told apart by two 64-bit hashes of all their hits and the number of these.
    """
    what = [c for c in hits.columns if c not in doc]
    sign = [F.bit_xor(F.xxhash64(F.lit(k), *what)).alias(f"sign_{k}") for k in (1, 2)]
    signs = hits.groupBy(*doc).agg(*sign, F.count("*").alias("size"))
    of = ["sign_1", "sign_2", "size"]
    least = signs.groupBy(*of).agg(F.min(F.struct(*doc)).alias("least"))
    members = signs.withColumnsRenamed({c: f"member_{c}" for c in doc})
    alike = materialize(
        members.join(least, of).select(*(f"least.{c}" for c in doc), *(f"member_{c}" for c in doc)), "alike"
    )
    stand = alike.select(*doc).distinct()
    return materialize(join_groups(hits, stand, doc), "class_hits"), alike


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    width: int = 6,
    least_literals: int = 3,
    least_coverage: float = 0.5,
    filter_windows: int = FILTER_WINDOWS,
    any_case: bool = False,
    least_run: int = 13,
    few_items: int | None = FEW_ITEMS,
) -> DataFrame:
    """Documents that hold a benchmark item, one row for each such pair.

    Returns ``doc_id, mark, item_id, coverage, n_windows, n_slots, n_changed, kind``: the
    share of the item's template words in fitting windows, and whether parameters were
    changed (``verbatim`` or ``reparameterised``). With ``few_items=None`` this holds for
    every pair. With a number, pairs need a window that no more items carry; a document that
    holds items only by more common windows has one row of kind ``shared`` for the least of
    them. Both find the same documents. ``mark`` is the XXH64 of the text, which
    tells rows of one doc_id apart; rows equal in both are one document. Texts that share an
    item_id are judged apart. Null or empty
    texts hold nothing and are held by nothing; an empty table on either side gives no
    rows; other columns are not read. Items below ``width`` words are one window.
    With ``any_case`` windows are also joined in a form in which names are lower-cased words,
    so copies match whatever their case and place in a sentence. A pair is reported if fitting
    windows cover ``least_coverage`` of the item's words, or if windows that few items carry
    (any, for ``None`` and for kind ``shared``) cover ``least_run`` words in a row. Windows that a document repeats are counted before
    they are joined, so a very long text costs what it holds of different windows.
    """
    items = _keyed(benchmark, "item_id").where("text <> ''").distinct()
    theirs = materialize(
        items.mapInArrow(_windows(width, least_literals, None, True, any_case), _WINDOW_SCHEMA).select(
            F.col("id").alias("item_id"), F.col("mark").alias("item_mark"), F.col("at").alias("item_at"), F.col("n").alias("item_n"),
            "total", F.col("window").alias("w"), F.col("slots").alias("item_slots"),
        ),
        "benchmark",
    )
    one = F.struct("item_id", "item_mark")
    own = F.count("*") > 0 if few_items is None else F.count_distinct(one) <= few_items
    carried = materialize(
        theirs.groupBy(F.col("w").alias("window"), F.col("item_n").alias("n")).agg(own.alias("own")),
        "carried",
    )
    keyed = ["window", "n"]
    theirs = materialize(
        theirs.withColumnsRenamed({"w": "window", "item_n": "n"}).join(carried, keyed), "items"
    )
    number = carried.select("window").distinct().limit(filter_windows + 1).count()
    lengths = [r[0] for r in carried.select("n").distinct().collect()]  # at most ``width``
    keys = None
    if number <= filter_windows:
        found = carried.select("window").distinct().toPandas()["window"].to_numpy(np.int64)
        keys = np.sort(found.view(np.uint64))
    ours = _keyed(documents, "doc_id").mapInArrow(
        _windows(width, least_literals, (lengths, keys), False, any_case), _WINDOW_SCHEMA
    )
    hits = materialize(
        ours.groupBy("id", "mark", *keyed, "slots").agg(F.count("*").alias("c")).join(carried.select(*keyed, "own"), keyed),
        "hits",
    )
    doc, item = ["id", "mark"], ["item_id", "item_mark"]
    hits, alike = _classes(hits, doc)
    rows = ["id", "mark", *item, "item_at", "n", "total", "slots", "item_slots", "c", "own"]
    schema = (
        "doc_id long, mark long, item_id long, coverage double, longest long, n_windows long, n_slots long, n_changed long"
    )
    enough = (F.col("coverage") >= least_coverage) | (F.col("longest") >= least_run)

    def judged(found: DataFrame, label: str) -> DataFrame:
        # no more words are covered than all windows have
        reach = found.groupBy(*doc, *item).agg(F.sum("n").alias("reach"), F.max("total").alias("of"))
        likely = reach.where((F.col("reach") / F.col("of") >= least_coverage) | (F.col("reach") >= least_run))
        found = join_groups(found, likely.select(*doc, *item), [*doc, *item])
        return materialize(found.groupBy(*doc, *item).applyInPandas(_judge, schema).where(enough), label)

    rare = materialize(hits.where("own").join(theirs.drop("own"), keyed).select(*rows), "rare")
    kind = F.when(F.col("n_changed") > 0, "reparameterised").otherwise("verbatim")
    if few_items is None:
        told = judged(rare, "pairs").withColumn("kind", kind)
    else:
        # what is shared joins pairs that are there already
        support = join_groups(hits.where("not own"), rare.select(*doc, *item).distinct(), doc).select(*hits.columns, *item)
        support = join_groups(support, theirs.where("not own").drop("own"), [*item, *keyed]).select(*rows)
        pairs = judged(materialize(rare.unionByName(support), "rows"), "pairs")
        # documents that no pair tells of: all their windows count, and the least item stands for all
        left = hits.where("not own").select(*doc).distinct()
        gone = pairs.select(F.col("doc_id").alias("id"), "mark").distinct().withColumn("told", F.lit(True))
        left = join_groups(left, gone, doc, "left").where("told is null").drop("told")
        all_rows = join_groups(hits, left, doc).withColumn("own", F.lit(True)).join(theirs.drop("own"), keyed)
        only = judged(materialize(all_rows.select(*rows), "all_rows"), "shared")
        named = [c for c in only.columns if c not in ("doc_id", "mark")]
        only = only.groupBy("doc_id", "mark").agg(F.min_by(F.struct(*named), F.struct("item_id", "n_windows")).alias("s"))
        only = only.select("doc_id", "mark", "s.*").withColumn("kind", F.lit("shared"))
        told = pairs.withColumn("kind", kind).unionByName(only)
    told = told.drop("longest").withColumnRenamed("doc_id", "id")
    columns = ["doc_id", "mark", *(c for c in told.columns if c not in doc)]
    told = join_groups(alike, told, doc).drop(*doc)
    return told.withColumnsRenamed({"member_id": "doc_id", "member_mark": "mark"}).select(*columns)


def decontaminate(documents: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The documents that no benchmark item contaminates, with all their columns, whatever
    their names; see :func:`contamination` for what counts."""
    found = contamination(documents, benchmark, **parameters).select("doc_id", "mark").distinct()
    own, mark = unused(documents.columns, "doc", "mark")
    found = materialize(found, "leaks").select(F.col("doc_id").alias(own), F.col("mark").alias(mark))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(mark))
    return documents.join(found, same, "left_anti")
