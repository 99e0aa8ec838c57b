"""Benchmark passages in documents: verbatim, with changed parameters, and not at all."""

import pytest

from auditloom.llm.decontaminate import contamination, decontaminate

from .conftest import EDGE

ITEM = "If a train from Boston travels 120 km in 3 hours, how many km does it travel in 5 hours?"
SHORT = "Name the largest moon."


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(1, ITEM), (2, SHORT), (3, None), (4, ""), (5, "...")]
    return spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "'x' as mark", "0 as n")


FILLER = "some other words that have nothing to do with any of the questions stand here "


def found(df):
    return {(r.doc_id, r.item_id): r for r in df.collect()}


@pytest.mark.parametrize("limit", [1000, 0])
def test_kinds_of_leaks(spark, docs_of, bench, limit):
    texts = [
        FILLER * 3,
        FILLER + ITEM + " " + FILLER,
        FILLER + ITEM.upper().replace(",", " ,"),  # no: capitals are names
        FILLER + ITEM.replace("120", "480").replace("3", "7").replace("Boston", "Turin"),
        FILLER + "\n\n" + ITEM.lower().replace("boston", "Boston") + "!!",
        "It travels 12 km in 3 hours, and 5 km in 9 hours, and 7 km in 2 hours.",
        FILLER.strip() + ". " + SHORT + " " + FILLER,
    ]
    got = found(contamination(docs_of(texts), bench, filter_windows=limit))
    assert set(got) == {(1, 1), (3, 1), (4, 1), (6, 2)}
    # its first word looks like a name there, as no sentence ends before it
    assert got[1, 1].kind == "verbatim" and got[1, 1].coverage == 0.95
    assert got[3, 1].kind == "reparameterised" and got[3, 1].n_changed >= 2


def test_slots_must_agree(spark, docs_of, bench):
    """The same number in the item may not become two numbers in the document."""
    item = "Take 7 apples and then 7 pears and then 7 plums and then 7 figs and give them all away"
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    same = item.replace("7", "31")
    mixed = item.replace("7", "1", 1).replace("7", "2", 1).replace("7", "3", 1).replace("7", "4", 1)
    got = found(contamination(docs_of([same, mixed]), bench, least_coverage=0.9))
    assert set(got) == {(0, 9)} and got[0, 9].kind == "reparameterised"


def test_given_leaks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    got = set(found(contamination(docs, bench)))
    items = bench.collect()
    want = {(d.doc_id, i.item_id) for d in docs.collect() for i in items if i.text in d.text}
    assert want <= got and len(got) <= len(want) + 3
    left = {r.doc_id for r in decontaminate(docs, bench).select("doc_id").collect()}
    assert left == {r.doc_id for r in docs.collect()} - {d for d, _ in got}


def test_edges(spark, docs_of, bench):
    docs = docs_of(EDGE)
    assert contamination(docs, bench).count() == 0
    assert decontaminate(docs, bench).count() == len(EDGE)
    assert decontaminate(docs, bench).columns == docs.columns
    assert contamination(docs_of([]), bench).count() == 0
    assert contamination(docs, bench.where("false")).count() == 0
    twice = docs_of([FILLER + ITEM]).unionAll(docs_of([FILLER + ITEM]))
    assert contamination(twice, bench).count() == 1
    assert decontaminate(twice, bench).count() == 0


DENSE = [
    "What is 12 + 7 - 3 * 4 / 2 + 9 - 1 + 6 * 8?",
    "Does 5 kg equal 11 lb?",
    "Ask Anna, Bert, Carla, Dora, Emil, Franz, Greta, Hanna and Ida.",
]


def test_items_of_placeholders_are_found_verbatim(spark, docs_of):
    bench = spark.createDataFrame(list(enumerate(DENSE)), "item_id long, text string")
    texts = [f"{FILLER.strip()}. {item} {FILLER}" for item in DENSE]
    texts += [t.replace("7", "5").replace("3", "2").replace("11", "8").replace("9", "6") for t in texts[:2]]
    got = found(contamination(docs_of(texts), bench))
    assert set(got) == {(0, 0), (1, 1), (2, 2)}
    assert all(r.coverage == 1.0 and r.kind == "verbatim" for r in got.values())


def test_case_and_place_do_not_matter(spark, docs_of, bench):
    names = "We met Anna Berg, Carl Dorn, Emil Falk and Gerd Hahn in Kiel and went with them to Lund by train."
    items = bench.select("item_id", "text").unionAll(spark.createDataFrame([(6, names)], "item_id long, text string"))
    texts = [
        FILLER + ITEM.upper(),
        FILLER + ITEM.lower(),
        FILLER + names.upper(),
        FILLER + names.lower(),
        FILLER + "and " + SHORT,
        FILLER + ITEM.upper().replace("120", "480").replace("3", "7"),
        FILLER + ITEM.replace("120", "480").replace("3", "7").replace("Boston", "Turin"),
    ]
    got = found(contamination(docs_of(texts), items, any_case=True))
    assert set(got) == {(0, 1), (1, 1), (2, 6), (3, 6), (4, 2), (5, 1), (6, 1)}
    assert all(got[k].coverage == 1.0 and got[k].kind == "verbatim" for k in got if k[0] < 5)
    assert got[5, 1].kind == got[6, 1].kind == "reparameterised"
    left = decontaminate(docs_of([*texts, FILLER]), items, any_case=True)
    assert [r.doc_id for r in left.collect()] == [7]


def test_a_passage_of_a_long_item_is_found(spark, docs_of):
    words = [f"{'abcdefghij'[i // 20]}{'klmnopqrst'[i // 2 % 10]}{'uv'[i % 2]}" for i in range(200)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    texts = [FILLER + " ".join(words[40 : 40 + n]) + " " + FILLER for n in (90, 13, 12)]
    got = found(contamination(docs_of(texts), bench))
    assert set(got) == {(0, 1), (1, 1)} and got[0, 1].coverage == 0.45


def _heads(n):
    """Items with a common head of 18 words and a question of ten words of their own."""
    head = "read the following short passage with care and then choose the one answer that fits it best today"
    own = lambda i: " ".join(f"{a}{'abcdefghijklmnopqrst'[i // 20]}{'uvwxyzabcdefghijklmn'[i % 20]}" for a in "klmnopqrst")
    return head, [f"{head}. {own(i)}" for i in range(n)], own


def test_shared_heads_make_no_pairs(spark, docs_of):
    head, items, own = _heads(200)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [f"{FILLER}. {head}. {FILLER}" for _ in range(100)]
    texts += [f"{FILLER}. {items[i]} {FILLER}" for i in range(60)]
    texts += [f"{FILLER}. {own(7)} {FILLER}", f"{FILLER}. {head}. {own(150)} {own(151)}", " ".join([items[9]] * 3000)]
    rows = contamination(docs_of(texts), bench).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.item_id, r.kind))
    # a document of the head alone is told once, one with a question for its question only
    assert all(got.pop(i) == [(0, "shared")] for i in range(100))
    assert all(got.pop(100 + i) == [(i, "verbatim")] for i in range(60))
    # ten words of a longer item (document 160) are below half of it and below a run
    assert {i: sorted(g) for i, g in got.items()} == {
        161: [(150, "verbatim"), (151, "verbatim")], 162: [(9, "verbatim")],
    }
    assert {r.coverage for r in rows if r.doc_id >= 100 and r.doc_id != 161} == {1.0}
    assert decontaminate(docs_of([*texts, FILLER]), bench).count() == 2


def test_items_that_repeat_are_still_found(spark, docs_of):
    """An item that stands in the benchmark many times has nothing but shared windows."""
    bench = spark.createDataFrame([(i, ITEM) for i in range(30)], "item_id long, text string")
    got = contamination(docs_of([FILLER + ITEM, FILLER + ITEM.replace("120", "480").replace("3", "7"), FILLER]), bench)
    assert sorted((r.doc_id, r.item_id, r.kind) for r in got.collect()) == [(0, 0, "shared"), (1, 0, "shared")]


def test_clashing_names(spark, docs_of, bench):
    docs = docs_of([FILLER + ITEM, FILLER]).selectExpr("*", "1 as __doc", "2 as __MARK", "3 as window", "4 as own", "5 as c")
    left = decontaminate(docs, bench)
    assert left.columns == docs.columns and [r.doc_id for r in left.collect()] == [1]


def plain_pairs(docs, items, width=6, least_run=13, least_coverage=0.5):
    """Pairs by comparing every window of every text, words lower-cased and stripped."""
    import re

    words = lambda t: [w for w in (re.sub(r"^[^0-9A-Za-z\x80-\uffff]+|[^0-9A-Za-z\x80-\uffff]+$", "", x).lower() for x in t.split()) if w]
    out = set()
    for d, text in docs:
        have = words(text)
        grams = {n: {tuple(have[i : i + n]) for i in range(len(have) - n + 1)} for n in range(1, width + 1)}
        for k, item in items:
            w = words(item)
            n = min(width, len(w))
            covered = [False] * len(w)
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams[n]:
                    covered[i : i + n] = [True] * n
            run = longest = 0
            for c in covered:
                run = run + 1 if c else 0
                longest = max(longest, run)
            if w and (sum(covered) >= least_coverage * len(w) or longest >= least_run):
                out.add((d, k))
    return out


def test_verbatim_parts_against_brute_force(spark, docs_of):
    """Texts of literals only: what is covered follows from equal windows alone."""
    import numpy as np

    rng = np.random.default_rng(12)
    words = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    items = [(i, " ".join(rng.choice(words, rng.integers(3, 40)))) for i in range(40)]
    docs = []
    for d in range(120):
        parts = [" ".join(rng.choice(words, rng.integers(0, 30)))]
        for _ in range(rng.integers(0, 3)):
            w = items[rng.integers(40)][1].split()
            a = rng.integers(len(w))
            parts += [" ".join(w[a : a + rng.integers(1, 30)]), " ".join(rng.choice(words, rng.integers(0, 9)))]
        docs.append((d, " ".join(p for p in parts if p)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contamination(docs_of(docs), bench, few_items=100).collect()}
    assert got == plain_pairs(docs, items) and len(got) > 30


def test_every_pair_is_told_against_brute_force(spark, docs_of):
    """Windows that many items carry propose pairs like others, when all pairs are asked for."""
    _, items, own = _heads(30)
    head = items[0].split(". ")[0]
    items = [*enumerate(items), (40, f"{head} {own(50)} {own(51)} {own(52)}"), (41, own(60))]
    texts = [f"{FILLER} {head}", f"{FILLER} {head} {own(3)}", f"{own(60)} {head[:60]}", f"{FILLER} {own(5)}"] * 2
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = contamination(docs_of(texts), bench, few_items=None).collect()
    want = plain_pairs([*enumerate(texts)], items)
    assert sorted((r.doc_id, r.item_id) for r in rows) == sorted(want) and len(want) > 120
    assert {r.kind for r in rows} == {"verbatim"}
    left = {r.doc_id for r in decontaminate(docs_of(texts), bench).select("doc_id").collect()}
    assert left == set(range(len(texts))) - {d for d, _ in want}


def test_shared_passages_of_other_items_than_the_least(spark, docs_of):
    """No passage's least item is held by the document, but items with two of them are."""
    word = lambda a, b: f"{'klmnopqrst'[a % 10]}{'abcdefghij'[a // 10]}{'uvwxyzabcdefghijklmnopqrst'[b % 26]}{'xy'[b // 26]}"
    one, two = ("first of two known passages that stand about", "then comes another passage which many others carry")
    own = lambda i, n: " ".join(word(i, b) for b in range(n))
    items = [f"{one} {own(i, 40)}" for i in range(10)] + [f"{two} {own(i, 40)}" for i in range(10, 20)]
    items += [f"{one} {own(i, 3)} {two}" for i in range(20, 30)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [f"{FILLER} {one} {FILLER} {two} {FILLER}", f"{FILLER} {one} {FILLER}"]
    got = contamination(docs_of(texts), bench).collect()
    assert [(r.doc_id, r.item_id, r.kind) for r in got] == [(0, 20, "shared")]
    every = contamination(docs_of(texts), bench, few_items=None).collect()
    assert sorted((r.doc_id, r.item_id) for r in every) == [(0, i) for i in range(20, 30)]
