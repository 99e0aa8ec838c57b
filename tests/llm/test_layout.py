"""Lines of sites, mixing, sharding and the pipeline."""

from collections import Counter
from fractions import Fraction
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from auditloom.llm.lines import line_dedup
from auditloom.llm.mixing import mix, timetable, whole_weights
from auditloom.llm.sharding import assign_shards, sharded_digest

from .conftest import EDGE


def test_boilerplate_of_a_site(spark):
    page = "<html><body><nav>Menu</nav><p>Text {0}</p><div>© Site &amp; co</div><p>{1}</p></body></html>"
    rows = [(i, "http://A.example.com:80/x", page.format(i, "shared" if i < 2 else i)) for i in range(10)]
    rows += [(100 + i, "http://b.example.com/", page.format(i, "b")) for i in range(3)]
    rows += [(300 + i, f"https://user{i}:p@w@C.example.com:8080?q=a@b", "<p>Same</p>" + f"<p>{i}</p>") for i in range(6)]
    rows += [(200, None, None), (201, "no url", "<!-- a\nb --><script>x<p></script>"), (None, "", ""), (0, "http://a.example.com", "<p>Menu</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as lines")
    got = line_dedup(pages).collect()
    assert len(got) == len(rows)
    text = {(r.page_id, r.n_lines): r.text for r in got}
    assert text[0, 4] == "Text 0\nshared" and text[5, 4] == "Text 5\n5"
    assert text[0, 1] == ""
    assert text[100, 4] == "Menu\nText 0\n© Site &amp; co\nb"  # too few pages to tell
    assert text[200, 0] == "" and text[201, 0] == "" and text[None, 0] == ""
    assert {r.host for r in got if r.page_id in range(300, 306)} == {"c.example.com"}
    assert all(r.text == str(r.page_id - 300) for r in got if r.page_id in range(300, 306))
    assert line_dedup(pages.where("false")).count() == 0


def earliest_deadlines(weights):
    """The plain loop over slots: ``(i, block, slot)`` of each."""
    total, sent, out = sum(weights), [0] * len(weights), []
    for t in range(total):
        due = [
            (-(-(n + 1) * total // w), i) for i, (n, w) in enumerate(zip(sent, weights)) if n < w and n * total // w <= t
        ]
        i = min(due)[1]
        out.append((i, sent[i], t))
        sent[i] += 1
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 300), min_size=1, max_size=9))
def test_timetable_is_the_plain_loop(weights):
    assert timetable(weights) == earliest_deadlines(weights)


@pytest.mark.parametrize(
    "weights",
    [[100_000, 33_333, 7, 1], [500_000, *np.random.default_rng(7).integers(1, 500, 2000).tolist()], [1] * 2000, [999_983, 2, 1]],
)
def test_every_prefix_is_within_one_block(weights):
    """Up to a million slots, up to 2,000 sources: each block inside its window, in order.

    A source whose blocks all lie in their windows is below one block off after every slot.
    """
    total, sent = sum(weights), [0] * len(weights)
    for t, (i, block, slot) in enumerate(timetable(weights)):
        w = weights[i]
        assert slot == t and block == sent[i]
        assert block * total // w <= slot < -(-(block + 1) * total // w)
        sent[i] += 1
    assert sent == list(weights)


def test_targets_are_exact(spark):
    """No rounding adds up, however small a weight; rows of a source go round several times."""
    weights = {"a": 5_000, "b": 1_666, "c": 7, "d": 1}
    rows = spark.range(0, 40_000).select(
        F.col("id").alias("doc_id"), F.lit("t").alias("text"),
        F.expr("case when id < 29920 then 'a' when id < 39930 then 'b' when id < 39985 then 'c' else 'd' end").alias("source"),
    )
    placed = mix(rows, weights, block_rows=1).collect()
    by_slot = sorted((r.slot, r.source) for r in placed)
    assert len({s for s, _ in by_slot}) == 40_000
    sent, total = Counter(), sum(weights.values())
    for slot, source in by_slot:
        if slot >= 39_000:
            break
        sent[source] += 1
        for s, w in weights.items():
            assert abs(sent[s] - Fraction(w * (slot + 1), total)) < 1


def test_mix_keeps_every_row_once(spark, docs_of):
    docs = docs_of([*EDGE, *[f"text {i}" for i in range(100)]], clash=False)
    rows = mix(docs, block_rows=4).collect()
    assert len(rows) == len(EDGE) + 100
    assert len({r.position for r in rows}) == len(rows)
    assert all(r.release <= r.slot < r.deadline for r in rows)
    assert mix(docs_of([])).count() == 0
    with pytest.raises(ValueError, match="without a target"):
        mix(docs, {"s0": 1})
    with pytest.raises(ValueError, match="positive"):
        mix(docs, {None: 1, "s0": 1, "s1": 0, "s2": 1})
    with pytest.raises(ValueError, match="coarsely"):
        whole_weights({"a": 1, "b": 1 << 40})
    assert mix(docs_of(EDGE)).columns[-1] == "position"
    clash = docs.selectExpr("*", "1 as __at", "2 as _block", "3 as __hash", "4 as slot", "5 as i", "6 as n")
    assert mix(clash).columns == [*docs.columns, "__at", "_block", "__hash", "i", "n", "block", "release", "deadline", "slot", "position"]
    assert mix(clash).count() == len(rows)


def test_many_sources(spark):
    rows = spark.range(0, 3000).selectExpr("id as doc_id", "'x' as text", "concat('s', id % 1500) as source")
    placed = mix(rows, block_rows=2).collect()
    assert len(placed) == 3000 and len({r.position for r in placed}) == 3000


def test_few_records_move(spark):
    keys = spark.range(4000).select("id", "id", "id").toDF("doc_id", "shard", "x")
    placed = assign_shards(keys, [1.0, 1.0, 2.0], grown=1.0).collect()
    share = [sum(r.shard == s for r in placed) / 4000 for s in range(3)]
    assert abs(share[0] - 0.25) < 0.03 and abs(share[2] - 0.5) < 0.03
    moved = [r for r in placed if r.grown_shard != r.shard]
    assert {r.grown_shard for r in moved} == {3} and abs(len(moved) / 4000 - 0.2) < 0.03
    with pytest.raises(ValueError):
        assign_shards(keys, [1.0, 0.0])


def test_slots_have_no_gaps(spark, docs_of):
    docs = docs_of([*EDGE, *[(5, "copy")] * 9000, *["t"] * 50])
    rows = sharded_digest(docs, [1.0] * 7).collect()
    assert len(rows) == len(EDGE) + 9050
    for s in range(7):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id == 0} >= {(16, 0)}
    assert sharded_digest(docs_of([]), [1.0]).count() == 0


def test_pipeline_stages_on_edges(spark, docs_of, tmp_path):
    rng = np.random.default_rng(1)
    words = ["".join(w) for w in product("kmprst", "aeiou", "lnrs", "aeo")]
    texts = [*EDGE, *[" ".join(rng.choice(words, 120)) + "." for _ in range(30)]]
    docs = docs_of(texts)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        if name != "sharding":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        assert 0 < docs.count() <= before.count()
        if name != "sharding":
            assert {r.slot for r in docs.select("slot").collect()} == {"own"}
    empty = docs_of([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0


def test_pipeline_keeps_one_of_each_group(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    kept = [r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()]
    assert len(kept) == len(set(kept))
    assert len({docs[d] for d in kept}) == len(kept)
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not [d for d in kept if any(i in docs[d] for i in items)]


def test_slots_follow_the_mix(spark, docs_of, tmp_path):
    """Inside a shard the slots keep the order of the mix, which goes if its stage goes."""
    docs = docs_of([f"text number {i}" for i in range(400)], clash=False)
    place = {r.doc_id: r.position for r in mix(docs).collect()}
    stages = dict(corpus_pipeline.STAGES)

    def slots(mixed, name):
        mixed.write.parquet(str(tmp_path / name))
        rows = stages["sharding"](spark, spark.read.parquet(str(tmp_path / name)), "").collect()
        assert len(rows) == 400
        return {(r.shard, r.slot): place[r.doc_id] for r in rows}

    def follows(at):
        assert set(at) == {(s, i) for s, n in Counter(s for s, _ in at).items() for i in range(n)}
        return all(p < at[s, i + 1] for (s, i), p in at.items() if (s, i + 1) in at)

    assert follows(slots(stages["mixing"](spark, docs, ""), "with"))
    assert not follows(slots(docs, "without"))
    got = stages["sharding"](spark, docs, "").collect()  # from no file
    assert follows({(r.shard, r.slot): place[r.doc_id] for r in got})
