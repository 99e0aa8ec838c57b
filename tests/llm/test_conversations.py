"""Repairs against a search over all edits, and against the operator's own blocks."""

import hashlib
import heapq
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditloom.llm import conversations as conv
from auditloom.llm.conversations import END, code_of, costs_before, damage, matrix, repair, repair_digest, through, walk

WHITE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """Least cost, then ASCII-least edits, by uniform-cost search; rows are (class, fault)."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            return cost, audit
        if (i, q) in done:
            continue
        done.add((i, q))
        fresh = {0: 2, 1: 2, 2: 3, 3: 2}[q]
        heapq.heappush(heap, (cost + 2, audit + "I", i, fresh))
        if i < len(rows):
            role, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, q))
            if fault < 2:
                heapq.heappush(heap, (cost + fault + 2, audit + "R", i + 1, fresh))
                kept = {(0, 0): 1, (1, 0): 2, (1, 1): 2, (1, 3): 2, (2, 2): 3}.get((role, q))
                if kept is not None:
                    heapq.heappush(heap, (cost + fault, audit + "K", i + 1, kept))


rows_of = st.lists(st.tuples(st.integers(0, 3), st.sampled_from([0, 0, 0, 1, 2])), max_size=14)


@settings(max_examples=400, deadline=None)
@given(rows_of)
def test_walk_is_the_cheapest_and_least(rows):
    codes = "".join(code_of(*r) for r in rows)
    cost, audit = cheapest(rows)
    assert costs_before(codes, END)[0] == cost
    assert walk(codes, END, 0, True)[0] == audit


@settings(max_examples=200, deadline=None)
@given(rows_of, st.integers(0, 14))
def test_blocks_join_up(rows, cut):
    """Matrices give the same costs, and walks through two blocks the same edits, as one."""
    codes = "".join(code_of(*r) for r in rows)
    left, right = codes[:cut], codes[cut:]
    middle = through(matrix(right), END) if right else END
    if left:
        assert through(matrix(left), middle)[0] == costs_before(codes, END)[0]
    first, state = walk(left, middle, 0, False)
    assert first + walk(right, END, state, True)[0] == walk(codes, END, 0, True)[0]


def test_checkpoints_are_few():
    """A long run keeps about the square root of its vectors, and few different steps."""
    rng = np.random.default_rng(4)
    codes = "".join(code_of(int(a), int(b)) for a, b in zip(rng.integers(0, 4, 40_000), rng.integers(0, 3, 40_000)))
    audit, _ = walk(codes, END, 0, True)
    assert len(audit) >= len(codes) and len(conv._STEPS) < 2000


def brute(original, rows):
    """Digest rows of the contract for (conv_id, turn, role, text)."""
    out = {}
    for c in {r[0] for r in original}:
        mine = [(t, " " if r is None else r, " " if x is None else x) for k, t, r, x in rows if k == c]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        turns = [t for t, _, _ in mine if t is not None]
        codes, seen, blank, duplicate, truncated = [], set(), 0, 0, 0
        for _, role, text in mine:
            fault = 0
            if not text.strip(WHITE):
                fault, blank = 2, blank + 1
            elif (role, text) in seen:
                fault, duplicate = 2, duplicate + 1
            elif text.strip(WHITE)[-1] not in ".!?":
                fault, truncated = 1, truncated + 1
            seen.add((role, text))
            codes.append(("sua".find(role[:1]) if role[:1] else 3, fault))
        codes = [(3 if a < 0 else a, f) for a, f in codes]
        initials = [role[:1] for _, role, _ in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = cheapest(codes)
        lines, at, q = [], 0, 0
        for e in audit:
            fresh = {0: 2, 1: 2, 2: 3, 3: 2}[q]
            name = {2: "user", 3: "assistant"}[fresh]
            if e == "I":
                lines.append(f"{name}:")
                q = fresh
                continue
            _, role, text = mine[at]
            if e == "K":
                lines.append(f"{role}:{text}")
                q = {"s": 1, "u": 2, "a": 3}[role[0]]
            elif e == "R":
                lines.append(f"{name}:{text}")
                q = fresh
            at += 1
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[c] = (gaps, blank, duplicate, truncated, illegal, cost, audit, digest)
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def made(seed, convs, longest):
    rng = np.random.default_rng(seed)
    roles = ["system", "user", "assistant", "tool", None, "", "unit"]
    texts = ["Yes.", "no", "What?", "", " \n", None, "Done!\t", "a\x0bb.", "Ünï.\r\n"]
    rows = []
    for c in range(convs):
        for t in range(rng.integers(1, longest)):
            turn = None if rng.random() < 0.05 else int(t + (rng.random() < 0.1) * 3)
            text = texts[rng.integers(len(texts))]
            rows.append((c or None, turn, roles[int(rng.choice(7, p=[0.1, 0.35, 0.35, 0.05, 0.05, 0.05, 0.05]))], text if rng.random() < 0.5 else f"{rng.integers(99)}."))
    return rows


def digests(rows):
    return {r.conv_id: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in rows}


@pytest.mark.parametrize("least", [1, 2, 256])
def test_repairs_are_those_of_the_search(spark, least):
    """Blocks of a few rows put every conversation through the checkpoints between blocks."""
    rows = made(least, 12, 24)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).selectExpr("*", "1 as id", "2 as conv", "'x' as audit", "3 as place")
    got = repair_digest(df, df, block_rows=least).collect()
    assert len(got) == 12
    assert digests(got) == brute(rows, rows)


def test_damage(spark):
    rows = [(c, t, "assistant", f"Text {t}. More! Of it?") for c in [None, *range(20)] for t in [None, *range(9)]]
    df = spark.createDataFrame(rows, SCHEMA)
    want = []
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.replace(".", "").replace("!", "").replace("?", "")
        if kind == 4:
            role = "user"
        want += [(c, t, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    got = [tuple(r) for r in damage(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) != len(rows)
    assert digests(repair_digest(df, damage(df)).collect()) == brute(rows, want)


def test_long_conversation_and_ties(spark):
    """One conversation of thousands of rows, cut into many blocks over many tasks."""
    rng = np.random.default_rng(3)
    rows = [(1, int(t), ["user", "assistant"][int(rng.integers(2))], f"{rng.integers(1000)}" + ".!x"[int(rng.integers(3))]) for t in range(3000)]
    rows += [(1, 5, "user", "tie one."), (1, 5, "user", "tie two."), (1, 5, "user", "tie two."), (2, 0, "user", "Hi.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert digests(repair_digest(df, df, block_rows=4).collect()) == brute(rows, rows)


def test_empty_lost_and_long_texts(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair_digest(empty, empty).count() == 0
    rows = [(1, 0, "user", "x" * 2_000_000 + "."), (1, 1, "assistant", "y " * 500_000), (2, 0, "user", "Hi.")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = digests(repair_digest(df, df.where("conv_id = 1")).collect())
    assert got == brute(rows, rows[:2])
    assert got[2] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    turns = repair(df)[1].collect()
    assert [(r.place, r.edit, r.role) for r in turns if r.conv_id == 2] == [(0, "K", "user"), (1, "I", "assistant")]
