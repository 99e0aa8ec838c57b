"""Repair of conversations to a system turn at most and user and assistant in turns.

The cheapest edits that give role initials ``(s?(ua)+)?`` are found by dynamic programming
over four states (nothing yet, after s, after u, after a). The vector of the costs still to
come, by state, is worked out backward and kept at checkpoints only, as many as the square
root of the rows; walking forward, the vectors between two checkpoints are made again from
the later one, and of all edits that stay on a cheapest path the ASCII-least is taken.

The same scheme spreads one conversation over the cluster. It is cut into blocks of about
the square root of its rows. Each block gives a 4 x 4 matrix of costs from state to state;
their products, taken backward, are the vectors at the checkpoints between blocks. Then each
block is walked forward from every state on its own, and the states in which blocks are
really entered follow in order. So no task holds more than a block, or one entry for each
block. Only the digest of a repaired conversation must be read by one task in order; it
streams.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.joins import join_groups
from auditloom.session import materialize

DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: Rows of a block, at least.
BLOCK_ROWS = 256
_INF = 1 << 40
#: State after an inserted or re-roled turn, by state: user, unless user was last.
_NEXT = (2, 2, 3, 2)
#: State after a kept turn, by class of role (s, u, a, other) and state; -1: not allowed.
_KEEP = ((1, -1, -1, -1), (2, 2, -1, 2), (-1, -1, 3, -1), (-1, -1, -1, -1))
_ROLE = {2: "user", 3: "assistant"}
#: Costs at the end of a conversation: complete, or one or two turns to be inserted.
END = (0, 2 * INSERT, INSERT, 0)
_LEGAL = {(0, 1), (1, 2), (2, 1)}
_WHITE = r"\x20\x09-\x0D"

Vector = tuple[int, ...]


def code_of(role_class: int, fault: int) -> str:
    """A row as one character; fault 0: none, 1: truncated, 2: must go."""
    return chr(65 + 3 * role_class + fault)


_PARTS = {code_of(c, f): (c, f) for c in range(4) for f in range(3)}
_STEPS: dict[tuple[Vector, str], tuple[Vector, int]] = {}


def step_back(after: Vector, code: str) -> tuple[Vector, int]:
    """Costs before a row (and the turns inserted before it) from the costs after it.

    Vectors are taken relative to their least entry, which comes second; so there are few
    of them, and each step is worked out once.
    """
    known = _STEPS.get((after, code))
    if known is None:
        role, fault = _PARTS[code]
        costs = []
        for q in range(4):
            best = DELETE + after[q]
            if fault < 2:
                best = min(best, fault * TRUNCATED + REROLE + after[_NEXT[q]])
                if _KEEP[role][q] >= 0:
                    best = min(best, fault * TRUNCATED + after[_KEEP[role][q]])
            costs.append(best)
        once = [min(costs[q], INSERT + costs[_NEXT[q]]) for q in range(4)]
        twice = [min(once[q], INSERT + once[_NEXT[q]]) for q in range(4)]
        least = min(twice)
        known = _STEPS[after, code] = tuple(min(x, _INF) - least if x < _INF else _INF for x in twice), least
    return known


def _back(codes: str, after: Vector, base: int) -> tuple[Vector, int]:
    for code in reversed(codes):
        after, more = step_back(after, code)
        base += more
    return after, base


def costs_before(codes: str, after: Vector) -> list[int]:
    """Costs to come by state before a run of rows, from those after it."""
    least = min(after)
    vector, base = _back(codes, tuple(min(x - least, _INF) for x in after), least)
    return [min(x + base, _INF) if x < _INF else _INF for x in vector]


def matrix(codes: str) -> list[int]:
    """Least costs of a block, 16 values: from state (row) to state (column)."""
    columns = [costs_before(codes, tuple(0 if q == r else _INF for q in range(4))) for r in range(4)]
    return [columns[r][q] for q in range(4) for r in range(4)]


def through(costs: list[int], after: Vector) -> Vector:
    """Costs before a block from its matrix and the costs after it."""
    return tuple(min(min(costs[4 * q + r] + after[r] for r in range(4)), _INF) for q in range(4))


def walk(codes: str, after: Vector, state: int, last: bool) -> tuple[str, int]:
    """ASCII-least cheapest edits of a run of rows entered in ``state``, and the state after.

    ``after`` are the costs after the run; with ``last`` what must be inserted at the end
    is added.
    """
    n = len(codes)
    size = isqrt(n) + 1
    marks = {n: (tuple(x - min(after) for x in after), min(after))}
    for end in range(n // size * size, -1, -size):  # checkpoints at multiples of the size
        high = min(end + size, n)
        marks[end] = _back(codes[end:high], *marks[high]) if high > end else marks[high]
    out = []
    for low in range(0, n, size):
        high = min(low + size, n)
        vectors = [marks[high]]
        for code in reversed(codes[low:high]):
            vector, base = vectors[-1]
            vector, more = step_back(vector, code)
            vectors.append((vector, base + more))
        vectors.reverse()
        for i, code in enumerate(codes[low:high]):
            (here, base), (then, base_then) = vectors[i : i + 2]
            role, fault = _PARTS[code]
            while True:
                left = here[state] + base - base_then  # relative to the vector after the row
                if left == DELETE + then[state]:
                    out.append("D")
                    break
                if here[state] == INSERT + here[_NEXT[state]]:
                    out.append("I")
                    state = _NEXT[state]
                    continue
                kept = _KEEP[role][state]
                if fault < 2 and kept >= 0 and left == fault * TRUNCATED + then[kept]:
                    out.append("K")
                    state = kept
                else:
                    out.append("R")
                    state = _NEXT[state]
                break
    while last and state in (1, 2):
        out.append("I")
        state = _NEXT[state]
    return "".join(out), state


def illegal_pairs(codes: str) -> int:
    """Neighbours whose role initials are not su, ua or au."""
    roles = [_PARTS[c][0] for c in codes]
    return sum(pair not in _LEGAL for pair in zip(roles, roles[1:], strict=False))


def damage(conversations: DataFrame) -> DataFrame:
    """The fixed damage that repair is measured on, by CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 removes ``[.!?]`` from it, 3 repeats the row and 4
    makes it the user's; nulls in the key, the role and the text count as one space.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(
        F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")
    ).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.where("kind <> 0").select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.explode(times).alias("copy"),
    ).drop("copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows with the columns that fix their order: ``turn`` (nulls first), ``role``, ``tie``."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"),
        some("role").alias("role"), some("text").alias("text"),
        F.unhex(F.sha2(some("text").cast("binary"), 256)).alias("tie"),
    )


_ORDER = ["conv", "turn", "role", "tie"]


def _coded(rows: DataFrame) -> DataFrame:
    """Every row's faults and code, under a number ``id`` that follows the order."""
    light = _ordered(rows).select(
        *_ORDER,
        (~F.col("text").rlike(f"[^{_WHITE}]")).alias("blank"),
        (~F.col("text").rlike(rf"[.!?][{_WHITE}]*\z")).alias("open"),
    )
    placed = materialize(
        light.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).withColumn("id", F.monotonically_increasing_id()),
        "turns",
    )
    said = placed.groupBy("conv", "role", "tie").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    said = said.where("n > 1").drop("n")
    duplicate = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    flags = join_groups(placed, said, ["conv", "role", "tie"], "left").select(
        "conv", "turn", "role", "tie", "id", "blank",
        (~F.col("blank") & duplicate).alias("duplicate"),
        (~F.col("blank") & ~duplicate & F.col("open")).alias("truncated"),
    )
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(F.col("blank") | F.col("duplicate"), 2).when(F.col("truncated"), 1).otherwise(0)
    return materialize(flags.withColumn("code", F.chr(F.lit(65) + 3 * role + fault)), "coded")


def _blocks(coded: DataFrame, sizes: DataFrame, least: int) -> DataFrame:
    """Consecutive rows as one string of codes: ``conv, part, block, first, codes``."""
    part, place = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    large = sizes.where(F.col("n") > least * least).select("conv", F.ceil(F.sqrt("n")).cast("long").alias("rows"))
    wide = join_groups(coded, large, ["conv"], "left")
    rows = F.coalesce(F.col("rows"), F.lit(least).cast("long"))
    turns = wide.select(
        "conv", part.alias("part"), F.floor(place / rows).alias("block"), "id", "code", "turn", "role", "tie"
    )
    return turns.groupBy("conv", "part", "block").agg(  # a block of rows at most
        F.min(F.struct("id", "turn", "role", "tie")).alias("first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "code"))), lambda x: x["code"]), "").alias("codes"),
    )


def _per_batch(make, kinds: dict[str, pa.DataType]):
    """mapInArrow function: keeps the columns, adds ``make(row)`` as columns of ``kinds``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["codes", *[c for c in batch.schema.names if c in ("after", "last")]]).to_pylist()
            made = [make(row) for row in rows]
            columns = [pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *kinds])

    return run


def _solve_alone(row: dict) -> tuple:
    audit, _ = walk(row["codes"], END, 0, True)
    return audit, costs_before(row["codes"], END)[0], illegal_pairs(row["codes"])


def _solve_block(row: dict) -> tuple:
    found = [walk(row["codes"], tuple(row["after"]), q, row["last"]) for q in range(4)]
    return [audit for audit, _ in found], [q for _, q in found]


def _edges(row: dict) -> tuple:
    codes = row["codes"]
    return matrix(codes), illegal_pairs(codes), _PARTS[codes[0]][0], _PARTS[codes[-1]][0]


def _checkpoints(table: pa.Table) -> pa.Table:
    """Costs after every block of a conversation, from the matrices, last block first."""
    rows = table.sort_by([("part", "ascending"), ("block", "ascending")])
    after, out = END, []
    for costs in reversed(rows.column("costs").to_pylist()):
        out.append(after)
        after = through(costs, after)
    firsts, lasts = rows.column("left").to_pylist(), rows.column("right").to_pylist()
    seams = sum((a, b) not in _LEGAL for a, b in zip(lasts, firsts[1:], strict=False))
    n = rows.num_rows
    illegal = [x + (seams if i == 0 else 0) for i, x in enumerate(rows.column("inside").to_pylist())]
    return pa.table(
        {
            **{c: rows.column(c) for c in ("conv", "part", "block")},
            "after": pa.array([list(v) for v in reversed(out)], pa.list_(pa.int64())),
            "last": pa.array([i == n - 1 for i in range(n)]),
            "cost": pa.array([after[0]] + [0] * (n - 1), pa.int64()),
            "illegal": pa.array(illegal, pa.int64()),
        }
    )


def _entries(table: pa.Table) -> pa.Table:
    """State in which every block of a conversation is entered, first block first."""
    rows = table.sort_by([("part", "ascending"), ("block", "ascending")])
    state, out = 0, []
    for exits in rows.column("exits").to_pylist():
        out.append(state)
        state = exits[state]
    return pa.table({**{c: rows.column(c) for c in ("conv", "part", "block")}, "entry": pa.array(out, pa.int32())})


def _solved(blocks: DataFrame) -> DataFrame:
    """Blocks with ``audit``, and ``cost, illegal`` that add up to the conversation's."""
    kind = dict(blocks.dtypes)["conv"]
    key = ["conv", "part", "block"]
    counts = blocks.groupBy("conv").agg(F.count("*").alias("blocks")).where("blocks > 1").drop("blocks")
    long = materialize(counts, "long")
    marked = materialize(
        join_groups(blocks, long.withColumn("split", F.lit(True)), ["conv"], "left").withColumn(
            "split", F.coalesce("split", F.lit(False))
        ),
        "blocks",
    )
    base = ", ".join(f"`{c}` {t}" for c, t in marked.dtypes)
    alone = marked.where("not split").mapInArrow(
        _per_batch(_solve_alone, {"audit": pa.string(), "cost": pa.int64(), "illegal": pa.int64()}),
        f"{base}, audit string, cost long, illegal long",
    )
    split = marked.where("split")
    edges = split.select(*key, "codes").mapInArrow(
        _per_batch(_edges, {"costs": pa.list_(pa.int64()), "inside": pa.int64(), "left": pa.int32(), "right": pa.int32()}),
        f"conv {kind}, part long, block long, codes string, costs array<long>, inside long, left int, right int",
    )
    # one row for each block of a conversation: about the square root of its rows
    after = edges.drop("codes").groupBy("conv").applyInArrow(
        _checkpoints, f"conv {kind}, part long, block long, after array<long>, last boolean, cost long, illegal long"
    )
    names = ", ".join(f"`{c}` {t}" for c, t in [*marked.dtypes, *after.dtypes[3:]])
    walked = materialize(
        join_groups(split, after, key).mapInArrow(
            _per_batch(_solve_block, {"audits": pa.list_(pa.string()), "exits": pa.list_(pa.int32())}),
            f"{names}, audits array<string>, exits array<int>",
        ),
        "walked",
    )
    entries = walked.select(*key, "exits").groupBy("conv").applyInArrow(
        _entries, f"conv {kind}, part long, block long, entry int"
    )
    entered = join_groups(walked, entries, key).withColumn("audit", F.expr("element_at(audits, entry + 1)"))
    names = [*key, "first", "audit", "cost", "illegal"]
    return materialize(alone.select(*names).union(entered.select(*names)), "solved")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired rows from a stream of rows and the edits of blocks, in order."""
    schema = pa.schema([("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    conv: object = None
    started, state, place = False, 0, 0
    letters: deque[str] = deque()  # edits of blocks not used up yet: two blocks, or equal rows between
    at = 0  # letters of the first that are used up
    rows: list[tuple] = []
    convs: list[object] = []

    def emit(edit: str, role: str, text: str) -> None:
        nonlocal place
        rows.append((place, edit, role, text))
        convs.append(conv)
        place += 1

    def inserted() -> None:
        """Take turns to be inserted off the front of the edits."""
        nonlocal state, at
        while letters:
            while at < len(letters[0]) and letters[0][at] == "I":
                at, state = at + 1, _NEXT[state]
                emit("I", _ROLE[state], "")
            if at < len(letters[0]):
                return
            letters.popleft()
            at = 0

    def batch_of(kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 4
        arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
        out = pa.RecordBatch.from_arrays([pa.array(convs, kind), *arrays], names=["conv_id", *schema.names])
        rows.clear()
        convs.clear()
        return out

    kind = pa.null()
    for batch in batches:
        kind = batch.schema.field("conv").type
        size = 0
        for row in zip(*[batch.column(c) for c in ("conv", "audit", "role", "text")], strict=True):
            now, audit, role, text = (x.as_py() for x in row)
            if not started or now != conv:
                inserted()
                conv, started, state, place = now, True, 0, 0
            if audit is not None:
                letters.append(audit)
                continue
            inserted()
            edit, at = letters[0][at], at + 1
            if edit == "K":
                state = _KEEP["sua".index(role[0])][state]
                emit(edit, role, text)
            elif edit == "R":
                state = _NEXT[state]
                emit(edit, _ROLE[state], text)
            size += len(text)
            if size > 1 << 22:
                yield batch_of(kind)
                size = 0
        if rows:
            yield batch_of(kind)
    inserted()
    if rows:
        yield batch_of(kind)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ``role:text`` lines of every conversation of an ordered stream."""
    conv, total, kind = None, None, pa.null()
    for batch in batches:
        kind, done = batch.schema.field("conv_id").type, []
        for row in zip(*[batch.column(c) for c in ("conv_id", "place", "role", "text")], strict=True):
            now, place, role, text = (x.as_py() for x in row)
            if place == 0:
                if total is not None:
                    done.append((conv, total.hexdigest()))
                conv, total = now, hashlib.sha256()
            total.update(("\n" * (place > 0) + f"{role}:{text}").encode())
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array([c for c, _ in done], kind), pa.array([d for _, d in done])], names=["conv_id", "repaired_sha256"]
            )
    if total is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([conv], kind), pa.array([total.hexdigest()])], names=["conv_id", "repaired_sha256"]
        )


def repair(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Figures of every conversation, and its repaired turns.

    ``conversations`` has ``conv_id, turn, role, text``; other columns are not read. A
    conversation's rows are taken by turn (nulls first), then role, then SHA-256 of the
    text, so ties have a fixed order; null roles and texts count as one space, a null
    conv_id is a conversation of its own, rows that are repeated are duplicates, and an
    empty table gives no rows. The first fault of a row counts: blank (no character but
    white space), duplicate (role and text came earlier), truncated (its last character
    but white space is not ``.!?``).

    The first result has ``conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit``; the second the turns after repair, ``conv_id, place, edit, role, text``, with
    the rows of a conversation together in one partition and in order.
    """
    coded = _coded(conversations)
    sums = [F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")]
    figures = materialize(
        coded.groupBy("conv").agg(
            F.count("*").alias("n"),
            (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
            *sums,
        ),
        "figures",
    )
    solved = _solved(_blocks(coded, figures, block_rows))
    # the edits of a conversation, one piece for each block
    pieces = solved.groupBy("conv").agg(
        F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "block", "audit"))), lambda x: x["audit"]), "").alias("audit"),
    )
    found = join_groups(figures, pieces, ["conv"]).select(
        F.col("conv").alias("conv_id"), F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"),
        "blank", "duplicate", "truncated", "illegal", "cost", "audit",
    )
    edits = solved.select(
        "conv", F.col("first.turn").alias("turn"), F.col("first.role").alias("role"), F.col("first.tie").alias("tie"),
        F.lit(0).alias("kind"), F.col("first.id").alias("id"), "audit", F.lit("").alias("text"),
    )
    turns = _ordered(conversations).select(
        *_ORDER, F.lit(1).alias("kind"), F.lit(0).cast("long").alias("id"), F.lit(None).cast("string").alias("audit"), "text"
    )
    stream = edits.unionByName(turns).repartition("conv").sortWithinPartitions(*_ORDER, "kind", "id")
    kind = dict(conversations.dtypes)["conv_id"]
    turns = stream.select("conv", "audit", "role", "text").mapInArrow(
        _apply, f"conv_id {kind}, place long, edit string, role string, text string"
    )
    return found, turns


def repair_digest(original: DataFrame, damaged: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Figures and digest of the repair of ``damaged``, for every conv_id of ``original``.

    A conversation that has lost all rows has zeros, no edits and the digest of no bytes.
    """
    found, turns = repair(damaged, block_rows)
    kind = dict(damaged.dtypes)["conv_id"]
    digests = turns.mapInArrow(_digest, f"conv_id {kind}, repaired_sha256 string")
    convs = original.select("conv_id").distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    out = join_groups(join_groups(convs, found, ["conv_id"], "left"), digests, ["conv_id"], "left")
    return out.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
