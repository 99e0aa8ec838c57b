"""Quality rules as weak supervision: votes, estimated accuracies, posterior quality.

Every rule looks at a few figures of a whole text and votes good (1), bad (-1) or abstains
(0). How often each combination of votes occurs is counted over all documents; expectation
maximisation on these counts estimates how each rule votes on good documents and on each
kind of bad ones, and so how far its votes can be trusted. The posterior probability of "good" given all votes decides, so one rule that errs does not
reject a document alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.text import hashes, mix, offsets, pieces, rolling

_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_LATER_BYTES = bytes(range(0x80, 0xC0))
_ENDS = (b".", b"!", b"?", b'"', b":", b"\xe2\x80\xa6")

FIGURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_distinct long, n_lines long, n_ended_lines long, n_upper long, n_letters long, "
    "n_block_words long, n_block_distinct long, n_block_repeats long"
)

#: Words of a block, in which repetition is judged whatever the length of the text.
BLOCK = 500


def figures(text: bytes) -> tuple[int, ...]:
    """The figures of one text, in the order of :data:`FIGURES`."""
    words = text.split()
    bare = text.translate(None, _SPACE)
    seen: set[bytes] = set()
    lines = ended = dup = 0
    for line in text.split(b"\n"):
        body = line.strip()
        if body:
            lines += 1
            ended += body.endswith(_ENDS)
            dup += line in seen
            seen.add(line)
    upper = _count(bare, _UPPER)
    return (
        len(words),
        len(bare.translate(None, _LATER_BYTES)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        dup,
        _repeat_words(text),
        len(set(words)),
        lines,
        ended,
        upper,
        upper + _count(bare, _LOWER),
        *_block_figures(text),
    )


_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_LOWER = bytes(range(ord("a"), ord("z") + 1))


def _count(text: bytes, what: bytes) -> int:
    return len(text) - len(text.translate(None, what))


def _repeat_words(text: bytes) -> int:
    """Words in 3-word windows that are found twice or more in the text."""
    buf = np.frombuffer(text, np.uint8)
    starts, ends = offsets(buf, np.array([0, len(buf)]))
    windows = rolling(hashes(buf, starts, ends), 3)
    if len(windows) < 2:
        return 0
    order = np.argsort(windows)
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    covered = np.zeros(len(starts), bool)
    for hit in (order[1:][same], order[:-1][same]):
        for j in range(3):
            covered[hit + j] = True
    return int(covered.sum())


def _block_figures(text: bytes) -> tuple[int, int, int]:
    """Words, different words, and words in repeated 3-word windows, each inside its block.

    Blocks are consecutive; the last words of a text that do not fill one are filled up with
    those before them, so all blocks of a text are of one length.
    """
    buf = np.frombuffer(text, np.uint8)
    h = hashes(buf, *offsets(buf, np.array([0, len(buf)])))
    if len(h) > BLOCK and len(h) % BLOCK:
        h = np.concatenate([h[: len(h) // BLOCK * BLOCK], h[-BLOCK:]])
    block = (np.arange(len(h)) // BLOCK).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    distinct = len(np.unique(mix(h + block)))
    at = np.flatnonzero(block[2:] == block[:-2])
    if not len(at):
        return len(h), distinct, 0
    windows = mix(rolling(h, 3)[at] + block[at])
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    covered = np.zeros(len(h), bool)
    hit = at[times[which] > 1]
    for j in range(3):
        covered[hit + j] = True
    return len(h), distinct, int(covered.sum())


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in FIGURES.split(", ")]
    for batch in batches:
        for low, high in pieces(batch.column("text")):
            part = batch.slice(low, high - low)
            rows = [figures((v.as_py() or "").encode()) for v in part.column("text")]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, *columns], names=[*part.schema.names, *names]
            )


@dataclass(frozen=True)
class Rule:
    """A vote by two conditions; where both hold or neither does, the rule abstains."""

    name: str
    good: Column
    bad: Column

    def vote(self) -> Column:
        good, bad = F.coalesce(self.good, F.lit(False)), F.coalesce(self.bad, F.lit(False))
        return good.cast("int") - bad.cast("int")


def _share(part: str, whole: str) -> Column:
    return F.try_divide(F.col(part), F.col(whole))


def default_rules() -> list[Rule]:
    """Rules on length, word shape, symbols, capitals, repetition and punctuation.

    To pass most of them is no sign of quality, so they abstain rather than vote good.
    Vocabulary and repetition are means over blocks, as both change with the length of a text.
    """
    words, mean = F.col("n_words"), _share("word_chars", "n_words")
    symbols, upper = _share("n_symbols", "n_words"), _share("n_upper", "n_letters")
    distinct, repeat = (_share(part, "n_block_words") for part in ("n_block_distinct", "n_block_repeats"))
    ended, dup = _share("n_ended_lines", "n_lines"), _share("n_dup_lines", "n_lines")
    never = F.lit(False)
    return [
        Rule("length", words >= 300, words < 30),
        Rule("word_length", never, (mean < 2.5) | (mean > 9.0)),
        Rule("symbols", never, symbols > 0.1),
        Rule("capitals", never, upper > 0.3),
        Rule("vocabulary", (words >= 40) & (distinct > 0.45), (words >= 40) & (distinct < 0.25)),
        Rule("repetition", never, repeat > 0.35),
        Rule("line_ends", (F.col("n_lines") >= 3) & (ended >= 0.9), ended < 0.4),
        Rule("repeated_lines", never, dup > 0.3),
    ]


#: Share of all texts added to every tally: a rule may err on so many texts of any kind.
_DOUBT = 0.001


@dataclass(frozen=True)
class LabelModel:
    """Shares of good texts and of each kind of bad ones, and how every rule votes on them."""

    prior: np.ndarray  # [kind]; kind 0 is good, kind r + 1 is what rule r is after
    log_vote: np.ndarray  # [kind, rule, vote + 1]

    def kinds(self, votes: np.ndarray) -> np.ndarray:
        """Probability of every kind for each row of votes."""
        rule = np.arange(votes.shape[1])
        log = np.log(self.prior)[:, None] + self.log_vote[:, rule, votes + 1].sum(axis=2)
        odds = np.exp(log - log.max(axis=0, initial=-np.inf))
        return odds / odds.sum(axis=0)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of "good" for each row of votes."""
        return self.kinds(votes)[0]

    def accuracy(self) -> np.ndarray:
        """For each rule, the probability that a text it votes bad is bad."""
        bad = np.exp(self.log_vote[:, :, 0]) * self.prior[:, None]
        return 1 - bad[0] / bad.sum(axis=0)


def fit_label_model(
    votes: np.ndarray, counts: np.ndarray, rounds: int = 50, worst: float = 0.005
) -> LabelModel:
    """Expectation maximisation on counted vote combinations.

    Texts are bad in different ways, so every rule has a kind of bad text it is after, on
    which it always votes bad. A kind begins with the texts that its rule votes bad (shared
    among rules that agree) and the good kind with the rest; a text that a rule votes bad
    is still good if its other votes fit good texts better than that kind. No rule is taken
    to err on more than ``worst`` of the good texts. Each round estimates how often every rule
    votes each way on every kind, then what kind each combination of votes most likely is.
    """
    rules = votes.shape[1]
    own = np.arange(rules)
    against = np.concatenate([np.zeros((1, len(votes))), (votes == -1).T])
    against[0] = ~against[1:].any(axis=0)
    share = against / np.maximum(against.sum(axis=0), 1)
    doubt = _DOUBT * (counts.sum() + 1)
    model = LabelModel(np.full(rules + 1, 1 / (rules + 1)), np.zeros((rules + 1, rules, 3)))
    for _ in range(rounds):
        weight = share * counts
        tally = doubt / 3 + np.stack([(weight[:, None, :] * (votes == v).T).sum(axis=2) for v in (-1, 0, 1)], axis=2)
        tally[own + 1, own] = [1.0, 0.0, 0.0]
        rest = tally[0, :, 1:].sum(axis=1)
        tally[0, :, 0] = np.minimum(tally[0, :, 0], rest * worst / (1 - worst))
        prior = weight.sum(axis=1) + doubt
        with np.errstate(divide="ignore"):
            model = LabelModel(prior / prior.sum(), np.log(tally / tally.sum(axis=2, keepdims=True)))
        new = model.kinds(votes)
        if np.abs(new - share).max(initial=0) < 1e-9:
            break
        share = new
    return model


def _with_votes(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    new = [f.split()[0] for f in FIGURES.split(", ")]
    taken = {*new, "vote_code", "quality", "base_failed", "kept", *(f"vote_{r.name}" for r in rules)}
    kept = documents.select(*[f"`{c}`" for c in documents.columns if c.lower() not in taken])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    table = kept.mapInArrow(_figures, f"{schema}, {FIGURES}")
    return table.withColumns({f"vote_{r.name}": r.vote() for r in rules})


def quality_rules(
    documents: DataFrame, rules: list[Rule] | None = None, threshold: float = 0.5, rounds: int = 50
) -> DataFrame:
    """Figures, votes, posterior quality and verdict of every document.

    Keeps the input's columns and adds the figures, one ``vote_<rule>`` column a rule,
    ``quality`` (posterior), ``base_failed`` and ``kept``. A null or empty text has no words
    and fails the base rules; an input column of the same name as a result is replaced;
    repeated rows get equal results; an empty table gives no rows. Vote combinations are
    counted over all documents; there are at most 3 to the number of rules, so they fit on
    the driver. The texts are read twice, to count votes and to judge; a very long text is
    judged in blocks, so its length alone changes no vote.
    """
    rules = rules or default_rules()
    names = [f"vote_{r.name}" for r in rules]
    only_text = documents.select("text")
    combos = _with_votes(only_text, rules).groupBy(*names).count().collect()
    votes = np.array([[r[n] for n in names] for r in combos], np.int64).reshape(-1, len(names))
    counts = np.array([r["count"] for r in combos], float)
    model = fit_label_model(votes, counts, rounds)
    spark = documents.sparkSession
    codes = ((votes + 1) * 3 ** np.arange(len(names))).sum(axis=1)
    known = spark.createDataFrame(
        list(zip(codes.tolist(), model.posterior(votes).tolist(), strict=True)),
        "vote_code int, quality double",
    )
    code = sum((F.col(n) + 1) * 3**i for i, n in enumerate(names)).cast("int")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        _with_votes(documents, rules)
        .withColumn("vote_code", code)
        .join(F.broadcast(known), "vote_code")
        .drop("vote_code")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
    )
