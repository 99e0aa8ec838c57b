"""Token counts of byte-level BPE vocabularies by rank-synchronous array merging.

Distinct pre-tokens of a piece of text are held together as one ragged array of byte ids.
In every round each sequence applies its own lowest-rank pair everywhere at once, and
sequences without a mergeable pair retire with the number of symbols left. A merge never
makes a pair of lower rank than itself, so this gives the tokens of one-at-a-time merging.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.text import pieces, utf8

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies of this kind.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose counts a task remembers; beyond it the memory starts anew.
CACHE_ENTRIES = 500_000
_NONE = np.int64(1 << 40)


def _byte_symbols() -> list[str]:
    """The character that stands for each byte in vocabularies of this kind."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    out, spare = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


_LETTER, _NUMBER, _SPACE, _OTHER = range(4)
#: A character of each class that is in no contraction, and of the same class everywhere.
_LIKE = {_LETTER: "ɐ", _NUMBER: "²", _SPACE: "\t", _OTHER: "§"}
_CODES = 0x110000


def _own_classes() -> np.ndarray:
    """Class of every code point in the tables of the regular expressions used here."""
    out = np.full(_CODES, _OTHER, np.uint8)
    every = "".join(chr(c) for c in range(_CODES) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for run in regex.finditer(pattern, every):
            out[[ord(c) for c in run.group()]] = kind
    return out


@lru_cache(maxsize=1)
def unlike_classes() -> dict[int, str]:
    """Code points that the tokenizers library puts in another class, and a character of that.

    The library has Unicode tables of its own, as old as it is. Its splitter is asked, not
    its version: the code points of one class in a row are one token, unless the library
    thinks otherwise; of each token it makes, the first character is then tried behind a
    letter, a digit and a mark.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    def cuts(text: str) -> list[tuple[int, int]]:
        return [span for _, span in ByteLevel(add_prefix_space=False).pre_tokenize_str(text)]

    own, runs = _own_classes(), []
    for kind in range(4):
        codes = np.flatnonzero(own == kind)
        codes = codes[(codes < 0xD800) | (codes >= 0xE000)]
        if kind == _SPACE:  # how white space is cut depends on what follows it
            runs += [codes[i : i + 1] for i in range(len(codes))]
        else:
            runs += [codes[a:b] for a, b in cuts("".join(map(chr, codes.tolist())))]
    classes = np.full(len(runs), _SPACE, np.uint8)
    for kind, before in ((_LETTER, "x"), (_NUMBER, "1"), (_OTHER, "!")):
        starts = {a for a, _ in cuts("".join(f"{before}{chr(r[0])}\n" for r in runs))}
        classes[[i for i in range(len(runs)) if 3 * i + 1 not in starts]] = kind
    return {
        int(c): _LIKE[int(kind)] for run, kind in zip(runs, classes, strict=True) if own[run[0]] != kind for c in run
    }


def _slot(key: np.ndarray, bits: int) -> np.ndarray:
    spread = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (spread >> np.uint64(64 - bits)).astype(np.int64)


def _hash_table(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Open addressing with steps of one: the key in every slot (or -1), its rank, and the
    number of bits of a slot; a quarter of the slots are used at most."""
    bits = max(18, (4 * len(keys)).bit_length())
    mask = (1 << bits) - 1
    slots, ranks = np.full(mask + 1, -1, np.int64), np.zeros(mask + 1, np.int64)
    rank, slot = np.arange(len(keys)), _slot(keys, bits)
    while len(rank):
        free = slots[slot] < 0
        put = np.unique(slot[free], return_index=True)[1]
        chosen = np.flatnonzero(free)[put]
        slots[slot[chosen]], ranks[slot[chosen]] = keys[rank[chosen]], rank[chosen]
        left = np.ones(len(rank), bool)
        left[chosen] = False
        rank, slot = rank[left], (slot[left] + 1) & mask
    return slots, ranks, bits


class ByteBpe:
    """A vocabulary file of the tokenizers library, without normalizer or added prefix.

    ``unlike`` are code points to be taken for others when a text is split
    (:func:`unlike_classes`).
    """

    def __init__(self, path: str, unlike: dict[int, str] | None = None) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"]:
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        vocab = spec["model"]["vocab"]
        self.first = np.array([vocab[c] for c in _byte_symbols()], np.int64)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.slots, self.ranks, self.bits = _hash_table(keys)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern = regex.compile(PRE_TOKEN)
        self.unlike = unlike or {}
        self.odd = np.zeros(_CODES, bool)
        self.odd[list(self.unlike)] = True

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text, as the library cuts them."""
        if text.isascii() or not self.odd[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
            return self.pattern.findall(text)
        spans = self.pattern.finditer(text.translate(self.unlike))
        return [text[m.start() : m.end()] for m in spans]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key, mask = left << 32 | right, len(self.slots) - 1
        slot = _slot(key, self.bits)
        out = np.full(len(key), _NONE)
        ask = np.arange(len(key))
        while len(ask):
            found = self.slots[slot]
            same = found == key
            out[ask[same]] = self.ranks[slot[same]]
            more = ~same & (found >= 0)
            ask, key, slot = ask[more], key[more], (slot[more] + 1) & mask
        return out

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """Number of symbols each byte sequence ends with."""
        out = np.zeros(len(tokens), np.int64)
        size = np.array([len(t) for t in tokens], np.int64)
        ids = self.first[np.frombuffer(b"".join(tokens), np.uint8)]
        live = np.flatnonzero(size > 0)
        size = size[live]
        while len(live):
            starts = np.concatenate([[0], np.cumsum(size)[:-1]])
            rank = np.full(len(ids), _NONE)
            rank[:-1] = self._rank(ids[:-1], ids[1:])
            rank[starts + size - 1] = _NONE  # the last symbol has no right neighbour
            least = np.minimum.reduceat(rank, starts)
            done = least == _NONE
            out[live[done]] = size[done]
            owner = np.repeat(np.arange(len(live)), size)
            hit = (rank == least[owner]) & ~done[owner]
            # pairs that overlap (a run of one symbol): take every second one from the left
            begin = hit & ~np.concatenate([[False], hit[:-1]])
            at = np.arange(len(ids))
            run = np.maximum.accumulate(np.where(begin, at, 0))
            hit &= (at - run) % 2 == 0
            ids[hit] = self.merged[rank[hit]]
            stay = ~done[owner]
            stay[1:] &= ~hit[:-1]
            size = np.bincount(owner[stay], minlength=len(live))[~done]
            ids, live = ids[stay], live[~done]
        return out


def _counter(path: str, limit: int, unlike: dict[int, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(path, unlike)
        known: dict[str, int] = {}
        for batch in batches:
            column = batch.column("text")
            for low, high in pieces(column):
                part = column[low:high]
                found, extra = [], []
                for value in part:
                    text, specials = value.as_py() or "", 0
                    if bpe.special is not None and bpe.special.search(text):
                        parts = bpe.special.split(text)
                        specials = len(parts) - 1
                        found.append([t for p in parts for t in bpe.split(p)])
                    else:
                        found.append(bpe.split(text))
                    extra.append(specials)
                if len(known) > CACHE_ENTRIES:
                    known = {}
                new = [t for t in set().union(*found) if t not in known]
                known.update(zip(new, bpe.counts([t.encode() for t in new]).tolist(), strict=True))
                n = [sum(map(known.__getitem__, t)) + e for t, e in zip(found, extra, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[low:high],
                        pa.array(np.diff(utf8(part)[1])),
                        pa.array(n, pa.int64()),
                        pa.array([x > limit for x in n], pa.bool_()),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return run


def token_counts(documents: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """Tokens of every whole text under a byte-level BPE vocabulary file.

    Returns ``doc_id, n_bytes, n_tokens, over_limit`` for every input row. A null text is
    empty and has no tokens; special strings inside a text count as one token; an empty
    table gives no rows; other columns are not read; a very long text is held by its task
    with its pre-tokens. Every executor needs the file. Letters, numbers and white space
    are those of the tokenizers library, which the driver needs to tell them.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(
        _counter(vocabulary, limit, unlike_classes()), "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
