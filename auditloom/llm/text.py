"""Words of many texts at once: offsets and hashes as numpy arrays.

A word is a run of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``). Texts
are taken in pieces of bounded size, so temporary arrays do not grow with a batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

#: Texts are joined to pieces of about this many bytes; a longer text is a piece alone.
PIECE_BYTES = 1 << 20
_STEP = 1 << 20

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_UNBASE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240101).integers(1, 1 << 63, size=256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


_POWER = _powers(_BASE, _STEP + 1)
_UNPOWER = _powers(_UNBASE, _STEP + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def offsets(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; ``bounds`` are the offsets at which texts begin and end."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = _IS_WORD[buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    before[bounds[bounds < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    cut = bounds[bounds > 0] - 1
    after[cut] = False
    return np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every word."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = max(int(np.searchsorted(ends, low + _STEP, side="right")), i + 1)
        s, e = starts[i:j] - low, ends[i:j] - low
        if e[-1] > _STEP:  # one word longer than a step
            out[i] = _long_hash(buf[low : int(ends[i])])
        else:
            part = _BYTE[buf[low : low + int(e[-1])]]
            part *= _POWER[: len(part)]
            total = np.cumsum(part, dtype=np.uint64)
            out[i:j] = (total[e - 1] - total[s] + part[s]) * _UNPOWER[s]
        i = j
    return mix(out)


def _long_hash(buf: np.ndarray) -> np.uint64:
    value, shift = 0, 1
    for at in range(0, len(buf), _STEP):
        part = _BYTE[buf[at : at + _STEP]]
        value += shift * int(np.sum(part * _POWER[: len(part)], dtype=np.uint64))
        shift = shift * pow(_BASE, _STEP, 1 << 64) % (1 << 64)
    return np.uint64(value % (1 << 64))


def unused(columns: Sequence[str], *names: str) -> list[str]:
    """Names for helper columns that clash with none of ``columns``, whatever its case."""
    taken = {c.lower() for c in columns}
    mark = "__"
    while any((mark + n).lower() in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and where its rows begin and end; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, where, data = column.buffers()
    bounds = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1]
    bounds = bounds.astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), bounds * 0
    buf = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if len(bounds) else np.zeros(0, np.uint8)
    return buf, bounds - bounds[0]


def pieces(column: pa.Array, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a text column that hold about ``size`` bytes each."""
    rows = len(column)
    _, bounds = utf8(column)
    low = 0
    while low < rows:
        high = int(np.searchsorted(bounds, bounds[low] + size, side="right")) - 1
        high = min(max(high, low + 1), rows)
        yield low, high
        low = high


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive values (empty if there are fewer)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(_BASE) + h[j : j + n]
    return mix(out)


def sliding(fn, values: np.ndarray, w: int) -> np.ndarray:
    """``fn`` (np.minimum or np.maximum) over every ``w`` consecutive values."""
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = fn(out[: len(out) - step], out[step:])
        have += step
    return out
