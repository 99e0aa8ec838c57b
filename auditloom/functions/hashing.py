"""Seeded hashes as column expressions.

``xxhash64`` is the default. ``md5`` is slower but can be recomputed by any SQL
engine, which makes bit-exact checks possible.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASHES = ("xxhash64", "md5")


def _hex_long(digest: Column, start: int) -> Column:
    # 15 hex digits are 60 bits, so the number always fits a signed long
    return F.conv(F.substring(digest, start, 15), 16, 10).cast("long")


def _six_bits(number: Column, index: int) -> Column:
    shifted = F.call_function("shiftrightunsigned", number, F.lit(6 * index))
    return shifted.bitwiseAND(F.lit(63).cast("long")).cast("int")


def block_and_bits(
    value: Column, blocks: Column, count: int, hash: str = "xxhash64"
) -> tuple[Column, list[Column]]:
    """A block in ``[0, blocks)`` and ``count`` bit numbers in ``[0, 64)`` for a value.

    One 64-bit hash gives ten bit numbers; more are taken from further hashes.
    """
    if hash == "xxhash64":
        block = F.pmod(F.xxhash64(value, F.lit(0)), blocks)
        bits = [_six_bits(F.xxhash64(value, F.lit(1 + i // 10)), i % 10) for i in range(count)]
    elif hash == "md5":
        if count > 10:
            raise ValueError("md5 gives at most 10 bit numbers")
        digest = F.md5(value)
        block = F.pmod(_hex_long(digest, 1), blocks)
        bits = [_six_bits(_hex_long(digest, 16), i) for i in range(count)]
    else:
        raise ValueError(f"unknown hash {hash}; valid: {', '.join(HASHES)}")
    return block, bits


def seeded_bucket(value: Column, seed: Column, size: int, hash: str = "xxhash64") -> Column:
    """One position in ``[0, size)`` for a value and a seed."""
    if hash == "xxhash64":
        return F.pmod(F.xxhash64(value, seed), F.lit(size).cast("long"))
    if hash != "md5":
        raise ValueError(f"unknown hash {hash}; valid: {', '.join(HASHES)}")
    digest = F.md5(F.concat_ws(":", seed.cast("string"), value))
    return F.pmod(_hex_long(digest, 1), F.lit(size).cast("long"))
