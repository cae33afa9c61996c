"""Pigeonhole keys of 64-bit fingerprints, and SimHash in built-in functions."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _signed(bits: int) -> int:
    bits &= 2**64 - 1
    return bits - 2**64 if bits >= 2**63 else bits


def block_keys(fp: Column, radius: int, blocks: int) -> Column:
    """One key for each choice of ``radius`` blocks left open: the other bits, and the choice.

    Fingerprints that differ in ``radius`` bits agree on all but that many blocks at most, so
    they share a key. A key is a 64-bit hash; a clash only adds candidates.
    """
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = [_signed(~sum((1 << edges[b + 1]) - (1 << edges[b]) for b in open_)) for open_ in combinations(range(blocks), radius)]
    return F.transform(F.lit(masks), lambda m: F.xxhash64(m, fp.bitwiseAND(m)))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


# Longs that :func:`byte_sums` may count into one row: with more, a byte would run over into the next.
FULL = 127
ONES = sum(1 << 8 * i for i in range(8))


def byte_sums(h: Column) -> list[Column]:
    """Aggregates that count the set bits of up to ``FULL`` longs: bits i, i + 8, ... in one sum, a byte each."""
    return [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(ONES))).alias(f"bytes_{i}") for i in range(8)]


def byte_majority(n: Column) -> Column:
    """Bit i is set if it is set in over half of the ``n`` longs that :func:`byte_sums` counted.

    Every other byte has room to 2^15, so that four are compared at once: what is added brings a
    byte to 128 exactly if it holds the least majority.
    """
    room = F.lit(sum(1 << 16 * i for i in range(4)))
    to_128 = (F.lit(127) - F.shiftright(n, 1)) * room
    bits = []
    for i in range(8):
        for odd in (0, 1):
            # No sum is null. Saying so halves the code, which the JVM would leave uncompiled else.
            counts = F.shiftrightunsigned(F.coalesce(f"bytes_{i}", F.lit(0)), 8 * odd).bitwiseAND(room * 255)
            over = (counts + to_128).bitwiseAND(room * 128)
            bits.append(F.shiftleft(over, i + 1) if odd else F.shiftrightunsigned(over, 7 - i))
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def bit_sums() -> list[Column]:
    """Aggregates over rows of :func:`byte_sums`, of any number of longs: bits i and i + 32 in one sum each.

    Either half of a sum holds up to 2^31 longs, more than an array can.
    """
    both = F.lit((255 << 32) + 255)
    return [F.sum(F.shiftrightunsigned(f"bytes_{i % 8}", i // 8 * 8).bitwiseAND(both)).alias(f"bits_{i}") for i in range(32)]


def majority(n: Column) -> Column:
    """Bit i is set if it is set in over half of the ``n`` longs that :func:`bit_sums` counted.

    Both halves of a sum are compared at once: with bit 30 of a half set, it keeps that bit after
    the least majority is taken from it exactly if it holds that many. ``n`` is below 2^30, as a
    text of two gigabytes has fewer words, so no half borrows from the other.
    """
    high = F.lit((1 << 62) + (1 << 30))
    least = (F.floor(n / 2) + 1).cast("long") * F.lit((1 << 32) + 1)
    kept = [(F.col(f"bits_{i}").bitwiseOR(high) - least).bitwiseAND(high) for i in range(32)]
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftrightunsigned(k, 30 - i) if i <= 30 else F.shiftleft(k, 1) for i, k in enumerate(kept)])
