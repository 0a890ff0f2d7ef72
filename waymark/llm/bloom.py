"""Bloom filters of 64-bit blocks: filled by Spark sums of bits, probed in numpy, never larger than a bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of filter per key; four of a block's 64 bits are set per key. About one probe in 500 passes by chance.
BITS = 24
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SHIFTS = [np.uint64(s) for s in (58, 52, 46, 40)]
_LOW, _ONE, _HALF = np.uint64(63), np.uint64(1), np.uint64(32)


def mix(hashes: np.ndarray) -> np.ndarray:
    """Spread each hash's bits over all 64."""
    h = hashes ^ (hashes >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slots_for(keys: int) -> int:
    """Blocks for so many keys, 16 at least."""
    return max(16, -(-keys * BITS // 64))


def places(hashes: np.ndarray, first: int, slots: int) -> np.ndarray:
    """The block of each mixed hash among ``slots`` blocks from ``first`` on (``slots`` under 2^32)."""
    return ((hashes >> _HALF) * np.uint64(slots) >> _HALF) + np.uint64(first)


def masks(hashes: np.ndarray) -> np.ndarray:
    """The four bits of each mixed hash."""
    g = hashes * _ODD
    out = np.zeros(len(g), np.uint64)
    for shift in _SHIFTS:
        out |= _ONE << (g >> shift & _LOW)
    return out


def passing(blocks: np.ndarray, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Indices of the mixed hashes whose four bits are set in their block ``at``."""
    g, found = hashes * _ODD, blocks[at]
    left = np.flatnonzero(found >> (g >> _SHIFTS[0] & _LOW) & _ONE)
    for shift in _SHIFTS[1:]:
        left = left[(found[left] >> (g[left] >> shift & _LOW) & _ONE).astype(bool)]
    return left


def filled(bits: DataFrame, first: int, slots: int) -> np.ndarray:
    """Blocks ``first`` to ``first + slots`` of the filter whose bits are the rows ``slot, mask``.

    The rows of a block are one sum of bits in Spark; at most ``slots`` rows of two numbers reach the
    driver, which callers bound.
    """
    rows = bits.filter(F.col("slot").between(first, first + slots - 1)).groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    blocks = np.zeros(slots, np.uint64)
    blocks[rows["slot"].to_numpy() - first] = rows["mask"].to_numpy().view(np.uint64)
    return blocks


def bit_rows(slots: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(slots.view(np.int64)), pa.array(bits.view(np.int64))], names=["slot", "mask"])


def counted(parts: Iterator[dict], limit: int, schema: pa.Schema, columns) -> Iterator[pa.RecordBatch]:
    """Sum the dictionaries ``parts`` of counts; pass a batch on whenever ``limit`` keys are held, and at the end.

    ``columns(keys)`` gives a batch's arrays but the last, which holds the counts.
    """
    held: dict = {}
    for part in parts:
        for key, n in part.items():
            held[key] = held.get(key, 0) + n
        if len(held) >= limit:
            yield pa.RecordBatch.from_arrays([*columns(list(held)), pa.array(held.values(), pa.int64())], schema=schema)
            held = {}
    if held:
        yield pa.RecordBatch.from_arrays([*columns(list(held)), pa.array(held.values(), pa.int64())], schema=schema)
