"""Character shingles of letters: hashes, size, parity sketch and exact similarity.

A text is taken as the set of the distinct runs of ``WIDTH`` characters in its
letters. Similarity of two sets is their Jaccard index; it is defined for
texts of at least ``LEAST`` letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulemill.llm.codepoints import decode, row_bounds

WIDTH, LEAST, WORDS = 4, 40, 8
BITS = 64 * WORDS
SKETCH = [f"s{i}" for i in range(WORDS)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of ``width`` characters within a row: 64-bit hash, row, place in the row."""
    starts, sizes = row_bounds(codes)
    counts = np.maximum(sizes - width + 1, 0)
    rows = np.repeat(np.arange(len(starts)), counts)
    places = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = starts[rows] + places
    wide = codes.astype(np.uint64)
    acc = np.zeros(len(at), np.uint64)
    for i in range(width):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + wide[at + i] + np.uint64(1)
        if i % 4 == 3:
            acc = mix(acc)
    return mix(acc), rows, places


#: Bits of a row number within a batch of at most 2,048 rows, and of a shingle's hash beside it.
ROW_BITS, HASH_BITS = 11, 53


def distinct_runs(codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (53-bit hash, row) of the runs of ``width`` characters, sorted by row and hash: one sort of one number each."""
    hashes, rows, _ = run_hashes(codes, width)
    key = rows.astype(np.uint64) << np.uint64(HASH_BITS) | hashes >> np.uint64(ROW_BITS)
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return key & np.uint64((1 << HASH_BITS) - 1), (key >> np.uint64(HASH_BITS)).astype(np.int64)


def parity_sketch(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """(n, WORDS) int64: bit b is the parity of the number of shingles in bucket b.

    The buckets are disjoint pivot sets. By the triangle inequality two sets
    differ in at least |count_b(x) - count_b(y)| shingles of bucket b, thus in
    at least as many shingles as there are bits that differ.
    """
    bucket = (hashes >> np.uint64(20)).astype(np.int64) % BITS
    odd = (np.bincount(rows * BITS + bucket, minlength=n * BITS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64).reshape(n, WORDS)


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Bounds what a batch of texts takes when it is expanded to shingles."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def may_be_similar(a: str, b: str, threshold: float) -> Column:
    """Necessary for similarity: sets of size n of which the sketches differ in no more bits than the sets may in shingles."""
    bits = " + ".join(f"bit_count({a}.{s} ^ {b}.{s})" for s in SKETCH)
    least, most = f"least({a}.n, {b}.n)", f"greatest({a}.n, {b}.n)"
    return F.expr(f"{least} >= {threshold - 1e-9} * {most} AND ({bits}) * {1 + threshold} <= {1 - threshold + 1e-9} * ({a}.n + {b}.n)")


@lru_cache(4096)
def _runs(text: str) -> frozenset[str]:
    return frozenset(text[i : i + WIDTH] for i in range(len(text) - WIDTH + 1))


def similarity(a: str, b: str) -> float:
    x, y = _runs(a), _runs(b)
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 0.0


def similar(threshold: float):
    @F.arrow_udf("boolean")
    def udf(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([similarity(x, y) >= threshold - 1e-12 for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.bool_())

    return udf
