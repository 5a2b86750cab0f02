"""Filling fixed-capacity containers (problem 6): shortest-pack-first over the length histogram.

Only the histogram of piece lengths, at most one number for each length up to
the capacity, reaches the driver. There lengths are placed longest first, each
into the pack that is shortest so far; packs alike are one pattern with a
count, so the work depends on the number of lengths and not of texts. Patterns
are then joined back to the pieces by their rank among those of equal length.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rulemill.session import cut, spread

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the public pre-tokenisation pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Parts in which rows of one length are ranked, so that a very common length is no single task.
RANK_PARTS = 1024


@lru_cache(4)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(path: str = TOKENIZER):
    """A column function: number of tokens of a text by the tokenizer whose file lies at ``path``; null stays null."""

    @F.arrow_udf(T.LongType())
    def count(texts: pa.Array) -> pa.Array:
        encode = tokenizer(path).encode_ordinary
        return pa.array([None if t is None else len(encode(t)) for t in texts.to_pylist()], pa.int64())

    return count


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packing patterns (count, [(length, copies), ...]) that use up the histogram of lengths 1 to capacity."""
    open_: dict[int, list[list]] = {}  # room left -> patterns [count, parts]
    done: list[tuple[int, list[tuple[int, int]]]] = []
    rooms = np.zeros(capacity + 1, bool)  # where there are open patterns

    def keep(room: int, count: int, parts: tuple) -> None:
        if count:
            open_.setdefault(room, []).append([count, parts])
            rooms[room] = True

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            fits = np.flatnonzero(rooms[length:])
            if not len(fits):
                each = capacity // length
                keep(capacity - each * length, left // each, ((length, each),))
                keep(capacity - left % each * length, 1 if left % each else 0, ((length, left % each),))
                break
            room = int(fits[-1]) + length
            count, parts = open_[room].pop()
            rooms[room] = bool(open_[room])
            used = min(count, left)
            keep(room, count - used, parts)
            left -= used
            more = (*parts[:-1], (length, parts[-1][1] + 1)) if parts[-1][0] == length else (*parts, (length, 1))
            keep(room - length, used, more)
    for patterns in open_.values():
        done += [(count, list(parts)) for count, parts in patterns]
    return done


def slots(patterns: list[tuple[int, list[tuple[int, int]]]], empty: int) -> np.ndarray:
    """Rows (length, first rank, first container, copies a container), sorted; containers count from 1. ``empty`` pieces of length 0 are dealt over all."""
    rows, at, base = [], {}, 1
    for count, parts in patterns:
        for length, copies in parts:
            rows.append((length, at.get(length, 0), base, copies))
            at[length] = at.get(length, 0) + count * copies
        base += count
    if empty:
        rows.append((0, 0, 1, -(-empty // max(base - 1, 1))))
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(sizes: DataFrame, doc_id: str, n_tokens: str, capacity: int = CAPACITY, parts: int = RANK_PARTS) -> DataFrame:
    """(container_no, doc_id, piece_no, n_tokens): where each document goes.

    A document above the capacity is cut into full pieces and a rest, numbered
    from 1; no other is cut. A document without tokens takes a place of size 0.
    Documents whose id or size is null are no items and are left out; an empty
    table needs no container. Repeated ids are items of their own.
    """
    n = F.col(n_tokens)
    items = sizes.where(F.col(doc_id).isNotNull() & n.isNotNull()).select(F.col(doc_id).alias("doc_id"), n.cast("long").alias("n"))
    pieces = items.select("doc_id", "n", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.col("n") / capacity)).cast("int"))).alias("piece_no"))
    size = F.least(F.lit(capacity), F.col("n") - (F.col("piece_no") - 1) * capacity).cast("int")
    pieces = cut(pieces.select("doc_id", "piece_no", size.alias("n_tokens"), F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(parts)).cast("int").alias("part")))
    counts = cut(pieces.groupBy("n_tokens", "part").agg(F.count("*").alias("c")))
    histogram = {r[0]: r[1] for r in counts.groupBy("n_tokens").agg(F.sum("c")).collect()}  # capacity + 1 rows at most
    empty = histogram.pop(0, 0)
    table = slots(shortest_pack_first(histogram, capacity), empty)
    # Ranks among pieces of one length: parts before, then the place in the part.
    before = Window.partitionBy("n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("n_tokens", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("n_tokens", "part").orderBy("doc_id", "piece_no")
    ranked = pieces.withColumn("place", F.row_number().over(within)).join(offsets, ["n_tokens", "part"])
    wide = 1 << 40

    @F.arrow_udf(T.LongType())
    def container(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        length, rank = lengths.to_numpy(zero_copy_only=False).astype(np.int64), ranks.to_numpy(zero_copy_only=False)
        row = table[np.searchsorted(table[:, 0] * wide + table[:, 1], length * wide + rank, "right") - 1]
        return pa.array(row[:, 2] + (rank - row[:, 1]) // row[:, 3])

    return ranked.select(container(F.col("n_tokens"), F.col("before") + F.col("place") - 1).alias("container_no"), "doc_id", "piece_no", "n_tokens")


def packed_documents(documents: DataFrame, tokenizer_path: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """p6: documents (doc_id, text) in containers, counted by the tokenizer at ``tokenizer_path``. Null texts are no items."""
    texts = spread(documents.select("doc_id", "text").where(F.col("text").isNotNull()))
    return pack(texts.select("doc_id", token_counts(tokenizer_path)(F.col("text")).alias("n")), "doc_id", "n", capacity)
