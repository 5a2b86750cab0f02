"""Evaluation texts leaking into training text (problem 7): a prefix-filtered set join.

A document leaks an item if their letters share a run of RUN characters. Each
window of RUN letters of an item is a set of shingles of GRAM letters, and a
document that holds the window holds all of them: one of them, the rarest in
the corpus, is the necessary prefix. Shingles of items are ordered by how often
they occur in all documents, each window gives its rarest one, and documents
are joined to these tokens. A meeting must leave room for the window in both
texts; what remains is verified by comparing the letters along its diagonal.

Items are a stated query set: they are taken in blocks of at most BLOCK letters
(about 20 bytes each in memory), and only a block's tokens are sent to the
executors. Documents are never shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulemill.llm.codepoints import decode, form, letters, row_bounds
from rulemill.llm.shingles import run_hashes, small_batches
from rulemill.llm.uniform import letters_of
from rulemill.session import spread

RUN, GRAM = 60, 16
BLOCK = 1 << 20


def find(sorted_keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values that are among the keys, and where there."""
    if not len(sorted_keys) or not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # One bit a hash class settles most misses without a search.
    seen = np.zeros(1 << 20, bool)
    seen[sorted_keys >> np.uint64(44)] = True
    some = np.flatnonzero(seen[values >> np.uint64(44)])
    at = np.minimum(np.searchsorted(sorted_keys, values[some]), len(sorted_keys) - 1)
    hit = sorted_keys[at] == values[some]
    return some[hit], at[hit]


def frequencies(texts: DataFrame, keys: np.ndarray, gram: int) -> np.ndarray:
    """How often each of the sorted keys occurs as a shingle in all of ``texts`` (id, text)."""

    def run(batches):
        total = np.zeros(len(keys), np.int64)
        for b in small_batches(batches, 500):
            total += np.bincount(find(keys, run_hashes(letters(form(decode(b.column(1)))), gram)[0])[1], minlength=len(keys))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["k", "n"])

    got = texts.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # one row a key at most
    out = np.zeros(len(keys), np.int64)
    out[got.column("k").to_numpy()] = got.column("n").to_numpy()
    return out


def window_prefixes(codes: np.ndarray, hashes: np.ndarray, rows: np.ndarray, places: np.ndarray, rank: np.ndarray, run: int, gram: int) -> np.ndarray:
    """Indices of the shingles that are the rarest of some window of ``run`` letters."""
    span = run - gram + 1
    chosen = []
    for row in range(len(row_bounds(codes)[0])):
        own = np.flatnonzero(rows == row)
        if len(own) >= span:
            chosen.append(np.unique(own[np.arange(len(own) - span + 1) + sliding_window_view(rank[own], span).argmin(axis=1)]))
    return np.concatenate(chosen) if chosen else np.empty(0, np.int64)


def longest_run(same: np.ndarray) -> int:
    breaks = np.flatnonzero(np.concatenate([[True], ~same, [True]]))
    return int(np.diff(breaks).max()) - 1


def leaks_of_block(texts: DataFrame, item_ids: np.ndarray, item_letters: list[str], run: int, gram: int) -> DataFrame:
    codes = decode(pa.array(item_letters, pa.string()))
    starts, _ = row_bounds(codes)
    hashes, rows, places = run_hashes(codes, gram)
    keys = np.unique(hashes)
    count = frequencies(texts, keys, gram)
    rank = np.empty(len(keys), np.int64)
    rank[np.lexsort((keys, count))] = np.arange(len(keys))
    chosen = window_prefixes(codes, hashes, rows, places, rank[np.searchsorted(keys, hashes)], run, gram)
    chosen = chosen[np.argsort(hashes[chosen], kind="stable")]
    tokens, first = np.unique(hashes[chosen], return_index=True)
    last = np.append(first[1:], len(chosen))
    item_of, place_of = rows[chosen], places[chosen]
    sizes = row_bounds(codes)[1]

    def search(batches):
        for b in small_batches(batches, 500):
            own = letters(form(decode(b.column(1))))
            begin, length = row_bounds(own)
            h, r, p = run_hashes(own, gram)
            at, token = find(tokens, h)
            times = last[token] - first[token]
            which = np.repeat(first[token], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            doc, item, shift = np.repeat(r[at], times), item_of[which], np.repeat(p[at], times) - place_of[which]
            low, high = np.maximum(shift, 0), np.minimum(length[doc], sizes[item] + shift)
            meets = np.unique(np.stack([doc, item, shift], axis=1)[high - low >= run], axis=0)
            found = set()
            for d, i, s in meets.tolist():
                if (d, i) not in found:
                    a, z = max(s, 0), min(length[d], sizes[i] + s)
                    if longest_run(own[begin[d] + a : begin[d] + z] == codes[starts[i] + a - s : starts[i] + z - s]) >= run:
                        found.add((d, i))
            ids = b.column(0).to_numpy(zero_copy_only=False)
            pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids[pairs[:, 0]], pa.int64()), pa.array(item_ids[pairs[:, 1]], pa.int64())], ["doc_id", "item_id"])

    return texts.mapInArrow(search, "doc_id long, item_id long")


def leaked_items(documents: DataFrame, items: DataFrame, run: int = RUN, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """p7: distinct (doc_id, item_id) of documents (doc_id, text) and items (item_id, text) that share a run of letters.

    Null ids and texts, and texts with fewer than ``run`` letters, leak nothing.
    """
    texts = spread(documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text"))
    known = items.where(F.col("item_id").isNotNull()).select("item_id", letters_of(F.col("text")).alias("l")).where(F.length("l") >= run)
    total = known.agg(F.sum(F.length("l"))).first()[0] or 0
    blocks = -(-total // block)
    out = None
    for k in range(blocks):
        part = known.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id").toArrow()
        if part.num_rows:
            found = leaks_of_block(texts, part.column("item_id").to_numpy(), part.column("l").to_pylist(), run, gram)
            out = found if out is None else out.union(found)
    return out.distinct() if out is not None else texts.where("false").select("doc_id", F.lit(0).cast("long").alias("item_id"))
