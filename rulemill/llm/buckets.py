"""Rows that share a key, found without a row for each key in the JVM.

A text has dozens of keys and most of them belong to it alone. Keys are
therefore moved as packed arrays: a task sorts those of its rows, cuts them
into ranges and sends one record a range; the task of a range looks for keys
that occur more than once. A range holds about RANGE_KEYS keys at any scale.

``Members`` are bitmaps of a fixed size that say, with some false positives
and no false negatives, which keys or ids a table has. They are what is
broadcast, so nothing that grows with the data is.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulemill.llm.shingles import mix

#: Keys for one range; keys gathered in a task before they are sent.
RANGE_KEYS, SEND = 1 << 21, 1 << 20
#: Members of a key that are compared with all that come after them, within the range's task.
CENTRES = 16
#: Bits of a membership bitmap (8 MB) and of slices it is merged in.
MEMBER_BITS, SLICES = 1 << 26, 8

Keys = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]


def packed(rows: DataFrame, keys: Keys, ranges: int) -> DataFrame:
    """(part, keys, marks, ids): ``keys`` gives of a batch the uint64 keys, the uint64 mark and the int64 id beside each."""

    def send(waiting):
        key, mark, own = (np.concatenate(x) for x in zip(*waiting))
        by = np.argsort(key)
        key, mark, own = key[by], mark[by], own[by]
        part = ((key >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        parts, first = np.unique(part, return_index=True)
        ends = np.append(first[1:], len(part))
        blob = lambda x, kind: pa.array([x[a:z].astype(kind).tobytes() for a, z in zip(first, ends)], pa.binary())
        # Within a range the lower half of a key tells it from others.
        return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), blob(key, np.uint32), blob(mark, np.uint64), blob(own, np.int64)], ["part", "keys", "marks", "ids"])

    def run(batches: Iterator[pa.RecordBatch]):
        waiting, size = [], 0
        for b in batches:
            waiting.append(keys(b))
            size += len(waiting[-1][0])
            if size >= SEND:
                yield send(waiting)
                waiting, size = [], 0
        if size:
            yield send(waiting)

    return rows.mapInArrow(run, "part int, keys binary, marks binary, ids binary")


def meetings(blobs: DataFrame, ranges: int, near: int) -> DataFrame:
    """What shares a key: (key, a, b).

    With key null, a < b are ids whose marks differ in at most ``near`` bits
    and of which one is among the first CENTRES of a key. Of keys with more
    than CENTRES + 1 rows all members come out as well: id a, at place b.
    A range is taken in runs; of the keys of earlier runs only the first
    members and the number seen are kept, so a key of any size needs no more
    memory than others.
    """

    def found(part, key, mark, own, seen, old):
        by = np.argsort(key, kind="stable")  # rows kept from earlier runs come first
        key, mark, own, seen, old = key[by], mark[by], own[by], seen[by], old[by]
        begins = np.concatenate([[True], key[1:] != key[:-1]])
        start = np.flatnonzero(begins)
        size = np.diff(np.append(start, len(key)))
        group = np.cumsum(begins) - 1
        place = np.arange(len(key)) - start[group]
        kept_before = np.add.reduceat(old.astype(np.int64), start)
        seen_before = seen[start] * (kept_before > 0)
        # The place of a new row among all that the key has had.
        place_all = np.where(old, place, place - kept_before[group] + seen_before[group])
        pairs = []
        for c in range(CENTRES):
            i = np.flatnonzero((place > c) & ~old)
            at = start[group[i]] + c
            i, at = (x[np.bitwise_count(mark[i] ^ mark[at]) <= near] for x in (i, at))
            a, b = own[i], own[at]
            pairs.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b])
        pairs = np.unique(np.concatenate(pairs), axis=0)
        total = seen_before + size - kept_before
        was_long = seen_before > CENTRES + 1
        out = (total > CENTRES + 1)[group] & (~old | ~was_long[group])
        names = (np.uint64(part) << np.uint64(32) | key[out].astype(np.uint64)).astype(np.int64)
        rows = pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(names)]), pa.array(np.concatenate([pairs[:, 0], own[out]])), pa.array(np.concatenate([pairs[:, 1], place_all[out]]))],
            ["key", "a", "b"],
        )
        # Carried on: members that later rows are compared with, or that come out if the key grows long.
        stay = place_all <= CENTRES
        return rows, (key[stay], mark[stay], own[stay], total[group][stay], np.ones(int(stay.sum()), bool))

    def run(batches: Iterator[pa.RecordBatch]):
        waiting, size, carried, last = [], 0, {}, None

        def settle(part):
            new = [np.concatenate(x) for x in zip(*waiting)]
            new += [np.zeros(len(new[0]), np.int64), np.zeros(len(new[0]), bool)]
            rows, carried[part] = found(part, *(np.concatenate(x) for x in zip(carried[part], new)) if part in carried else new)
            return rows

        for b in batches:
            for part, *blobs in zip(*(c.to_pylist() for c in b.columns)):
                if waiting and (part != last or size >= 2 * RANGE_KEYS):
                    yield settle(last)
                    waiting, size = [], 0
                last = part
                waiting.append(tuple(np.frombuffer(x, kind) for x, kind in zip(blobs, (np.uint32, np.uint64, np.int64))))
                size += len(waiting[-1][0])
        if waiting:
            yield settle(last)

    return blobs.repartitionById(ranges, F.col("part")).mapInArrow(run, "key long, a long, b long")


class Members:
    """Which of the longs of a table may be there; two bits each in a bitmap of fixed size, packed while it is sent."""

    def __init__(self, slices: list[bytes]):
        self.slices = slices
        self.bits = None

    def __getstate__(self):
        return self.slices

    def __setstate__(self, slices):
        self.__init__(slices)

    @staticmethod
    def places(x: np.ndarray) -> np.ndarray:
        wide = mix(x.view(np.uint64))
        return np.stack([wide & np.uint64(MEMBER_BITS - 1), wide >> np.uint64(64 - MEMBER_BITS.bit_length() + 1)])

    def may_have(self, x: np.ndarray) -> np.ndarray:
        if self.bits is None:
            self.bits = np.frombuffer(b"".join(map(zlib.decompress, self.slices)), np.uint8)
        at = self.places(x)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(axis=0)


def members(rows: DataFrame, longs: Callable[[pa.RecordBatch], np.ndarray]) -> Members:
    """The bitmap of what ``longs`` gives of each batch of ``rows``. Tasks send sorted places, each slice is set by one task, and the slices reach the driver."""
    width = MEMBER_BITS // SLICES

    def send(waiting):
        at = np.unique(np.concatenate(waiting).astype(np.uint32))
        part, first = np.unique(at // width, return_index=True)
        ends = np.append(first[1:], len(at))
        return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([at[a:z].tobytes() for a, z in zip(first, ends)], pa.binary())], ["part", "places"])

    def mark(batches):
        waiting, size = [], 0
        for b in batches:
            waiting.append(Members.places(longs(b)).ravel())
            size += len(waiting[-1])
            if size >= SEND:
                yield send(waiting)
                waiting, size = [], 0
        if size:
            yield send(waiting)

    def merge(batches):
        bits, own = np.zeros(width, bool), None
        for b in batches:
            for part, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                bits[np.frombuffer(places, np.uint32) - part * width], own = True, part
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)], pa.binary())], ["part", "places"])

    shape = "part int, places binary"
    got = rows.mapInArrow(mark, shape).repartitionById(SLICES, F.col("part")).mapInArrow(merge, shape).toArrow()  # one bitmap
    none = zlib.compress(bytes(width // 8))
    slices = dict(zip(got.column("part").to_pylist(), got.column("places").to_pylist()))
    return Members([slices.get(k, none) for k in range(SLICES)])


@contextmanager
def shared(rows: DataFrame, longs: Callable[[pa.RecordBatch], np.ndarray]):
    """The bitmap as a broadcast, which is removed at the end of the block."""
    sent = rows.sparkSession.sparkContext.broadcast(members(rows, longs))
    try:
        yield sent
    finally:
        sent.destroy()


def ids_of(batch: pa.RecordBatch) -> np.ndarray:
    """All longs of a batch."""
    return np.concatenate([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]) if batch.num_columns else np.empty(0, np.int64)
