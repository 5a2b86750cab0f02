"""Groups of records that are largely the same (problem 3): a multi-index Hamming join.

Each text gets a b-bit signature: CHUNKS x SYMBOLS minwise hashes of its
shingles (one permutation, cut into bins; an empty bin takes over from the next
full one), BITS_EACH bits of each. If two signatures differ in no more than
(ERRORS + 1) x CHUNKS - 1 symbols then, by the pigeonhole principle, at least
one chunk differs in no more than ERRORS symbols. All ways to allow for ERRORS
errors in a chunk are enumerated as keys (the chunk with those symbols
blanked), so every pair within that signature distance - 27 of 84 symbols with
the defaults - shares a key. Beyond it keys are still shared by chance: a pair
at similarity exactly 0.7 is missed once in some 2,200 times, at 0.75 once in
47,000, at 0.8 less than once in a million.

What shares a key must also agree in the parity bits of its symbols but for
NEAR of 64, which a pair at 0.7 fails to do less than once in 50,000 times, and
is then verified on the texts themselves. Keys are exchanged as packed arrays,
some chunks at a time. Within a key not all pairs are formed: the first members
are compared with all others; of keys with more members, what is linked becomes
one component, and only pairs of different components are compared, with twice
as many centres each time, until no key holds two components that have not met.
A hot key of near-copies thus costs a few comparisons a member, and no link
between different components is lost.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulemill.llm.codepoints import decode, encode, form, letters, letters_array, row_bounds
from rulemill.llm.buckets import CENTRES, RANGE_KEYS, ids_of, meetings, packed, shared
from rulemill.llm.shingles import LEAST, SKETCH, WIDTH, distinct_runs, may_be_similar, mix, parity_sketch, similar, small_batches
from rulemill.operators.components import connected_components
from rulemill.session import cut, discard, spread

CHUNKS, SYMBOLS, ERRORS, BITS_EACH = 14, 6, 1, 8
#: Chunks joined at once.
AT_ONCE = 4
#: Of 64 symbols of two similar signatures, how many may differ in their lowest bit.
NEAR = 22


def signatures(hashes: np.ndarray, rows: np.ndarray, n: int, count: int) -> np.ndarray:
    """(n, count) uint8 from distinct 53-bit hashes sorted by row and hash: bins are ranges of the hash, so the first of a bin is its least."""
    bins = rows * count + ((hashes * np.uint64(count)) >> np.uint64(53)).astype(np.int64)
    first = np.concatenate([[True], bins[1:] != bins[:-1]]) if len(bins) else np.empty(0, bool)
    symbols, full = np.zeros(n * count, np.uint64), np.zeros(n * count, bool)
    symbols[bins[first]], full[bins[first]] = mix(hashes[first]), True
    symbols, full = symbols.reshape(n, count), full.reshape(n, count)
    step = 0
    while not full.all() and step < count:
        step += 1
        take = ~full & np.roll(full, -1, axis=1)
        # Each bin passed on the way changes the symbol, so that copies in a row stay independent of their place.
        symbols[take] = mix(np.roll(symbols, -1, axis=1)[take] + np.uint64(0x9E3779B97F4A7C15))
        full = full | take
    return (symbols & np.uint64((1 << BITS_EACH) - 1)).astype(np.uint8)


def error_keys(symbols: np.ndarray, chunks: range, size: int, errors: int) -> np.ndarray:
    """(n, len(chunks) * C(size, errors)) uint64: of each chunk one key for each choice of symbols that may be wrong."""
    keys = []
    for c in chunks:
        part = symbols[:, c * size : (c + 1) * size].astype(np.uint64)
        for k, gone in enumerate(combinations(range(size), errors)):
            packed = np.full(len(part), c * 1009 + k + 1, np.uint64)
            for i in set(range(size)) - set(gone):
                packed = packed << np.uint64(BITS_EACH) | part[:, i]
            keys.append(mix(packed ^ np.uint64((c * 1009 + k + 1) << 44)))
    return np.stack(keys, axis=1)


PROFILE = ["n", *SKETCH, "sig"]
PROFILE_TYPES = f"n int, {', '.join(f'{c} long' for c in SKETCH)}, sig binary"


def fingerprints(rows: DataFrame, row_id: str, text: str, keep_letters: bool = False, least: int = LEAST, count: int = CHUNKS * SYMBOLS) -> DataFrame:
    """(id, d0, d1, n, sketch, sig, letters) of texts with enough letters; d0 and d1 are a 128-bit digest of the letters, which come out on demand.

    Null ids and texts are left out.
    """
    kept = spread(rows.where(F.col(row_id).isNotNull() & F.col(text).isNotNull()).select(F.col(row_id).cast("long").alias("id"), F.col(text).alias("text")))

    def run(batches):
        for b in small_batches(batches):
            codes = letters(form(decode(b.column(1))))
            starts, sizes = row_bounds(codes)
            long = sizes >= least
            codes = codes[np.repeat(long, sizes + 1)]
            ids, n = b.column(0).to_numpy(zero_copy_only=False)[long], int(long.sum())
            starts, sizes = row_bounds(codes)
            digests = []
            place = np.arange(len(codes)) - np.repeat(starts, sizes + 1)
            for salt in (1, 2):  # sums over the letters of a mix of letter and place
                mixed = mix(codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(salt << 40))
                digests.append(np.add.reduceat(mixed, starts).view(np.int64) if n else np.empty(0, np.int64))
            hashes, own = distinct_runs(codes, WIDTH)
            sketch = parity_sketch(hashes, own, n)
            sig = signatures(hashes, own, n, count)
            sizes = np.bincount(own, minlength=n).astype(np.int32)
            columns = [pa.array(ids), *map(pa.array, digests), pa.array(sizes), *[pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(len(SKETCH))]]
            columns.append(pa.FixedSizeBinaryArray.from_buffers(pa.binary(count), n, [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary()))
            names = ["id", "d0", "d1", *PROFILE]
            if keep_letters:
                columns.append(encode(codes).cast(pa.string()))
                names.append("letters")
            yield pa.RecordBatch.from_arrays(columns, names)

    return kept.mapInArrow(run, f"id long, d0 long, d1 long, {PROFILE_TYPES}" + ", letters string" * keep_letters)


def representatives(prints: DataFrame, *more: str) -> DataFrame:
    """(rep, d0, d1, profile, copies): of rows with the same letters the one with the smallest id."""
    best = prints.groupBy("d0", "d1").agg(F.min_by(F.struct("id", *PROFILE, *more), "id").alias("p"), F.count("*").alias("copies"))
    return best.select(F.col("p.id").alias("rep"), "d0", "d1", *[f"p.{c}" for c in (*PROFILE, *more)], "copies")


def signatures_of(batch: pa.RecordBatch, column: str = "sig") -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), np.uint8).reshape(len(batch), -1)


def marks_of(sig: np.ndarray) -> np.ndarray:
    """The lowest bits of 64 symbols in one word."""
    return np.packbits(sig[:, :64] & 1, axis=1, bitorder="little").view(np.uint64).ravel()


def keys_of(chunks: range):
    """Keys, marks and reps of a batch (rep, sig)."""

    def run(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sig = signatures_of(batch)
        keys = error_keys(sig, chunks, SYMBOLS, ERRORS)
        wide = lambda x: np.repeat(x, keys.shape[1])
        return keys.ravel(), wide(marks_of(sig)), wide(batch.column("rep").to_numpy())

    return run


def letters_where(texts: DataFrame, ids: DataFrame, text: str = "text") -> DataFrame:
    """A table (id, letters) of the rows of ``texts`` (id, text) whose id is in ``ids``, and a few more. Texts are filtered where they are read and not shuffled.

    With text 'letters' they are letters already.
    """
    with shared(ids, ids_of) as wanted:

        def run(batches):
            for b in small_batches(batches):
                kept = b.filter(pa.array(wanted.value.may_have(b.column(0).to_numpy(zero_copy_only=False))))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1).cast(pa.string()) if text == "letters" else letters_array(kept.column(1)).cast(pa.string())], ["id", "letters"])

        return cut(texts.select("id", text).mapInArrow(run, "id long, letters string"))


def plausible(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Of distinct (a, b) those that sizes and sketches of a in ``left`` and b in ``right`` allow."""
    small = ["rep", "n", *SKETCH]
    met = pairs.alias("p").join(left.select(*small).alias("x"), F.expr("p.a = x.rep")).join(right.select(*small).alias("y"), F.expr("p.b = y.rep"))
    return met.where(may_be_similar("x", "y", threshold)).select("a", "b")


def truly_similar(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Of (a, b) those whose letters in ``left`` and ``right`` (id, letters) are similar."""
    full = pairs.join(left.select(F.col("id").alias("a"), F.col("letters").alias("la")), "a").join(right.select(F.col("id").alias("b"), F.col("letters").alias("lb")), "b")
    return full.where(similar(threshold)(F.col("la"), F.col("lb"))).select("a", "b")


def verified_pairs(pairs: DataFrame, reps: DataFrame, texts: DataFrame, threshold: float, text: str = "text") -> DataFrame:
    """Of (a, b), repeated or not, those truly similar, once each. Pairs meet the sketches first; texts (id, text) are read for what is left."""
    near = cut(plausible(pairs.distinct(), reps, reps, threshold))
    wanted = letters_where(texts, near, text)
    out = cut(truly_similar(near, wanted, wanted, threshold))
    discard(near, wanted)
    return out


def key_meetings(reps: DataFrame) -> DataFrame:
    """(key, a, b) as ``buckets.meetings`` has them, over all chunks; pairs may be repeated."""
    many = reps.count() * CHUNKS * SYMBOLS
    met = None
    for c in range(0, CHUNKS, AT_ONCE):
        chunks = range(c, min(c + AT_ONCE, CHUNKS))
        ranges = max(int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-many * len(chunks) // CHUNKS // RANGE_KEYS))
        part = cut(meetings(packed(spread(reps).select("rep", "sig"), keys_of(chunks), ranges), ranges, NEAR))
        met = part if met is None else met.union(part)
    return met


def similar_edges(reps: DataFrame, texts: DataFrame, threshold: float, text: str = "text", every: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Verified links (a, b) among reps that join all that is similar, and the components (node, component) they make.

    With ``every`` the links are all similar pairs that share a key, and no components are made.
    """
    met = key_meetings(reps)
    edges = verified_pairs(met.where("key IS NULL").select("a", "b"), reps, texts, threshold, text)
    parts = None if every else connected_components(edges)
    rest = met.where("key IS NOT NULL").select("key", F.col("a").alias("rep"), F.col("b").alias("place"))
    first, width = CENTRES, CENTRES
    while True:
        if every:
            rest = rest.withColumn("part", F.col("rep"))
        else:
            rest = rest.drop("part").join(parts, rest.rep == parts.node, "left").select("key", "rep", "place", F.coalesce("component", "rep").alias("part"))
        # Keys with centres yet to come, and with more than one component among their members.
        open_ = rest.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y"), F.max("place").alias("z")).where((F.col("x") < F.col("y")) & (F.col("z") > first)).select("key")
        rest = cut(rest.join(open_, "key", "left_semi"))
        if not rest.head(1):
            return edges, parts
        centres = rest.where(F.col("place").between(first, first + width - 1))
        new = rest.alias("x").join(centres.alias("c"), F.expr("x.key = c.key AND x.place > c.place AND x.part <> c.part")).select(F.least("x.rep", "c.rep").alias("a"), F.greatest("x.rep", "c.rep").alias("b"))
        new = verified_pairs(new, reps, texts, threshold, text)
        if new.head(1):
            edges = edges.union(new)
            parts = None if every else connected_components(edges)
        first, width = first + width, width * 2


def near_duplicate_groups(rows: DataFrame, row_id: str, text: str, threshold: float = 0.7) -> DataFrame:
    """(group_no, unit_no): members of groups of two or more joined by similarity of at least ``threshold``.

    group_no is the smallest id of the group. Rows with the same letters are
    collapsed first and come back as members. Texts with fewer than LEAST
    letters, null texts and null ids are in no group; an empty table has none.
    Only ids, digests and signatures are shuffled; texts are read again for
    candidates.
    """
    base = cut(fingerprints(rows, row_id, text))
    reps = cut(representatives(base))
    copies = cut(base.select("id", "d0", "d1"))
    discard(base)
    texts = rows.where(F.col(row_id).isNotNull() & F.col(text).isNotNull()).select(F.col(row_id).cast("long").alias("id"), F.col(text).alias("text"))
    _, parts = similar_edges(reps, texts, threshold)
    grouped = reps.join(parts, reps.rep == parts.node, "left").where("component IS NOT NULL OR copies > 1").select("d0", "d1", F.coalesce("component", "rep").alias("group_no"))
    return copies.join(grouped, ["d0", "d1"]).select("group_no", F.col("id").alias("unit_no")).distinct()
