"""Checks of records against schema, registry, vocabulary and each other."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulemill.model import STATUSES

# Kinds and states of relations.
RELATION_TYPES = ["overrides", "excepts", "supersedes", "unresolved"]
RELATION_STATUSES = ["draft", "verified", "approved", "suspended", "rejected"]


def messages(*checks: tuple[Column, str | Column]) -> Column:
    """The messages of all checks that fail."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), m if isinstance(m, Column) else F.lit(m)) for bad, m in checks]))


def rule_schema_errors() -> Column:
    ref = F.col("source_ref")
    return messages(
        (~F.col("rule_id").rlike(r"^[a-z0-9][a-z0-9\-]+$"), "rule_id"),
        (F.length("text") < 10, "text"),
        (ref["document"].isNull() | ref["version"].isNull() | ref["location"].isNull(), "source_ref"),
        (F.size("scope") < 1, "scope"),
        (F.length("authority") < 1, "authority"),
        (F.col("domain").isNotNull() & ~F.col("domain").rlike(r"^[a-z][a-z0-9\-]*$"), "domain"),
        (~F.col("status").isin(STATUSES), "status"),
        ((F.col("status") == "approved") & F.col("approval").isNull(), "approval"),
        ((F.col("status") == "superseded") & F.col("superseded_by").isNull(), "superseded_by"),
        ((F.col("status") == "rejected") & F.col("rejection_reason").isNull(), "rejection_reason"),
    )


def relation_schema_errors() -> Column:
    required = ["relation_id", "type", "source_rule", "target_rule", "condition", "resolution", "authority_basis", "registered_by", "status"]
    return messages(
        *[(F.col(c).isNull(), f"{c} missing") for c in required],
        (F.coalesce(~F.col("relation_id").rlike(r"^rel-[a-z0-9][a-z0-9\-]+$"), F.lit(False)), "relation_id"),
        (F.coalesce(~F.col("type").isin(RELATION_TYPES), F.lit(False)), "type"),
        (F.coalesce(F.length("condition") < 5, F.lit(False)), "condition"),
        (F.coalesce(F.length("resolution") < 10, F.lit(False)), "resolution"),
        (F.coalesce(~F.col("status").isin(RELATION_STATUSES), F.lit(False)), "status"),
        (F.coalesce((F.col("status") == "approved") & F.col("approval").isNull(), F.lit(False)), "approval"),
        (F.coalesce((F.col("status") == "suspended") & F.col("suspension_reason").isNull(), F.lit(False)), "suspension_reason"),
    )


def source_errors(rules: DataFrame, registry: DataFrame, row_id: str) -> DataFrame:
    """(row id, error): unknown document, or else unknown version. registry: (doc_id, version)."""
    refs = rules.select(row_id, F.col("source_ref.document").alias("document"), F.col("source_ref.version").alias("version"))
    docs = registry.select(F.col("doc_id").alias("document")).distinct().withColumn("d", F.lit(1))
    versions = registry.select(F.col("doc_id").alias("document"), "version").distinct().withColumn("v", F.lit(1))
    seen = refs.join(docs, "document", "left").join(versions, ["document", "version"], "left")
    error = F.when(F.col("d").isNull(), F.concat(F.lit("unknown document: "), F.coalesce("document", F.lit("")))).when(F.col("v").isNull(), F.concat(F.lit("unknown version: "), F.coalesce("version", F.lit(""))))
    return seen.select(row_id, error.alias("error")).where("error IS NOT NULL")


def authority_errors(rules: DataFrame, levels: DataFrame, row_id: str, default_domain: str = "ra") -> DataFrame:
    """(row id, error): no domain levels, no authority, or one that is not a level of the domain. levels: (domain, level)."""
    own = rules.select(row_id, "authority", F.coalesce(F.nullif("domain", F.lit("")), F.lit(default_domain)).alias("domain"))
    domains = levels.select("domain").distinct().withColumn("d", F.lit(1))
    seen = own.join(domains, "domain", "left").join(levels.select("domain", F.col("level").alias("authority")).distinct().withColumn("l", F.lit(1)), ["domain", "authority"], "left")
    error = F.when(F.col("d").isNull(), "no authority levels").when(F.coalesce("authority", F.lit("")) == "", "authority missing").when(F.col("l").isNull(), "unknown authority")
    return seen.select(row_id, error.alias("error")).where("error IS NOT NULL")


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys on more than one row."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def checklist_errors(checklist: Column, items: list[str]) -> Column:
    """What a review checklist lacks or has other than pass and fail."""
    entries = [F.when(~F.coalesce(F.map_contains_key(checklist, F.lit(i)), F.lit(False)), F.concat(F.lit("missing "), F.lit(i))).when(~F.element_at(checklist, F.lit(i)).isin("pass", "fail"), F.concat(F.lit("value of "), F.lit(i))) for i in items]
    return F.array_compact(F.array(*entries))


def ratio_udf(autojunk: bool = True):
    """Ratcliff/Obershelp ratio of (candidate, existing); the order of the two matters."""

    @F.arrow_udf(T.DoubleType())
    def udf(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([SequenceMatcher(None, x, y, autojunk).ratio() for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    return udf


#: Buckets of characters that are counted; bits of single characters and of pairs; rows of candidates that are held, and compared, at a time; pairs that are compared again at a time; places in a word of the last comparison, steps between its looks at what is left, and pairs that it takes at a time.
BUCKETS, BITS, BLOCK, TILE, LATER, LANE, LOOK, LAST = 64, (1024, 4096), 1 << 18, 1 << 14, 1 << 16, 62, 32, 1 << 11
#: Characters from here on are syllables and signs of words; texts with fewer of them than this share are in an alphabet.
SYLLABLES, ALPHABET = 0x1100, 0.3
#: Counts modulo 8 in 4 bits and modulo 16 in 8: as many bits differ as the counts do, or fewer.
RING4, RING8 = (np.array([(1 << k) - 1 for k in range(n)] + [(1 << n) - (1 << k) for k in range(n)], np.uint8) for n in (4, 8))
_MIX, _AGAIN, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def odd_bits(row: np.ndarray, token: np.ndarray, n: int, bits: int) -> np.ndarray:
    """(n, words) whether an odd number of the tokens of a row falls on a bit; the second time a token stands in a row it falls elsewhere."""
    key = np.sort(row << np.uint64(48) | token >> np.uint64(16))
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    time = np.arange(len(key)) - np.repeat(new, np.diff(np.append(new, len(key))))
    bit = (((key << np.uint64(16)) + time.astype(np.uint64) * _AGAIN) * _LAST >> np.uint64(65 - bits.bit_length())).astype(np.int64)
    odd = np.bincount((key >> np.uint64(48)).astype(np.int64) * bits + bit, minlength=n * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, bits), axis=1).view(np.uint64)


def character_counts(texts: list[str]) -> dict:
    """Of texts: lengths, syllables, (n, BUCKETS) characters by bucket of code points, and places in what is there of texts in an alphabet only (-1: none): bits of characters and of pairs of neighbours, and the buckets in order."""
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), sizes)
    bucket = (codes * _MIX >> np.uint64(58)).astype(np.int64)
    counts = np.minimum(np.bincount(row * BUCKETS + bucket, minlength=len(texts) * BUCKETS), 127).astype(np.uint8).reshape(-1, BUCKETS)
    wide = np.bincount(row[codes >= SYLLABLES], minlength=len(texts))
    alphabet = np.flatnonzero(wide < ALPHABET * sizes)
    ends, bucket = np.cumsum(sizes), bucket.astype(np.uint8)
    at, parts = np.full(len(texts), -1), [[np.zeros((0, b // 64), np.uint64)] for b in BITS]
    at[alphabet] = np.arange(len(alphabet))
    for k in range(0, len(alphabet), 512):
        some = alphabet[k : k + 512]
        own = np.concatenate([codes[ends[i] - sizes[i] : ends[i]] for i in some])
        r = np.repeat(np.arange(len(some), dtype=np.uint64), sizes[some])
        same = r[:-1] == r[1:]
        for part, rows, tokens, bits in zip(parts, (r, r[:-1][same]), (own * _MIX, ((own[:-1] * _MIX ^ own[1:]) * _MIX)[same]), BITS):
            part.append(odd_bits(rows, tokens, len(some), bits))
    one, two = (np.concatenate(p) for p in parts)
    return {"size": sizes, "wide": wide, "counts": counts, "at": at, "one": one, "two": two, "letters": [bucket[ends[i] - sizes[i] : ends[i]] for i in alphabet]}


def ring_codes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(4, n) and (8, n) words of the counts in the two codes."""
    four = RING4[counts & 7]
    return np.ascontiguousarray((four[:, ::2] | four[:, 1::2] << 4).view(np.uint64).T), np.ascontiguousarray(RING8[counts & 15].view(np.uint64).T)


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sum of the differences of each two rows of BUCKETS counts."""
    d, low = np.abs(x.view(np.int8) - y.view(np.int8)).view(np.uint64), np.uint64(0x00FF00FF00FF00FF)
    return (((d & low) + (d >> np.uint64(8) & low)).sum(axis=1) * np.uint64(0x0001000100010001) >> np.uint64(48)).astype(np.int64)


def _profiles(batches):
    for b in batches:
        own = character_counts(b.column("text").to_pylist())
        more = [None if k < 0 else own["one"][k].tobytes() + own["two"][k].tobytes() + own["letters"][k].tobytes() for k in own["at"].tolist()]
        yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(own["size"]), pa.array(own["wide"]), pa.array([c.tobytes() for c in own["counts"]], pa.binary()), pa.array(more, pa.binary())], ["label", "size", "wide", "counts", "more"])


def _held(rows: pa.Table) -> dict:
    """What character_counts gives, and labels, codes and tiles: (first, end, alphabet, lengths from, to). Tiles are alike in alphabet and length, and rows in them sorted by syllables."""
    size, wide = rows["size"].to_numpy(), rows["wide"].to_numpy()
    alphabet = ~np.array(rows["more"].is_null())
    by = np.lexsort((size, alphabet))
    tiles, turn = [], int((~alphabet).sum())
    for first, last in ((0, turn), (turn, len(by))):
        for a in range(first, last, TILE):
            b = min(a + TILE, last)
            tiles.append((a, b, first == turn and turn < last, int(size[by[a]]), int(size[by[b - 1]])))
            by[a:b] = by[a:b][np.argsort(wide[by[a:b]], kind="stable")]
    rows = rows.take(pa.array(by))
    counts = np.frombuffer(b"".join(rows["counts"].to_pylist()), np.uint8).reshape(-1, BUCKETS)
    more, ends = rows["more"].to_pylist()[turn:], np.cumsum([0, *(b // 8 for b in BITS)])
    one, two = (np.frombuffer(b"".join(m[a:b] for m in more), np.uint64).reshape(-1, (b - a) // 8) for a, b in zip(ends[:-1], ends[1:]))
    letters = [np.frombuffer(m, np.uint8, offset=ends[-1]) for m in more]
    return {"label": rows["label"].to_numpy(), "size": size[by], "wide": wide[by], "counts": counts, "codes": ring_codes(counts), "at": np.where(alphabet[by], np.arange(len(by)) - turn, -1), "one": one, "two": two, "letters": letters, "tiles": tiles}


def have_in_common(x: list[np.ndarray], y: list[np.ndarray], which: np.ndarray, least: float) -> np.ndarray:
    """Whether x[which[k]] and y[k] have a common subsequence long enough for the ratio, by bits of the places where each letter stands.

    A letter of y can only be one of x that stands no further off than letters
    may stay over before either, so words of other places are left alone. After t
    letters of y, all but those that may stay over must have been found in as many
    letters of x and those that may stay over there.
    """
    n, m = np.array([len(t) for t in x]), np.array([len(t) for t in y])
    width, full = -(-max(int(n.max()), 1) // LANE), np.uint64((1 << LANE) - 1)
    at = np.concatenate([np.arange(k) for k in n])
    places = np.zeros((width, len(x) * (BUCKETS + 1)), np.uint64)
    np.add.at(places, (at // LANE, np.repeat(np.arange(len(x)), n) * (BUCKETS + 1) + np.concatenate(x)), np.uint64(1) << (at % LANE).astype(np.uint64))
    order = np.full((max(int(m.max()), 1), len(y)), BUCKETS, np.int64)
    order[np.concatenate([np.arange(k) for k in m]), np.repeat(np.arange(len(y)), m)] = np.concatenate(y)
    order += which * (BUCKETS + 1)
    n, alive = n[which], np.arange(len(y))
    need = least * (n + m) / 2 - 1e-6
    first = lambda k: (np.uint64(1) << np.clip(k - np.arange(width)[:, None] * LANE, 0, LANE).astype(np.uint64)) - np.uint64(1)
    left, over_x, over_y = list(first(n)), (n - need).max(), (m - need).max()
    for t in range(len(order)):
        carry, row = np.uint64(0), order[t]
        for w in range(max(0, int(t - over_y) // LANE), min(width, int(t + over_x) // LANE + 1)):
            met = left[w] & places[w][row]
            total = left[w] + met + carry
            carry = total >> np.uint64(LANE)
            left[w] = (total & full) | (left[w] ^ met)
        if (t + 1) % LOOK == 0 or t + 1 == len(order):
            most = np.minimum(np.floor(t + 1 + n - need), n).astype(np.int64)
            found = most - np.bitwise_count(np.array(left) & first(most)).sum(axis=0, dtype=np.int64)
            good = found >= np.minimum(t + 1, m) - (m - need)
            alive, n, m, need, order, left = alive[good], n[good], m[good], need[good], order[:, good], [w[good] for w in left]
            if not len(alive):
                break
            over_x, over_y = (n - need).max(), (m - need).max()
    out = np.zeros(len(y), bool)
    out[alive] = True
    return out


def _near(held: dict, texts: list[str], least: float):
    """(places in held, places in texts) of pairs within all bounds, in portions."""
    theirs = character_counts(texts)
    sizes, o_sizes, (words, fine) = held["size"], theirs["size"], held["codes"]
    o_words, o_fine = (np.ascontiguousarray(c.T) for c in ring_codes(theirs["counts"]))
    low, high = o_sizes * least / (2 - least) - 1e-6, o_sizes * (2 - least) / least + 1e-6
    x, one, total = np.empty(TILE, np.uint64), np.empty(TILE, np.uint8), np.empty(TILE, np.uint8)
    found, n, waiting = [], 0, []

    def first_look(code, other, a, b, most):
        k = b - a
        np.bitwise_xor(code[0, a:b], other[0], out=x[:k])
        np.bitwise_count(x[:k], out=total[:k])
        for w in range(1, len(code) - 1):
            np.bitwise_xor(code[w, a:b], other[w], out=x[:k])
            np.bitwise_count(x[:k], out=one[:k])
            np.add(total[:k], one[:k], out=total[:k])
        near = np.flatnonzero(total[:k] <= most)
        return near[total[near] + np.bitwise_count(code[-1, a + near] ^ other[-1]).astype(np.int64) <= most] + a

    def closer(i, j):
        most = (1 - least) * (sizes[i] + o_sizes[j]) + 1e-6
        near = apart(held["counts"][i], theirs["counts"][j]) <= most
        i, j, most = i[near], j[near], most[near]
        both = (held["at"][i] >= 0) & (theirs["at"][j] >= 0)
        rest, i, j, most = (i[~both], j[~both]), i[both], j[both], most[both]
        for bits, times in (("one", 1), ("two", 3)):
            differ = held[bits][held["at"][i]] ^ theirs[bits][theirs["at"][j]]
            near = np.bitwise_count(differ).sum(axis=1, dtype=np.int32) <= times * most
            i, j, most = i[near], j[near], most[near]
        waiting.append((i, j))
        return rest

    for a, b, alphabet, least_size, most_size in held["tiles"]:
        wide = held["wide"][a:b]
        js = np.flatnonzero((low <= most_size) & (high >= least_size))
        top = np.minimum(most_size, high[js])
        most = (1 - least) * (top + o_sizes[js]) + 1e-6
        begin = a + np.searchsorted(wide, theirs["wide"][js] + (np.maximum(least_size, low[js]) - o_sizes[js] - most) / 2 - 1e-6)
        end = a + np.searchsorted(wide, theirs["wide"][js] + (top - o_sizes[js] + most) / 2 + 1e-6, "right")
        some = np.flatnonzero(begin < end)
        for j, p, q, most_j in zip(js[some].tolist(), begin[some].tolist(), end[some].tolist(), np.minimum(most[some], 254).astype(int).tolist()):
            if alphabet and theirs["at"][j] >= 0:
                near = first_look(fine, o_fine[j], p, q, most_j if most_j < 254 else 512)
            else:
                near = first_look(words, o_words[j], p, q, most_j if most_j < 254 else 512)
            if len(near):
                found.append((near, np.full(len(near), j)))
                n += len(near)
            if n >= LATER:
                yield closer(*map(np.concatenate, zip(*found)))
                found, n = [], 0
    if found:
        yield closer(*map(np.concatenate, zip(*found)))
    if waiting:
        i, j = map(np.concatenate, zip(*waiting))
        by = np.argsort(sizes[i], kind="stable")
        for k in range(0, len(by), LAST):
            i_k, j_k = i[by[k : k + LAST]], j[by[k : k + LAST]]
            own, which = np.unique(i_k, return_inverse=True)
            good = have_in_common([held["letters"][u] for u in held["at"][own].tolist()], [theirs["letters"][u] for u in theirs["at"][j_k].tolist()], which, least)
            yield i_k[good], j_k[good]


def duplicate_candidates(candidates: DataFrame, existing: DataFrame, least: float = 0.9) -> DataFrame:
    """Pairs (label, o_label) of (label, text) that may reach the ratio; none that does is left out.

    A ratio is at most 2 m / (a + b) for m common characters in blocks. So the
    lengths lie within a factor, and counts of characters by bucket differ by no
    more than u = (1 - ratio) (a + b) in all; codes of the counts in four or
    eight bits are compared first, then the counts. In an alphabet counts of
    letters are much alike. There are u + 1 blocks at most, so pairs of
    neighbouring characters differ by no more than 3 u, and the texts have a
    common subsequence of the length; this is looked at for what is left there.
    Candidates are a query set: what is compared of them is held in blocks of a
    fixed size, and existing texts pass by once a block.
    """
    spark, out = candidates.sparkSession, None
    blocks = -(-candidates.count() // BLOCK)
    for k in range(blocks):
        part = candidates.where(F.pmod("label", F.lit(blocks)) == k) if blocks > 1 else candidates
        held = spark.sparkContext.broadcast(_held(part.mapInArrow(_profiles, "label long, size long, wide long, counts binary, more binary").toArrow()))

        def run(batches, held=held):
            for b in batches:
                labels = b.column("label").to_numpy()
                for i, j in _near(held.value, b.column("text").to_pylist(), least):
                    yield pa.RecordBatch.from_arrays([pa.array(held.value["label"][i]), pa.array(labels[j])], ["label", "o_label"])

        met = existing.mapInArrow(run, "label long, o_label long")
        out = met if out is None else out.union(met)
    return out if out is not None else candidates.where("false").select("label", F.col("label").alias("o_label"))


def _ratios(least: float):
    def run(batches):
        for b in batches:
            ratios = np.array([SequenceMatcher(None, x, y).ratio() for x, y in zip(b.column("text").to_pylist(), b.column("o_text").to_pylist(), strict=True)], np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ratios)], [*b.schema.names, "ratio"]).filter(pa.array(ratios >= least))

    return run


def duplicates(candidates: DataFrame, existing: DataFrame, row_id: str, text: str = "text", least: float = 0.9) -> DataFrame:
    """(row id, o_row id, ratio) of pairs of other rule_ids that reach the ratio.

    Each two different texts are compared once, however many rows hold them. A
    label is a hash of a text; texts themselves are compared where rows are joined.
    """
    label = lambda c: F.xxhash64(c)
    own = candidates.where(F.col(text).isNotNull()).select(F.col(row_id).cast("long").alias("id"), "rule_id", label(text).alias("label"), F.col(text).alias("text"))
    have = existing.where(F.col(text).isNotNull()).select(F.col(row_id).cast("long").alias("o_id"), F.col("rule_id").alias("o_rule_id"), label(text).alias("o_label"), F.col(text).alias("o_text"))
    spark = own.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts, o_texts = (t.repartition(parts, "label").dropDuplicates(["label", "text"]) for t in (own.select("label", "text"), have.select(F.col("o_label").alias("label"), F.col("o_text").alias("text"))))
    met = duplicate_candidates(texts, o_texts, least).distinct()
    full = met.join(texts, "label").join(o_texts.select(F.col("label").alias("o_label"), F.col("text").alias("o_text")), "o_label").select("label", "text", "o_label", "o_text")
    alike = full.mapInArrow(_ratios(least), "label long, text string, o_label long, o_text string, ratio double")
    rows = alike.join(own, ["label", "text"]).join(have, ["o_label", "o_text"]).where(F.col("rule_id") != F.col("o_rule_id"))
    return rows.select(F.col("id").alias(row_id), F.col("o_id").alias(f"o_{row_id}"), F.round("ratio", 6).alias("ratio"))


def fidelity(rows: DataFrame, row_id: str, text: str, source: str, least: float = 0.95) -> DataFrame:
    """(row id, ratio, faithful): the text against the window of its source that begins where its first 50 characters stand."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    own = rows.select(row_id, flat(F.col(text)).alias("t"), flat(F.col(source)).alias("s"))
    at = F.expr("locate(substring(t, 1, 50), s)")
    met = own.withColumn("at", at).where("at > 0 AND length(t) > 0").withColumn("w", F.expr("substring(s, at, cast(length(t) * 1.2 AS int))"))
    return met.select(row_id, F.round(ratio_udf()("t", "w"), 6).alias("ratio")).withColumn("faithful", F.col("ratio") >= least)
