"""Holding new batches against all history (problem 2): a pivot-distance table.

The metric is the number of shingles by which two sets differ,
D(x, y) = |x - y| + |y - x|; a similarity of t means D <= (1-t)/(1+t) (|x|+|y|).
The table holds, once for each distinct accepted text, its distances to fixed
pivots, none of which depends on the data:

* the empty set: its distance is the size. By the triangle inequality a partner
  lies in a range of it; the table is stored in folders by such ranges, and a
  batch reads those next to its own sizes only;
* 512 disjoint buckets of all shingles: D(x, bucket) is kept modulo 2, in eight
  words; the number of words' bits that differ is a lower bound of D(x, y);
* the heads of 84 fixed orders of the shingles: the distance is the rank of the
  first shingle that is in x, kept modulo 256. Sets of similarity t are at the
  same distance from such a pivot with probability t.

Range and buckets prune without loss. They leave too many pairs to visit, and
so would whole texts or rare single shingles as pivots: unrelated units lie 0.85
to 1 apart, and of 24,000 history texts some 2,400 share more than one shingle
in twenty with a draft. So a draft visits only what has the same distances to
five of six pivots in one of fourteen groups - the keys that the near-duplicate
join uses, with its chance of a miss - and what is left is verified on the
distance itself.

The history lies in one folder: ``pivots`` (the table), ``texts`` (letters,
read for candidates only), ``ids`` and ``about``. ``accept_all`` makes it,
``History.load`` opens it in another session, and accepted drafts are appended
as further files: no text of the history is shingled again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulemill.llm.buckets import ids_of, shared
from rulemill.llm.near_duplicates import CHUNKS, NEAR, PROFILE, PROFILE_TYPES, fingerprints, keys_of, letters_where, plausible, representatives, similar_edges, truly_similar
from rulemill.llm.shingles import small_batches
from rulemill.llm.uniform import uniform_text
from rulemill.session import cut, discard, shared_dir, spread

#: Rows of a key, smallest first, that a draft is compared with at first, and how many times more in each round after.
FRONT, MORE = 16, 16
KEYS = keys_of(range(CHUNKS))


@dataclass(frozen=True)
class History:
    """Accepted texts and ids, stored in the folder ``path``."""

    spark: SparkSession
    path: str
    threshold: float

    def _table(self, name: str, shape: str) -> DataFrame:
        return self.spark.read.schema(shape).parquet(f"{self.path}/{name}")

    @property
    def texts(self) -> DataFrame:
        return self._table("texts", "id long, letters string")

    @property
    def pivots(self) -> DataFrame:
        return self._table("pivots", f"rep long, {PROFILE_TYPES}, size_range int")

    @property
    def ids(self) -> DataFrame:
        return self._table("ids", "id_key string, kept_no long")

    def near(self, batch: DataFrame) -> DataFrame:
        """The ranges of the table in which partners of the rows of ``batch`` (n) can lie."""
        own = [r[0] for r in batch.select(size_range(F.col("n"), self.threshold)).distinct().collect()]  # as many as a text's length has steps
        return self.pivots.where(F.col("size_range").isin(sorted({r + k for r in own for k in (-1, 0, 1)})))

    @staticmethod
    def load(spark: SparkSession, path: str) -> History:
        return History(spark, path, spark.read.schema("threshold double").parquet(f"{path}/about").first()[0])

    def append(self, texts: DataFrame, pivots: DataFrame, ids: DataFrame) -> None:
        """Adds files: texts (id, letters), pivots (rep, profile) of distinct letters, ids (id_key, kept_no)."""
        cut(texts.select("id", "letters"), f"{self.path}/texts")
        cut(pivots.select("rep", *PROFILE, size_range(F.col("n"), self.threshold).alias("size_range")), f"{self.path}/pivots", ["size_range"])
        cut(ids.select("id_key", "kept_no"), f"{self.path}/ids")


def size_range(n: Column, threshold: float) -> Column:
    """Ranges of the distance to the empty set, of ratio 1 / threshold: partners lie in the same or a neighbouring one."""
    return F.floor(F.log(n) / F.log(F.lit(1 / threshold))).cast("int")


def _keys_in(rows: DataFrame, wanted) -> DataFrame:
    """(key, rep, n, mark) of rows (rep, n, sig), for the keys that the broadcast bitmap may have."""

    def run(batches):
        for b in small_batches(batches):
            key, mark, rep = KEYS(b)
            hit = wanted.value.may_have(key)
            n = np.repeat(b.column("n").to_numpy(), len(key) // max(len(b), 1))
            columns = [key.view(np.int64), rep, n, mark.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c[hit]) for c in columns], ["key", "rep", "n", "mark"])

    return rows.select("rep", "n", "sig").mapInArrow(run, "key long, rep long, n int, mark long")


def smallest_similar(batch: DataFrame, batch_texts: DataFrame, table: DataFrame, table_texts: DataFrame, threshold: float, front: int = FRONT) -> DataFrame:
    """(a, b): for each rep of ``batch`` the smallest similar rep of ``table``; both are profiles, with letters by id beside them.

    Only keys of the batch leave the table, by a bitmap of fixed size. Of the
    table's rows with one key the ``front`` smallest are visited at first
    (ranked before the shuffle too, so a hot key sends few); a row of the batch
    goes on to more of them only while its best partner could be beaten by one
    not visited yet. No pair within a hot group is formed beyond that.
    """
    t, found, open_ = threshold, None, batch
    rank = F.row_number().over(Window.partitionBy("key").orderBy("rep"))
    fits = F.expr(f"bit_count(x.mark ^ y.mark) <= {NEAR} AND least(x.n, y.n) >= {t - 1e-9} * greatest(x.n, y.n)")
    while True:
        with shared(spread(open_).select("rep", "sig"), lambda b: KEYS(b)[0].view(np.int64)) as asked:
            ranked = cut(_keys_in(table, asked).withColumn("place", rank).where(F.col("place") <= front + 1))
        with shared(ranked.select("key"), ids_of) as there:
            met = _keys_in(spread(open_), there).alias("x").join(ranked.alias("y"), "key").where(fits | (F.col("place") > front))
            met = cut(met.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), (F.col("place") > front).alias("beyond")).distinct())
        near = cut(plausible(met.where("NOT beyond").select("a", "b"), open_, table, t))
        left, right = (letters_where(x, near.select(c), "letters") for x, c in ((batch_texts, "a"), (table_texts, "b")))
        best = cut(truly_similar(near, left, right, t).groupBy("a").agg(F.min("b").alias("b")))
        found = best if found is None else found.union(best)
        unseen = met.where("beyond").groupBy("a").agg(F.min("b").alias("next")).join(best, "a", "left").where("b IS NULL OR next < b").select("a")
        open_ = cut(open_.join(unseen, open_.rep == unseen.a, "left_semi"))
        discard(ranked, met, near, left, right)
        if not open_.head(1):
            return found.groupBy("a").agg(F.min("b").alias("b"))
        front *= MORE


def id_key(rule_id: Column, version: Column) -> Column:
    """Plain id and version in one; null where either is null or the id blank, and then it matches nothing."""
    plain = F.lower(F.trim(uniform_text(rule_id)))
    return F.when(F.length(plain) > 0, F.concat(plain, F.lit("\n"), version))


def accept_all(units: DataFrame, threshold: float, path: str | None = None) -> History:
    """A new history of ``units`` (unit_no, rule_id, version, text), all accepted, in the folder ``path``. Of equal texts or ids the smallest unit_no stands."""
    spark = units.sparkSession
    path = path or f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    out = History(spark, path, threshold)
    spark.range(1).select(F.lit(threshold).alias("threshold")).coalesce(1).write.parquet(f"{path}/about")
    prints = cut(fingerprints(units, "unit_no", "text", keep_letters=True), f"{path}/texts")
    keys = units.where(F.col("unit_no").isNotNull()).select(id_key(F.col("rule_id"), F.col("version")).alias("id_key"), F.col("unit_no").alias("kept_no"))
    pivots = representatives(prints)
    cut(pivots.select("rep", *PROFILE, size_range(F.col("n"), threshold).alias("size_range")), f"{path}/pivots", ["size_range"])
    cut(keys.where(F.col("id_key").isNotNull()).groupBy("id_key").agg(F.min("kept_no").alias("kept_no")), f"{path}/ids")
    return out


def hold_batches(history: History, drafts: DataFrame) -> DataFrame:
    """Take in drafts (unit_no, batch_no, rule_id, version, text) by batch_no, then unit_no.

    Returns (kept_no, unit_no) of those that repeat an accepted unit - by id
    and version or by text - with the smallest such unit_no; the others are
    appended to the history. unit_no of drafts must be larger than any in the
    history. Drafts without unit_no or batch_no are not taken. Null texts,
    texts below the least length, null ids and null versions match nothing.

    All batches are decided together: first against the history, then, among
    those without a partner there, in rounds. A draft is accepted once no
    undecided earlier draft could be repeated by it, and all that repeat an
    accepted one leave; rounds are as many as the longest chain of repeats.
    """
    t = history.threshold
    rows = drafts.where(F.col("unit_no").isNotNull() & F.col("batch_no").isNotNull())
    prints = cut(fingerprints(rows, "unit_no", "text", keep_letters=True))
    letters = prints.select("id", "letters")
    reps = cut(representatives(prints))
    rep_of = prints.select("id", "d0", "d1").join(reps.select("d0", "d1", "rep"), ["d0", "d1"]).select(F.col("id").alias("unit_no"), "rep")
    keyed = rows.select("unit_no", F.struct("batch_no", "unit_no").alias("turn"), id_key(F.col("rule_id"), F.col("version")).alias("id_key"))
    by_text = smallest_similar(reps, letters, history.near(reps), history.texts, t)
    held = keyed.join(rep_of, "unit_no", "left").join(by_text, F.col("rep") == F.col("a"), "left").join(history.ids.groupBy("id_key").agg(F.min("kept_no").alias("by_id")), "id_key", "left")
    held = cut(held.select("unit_no", "turn", "id_key", "rep", F.least("b", "by_id").alias("kept_no")))
    old = held.where("kept_no IS NOT NULL").select("kept_no", "unit_no")
    new, accepted = decide(held.where("kept_no IS NULL").drop("kept_no"), reps, letters, t)
    texts = accepted.where("rep IS NOT NULL").groupBy("rep").agg(F.min("unit_no").alias("u"))
    history.append(
        texts.join(letters, texts.rep == letters.id).select(F.col("u").alias("id"), "letters"),
        texts.join(reps, "rep").select(F.col("u").alias("rep"), *PROFILE),
        accepted.where("id_key IS NOT NULL").select("id_key", F.col("unit_no").alias("kept_no")),
    )
    return old.union(new)


def decide(rest: DataFrame, reps: DataFrame, letters: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Of drafts (unit_no, turn, id_key, rep) without a partner in the history: repeats (kept_no, unit_no) and accepted rows.

    Drafts meet through their id and through their text, each kept once, so a
    group of copies costs a row each and not a pair each.
    """
    there = cut(reps.join(rest.select("rep").distinct(), "rep", "left_semi"))
    links, _ = similar_edges(there, letters, threshold, "letters", every=True)
    links = cut(links.union(links.select("b", "a")).distinct())
    near = links.union(rest.where("rep IS NOT NULL").select(F.col("rep").alias("a"), F.col("rep").alias("b")).distinct())
    busy = lambda c: rest.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).where("n > 1").select(c)
    linked = rest.join(busy("id_key"), "id_key", "left_semi").union(rest.join(busy("rep").union(links.select("a")), "rep", "left_semi").select("id_key", "unit_no", "turn", "rep")).distinct()
    linked = cut(linked.select("unit_no", "turn", "id_key", "rep"))
    accepted = cut(rest.join(linked, "unit_no", "left_anti"))
    winners_all = None
    open_ = linked
    while open_.head(1):
        by_id = open_.where("id_key IS NOT NULL").groupBy("id_key").agg(F.min("turn").alias("first_id"))
        by_rep = open_.where("rep IS NOT NULL").groupBy("rep").agg(F.min("turn").alias("turn"))
        by_near = near.join(by_rep, near.b == by_rep.rep).groupBy("a").agg(F.min("turn").alias("first_near"))
        ranked = open_.join(by_id, "id_key", "left").join(by_near, F.col("rep") == F.col("a"), "left")
        first = (F.col("id_key").isNull() | (F.col("turn") == F.col("first_id"))) & (F.col("rep").isNull() | (F.col("turn") == F.col("first_near")))
        winners = cut(ranked.where(first).select("unit_no", "turn", "id_key", "rep"))
        taken_ids = winners.where("id_key IS NOT NULL").select("id_key").distinct()
        taken_reps = near.join(winners.where("rep IS NOT NULL").select(F.col("rep").alias("b")).distinct(), "b").select(F.col("a").alias("rep")).distinct()
        open_ = cut(open_.join(taken_ids, "id_key", "left_anti").join(taken_reps, "rep", "left_anti").select("unit_no", "turn", "id_key", "rep"))
        winners_all = winners if winners_all is None else winners_all.union(winners)
    if winners_all is None:
        return rest.where("false").select(F.col("unit_no").alias("kept_no"), "unit_no"), accepted
    losers = linked.join(winners_all, "unit_no", "left_anti")
    won = winners_all.select(F.col("unit_no").alias("kept_no"), F.col("turn").alias("kept_turn"), F.col("id_key").alias("kept_id"), F.col("rep").alias("kept_rep"))
    through_id = losers.join(won, F.expr("id_key = kept_id AND kept_turn < turn"))
    through_text = losers.join(near, F.expr("rep = a")).join(won, F.expr("b = kept_rep AND kept_turn < turn"))
    repeats = through_id.select("unit_no", "kept_no").union(through_text.select("unit_no", "kept_no")).groupBy("unit_no").agg(F.min("kept_no").alias("kept_no"))
    return cut(repeats.select("kept_no", "unit_no")), accepted.unionByName(winners_all)


def draft_cases(units: DataFrame, drafts: DataFrame, threshold: float = 0.7) -> DataFrame:
    """p2: (kept_no, unit_no)."""
    shape = lambda df, *more: df.select("unit_no", *more, "rule_id", F.col("source_ref.version").alias("version"), "text")
    return hold_batches(accept_all(shape(units), threshold), shape(drafts, "batch_no"))
