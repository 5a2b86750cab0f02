"""Visually identical text with different characters (problem 1)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulemill.llm.codepoints import letters_array, look_array
from rulemill.session import cut, spread


@F.arrow_udf(T.StringType())
def uniform_text(column: pa.Array) -> pa.Array:
    """The one written form of each text; null stays null, an empty text stays empty."""
    return look_array(column).cast(pa.string())


@F.arrow_udf(T.StringType())
def letters_of(column: pa.Array) -> pa.Array:
    """Letters and digits of the written form in lower case; null stays null."""
    return letters_array(column).cast(pa.string())


@F.arrow_udf(T.ArrayType(T.StringType()))
def uniform_items(column: pa.Array) -> pa.Array:
    """The written form of every item of a string array; null arrays and null items stay null."""
    forms = look_array(column.values).cast(pa.string())
    return pa.ListArray.from_arrays(column.offsets, forms, mask=column.is_null())


def uniform(df: DataFrame, texts: list[str] = (), items: list[str] = ()) -> DataFrame:
    """``df`` with the named string and array columns in written form; all other columns as they are."""
    done = {c: uniform_text(F.col(f"`{c}`")) for c in texts} | {c: uniform_items(F.col(f"`{c}`")) for c in items}
    return df.withColumns(done) if done else df


def key(text: Column) -> Column:
    """A short stand-in for a whole text in joins."""
    return F.unhex(F.sha2(text, 256))


def spelling_pairs(rows: DataFrame, row_id: str, text: str) -> DataFrame:
    """(key_a, key_b): rows whose texts look the same and are not the same characters, smaller id first.

    Pairs are formed between the distinct spellings of a form and only then
    expanded to rows: any number of rows spelled alike costs nothing, and no
    two rows meet that are not in the result. Null texts and ids are left out.
    Forms are made once and written as digests.
    """
    given = rows.where(F.col(text).isNotNull() & F.col(row_id).isNotNull())
    seen = cut(given.select(F.col(row_id).alias("id"), key(uniform_text(F.col(text))).alias("form"), key(F.col(text)).alias("raw")))
    spellings = seen.select("form", "raw").distinct()
    several = spellings.groupBy("form").agg(F.count("*").alias("n")).where("n > 1").select("form")
    odd = spellings.join(several, "form", "left_semi")
    pairs = odd.alias("a").join(odd.alias("b"), F.expr("a.form = b.form AND a.raw < b.raw")).select(F.col("a.raw").alias("raw_a"), F.col("b.raw").alias("raw_b"))
    one = seen.select(F.col("id").alias("id_a"), F.col("raw").alias("raw_a"))
    two = seen.select(F.col("id").alias("id_b"), F.col("raw").alias("raw_b"))
    met = pairs.join(one, "raw_a").join(two, "raw_b").where("id_a <> id_b")
    return met.select(F.least("id_a", "id_b").alias("key_a"), F.greatest("id_a", "id_b").alias("key_b"))


def vocabulary_pairs(rows: DataFrame, row_id: str, items: str, vocabulary: DataFrame, item_id: str, item: str) -> DataFrame:
    """(key_a, key_b): rows with an array item that looks the same as a vocabulary item but is written in other characters.

    Distinct items are brought to form once, so a very common item costs one.
    """
    used = rows.where(F.col(row_id).isNotNull()).select(F.col(row_id).alias("key_a"), F.explode(F.array_distinct(F.col(items))).alias("raw")).where(F.col("raw").isNotNull())
    forms = spread(used.select("raw").distinct()).select("raw", uniform_text(F.col("raw")).alias("form"))
    known = vocabulary.where(F.col(item).isNotNull()).select(F.col(item_id).alias("key_b"), F.col(item).alias("known"), uniform_text(F.col(item)).alias("form"))
    hits = forms.join(known, "form").where("raw <> known").select("raw", "key_b")
    return used.join(hits, "raw").select("key_a", "key_b").distinct()


def spelling_cases(units: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """p1: (field_name, key_a, key_b)."""
    texts = spelling_pairs(spread(units.select("unit_no", "text")), "unit_no", "text")
    items = vocabulary_pairs(units.select("unit_no", "scope"), "unit_no", "scope", vocabulary, "item_no", "item")
    return texts.distinct().select(F.lit("text").alias("field_name"), "key_a", "key_b").unionByName(items.select(F.lit("scope").alias("field_name"), "key_a", "key_b"))
