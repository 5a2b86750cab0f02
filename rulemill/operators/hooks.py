"""Judges outside the engine - language models, reviewers - as injected callables.

A judge takes the texts of a batch and gives one answer each. Whatever it
raises, or an answer that cannot be read, makes the row fall back: the answer
is null, and the reason says why. The engine never waits for a judge that is
not there.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Judge = Callable[[list[str]], list[str]]


def reply_json(reply: str) -> dict:
    """The object in a reply, with or without a code fence around it."""
    flat = reply.strip()
    if flat.startswith("```"):
        flat = flat.split("\n", 1)[1].rsplit("```", 1)[0]
    got = json.loads(flat)
    if not isinstance(got, dict):
        raise ValueError("the reply is no object")
    return got


def prompt_hash(prompt: str) -> str:
    """The first eight digits of the prompt's SHA-256."""
    return hashlib.sha256(prompt.encode()).hexdigest()[:8]


def ask(rows: DataFrame, prompt: Column, judge: Judge | None, missing: str = "no judge") -> DataFrame:
    """``rows`` with _reply (the JSON object of the answer as text), _why (why there is none) and _prompt_hash. Null prompts are not asked."""

    @F.arrow_udf(T.StructType([T.StructField("reply", T.StringType()), T.StructField("why", T.StringType()), T.StructField("hash", T.StringType())]))
    def asked(prompts: pa.Array) -> pa.Array:
        texts = prompts.to_pylist()
        wanted = [t for t in texts if t is not None]
        try:
            if judge is None:
                raise RuntimeError(missing)
            replies = dict(zip(wanted, judge(wanted), strict=True))
            why = None
        except Exception as e:  # noqa: BLE001 - any failure of an outside judge falls back
            replies, why = {}, str(e) or type(e).__name__
        out = []
        for t in texts:
            reply, reason = None, why
            if t is None:
                reason = "not asked"
            elif t in replies:
                try:
                    reply = json.dumps(reply_json(replies[t]), ensure_ascii=False)
                except (ValueError, IndexError) as e:
                    reason = f"unreadable reply: {e}"
            out.append({"reply": reply, "why": reason, "hash": None if t is None else prompt_hash(t)})
        return pa.array(out, pa.struct([("reply", pa.string()), ("why", pa.string()), ("hash", pa.string())]))

    return rows.withColumn("_a", asked(prompt)).select(*rows.columns, F.col("_a.reply").alias("_reply"), F.col("_a.why").alias("_why"), F.col("_a.hash").alias("_prompt_hash"))


def split_judged(candidates: DataFrame, judge: Judge | None = None) -> DataFrame:
    """Candidates with ``split_method`` and ``reasoning``: what wants review is put to the judge, MERGE joins a paragraph's items into it.

    candidates: as ``ingest.candidates``. Items of a merged paragraph leave.
    Without an answer the split stays as it is and needs_review with it.
    """
    key = ["doc_id", "article_seq", "para_seq"]
    items = candidates.where("item_seq > 0").groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_seq", "text"))), lambda r: F.concat(F.lit("- "), r["text"])), "\n").alias("_items"))
    unsure = candidates.where("needs_review").join(items, key, "left")
    prompt = F.concat(F.lit("Do these items share a single decision point? Answer {\"decision\": \"MERGE\" or \"SPLIT\", \"reasoning\": ...}\n"), F.col("text"), F.lit("\n"), F.coalesce("_items", F.lit("")))
    told = ask(unsure, prompt, judge)
    answer = F.from_json("_reply", "decision string, reasoning string")
    reason = F.concat(F.coalesce(answer["reasoning"], F.lit("")), F.lit(" (prompt "), F.col("_prompt_hash"), F.lit(")"))
    verdicts = told.select(*key, F.col("_reply").isNotNull().alias("_told"), F.coalesce(answer["decision"] == "MERGE", F.lit(False)).alias("_merge"), reason.alias("_reason"))
    met = candidates.join(verdicts, key, "left").where(~(F.coalesce("_merge", F.lit(False)) & (F.col("item_seq") > 0)))
    told_ = F.coalesce("_told", F.lit(False))
    return met.withColumns({"split_method": F.when(told_, "judged").otherwise("deterministic"), "reasoning": F.when(told_, F.col("_reason")), "needs_review": F.col("needs_review") & ~told_}).drop("_told", "_merge", "_reason")


def scope_judged(rows: DataFrame, row_id: str, text: str, heuristic: DataFrame, judge: Judge | None = None) -> DataFrame:
    """(row id, scope): the judge's scope items where it gives any, else those of ``heuristic`` (row id, scope)."""
    prompt = F.concat(F.lit("Which matters does this rule apply to? Answer {\"scope\": [...]}\n"), F.col(text))
    told = ask(rows.select(row_id, text), prompt, judge).select(row_id, F.from_json("_reply", "scope array<string>")["scope"].alias("_judged"))
    return told.join(heuristic.select(row_id, "scope"), row_id, "left").select(row_id, F.when(F.size("_judged") > 0, F.col("_judged")).otherwise(F.col("scope")).alias("scope"))


def coherence_warnings(rows: DataFrame, row_id: str, judge: Judge | None = None) -> DataFrame:
    """(row id, warning): scope items that the judge finds not derivable from the text, or why nothing was asked. Rows without scope or text are not asked."""
    prompt = F.when((F.size("scope") > 0) & (F.length("text") > 0), F.concat(F.lit("Can each item be derived from the text? Answer {\"results\": [{\"scope\": ..., \"derivable\": true or false, \"reason\": ...}]}\n"), F.col("text"), F.lit("\n"), F.array_join("scope", "\n")))
    told = ask(rows.select(row_id, "text", "scope"), prompt, judge)
    bad = F.filter(F.from_json("_reply", "results array<struct<scope:string,derivable:boolean,reason:string>>")["results"], lambda r: ~F.coalesce(r["derivable"], F.lit(True)))
    said = F.transform(bad, lambda r: F.concat(F.lit("scope '"), r["scope"], F.lit("' may not be derivable: "), F.coalesce(r["reason"], F.lit("no reason"))))
    skipped = F.when(F.col("_reply").isNull() & (F.col("_why") != "not asked"), F.array(F.concat(F.lit("scope not judged: "), F.col("_why"))))
    return told.select(row_id, F.explode(F.coalesce(said, skipped)).alias("warning"))
