"""Keyword search: IDF weights, scope, text and relation scores, citations."""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the score.
SCOPE_WEIGHT, TEXT_WEIGHT, FUZZY_LEAST, FUZZY_SHARE, BONUS = 0.6, 0.4, 0.75, 0.8, 0.1
VISIBLE = {"approved_only": ["approved"], "verified_and_above": ["approved", "verified"]}
HIDDEN = ["draft", "rejected"]


def keywords_of(query: str) -> list[str]:
    """Split at Unicode blanks; repeated words weigh twice."""
    return query.split()


def status_allows(status: Column, level: str) -> Column:
    return F.lit(True) if level == "all" else status.isin(VISIBLE[level])


def domain_is(domain: Column, wanted: str, default: str) -> Column:
    """An explicit domain counts, else the default of the marker."""
    return F.coalesce(F.nullif(domain, F.lit("")), F.lit(default)) == wanted


def _holds(word: str):
    return lambda x: x.contains(word)


def corpus(text: str = "text", scope: str = "scope") -> Column:
    return F.concat(F.array_join(scope, " "), F.lit(" "), F.col(text))


def idf_weights(rules: DataFrame, words: list[str]) -> list[float]:
    """One weight a keyword over all rules, before any filter: a single aggregate row reaches the driver."""
    import math

    if not words:
        return []
    row = rules.agg(F.count("*"), *[F.sum(corpus().contains(w).cast("long")) for w in words]).first()
    n, found = row[0], [x or 0 for x in row[1:]]
    return [1.0 if not n else max(math.log(n / df), 0.1) if df else math.log(n + 1) for df in found]


def window_ratio(word: str, target: str) -> float:
    """Best ratio of ``word`` to a window of its length; 0 if the target is shorter."""
    k = len(word)
    return max((SequenceMatcher(None, word, target[i : i + k]).ratio() for i in range(len(target) - k + 1)), default=0.0)


def fuzzy_items(items: DataFrame, word: str) -> DataFrame:
    """(item, fuzzy) for distinct items that do not hold the word: the discounted ratio where it is high enough.

    A window of fewer than four characters can only match in full, so no item is looked at then.
    """

    @F.arrow_udf(T.DoubleType())
    def best(column: pa.Array) -> pa.Array:
        ratios = [window_ratio(word, x) for x in column.to_pylist()]
        return pa.array([r * FUZZY_SHARE if r >= FUZZY_LEAST else 0.0 for r in ratios], pa.float64())

    return items.where(~F.col("item").contains(word) & (F.length("item") >= len(word))).select("item", best("item").alias("fuzzy")).where("fuzzy > 0")


def fuzzy_scores(rules: DataFrame, row_id: str, words: list[str]) -> DataFrame | None:
    """(row id, fz_<k>...) of rules with a fuzzy scope match, or None if no keyword is long enough for one."""
    pairs = rules.select(row_id, F.explode(F.array_distinct("scope")).alias("item"))
    out = None
    for k, word in enumerate(words):
        if len(word) >= 4:
            hits = fuzzy_items(pairs.select("item").distinct(), word)
            one = pairs.join(hits, "item").select(row_id, F.lit(k).alias("k"), "fuzzy")
            out = one if out is None else out.union(one)
    if out is None:
        return None
    return out.groupBy(row_id).agg(*[F.max(F.when(F.col("k") == k, F.col("fuzzy"))).alias(f"fz_{k}") for k in range(len(words))])


def relation_hits(relations: DataFrame, words: list[str], order: str) -> DataFrame:
    """(rule_id, hits): approved relations with a real condition, the first of each unordered pair, that name a keyword.

    Endpoints are exploded so that the join to rules is on one key.
    """
    a, b = F.coalesce("source_rule", F.lit("")), F.coalesce("target_rule", F.lit(""))
    usable = relations.where((F.col("status") == "approved") & (F.length(F.trim("condition")) >= 5))
    pairs = usable.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(order).alias("o"), "condition")
    first = pairs.groupBy("a", "b").agg(F.min_by("condition", "o").alias("condition"))
    named = F.lit(False)
    for w in words:
        named = named | F.col("condition").contains(w)
    ends = first.where(named).select(F.explode(F.array_distinct(F.array("a", "b"))).alias("rule_id"))
    return ends.where(F.col("rule_id") != "").groupBy("rule_id").agg(F.count("*").alias("hits"))


def search(rules: DataFrame, query: str, row_id: str, relations: DataFrame | None = None, relation_order: str = "rel_no", level: str = "verified_and_above",
           threshold: float = 0.5, domain: str | None = None, default_domain: str = "ra", fuzzy: bool = True) -> DataFrame:
    """Rules with their score, best first, ties in row order. An empty query scores 0."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must lie in 0..1")
    words = keywords_of(query)
    weights = idf_weights(rules, words)
    shown = rules.where(status_allows(F.col("status"), level))
    if domain is not None:
        shown = shown.where(domain_is(F.col("domain"), domain, default_domain))
    near = fuzzy_scores(shown, row_id, words) if fuzzy else None
    if near is not None:
        shown = shown.join(near, row_id, "left")
    total = sum(weights) or 1.0
    scope, text = F.lit(0.0), F.lit(0.0)
    for k, (w, weight) in enumerate(zip(words, weights)):
        inside = F.exists("scope", _holds(w))
        close = F.coalesce(F.col(f"fz_{k}"), F.lit(0.0)) if near is not None else F.lit(0.0)
        scope = scope + F.when(inside, 1.0).otherwise(close) * weight
        text = text + F.when(F.col("text").contains(w), weight).otherwise(0.0)
    score = (scope * SCOPE_WEIGHT + text * TEXT_WEIGHT) / total
    if relations is not None and words:
        shown = shown.join(relation_hits(relations, words, relation_order), "rule_id", "left")
        score = score + F.least(F.coalesce(F.col("hits"), F.lit(0)) / len(words) * BONUS, F.lit(BONUS))
    return shown.withColumn("score", F.round(score, 6)).where(F.col("score") >= threshold).orderBy(F.desc("score"), row_id)


def top(found: DataFrame, limit: int) -> DataFrame:
    """The first rows; the limit is kept within 1 to 20."""
    return found.limit(max(1, min(limit, 20)))


def citation() -> Column:
    """How a rule may be cited by its status; null if not at all."""
    name, text = F.coalesce("rule_id", F.lit("unknown")), F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    return (
        F.when(F.col("status") == "superseded", F.concat(F.lit("[대체됨: "), name, F.lit("] 이 규칙은 "), F.coalesce("superseded_by", F.lit("unknown")), F.lit(" 규칙으로 대체되었습니다.")))
        .when(F.col("status") == "suspended", F.concat(F.lit("[재검토중: "), name, F.lit("] 이 규칙은 현재 재검토 중입니다.")))
        .when(F.col("status") == "approved", F.concat(F.lit("[근거: "), name, F.lit("] "), text))
        .when(F.col("status") == "verified", F.concat(F.lit("[미승인] 자동검증 완료, 인간 승인 대기중. [근거: "), name, F.lit("] "), text))
    )


def first_by_id(rules: DataFrame, order: str) -> DataFrame:
    """One row a rule_id, the first in order: the target of point lookups."""
    rest = [c for c in rules.columns if c != "rule_id"]
    return rules.groupBy("rule_id").agg(F.min_by(F.struct(*rest), order).alias("r")).select("rule_id", "r.*")


def cite(requests: DataFrame, rules: DataFrame, order: str) -> DataFrame:
    """(rule_id, status, citation, citable) for a request table of rule_id; missing rules give nulls."""
    known = first_by_id(rules, order).select("rule_id", "status", citation().alias("citation"))
    return requests.join(known, "rule_id", "left").withColumn("citable", F.coalesce(F.col("status").isin("approved", "verified"), F.lit(False)))


def public(rules: DataFrame, fields: list[str]) -> DataFrame:
    """Public fields of rules that may be shown."""
    return rules.where(~F.col("status").isin(HIDDEN)).select(*fields)


def hierarchy(links: DataFrame, order: str) -> DataFrame:
    """(parent, child, pos): of several links with one parent the last replaces the others."""
    last = links.groupBy("parent").agg(F.max_by("children", order).alias("children"))
    return last.select("parent", F.posexplode("children").alias("pos", "child"))


def siblings(edges: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(child, sibling) under one parent, for the rule ids ``asked`` (rule_id) or, without, for all.

    The result has as many rows as there are pairs under a parent; with a
    parent of very many children ask for the rules that are wanted.
    """
    own = edges if asked is None else edges.join(asked.select(F.col("rule_id").alias("child")).distinct(), "child", "left_semi").select(*edges.columns)
    return own.alias("x").join(edges.alias("y"), F.expr("x.parent = y.parent AND x.child <> y.child")).select(F.col("x.child").alias("child"), F.col("y.child").alias("sibling"))


def full_context(asked: DataFrame, rules: DataFrame, links: DataFrame, relations: DataFrame, order: str, link_order: str, fields: list[str], relation_fields: list[str]) -> DataFrame:
    """For each rule_id of ``asked``: rule (public fields or null), parent, hierarchy_type, children, siblings, relations.

    links: (parent, children, hierarchy_type), of one parent the last counts,
    and of several parents of a child the last link. Children and siblings keep
    the link's order. Relations are the approved ones with the rule at either
    end, with ``relation_fields`` only. Lists are made for the ids asked only;
    a rule has one parent, so its siblings are its parent's list without it.
    """
    last = links.groupBy("parent").agg(F.max_by(F.struct("children", "hierarchy_type", F.col(link_order).alias("o")), link_order).alias("l")).select("parent", "l.*")
    up = last.select("parent", "children", "hierarchy_type", "o", F.explode("children").alias("rule_id")).join(asked.select("rule_id"), "rule_id", "left_semi")
    up = up.groupBy("rule_id").agg(F.max_by(F.struct("parent", "children", "hierarchy_type"), "o").alias("u"))
    ids = asked.select("rule_id").distinct()
    shown = first_by_id(rules, order).where(~F.col("status").isin(HIDDEN)).select("rule_id", F.struct("rule_id", *[f for f in fields if f != "rule_id"]).alias("rule"))
    ends = relations.where("status = 'approved'").select(F.struct(*relation_fields).alias("r"), F.explode(F.array_distinct(F.array("source_rule", "target_rule"))).alias("rule_id"))
    tied = ends.join(ids, "rule_id", "left_semi").groupBy("rule_id").agg(F.array_sort(F.collect_list("r")).alias("relations"))
    down = last.select(F.col("parent").alias("rule_id"), F.col("children").alias("c"), F.col("hierarchy_type").alias("own_type"))
    met = ids.join(shown, "rule_id", "left").join(up, "rule_id", "left").join(down, "rule_id", "left").join(tied, "rule_id", "left")
    none = F.array().cast("array<string>")
    return met.select(
        "rule_id", "rule", F.col("u.parent").alias("parent"), F.coalesce("own_type", "u.hierarchy_type").alias("hierarchy_type"), F.coalesce("c", none).alias("children"),
        F.coalesce(F.filter("u.children", lambda x: x != F.col("rule_id")), none).alias("siblings"), F.coalesce("relations", F.array().cast(tied.schema["relations"].dataType)).alias("relations"),
    )


def scope_share(rules: DataFrame, words: list[str], row_id: str) -> DataFrame:
    """(row id, score): the share of keywords that stand in the joined scope; 0 without keywords."""
    joined = F.array_join("scope", " ")
    hits = sum((joined.contains(w).cast("int") for w in words), F.lit(0))
    return rules.select(row_id, (hits / max(len(words), 1)).alias("score"))


def context(rules: DataFrame, edges: DataFrame, relations: DataFrame, order: str) -> DataFrame:
    """(rule_id, shown, parent, n_children, n_relations): a rule with its place in the hierarchy and its approved relations."""
    base = first_by_id(rules, order).select("rule_id", (~F.col("status").isin(HIDDEN)).alias("shown"))
    up = edges.groupBy(F.col("child").alias("rule_id")).agg(F.min("parent").alias("parent"))
    down = edges.groupBy(F.col("parent").alias("rule_id")).agg(F.count("*").alias("n_children"))
    ends = relations.where("status = 'approved'").select("relation_id", F.explode(F.array_distinct(F.array("source_rule", "target_rule"))).alias("rule_id"))
    tied = ends.groupBy("rule_id").agg(F.count("*").alias("n_relations"))
    zero = {"n_children": 0, "n_relations": 0}
    return base.join(up, "rule_id", "left").join(down, "rule_id", "left").join(tied, "rule_id", "left").fillna(zero)


def restore_parents(primary: DataFrame, edges: DataFrame, rules: DataFrame, order: str) -> DataFrame:
    """Parents of found rules that were not found themselves, each once."""
    wanted = primary.select(F.col("rule_id").alias("child")).join(edges, "child").select(F.col("parent").alias("rule_id")).distinct()
    return first_by_id(rules, order).join(wanted.join(primary.select("rule_id"), "rule_id", "left_anti"), "rule_id", "left_semi")


def latest_status(rules: DataFrame, order: str) -> DataFrame:
    return rules.groupBy("rule_id").agg(F.max_by("status", order).alias("status"))
