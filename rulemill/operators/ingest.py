"""Documents to sections to rule candidates, as windows over lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rulemill.operators import hooks

# What begins an article, a paragraph, an item and a sub-item; phrases that announce a list.
ARTICLE, PARAGRAPH, ITEM, SUB = r"^제(\d+)조\s*[(（]", "^([①②③④⑤⑥⑦⑧⑨⑩])", r"^(\d+)\.\s", r"^[가나다라마바사아자차카타파하]\.\s"
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩"
MARKERS = ["다음 각 호", "다음 각 목", "다음 사항"]
#: The shortest word of a vocabulary item that counts, and what texts and words meet on.
GRAM = 2


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def sections(documents: DataFrame, doc_id: str, text: str, markdown: bool = False) -> DataFrame:
    """(doc_id, article_seq, para_seq, item_seq, level, number, heading, text, location) of each section.

    Lines are numbered, classified and counted within their document; a
    paragraph needs an open article, an item an open paragraph, a sub-item an
    open item, else the line continues what is open. Blank lines stay between
    two continuation lines only. Lines before the first article, and those
    between an article's heading and its first paragraph, belong to no section.
    With ``markdown`` headings count too. Null texts have no sections.
    """
    raw = documents.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("n", "line")).select("doc_id", "n", strip(F.col("line")).alias("line"))
    marks = F.regexp_extract("line", r"^(#{1,4})\s+\S", 1) if markdown else F.lit("")
    deep = F.length(marks)
    doc = Window.partitionBy("doc_id").orderBy("n")
    is_art = F.when(deep.isin(1, 2) | ((deep == 0) & F.col("line").rlike(ARTICLE)), 1).otherwise(0)
    lines = raw.withColumns({"deep": deep, "art": is_art}).withColumn("article_seq", F.sum("art").over(doc)).where("article_seq > 0")
    is_para = F.when((F.col("art") == 0) & ((F.col("deep") == 3) | ((F.col("deep") == 0) & F.col("line").rlike(PARAGRAPH))), 1).otherwise(0)
    lines = lines.withColumn("par", is_para).withColumn("para_seq", F.sum("par").over(Window.partitionBy("doc_id", "article_seq").orderBy("n")))
    is_item = F.when((F.col("par") == 0) & (F.col("para_seq") > 0) & ((F.col("deep") == 4) | ((F.col("deep") == 0) & F.col("line").rlike(ITEM))), 1).otherwise(0)
    lines = lines.withColumn("itm", is_item).withColumn("item_seq", F.sum("itm").over(Window.partitionBy("doc_id", "article_seq", "para_seq").orderBy("n")))
    head = (F.col("art") + F.col("par") + F.col("itm")) > 0
    kind = F.when(head, "head").when(F.col("line") == "", "blank").when((F.col("item_seq") > 0) & (F.col("deep") == 0) & F.col("line").rlike(SUB), "sub").when(F.col("deep") > 0, "skip").otherwise("body")
    lines = lines.withColumn("kind", kind).where("kind <> 'skip'")
    key = ["doc_id", "article_seq", "para_seq", "item_seq"]
    within = Window.partitionBy(*key).orderBy("n")
    solid = F.when(F.col("kind") != "blank", F.col("kind"))
    before = F.last(solid, True).over(within.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(solid, True).over(within.rowsBetween(1, Window.unboundedFollowing))
    has_para = F.max("para_seq").over(Window.partitionBy("doc_id", "article_seq"))
    lines = lines.withColumns({"b": before, "a": after, "paras": has_para})
    kept = lines.where(((F.col("kind") != "blank") | ((F.col("b") == "body") & (F.col("a") == "body"))) & ((F.col("kind") == "head") | (F.col("para_seq") > 0) | (F.col("paras") == 0)))
    shown = F.when((F.col("kind") == "head") & (F.col("deep") > 0), F.lit(None)).otherwise(F.col("line"))
    grouped = kept.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("n", shown.alias("line")))).alias("rows"), F.min_by("line", "n").alias("first"), F.min_by("deep", "n").alias("deep"))
    level = F.when(F.col("item_seq") > 0, 3).when(F.col("para_seq") > 0, 2).otherwise(1)
    title = F.regexp_replace("first", r"^#+\s+", "")
    stated = F.regexp_extract(title, r"^제(\d+)조", 1)
    number = (
        F.when(level == 1, F.when(stated != "", stated.cast("int")).otherwise(F.col("article_seq").cast("int")))
        .when(level == 2, F.when(F.col("deep") > 0, F.col("para_seq").cast("int")).otherwise(F.instr(F.lit(CIRCLED), F.substring("first", 1, 1))))
        .otherwise(F.when(F.col("deep") > 0, F.col("item_seq").cast("int")).otherwise(F.regexp_extract("first", ITEM, 1).cast("int")))
    )
    heading = F.when(F.col("deep") > 0, title).when(level == 1, F.col("first")).when(level == 2, F.substring("first", 1, 1)).otherwise(F.concat(F.col("first").substr(F.lit(1), F.instr("first", ".")), F.lit("")))
    joined = F.array_join(F.filter(F.transform("rows", lambda r: r["line"]), lambda x: x.isNotNull()), "\n")
    out = grouped.select(*key, level.alias("level"), number.alias("number"), heading.alias("heading"), joined.alias("text"))
    article = F.max(F.when(F.col("level") == 1, F.col("number"))).over(Window.partitionBy("doc_id", "article_seq"))
    paragraph = F.max(F.when(F.col("level") == 2, F.col("number"))).over(Window.partitionBy("doc_id", "article_seq", "para_seq"))
    place = F.concat_ws(" ", F.format_string("제%d조", article), F.when(F.col("level") > 1, F.format_string("제%d항", paragraph)), F.when(F.col("level") > 2, F.format_string("제%d호", F.col("number"))))
    return out.withColumn("location", place)


def candidates(found: DataFrame) -> DataFrame:
    """(doc_id, rule_id, location, heading, text, needs_review, ...) of the sections that become rules.

    Articles with children give way to them; a paragraph with two items or more
    and a phrase that announces a list wants review. A section whose location
    names no article has no rule_id; ``drafts`` reports it.
    """
    family = Window.partitionBy("doc_id", "article_seq")
    group = Window.partitionBy("doc_id", "article_seq", "para_seq")
    marked = F.lit(False)
    for m in MARKERS:
        marked = marked | F.col("text").contains(m)
    seen = found.withColumns({"paras": F.max("para_seq").over(family), "items": F.sum(F.when(F.col("level") == 3, 1).otherwise(0)).over(group), "marked": F.max(marked).over(group)})
    suffix = F.when(F.col("level") == 3, F.concat(F.lit("item"), F.coalesce("number", F.lit(1)))).otherwise(F.lit("main"))
    number = lambda pattern, default: F.coalesce(F.nullif(F.regexp_extract("location", pattern, 1), F.lit("")), F.lit(default))
    name = F.concat(F.col("doc_id").cast("string"), F.lit("-art"), F.nullif(F.regexp_extract("location", "제(\\d+)조", 1), F.lit("")), F.lit("-p"), number("제(\\d+)항", "1"), F.lit("-"), suffix)
    review = (F.col("level") == 2) & (F.col("items") >= 2) & F.col("marked")
    return seen.where((F.col("level") > 1) | (F.col("paras") == 0)).select("doc_id", name.alias("rule_id"), "location", "heading", "text", review.alias("needs_review"), "article_seq", "para_seq", "item_seq")


def scope_of(rows: DataFrame, row_id: str, text: str, heading: str, location: str, vocabulary: DataFrame, order: str = "item_no") -> DataFrame:
    """(row id, scope): vocabulary items of which half the words stand in the text, else a phrase from the heading, else from the location.

    Words of a vocabulary of any size are found by one joined pattern a row of
    ``GRAM`` characters: texts and words meet on the words' first characters,
    and the whole word is looked up in the text then.
    """
    words = vocabulary.select(F.col(order).alias("o"), "item", F.filter(F.split("item", r"(?U)\s+"), lambda w: F.length(w) >= GRAM).alias("ws")).where(F.size("ws") > 0)
    need = F.greatest(F.lit(1), F.floor(F.size("ws") / 2)).alias("need")
    each = words.select("o", "item", need, F.explode("ws").alias("w")).withColumn("g", F.substring("w", 1, GRAM))
    grams = rows.select(row_id, F.col(text).alias("t"), F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - GRAM + 1, F.lit(1))), lambda i: F.substr(F.col(text), i, F.lit(GRAM))))).alias("g"))
    # Each word of an item counts once for each time it stands in the item.
    hits = grams.join(each, "g").where(F.contains("t", F.col("w"))).groupBy(row_id, "o", "item", "need").agg(F.count("*").alias("n")).where("n >= need")
    got = hits.groupBy(row_id).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "item"))), lambda x: x["item"]).alias("got"))
    named = F.regexp_replace(F.regexp_replace(heading, r"제\d+조\s*", ""), r"^[() ]+|[() ]+$", "")
    label = F.coalesce(F.nullif(F.regexp_extract(location, r"(제\d+조)", 1), F.lit("")), F.col(location))
    fall = F.when(named != "", F.concat(named, F.lit(" 관련 규정"))).otherwise(F.concat(label, F.lit(" 적용 범위")))
    return rows.join(got, row_id, "left").select(row_id, F.coalesce("got", F.array(fall)).alias("scope"))


def drafts(found: DataFrame, registry: DataFrame, scopes: DataFrame, default_domain: str = "ra") -> DataFrame:
    """(doc_id, rule_id, text, source_ref, scope, authority, domain, status, file, needs_review, error): one row for each of ``found``.

    found: candidates with version and, if known, domain. registry: (doc_id,
    version, authority_level), one row a document and version. scopes: (doc_id,
    rule_id, scope). No row is lost: what a draft lacks - its document in the
    registry, an authority, an article number, a scope - stands in ``error``,
    and such a row is no draft. The domain is left out where it is the default.
    """
    known = registry.groupBy("doc_id").agg(F.max("authority_level").alias("authority")).withColumn("_there", F.lit(True))
    met = found.join(known, "doc_id", "left").join(scopes, ["doc_id", "rule_id"], "left")
    ref = F.struct(F.col("doc_id").cast("string").alias("document"), "version", "location")
    error = F.when(F.col("_there").isNull(), "unknown document").when(F.coalesce("authority", F.lit("")) == "", "no authority level").when(F.col("rule_id").isNull(), "no article number").when(F.coalesce(F.size("scope"), F.lit(0)) < 1, "no scope")
    prefix = F.concat(F.col("doc_id").cast("string"), F.lit("-"))
    file = F.concat(F.when(F.startswith("rule_id", prefix), F.expr("substring(rule_id, length(cast(doc_id AS string)) + 2)")).otherwise(F.col("rule_id")), F.lit(".yaml"))
    return met.select("doc_id", "rule_id", "text", ref.alias("source_ref"), "scope", "authority", F.nullif("domain", F.lit(default_domain)).alias("domain"), F.when(error.isNull(), "draft").alias("status"), file.alias("file"), "needs_review", error.alias("error"))


def run_pipeline(documents: DataFrame, registry: DataFrame, vocabulary: DataFrame, markdown: bool = False, default_domain: str = "ra", split=None, scope=None) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, version, domain, text) to drafts, all at once, and a summary of each document.

    summary: (doc_id, sections_found, rule_candidates, deterministic_count,
    judged_count, drafts, success, error). Errors are isolated by document: one
    that is not in the registry has no drafts and says why. ``split`` and
    ``scope`` are optional judges (``hooks``).
    """
    found = sections(documents, "doc_id", "text", markdown)
    split_ = hooks.split_judged(candidates(found), split)
    named = split_.join(documents.select("doc_id", "version", "domain"), "doc_id")
    keyed = named.withColumn("_row", F.struct("doc_id", "article_seq", "para_seq", "item_seq"))
    scopes = scope_of(keyed, "_row", "text", "heading", "location", vocabulary)
    if scope is not None:
        scopes = hooks.scope_judged(keyed, "_row", "text", scopes, scope)
    by_rule = scopes.join(keyed.select("_row", "rule_id"), "_row").select(F.col("_row.doc_id").alias("doc_id"), "rule_id", "scope").dropDuplicates(["doc_id", "rule_id"])
    out = drafts(named, registry, by_rule, default_domain)
    first_error = F.min("error").alias("_error")
    counts = out.groupBy("doc_id").agg(F.count("*").alias("rule_candidates"), F.count("status").alias("drafts"), first_error)
    ways = split_.groupBy("doc_id").agg(F.count_if(F.col("split_method") == "deterministic").alias("deterministic_count"), F.count_if(F.col("split_method") == "judged").alias("judged_count"))
    known = registry.select("doc_id").distinct().withColumn("_there", F.lit(True))
    seen = documents.select("doc_id").join(found.groupBy("doc_id").agg(F.count("*").alias("sections_found")), "doc_id", "left").join(counts, "doc_id", "left").join(ways, "doc_id", "left").join(known, "doc_id", "left")
    numbers = ["sections_found", "rule_candidates", "deterministic_count", "judged_count", "drafts"]
    error = F.when(F.col("_there").isNull(), "unknown document").otherwise(F.col("_error"))
    return out, seen.fillna(0, numbers).select("doc_id", *numbers, error.isNull().alias("success"), error.alias("error"))


def batch_summary(results: DataFrame) -> DataFrame:
    """One row: total, succeeded, failed, drafts."""
    return results.agg(F.count("*").alias("total"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), F.coalesce(F.sum("drafts"), F.lit(0)).alias("drafts"))
