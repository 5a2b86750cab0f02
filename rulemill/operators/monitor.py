"""Queue, scope and corpus figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUEUE_MOST, AGE_MOST, SCOPE_LONG, BROAD_SHARE = 10, 14, 50, 0.2


def age_days(as_of: str, verified_at: str = "verified_at", written: str | None = None) -> Column:
    """Days since the verification, else since the record was written, else 0; stamps without a zone are UTC."""
    stamp = F.try_to_timestamp(F.col(verified_at))
    moment = F.coalesce(stamp, F.col(written)) if written else stamp
    return F.coalesce((F.unix_micros(F.to_timestamp(F.lit(as_of))) - F.unix_micros(moment)) / 86_400e6, F.lit(0.0))


def queue_report(rules: DataFrame, order: str, as_of: str, domain: str | None = None, default_domain: str = "ra", written: str | None = None) -> DataFrame:
    """Verified rules, oldest first: id, domain, authority, snippet, age in days to one place."""
    shown = rules.where("status = 'verified'")
    if domain is not None:
        shown = shown.where(F.coalesce(F.nullif("domain", F.lit("")), F.lit(default_domain)) == domain)
    snippet = F.when(F.length("text") > 80, F.concat(F.substring("text", 1, 80), F.lit("..."))).otherwise(F.col("text"))
    out = shown.select(order, "rule_id", F.coalesce("domain", F.lit("unknown")).alias("domain"), "authority", snippet.alias("snippet"), F.round(age_days(as_of, written=written), 1).alias("age_days"))
    return out.orderBy(F.desc("age_days"), order)


def queue_warnings(report: DataFrame) -> DataFrame:
    """One row: size of the queue, rules above the age, and whether either is too many."""
    old = F.count_if(F.col("age_days") > AGE_MOST)
    return report.agg(F.count("*").alias("n_queued"), old.alias("n_old")).withColumn("too_long", F.col("n_queued") > QUEUE_MOST)


def scope_metrics(rules: DataFrame) -> DataFrame:
    """One row of figures about scope items; one pass, no explode."""
    lengths = F.transform("scope", lambda x: F.length(x))
    per = rules.select(F.size("scope").alias("n"), F.aggregate(lengths, F.lit(0), lambda a, x: a + x).alias("c"), F.size(F.filter(lengths, lambda x: x > SCOPE_LONG)).alias("b"))
    m = per.agg(F.count("*").alias("total_rules"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_scope_items"), F.coalesce(F.sum("c"), F.lit(0)).alias("chars"), F.count_if(F.col("n") == 1).alias("single_scope_count"), F.coalesce(F.sum("b"), F.lit(0)).alias("broad_scope_count"))
    avg = F.round(F.col("chars") / F.greatest("total_scope_items", F.lit(1)), 1)
    return m.select("total_rules", "total_scope_items", avg.alias("avg_scope_chars"), "single_scope_count", "broad_scope_count", F.round(F.col("broad_scope_count") / F.greatest("total_rules", F.lit(1)), 3).alias("broad_scope_pct"))


def scope_warnings(metrics: DataFrame) -> DataFrame:
    """One row: what is wrong with the figures of ``scope_metrics``."""
    bad = F.array_compact(F.array(F.when(F.col("avg_scope_chars") > SCOPE_LONG, "long items"), F.when(F.col("broad_scope_pct") > BROAD_SHARE, "broad items")))
    return metrics.select(bad.alias("warnings"))


def scope_lists(rules: DataFrame) -> DataFrame:
    """(kind, rule_id, item): rules with a single scope item, and items longer than SCOPE_LONG characters."""
    items = rules.select("rule_id", F.size("scope").alias("n"), F.explode("scope").alias("item"))
    kind = F.explode(F.array_compact(F.array(F.when(F.col("n") == 1, "single"), F.when(F.length("item") > SCOPE_LONG, "broad"))))
    return items.select(kind.alias("kind"), "rule_id", "item")


def waiting_too_long(report: DataFrame, row_id: str) -> DataFrame:
    """The rows of a queue report above the age, one by one."""
    return report.where(F.col("age_days") > AGE_MOST).select(row_id, "age_days")


def queue_json(report: DataFrame) -> DataFrame:
    """(line): each entry of a queue report as a JSON object, all keys present."""
    return report.select(F.to_json(F.struct(*report.columns), {"ignoreNullFields": "false"}).alias("line"))


def groups_by_document(rules: DataFrame, pass_rates: DataFrame | None = None, least: float = 0.9) -> DataFrame:
    """(document, n, sample, accepted): verified rules by source document and how many to look at."""
    n = rules.where("status = 'verified'").groupBy(F.coalesce("source_ref.document", F.lit("_unknown")).alias("document")).agg(F.count("*").alias("n"))
    out = n.withColumn("sample", sample_size(F.col("n")))
    rate = F.lit(1.0)
    if pass_rates is not None:
        out, rate = out.join(pass_rates, "document", "left"), F.coalesce(F.col("pass_rate"), F.lit(1.0))
    return out.select("document", "n", "sample", (rate >= least).alias("accepted"))


def sample_size(n: Column) -> Column:
    return F.when(n <= 5, n).otherwise(F.greatest(F.ceil(n / 10), F.lit(5))).cast("long")


def approximate_tokens(text: Column) -> Column:
    """Hangul and ideographs one each, ASCII words one each, at least 1."""
    return F.greatest(F.regexp_count(text, F.lit("[가-힣ㄱ-ㆎ一-鿿]")) + F.regexp_count(text, F.lit("[A-Za-z0-9]+")), F.lit(1)).cast("long")


def token_savings(all_rules: DataFrame, found: DataFrame) -> DataFrame:
    """One row: tokens of the whole corpus, of what was found, and the share saved."""
    whole = all_rules.agg(F.sum(approximate_tokens(F.col("text"))).alias("before"))
    part = found.agg(F.coalesce(F.sum(approximate_tokens(F.col("text"))), F.lit(0)).alias("after"))
    return whole.crossJoin(part).withColumn("saved_pct", F.round((1 - F.col("after") / F.col("before")) * 100, 1))  # one row each


def monolithic(rules: DataFrame, order: str, group: str) -> DataFrame:
    """(group, text): texts of a group joined in order with a blank line; groups are single documents."""
    rows = F.array_sort(F.collect_list(F.struct(order, "text")))
    return rules.groupBy(group).agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n\n").alias("text"))


def vocabulary_consistency(rows: DataFrame, items: str, vocabulary: DataFrame, item: str) -> DataFrame:
    """One row: share of items that have a word of three characters or more in common with the vocabulary."""
    words = lambda c: F.filter(F.split(c, r"(?U)\s+"), lambda w: F.length(w) >= 3)
    used = rows.select(F.posexplode(items).alias("pos", "item"), F.monotonically_increasing_id().alias("r"))
    known = vocabulary.select(F.explode(words(F.col(item))).alias("w")).distinct()
    hit = used.select("item").distinct().select("item", F.explode(words(F.col("item"))).alias("w")).join(known, "w", "left_semi").select("item").distinct()
    tagged = used.join(hit.withColumn("hit", F.lit(1)), "item", "left")
    return tagged.agg(F.round(F.coalesce(F.count("hit") / F.count("item"), F.lit(0.0)), 6).alias("consistency"))


def relation_table(relations: DataFrame) -> DataFrame:
    """(relation_id, line): fixed-width lines."""
    cells = [F.rpad(F.coalesce(c, F.lit("")), w, " ") for c, w in (("relation_id", 20), ("type", 12), ("status", 10), ("source_rule", 30), ("target_rule", 30))]
    return relations.select("relation_id", F.rtrim(F.concat_ws(" ", *cells)).alias("line"))
