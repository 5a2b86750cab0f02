"""What follows from changed records: orphans, cascades, migration guides, incremental capture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GONE = ["suspended", "superseded"]


def orphan_relations(relations: DataFrame, statuses: DataFrame) -> DataFrame:
    """Relations still in force of which an endpoint is gone, with the reason. statuses: (rule_id, status), one row an id."""
    source = statuses.where(F.col("status").isin(GONE)).select(F.col("rule_id").alias("source_rule"), F.col("status").alias("s"))
    target = statuses.where(F.col("status").isin(GONE)).select(F.col("rule_id").alias("target_rule"), F.col("status").alias("t"))
    seen = relations.where(~F.col("status").isin("rejected", "suspended")).join(source, "source_rule", "left").join(target, "target_rule", "left")
    reason = F.concat_ws(
        "; ",
        F.when(F.col("s").isNotNull(), F.concat(F.lit("source_rule '"), "source_rule", F.lit("' is "), "s")),
        F.when(F.col("t").isNotNull(), F.concat(F.lit("target_rule '"), "target_rule", F.lit("' is "), "t")),
    )
    return seen.where("s IS NOT NULL OR t IS NOT NULL").withColumn("reason", reason).drop("s", "t")


def cascade(orphans: DataFrame) -> DataFrame:
    """Orphans with the state they pass to; applying it again changes nothing."""
    state = F.when(F.col("status") == "approved", "suspended").when(F.col("status").isin("draft", "verified"), "rejected").otherwise(F.col("status"))
    return orphans.withColumns({"new_status": state, "suspension_reason": F.when(F.col("status") == "approved", F.col("reason")), "rejection_reason": F.when(F.col("status").isin("draft", "verified"), F.col("reason"))})


def migration_guide(relations: DataFrame, new_rules: DataFrame, document: str) -> DataFrame:
    """(relation_id, candidates, human_review): for each suspended relation of a document the new rules whose ids end alike, source before target."""
    prefix = f"{document}-"
    suffix = lambda c: F.when(F.startswith(c, F.lit(prefix)), F.substring(c, len(prefix) + 1, 10_000))
    open_ = relations.where((F.col("status") == "suspended") & (F.col("source_rule").startswith(prefix) | F.col("target_rule").startswith(prefix)))
    new = new_rules.where(F.col("rule_id").startswith(prefix)).groupBy(suffix(F.col("rule_id")).alias("suffix")).agg(F.max("rule_id").alias("new_id"))
    left, right = (new.select(F.col("suffix").alias(f"{e}_suffix"), F.col("new_id").alias(f"{e}_new")) for e in ("s", "t"))
    met = open_.withColumns({"s_suffix": suffix(F.col("source_rule")), "t_suffix": suffix(F.col("target_rule"))}).join(left, "s_suffix", "left").join(right, "t_suffix", "left")
    found = F.array_distinct(F.array_compact(F.array("s_new", "t_new")))
    return met.select("relation_id", F.array_join(found, ",").alias("candidates"), F.lit(True).alias("human_review"))


def guide_lines(guide: DataFrame) -> DataFrame:
    """(line): one line of a migration guide for each relation."""
    return guide.select(F.concat_ws(" ", "relation_id", F.lit("->"), F.coalesce(F.nullif("candidates", F.lit("")), F.lit("no candidate")), F.when(F.col("human_review"), "(review)")).alias("line"))


def changed_files(listing: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """Of (file_id, modified_at) the files that are new or modified since the manifest. Deletions are not reported."""
    if force:
        return listing
    known = manifest.select("file_id", F.col("modified_at").alias("_known"), F.lit(1).alias("_there"))
    seen = listing.join(known, "file_id", "left")
    return seen.where(F.col("_there").isNull() | ~F.col("modified_at").eqNullSafe(F.col("_known"))).drop("_known", "_there")


def insert_absent(table: DataFrame, rows: DataFrame, key: str, force: bool = False) -> DataFrame:
    """The table with the rows whose key it lacks; with ``force`` rows replace those of the same key. Of repeated keys any one row is taken."""
    new = rows.dropDuplicates([key])
    if force:
        return table.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
    return table.unionByName(new.join(table.select(key), key, "left_anti"), allowMissingColumns=True)
