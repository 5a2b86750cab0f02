"""The project's own cases for snapshot changes and missing references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemill.functions.looks import look_column, plain_id_column
from rulemill.operators.references import month_end, orphans
from rulemill.operators.snapshots import latest_rows, snapshot_changes
from rulemill.session import spread, table


def snapshot_cases(snapshots: DataFrame) -> DataFrame:
    """p4: (snap_no, rule_id, change_kind) between consecutive snapshots of a rule register.

    The plain id counts as the key; of repeated, stale and late rows the one
    with the latest delivered_at, then the largest row_no. Null or blank ids
    name no rule and are left out; a null text or source is a value.
    """
    ref = F.col("source_ref")
    rows = spread(snapshots.select("snap_no", "delivered_at", "row_no", "rule_id", "text", "source_ref")).select(
        "snap_no",
        "delivered_at",
        "row_no",
        plain_id_column(F.col("rule_id")).alias("rule_id"),
        look_column(F.col("text")).alias("text"),
        look_column(ref["document"]).alias("document"),
        look_column(ref["version"]).alias("version"),
        look_column(ref["location"]).alias("location"),
    )
    content = ["text", "document", "version", "location"]
    digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    kept = rows.where(F.length("rule_id") > 0).select("snap_no", "rule_id", "delivered_at", "row_no", digest.alias("content"))
    last = latest_rows(kept, ["snap_no", "rule_id"], ["delivered_at", "row_no"])
    return snapshot_changes(last, "snap_no", "rule_id", [F.col("content")])


def reference_cases(relations: DataFrame, units: DataFrame, versions: DataFrame) -> DataFrame:
    """p5: (tbl_name, period_month, row_no, field_name) of references that no row could mean at the end of their month.

    Rule references match by plain id; source references by exact (document,
    version), a null part meaning any. Null or blank references are none, nor
    are rows without a month.
    """
    named = spread(relations.select("rel_no", "source_rule", "target_rule", "registered_at")).select(
        "rel_no", "registered_at", plain_id_column(F.col("source_rule")).alias("source_rule"), plain_id_column(F.col("target_rule")).alias("target_rule")
    )
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("rule")) for f in ("source_rule", "target_rule")]))
    rules = named.where(F.col("registered_at").isNotNull()).select("rel_no", "registered_at", fields.alias("x")).select("rel_no", "registered_at", "x.*").where(F.length("rule") > 0)
    rules = rules.select(F.lit("relations").alias("tbl_name"), F.col("registered_at").alias("moment"), F.col("rel_no").alias("row_no"), "field_name", "rule", month_end(F.col("registered_at")).alias("period_end"))
    owned = spread(units.select("rule_id", "ingested_at", "withdrawn_at")).select(plain_id_column(F.col("rule_id")).alias("rule"), "ingested_at", "withdrawn_at")
    lost_rules = orphans(rules, owned.where(F.length("rule") > 0), ["rule"], "ingested_at", "withdrawn_at")
    blank = lambda c: F.when(F.length(F.trim(c)) > 0, c)
    sources = units.where(F.col("source_ref").isNotNull() & F.col("ingested_at").isNotNull()).select(
        F.lit("rule_units").alias("tbl_name"), F.col("ingested_at").alias("moment"), F.col("unit_no").alias("row_no"), F.lit("source_ref").alias("field_name"),
        blank(F.col("source_ref.document")).alias("document"), blank(F.col("source_ref.version")).alias("version"), month_end(F.col("ingested_at")).alias("period_end"),
    )
    sources = sources.where(F.col("document").isNotNull() | F.col("version").isNotNull())
    registry = versions.select(F.col("doc_id").alias("document"), "version", "registered_at", "withdrawn_at")
    lost_sources = orphans(sources, registry, ["document", "version"], "registered_at", "withdrawn_at")
    columns = ["tbl_name", F.date_format("moment", "yyyy-MM").alias("period_month"), "row_no", "field_name"]
    return lost_rules.select(*columns).union(lost_sources.select(*columns)).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_cases(table(spark, sf_dir, "rule_snapshots"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference_cases(table(spark, sf_dir, "relations"), table(spark, sf_dir, "rule_units"), table(spark, sf_dir, "source_versions"))
