"""The data model as Spark types, and the test tables as its views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulemill.session import table

_s = T.StringType()
SOURCE_REF = T.StructType([T.StructField(c, _s) for c in ("document", "version", "location")])
APPROVAL = T.StructType([T.StructField("reviewer", _s), T.StructField("timestamp", _s), T.StructField("gate2_checklist", T.MapType(_s, _s)), T.StructField("notes", _s)])
RULE = T.StructType(
    [T.StructField("rule_id", _s), T.StructField("text", _s), T.StructField("source_ref", SOURCE_REF), T.StructField("scope", T.ArrayType(_s))]
    + [T.StructField(c, _s) for c in ("authority", "domain", "status")]
    + [T.StructField("approval", APPROVAL)]
    + [T.StructField(c, _s) for c in ("superseded_by", "rejection_reason", "verified_at")]
)
RELATION = T.StructType(
    [T.StructField(c, _s) for c in ("relation_id", "type", "source_rule", "target_rule", "condition", "resolution", "authority_basis", "registered_by", "status", "suspension_reason")]
    + [T.StructField("approval", T.StructType([T.StructField(c, _s) for c in ("reviewer", "timestamp", "notes")]))]
)
RULE_FIELDS = ["rule_id", "text", "source_ref", "scope", "authority", "status"]
RELATION_FIELDS = ["relation_id", "type", "source_rule", "target_rule", "condition", "resolution", "authority_basis", "status"]
STATUSES = ["draft", "verified", "approved", "suspended", "superseded", "rejected"]


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule units with ``path`` order taken from unit_no; null scope items do not count."""
    scope = F.filter(F.coalesce("scope", F.array()), lambda x: x.isNotNull())
    return table(spark, sf_dir, "rule_units").withColumns({"scope": scope, "text": F.coalesce("text", F.lit(""))})


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "relations")
