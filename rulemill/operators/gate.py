"""Records and what is decided about them: checks in one report, decisions joined back, relations, new versions.

Every step is a plan from tables to tables; moments are passed in, so a run can
be repeated.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulemill.operators import checks, lifecycle, monitor


def by_row(errors: DataFrame, row_id: str, column: str = "error") -> DataFrame:
    """(row id, found): the messages of each row, sorted. A row has as many as there are checks."""
    return errors.groupBy(row_id).agg(F.array_sort(F.collect_set(column)).alias("found"))


def gate_report(rows: DataFrame, registry: DataFrame, levels: DataFrame, row_id: str, duplicates: DataFrame | None = None, warnings: DataFrame | None = None, default_domain: str = "ra") -> DataFrame:
    """(row id, passed, new_status, errors, warnings) of the checks that a draft must pass.

    Schema, source and authority are checked here; ``duplicates`` (row id,
    error) and ``warnings`` (row id, warning) are what costlier checks found.
    Warnings never fail a row. A row in another state than draft keeps it and
    fails with a message that says so. Null states count as no draft.
    """
    draft = F.coalesce(F.col("status") == "draft", F.lit(False))
    schema = rows.select(row_id, F.explode(checks.rule_schema_errors()).alias("error"))
    found = schema.union(checks.source_errors(rows, registry, row_id)).union(checks.authority_errors(rows, levels, row_id, default_domain))
    if duplicates is not None:
        found = found.union(duplicates.select(row_id, "error"))
    out = rows.select(row_id, "status").join(by_row(found, row_id), row_id, "left")
    if warnings is not None:
        out = out.join(by_row(warnings, row_id, "warning").withColumnRenamed("found", "warned"), row_id, "left")
    none = F.array().cast("array<string>")
    state = F.concat(F.lit("only drafts are processed (current: "), F.coalesce("status", F.lit("none")), F.lit(")"))
    errors = F.when(~draft, F.array(state)).otherwise(F.coalesce("found", none))
    warned = F.when(draft, F.coalesce("warned", none)).otherwise(none) if warnings is not None else none
    passed = F.size(errors) == 0
    return out.select(row_id, passed.alias("passed"), F.when(passed, "verified").when(draft, "rejected").otherwise(F.col("status")).alias("new_status"), errors.alias("errors"), warned.alias("warnings"))


def apply_report(rows: DataFrame, report: DataFrame, row_id: str, stamp: str) -> DataFrame:
    """The rows with drafts that passed verified at ``stamp``; all others as they are."""
    ok = report.where("passed").select(row_id, F.lit(True).alias("_ok"))
    met = rows.join(ok, row_id, "left")
    return met.withColumns({"status": F.when(F.col("_ok"), "verified").otherwise(F.col("status")), "verified_at": F.when(F.col("_ok"), F.lit(stamp)).otherwise(F.col("verified_at"))}).drop("_ok")


def decide(rows: DataFrame, decisions: DataFrame, row_id: str, stamp: str) -> DataFrame:
    """The rows with review decisions (row id, reviewer, checklist: map item -> pass or fail) applied to verified ones.

    One failed item rejects, with the failed items by name as the reason;
    otherwise the row is approved. Rows without a decision stay.
    """
    met = rows.withColumnsRenamed({"approval": "_approval", "rejection_reason": "_reason"}).join(decisions.select(row_id, F.col("reviewer").alias("_reviewer"), F.col("checklist").alias("_list")), row_id, "left")
    open_ = (F.col("status") == "verified") & F.col("_list").isNotNull()
    failed = F.array_sort(F.map_keys(F.map_filter("_list", lambda k, v: v == "fail")))
    bad = open_ & (F.size(failed) > 0)
    good = open_ & (F.size(failed) == 0)
    approval = F.struct(F.col("_reviewer").alias("reviewer"), F.lit(stamp).alias("timestamp"), F.col("_list").alias("gate2_checklist"), F.lit(None).cast("string").alias("notes"))
    return met.withColumns(
        {
            "status": F.when(bad, "rejected").when(good, "approved").otherwise(F.col("status")),
            "rejection_reason": F.when(bad, F.concat(F.lit("failed in review: "), F.array_join(failed, ", "))).otherwise(F.col("_reason")),
            "approval": F.when(good, approval).otherwise(F.col("_approval")),
        }
    ).drop("_approval", "_reason", "_reviewer", "_list")


def approve_bundles(rows: DataFrame, row_id: str, reviewer: str, items: list[str], stamp: str, pass_rates: DataFrame | None = None, least: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """Rows with all verified ones approved whose document's sample passed, and the report by document (document, n, sample, accepted).

    pass_rates: (document, pass_rate) of the samples; a document without one counts as passed.
    """
    report = monitor.groups_by_document(rows, pass_rates, least)
    document = F.coalesce("source_ref.document", F.lit("_unknown"))
    passed = rows.where("status = 'verified'").select(row_id, document.alias("document")).join(report.where("accepted").select("document"), "document", "left_semi")
    checklist = F.map_from_arrays(F.array(*map(F.lit, items)), F.array_repeat(F.lit("pass"), len(items)))
    return decide(rows, passed.select(row_id, F.lit(reviewer).alias("reviewer"), checklist.alias("checklist")), row_id, stamp), report


def list_relations(relations: DataFrame, status: str | None = None) -> DataFrame:
    """Relations with an id, by id, of one status or all."""
    shown = relations.where(F.col("relation_id").isNotNull())
    return (shown.where(F.col("status") == status) if status else shown).orderBy("relation_id")


def create_relations(existing: DataFrame, requests: DataFrame, order: str) -> DataFrame:
    """The requests with ``outcome``: created (as a draft), exists, or the errors of the schema joined by commas.

    Of requests with one id the first in ``order`` that can be created is; the others exist then.
    """
    asked = requests.withColumns({"status": F.lit("draft"), "approval": F.lit(None).cast(requests.schema["approval"].dataType), "suspension_reason": F.lit(None).cast("string")})
    errors = asked.withColumn("_errors", F.array_join(checks.relation_schema_errors(), ","))
    known = existing.select("relation_id").where("relation_id IS NOT NULL").distinct().withColumn("_known", F.lit(True))
    seen = errors.join(known, "relation_id", "left")
    free = seen.where("_errors = '' AND _known IS NULL").groupBy("relation_id").agg(F.min(order).alias("_first"))
    met = seen.join(free, "relation_id", "left")
    outcome = F.when(F.col("_errors") != "", F.col("_errors")).when(F.col("_known") | (F.col(order) != F.col("_first")), "exists").otherwise("created")
    return met.withColumn("outcome", outcome).drop("_errors", "_known", "_first")


def approve_relations(relations: DataFrame, ids: DataFrame, reviewer: str, stamp: str) -> DataFrame:
    """The relations with those whose relation_id is in ``ids`` approved; approved ones keep their approval."""
    wanted = ids.select("relation_id").distinct().withColumn("_wanted", F.lit(True))
    turn = F.coalesce("_wanted", F.lit(False)) & ~F.col("status").eqNullSafe("approved")
    approval = F.struct(F.lit(reviewer).alias("reviewer"), F.lit(stamp).alias("timestamp"), F.lit(None).cast("string").alias("notes"))
    met = relations.join(wanted, "relation_id", "left").withColumn("_turn", turn)
    return met.withColumns({"approval": F.when(F.col("_turn"), approval).otherwise(F.col("approval")), "status": F.when(F.col("_turn"), "approved").otherwise(F.col("status"))}).drop("_wanted", "_turn")


class VersionUpdate(NamedTuple):
    rules: DataFrame
    versions: DataFrame
    relations: DataFrame
    counts: DataFrame


def update_versions(rules: DataFrame, versions: DataFrame, relations: DataFrame, updates: DataFrame, order: str, relation_id: str = "relation_id") -> VersionUpdate:
    """What follows from new versions of documents, any number at once. updates: (document, old_version, new_version, file), one row a document and old version.

    Approved rules of the old version are suspended with the reason, the new
    version joins the registry where it is not there yet, and relations whose
    endpoints are gone now pass on. counts: (document, old_version,
    new_version, rules_found, rules_suspended); an update without rules has
    rules_found 0, which a caller may treat as an error.
    """
    ref = F.col("source_ref")
    step = updates.select(F.col("document").alias("_doc"), F.col("old_version").alias("_old"), F.col("new_version").alias("_new"))
    seen = rules.join(step, (ref["document"] == F.col("_doc")) & (ref["version"] == F.col("_old")), "left")
    hit = F.col("_new").isNotNull() & (F.col("status") == "approved")
    reason = F.when(hit, F.concat(F.lit("원천 문서 버전 변경: "), F.col("_old"), F.lit(" → "), F.col("_new")))
    changed = seen.withColumns({"suspension_reason": reason, "status": F.when(hit, "suspended").otherwise(F.col("status")), "_hit": hit})
    counts = changed.where("_new IS NOT NULL").groupBy("_doc", "_old").agg(F.count("*").alias("rules_found"), F.count_if("_hit").alias("rules_suspended"))
    report = step.join(counts, ["_doc", "_old"], "left").fillna(0, ["rules_found", "rules_suspended"]).toDF("document", "old_version", "new_version", "rules_found", "rules_suspended")
    new = updates.select(F.col("document").alias("doc_id"), F.col("new_version").alias("version"), "file", F.col("old_version").alias("supersedes")).dropDuplicates(["doc_id", "version"])
    registry = versions.unionByName(new.join(versions.select("doc_id", "version"), ["doc_id", "version"], "left_anti"), allowMissingColumns=True)
    after = changed.drop("_doc", "_old", "_new", "_hit")
    states = after.where("rule_id IS NOT NULL").groupBy("rule_id").agg(F.max_by("status", order).alias("status"))
    gone = lifecycle.cascade(lifecycle.orphan_relations(relations, states)).where("new_status <> status")
    passed = gone.select(F.col(relation_id).alias("_id"), F.col("new_status").alias("_state"), F.col("reason").alias("_why"))
    met = relations.join(passed, F.col(relation_id) == F.col("_id"), "left")
    told = met.withColumns({"suspension_reason": F.when(F.col("_state") == "suspended", F.col("_why")).otherwise(F.col("suspension_reason")), "status": F.coalesce("_state", "status")})
    return VersionUpdate(after, registry, told.drop("_id", "_state", "_why"), report)
