"""Queries about decisions on records, contexts, ingestion and capture over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemill import model
from rulemill.operators import checks, gate, ingest, lifecycle, monitor, search
from rulemill.plans import reference as base
from rulemill.session import spread, table
from rulemill.sources import files

STAMP, REVIEWER = "2025-06-01T00:00:00+00:00", "reviewer"
ITEMS = ["scope_completeness", "semantic_accuracy"]


def _levels(s: SparkSession) -> DataFrame:
    """The levels of each domain, from records with a list of them."""
    lists: dict[str, list[str]] = {}
    for domain, level in base.LEVELS:
        lists.setdefault(domain, []).append(level)
    return files.ranked(s.createDataFrame(list(lists.items()), "domain string, levels array<string>"), "levels")


def _drafts(s: SparkSession, d: str) -> DataFrame:
    none = F.lit(None)
    scope = F.filter(F.coalesce("scope", F.array()), lambda x: x.isNotNull())
    return table(s, d, "draft_units").withColumns({"text": F.coalesce("text", F.lit("")), "scope": scope, "approval": none.cast(model.APPROVAL), "superseded_by": none.cast("string"), "rejection_reason": none.cast("string"), "verified_at": none.cast("string")})


def _gate(s: SparkSession, d: str) -> DataFrame:
    return gate.gate_report(_drafts(s, d), table(s, d, "source_versions"), _levels(s), "unit_no")


def gate_checked(s: SparkSession, d: str) -> DataFrame:
    return _gate(s, d).select("unit_no", "passed", "new_status", F.array_join("errors", ",").alias("errors"))


def gate_applied(s: SparkSession, d: str) -> DataFrame:
    return gate.apply_report(_drafts(s, d), _gate(s, d), "unit_no", STAMP).select("unit_no", "status", "verified_at")


def rules_decided(s: SparkSession, d: str) -> DataFrame:
    """Verified rules with a decision drawn from what they hold: scope items, and a text of some length."""
    rules = base._rules(s, d)
    verdict = lambda ok: F.when(ok, "pass").otherwise("fail")
    checklist = F.create_map(F.lit(ITEMS[0]), verdict(F.size("scope") > 0), F.lit(ITEMS[1]), verdict(F.length("text") >= 60))
    decisions = rules.where("status = 'verified'").select("unit_no", F.lit(REVIEWER).alias("reviewer"), checklist.alias("checklist"))
    return gate.decide(rules, decisions, "unit_no", STAMP).select("unit_no", "status", "rejection_reason", F.col("approval.reviewer").alias("reviewer"))


def bundles_approved(s: SparkSession, d: str) -> DataFrame:
    """Documents whose verified rules are approved at once, by the share of them without schema errors."""
    rules = base._rules(s, d)
    ok = (F.size(checks.rule_schema_errors()) == 0).cast("double")
    rates = rules.where("status = 'verified'").groupBy(F.coalesce("source_ref.document", F.lit("_unknown")).alias("document")).agg(F.avg(ok).alias("pass_rate"))
    return gate.approve_bundles(rules, "unit_no", REVIEWER, ITEMS, STAMP, rates)[0].select("unit_no", "status", F.col("approval.reviewer").alias("reviewer"))


def relations_listed(s: SparkSession, d: str) -> DataFrame:
    return gate.list_relations(table(s, d, "relations"), "approved").select("relation_id", "rel_no", "type")


def relations_created(s: SparkSession, d: str) -> DataFrame:
    relations = table(s, d, "relations")
    return gate.create_relations(relations.where("status = 'suspended'"), relations, "rel_no").select("rel_no", "outcome")


def relations_approved(s: SparkSession, d: str) -> DataFrame:
    relations = table(s, d, "relations")
    return gate.approve_relations(relations, relations.where("status IN ('draft', 'verified')"), REVIEWER, STAMP).select("rel_no", "status", F.col("approval.reviewer").alias("reviewer"))


def _update(s: SparkSession, d: str) -> gate.VersionUpdate:
    versions = table(s, d, "source_versions")
    updates = versions.where("supersedes IS NOT NULL").groupBy(F.col("doc_id").alias("document"), F.col("supersedes").alias("old_version")).agg(F.max("version").alias("new_version"), F.max("file").alias("file"))
    return gate.update_versions(base._rules(s, d), versions, table(s, d, "relations"), updates, "unit_no", "rel_no")


def versions_updated(s: SparkSession, d: str) -> DataFrame:
    return _update(s, d).counts


def relations_after_update(s: SparkSession, d: str) -> DataFrame:
    return _update(s, d).relations.select("rel_no", "status")


def rule_contexts(s: SparkSession, d: str) -> DataFrame:
    """Each rule named in a relation, with its parent, children, siblings and approved relations as lists."""
    links = base._edges(s, d).groupBy("parent").agg(F.array_sort(F.collect_list("child")).alias("children")).withColumns({"hierarchy_type": F.lit("document"), "link_no": F.col("parent")})
    relations = table(s, d, "relations")
    asked = relations.select(F.explode(F.array("source_rule", "target_rule")).alias("rule_id")).union(links.select(F.explode("children"))).where("rule_id IS NOT NULL").distinct()
    got = search.full_context(asked, base._rules(s, d).where("rule_id IS NOT NULL"), links, relations, "unit_no", "link_no", model.RULE_FIELDS, ["rel_no", *model.RELATION_FIELDS])
    joined = lambda c: F.array_join(c, "|")
    numbers = F.transform("relations", lambda r: r["rel_no"].cast("string"))
    return got.select("rule_id", F.col("rule.status").alias("status"), "parent", "hierarchy_type", joined("children").alias("children"), joined("siblings").alias("siblings"), joined(numbers).alias("relations"))


def scope_shares(s: SparkSession, d: str) -> DataFrame:
    return search.scope_share(base._rules(s, d), base.QUERY.split(), "unit_no").withColumn("score", F.round("score", 6))


def scope_lists(s: SparkSession, d: str) -> DataFrame:
    return monitor.scope_lists(base._rules(s, d).withColumn("rule_id", F.col("unit_no"))).select("kind", F.col("rule_id").alias("unit_no"), "item")


def scope_flags(s: SparkSession, d: str) -> DataFrame:
    return monitor.scope_warnings(base.scope_figures(s, d)).select(F.array_join("warnings", ",").alias("warnings"))


def queue_waiting(s: SparkSession, d: str) -> DataFrame:
    return monitor.waiting_too_long(base.queue(s, d), "unit_no")


def queue_lines(s: SparkSession, d: str) -> DataFrame:
    return monitor.queue_json(base.queue(s, d).select("unit_no", "domain", "authority", "age_days"))


def vocabulary_ranked(s: SparkSession, d: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("item_no", "item")))
    lists = table(s, d, "scope_vocabulary").groupBy("category").agg(F.transform(rows, lambda r: r["item"]).alias("items"))
    return files.ranked(lists, "items", "category", "item")


def registry_errors(s: SparkSession, d: str) -> DataFrame:
    """The registry after all updates has each version once: repeated ones would stand here."""
    return _update(s, d).versions.groupBy("doc_id").agg(F.count("*").alias("n_versions"))


def ingest_summaries(s: SparkSession, d: str) -> DataFrame:
    """Each unit's text taken as a document of its own source's authority."""
    units = table(s, d, "rule_units")
    documents = spread(units.select("unit_no", "text", "domain", "source_ref")).where("text IS NOT NULL").select(F.col("unit_no").alias("doc_id"), F.col("source_ref.version").alias("version"), "domain", "text")
    known = table(s, d, "source_versions").groupBy(F.col("doc_id").alias("document")).agg(F.max("authority_level").alias("authority_level"))
    registry = units.select(F.col("unit_no").alias("doc_id"), F.col("source_ref.document").alias("document")).join(known, "document")
    summary = ingest.run_pipeline(documents, registry, table(s, d, "scope_vocabulary"))[1]
    return summary.select("doc_id", "sections_found", "rule_candidates", "deterministic_count", "drafts", "success", "error")


def migration_lines(s: SparkSession, d: str) -> DataFrame:
    return lifecycle.guide_lines(base.migration(s, d).withColumnRenamed("rel_no", "relation_id"))


QUERIES = {
    f.__name__: f
    for f in (
        gate_checked, gate_applied, rules_decided, bundles_approved, relations_listed, relations_created, relations_approved, versions_updated, relations_after_update,
        rule_contexts, scope_shares, scope_lists, scope_flags, queue_waiting, queue_lines, vocabulary_ranked, registry_errors, ingest_summaries, migration_lines,
    )
}

_DRAFTS = f"r AS (SELECT * REPLACE (coalesce(text, '') AS text, {base._SCOPE} AS scope), NULL AS approval, NULL AS superseded_by, NULL AS rejection_reason FROM draft_units)"
_GATE = f"""{_DRAFTS}, l(d, a) AS (VALUES {base._LEVELS}),
    e AS (SELECT unit_no, status, {base._RULE_ERRORS} AS se,
        CASE WHEN NOT EXISTS (SELECT 1 FROM source_versions s WHERE s.doc_id = source_ref.document) THEN 'unknown document: ' || coalesce(source_ref.document, '')
            WHEN NOT EXISTS (SELECT 1 FROM source_versions s WHERE s.doc_id = source_ref.document AND s.version = source_ref.version) THEN 'unknown version: ' || coalesce(source_ref.version, '') END AS re,
        CASE WHEN coalesce(nullif(domain, ''), 'ra') NOT IN (SELECT d FROM l) THEN 'no authority levels' WHEN coalesce(authority, '') = '' THEN 'authority missing'
            WHEN (coalesce(nullif(domain, ''), 'ra'), authority) NOT IN (SELECT d, a FROM l) THEN 'unknown authority' END AS ae FROM r),
    g AS (SELECT unit_no, status, status = 'draft' AND len(se) = 0 AND re IS NULL AND ae IS NULL AS ok, array_to_string(list_sort(list_distinct(list_filter(list_concat(se, [re, ae]), lambda x: x IS NOT NULL))), ',') AS errors FROM e)"""
_UPDATES = "u AS (SELECT doc_id AS d, supersedes AS o, max(version) AS n FROM source_versions WHERE supersedes IS NOT NULL GROUP BY ALL)"
_DOC = "coalesce(source_ref.document, '_unknown')"
_RELATION = ", ".join(f"CASE WHEN {c} IS NULL THEN '{c} missing' END" for c in ("relation_id", "type", "source_rule", "target_rule", "condition", "resolution", "authority_basis", "registered_by"))
ORACLES = {
    "gate_checked": f"WITH {_GATE} SELECT unit_no, coalesce(ok, false) AS passed, CASE WHEN ok THEN 'verified' WHEN status = 'draft' THEN 'rejected' ELSE status END AS new_status, CASE WHEN coalesce(status <> 'draft', true) THEN 'only drafts are processed (current: ' || coalesce(status, 'none') || ')' ELSE errors END AS errors FROM g",
    "gate_applied": f"WITH {_GATE} SELECT unit_no, CASE WHEN ok THEN 'verified' ELSE status END AS status, CASE WHEN ok THEN '{STAMP}' END AS verified_at FROM g",
    "rules_decided": f"""WITH {base.RULES}, f AS (SELECT *, array_to_string(list_filter([CASE WHEN len(scope) = 0 THEN 'scope_completeness' END, CASE WHEN length(text) < 60 THEN 'semantic_accuracy' END], lambda x: x IS NOT NULL), ', ') AS bad FROM r)
        SELECT unit_no, CASE WHEN status <> 'verified' THEN status WHEN bad = '' THEN 'approved' ELSE 'rejected' END AS status, CASE WHEN status = 'verified' AND bad <> '' THEN 'failed in review: ' || bad ELSE rejection_reason END AS rejection_reason,
        CASE WHEN status = 'verified' AND bad = '' THEN '{REVIEWER}' ELSE approval.reviewer END AS reviewer FROM f""",
    "bundles_approved": f"""WITH {base.RULES}, p AS (SELECT {_DOC} AS doc, avg((len({base._RULE_ERRORS}) = 0)::int) AS rate FROM r WHERE status = 'verified' GROUP BY 1)
        SELECT unit_no, CASE WHEN status = 'verified' AND rate >= 0.9 THEN 'approved' ELSE status END AS status, CASE WHEN status = 'verified' AND rate >= 0.9 THEN '{REVIEWER}' ELSE approval.reviewer END AS reviewer FROM r LEFT JOIN p ON doc = {_DOC}""",
    "relations_listed": "SELECT relation_id, rel_no, type FROM relations WHERE relation_id IS NOT NULL AND status = 'approved'",
    "relations_created": f"""WITH e AS (SELECT rel_no, relation_id, array_to_string(list_filter([{_RELATION}, CASE WHEN NOT regexp_matches(relation_id, '^rel-[a-z0-9][a-z0-9\\-]+$') THEN 'relation_id' END,
            CASE WHEN type NOT IN ('overrides', 'excepts', 'supersedes', 'unresolved') THEN 'type' END, CASE WHEN length(condition) < 5 THEN 'condition' END, CASE WHEN length(resolution) < 10 THEN 'resolution' END], lambda x: x IS NOT NULL), ',') AS errors FROM relations),
        k AS (SELECT DISTINCT relation_id FROM relations WHERE status = 'suspended' AND relation_id IS NOT NULL),
        m AS (SELECT relation_id, min(rel_no) AS first FROM e WHERE errors = '' AND relation_id NOT IN (SELECT relation_id FROM k) GROUP BY 1)
        SELECT rel_no, CASE WHEN errors <> '' THEN errors WHEN rel_no = first THEN 'created' ELSE 'exists' END AS outcome FROM e LEFT JOIN m USING (relation_id)""",
    "relations_approved": f"""WITH w AS (SELECT DISTINCT relation_id FROM relations WHERE status IN ('draft', 'verified') AND relation_id IS NOT NULL), x AS (SELECT *, relation_id IS NOT NULL AND relation_id IN (SELECT relation_id FROM w) AND status IS DISTINCT FROM 'approved' AS t FROM relations)
        SELECT rel_no, CASE WHEN t THEN 'approved' ELSE status END AS status, CASE WHEN t THEN '{REVIEWER}' ELSE approval.reviewer END AS reviewer FROM x""",
    "versions_updated": f"""WITH {_UPDATES} SELECT d AS document, o AS old_version, n AS new_version, count(unit_no) AS rules_found, count(unit_no) FILTER (status = 'approved') AS rules_suspended
        FROM u LEFT JOIN rule_units ON source_ref.document = d AND source_ref.version = o GROUP BY ALL""",
    "relations_after_update": f"""WITH {_UPDATES}, a AS (SELECT unit_no, rule_id, CASE WHEN status = 'approved' AND n IS NOT NULL THEN 'suspended' ELSE status END AS status FROM rule_units LEFT JOIN u ON source_ref.document = d AND source_ref.version = o),
        st AS (SELECT rule_id, arg_max(status, unit_no) AS st FROM a WHERE rule_id IS NOT NULL GROUP BY 1)
        SELECT rel_no, CASE WHEN (coalesce(s.st, '') IN ('suspended', 'superseded') OR coalesce(t.st, '') IN ('suspended', 'superseded')) THEN CASE WHEN status = 'approved' THEN 'suspended' WHEN status IN ('draft', 'verified') THEN 'rejected' ELSE status END ELSE status END AS status
        FROM relations LEFT JOIN st s ON s.rule_id = source_rule LEFT JOIN st t ON t.rule_id = target_rule""",
    "rule_contexts": f"""WITH {base._EDGES}, c AS (SELECT parent, list_sort(list(child)) AS children FROM e GROUP BY 1), q AS (SELECT source_rule AS rule_id FROM relations UNION SELECT target_rule FROM relations UNION SELECT child FROM e),
        f AS (SELECT rule_id, CASE WHEN status NOT IN ('draft', 'rejected') THEN status END AS status FROM rule_units WHERE rule_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY unit_no) = 1),
        up AS (SELECT child AS rule_id, max(parent) AS parent FROM e GROUP BY 1),
        tied AS (SELECT rule_id, string_agg(rel_no::VARCHAR, '|' ORDER BY rel_no) AS relations FROM (SELECT rel_no, unnest(list_distinct([source_rule, target_rule])) AS rule_id FROM relations WHERE status = 'approved') GROUP BY 1)
        SELECT q.rule_id, status, up.parent, CASE WHEN own.parent IS NOT NULL OR up.parent IS NOT NULL THEN 'document' END AS hierarchy_type, coalesce(array_to_string(own.children, '|'), '') AS children,
            coalesce(array_to_string(list_filter(par.children, lambda x: x <> q.rule_id), '|'), '') AS siblings, coalesce(relations, '') AS relations
        FROM q LEFT JOIN f USING (rule_id) LEFT JOIN up USING (rule_id) LEFT JOIN c own ON own.parent = q.rule_id LEFT JOIN c par ON par.parent = up.parent LEFT JOIN tied USING (rule_id) WHERE q.rule_id IS NOT NULL""",
    "scope_shares": f"WITH {base.RULES} SELECT unit_no, round(({' + '.join(f'''contains(array_to_string(scope, ' '), '{w}')::int''' for w in base.QUERY.split())}) / {len(base.QUERY.split())}, 6) AS score FROM r",
    "scope_lists": f"WITH {base.RULES}, x AS (SELECT unit_no, len(scope) AS n, unnest(scope) AS item FROM r) SELECT 'single' AS kind, unit_no, item FROM x WHERE n = 1 UNION ALL SELECT 'broad', unit_no, item FROM x WHERE length(item) > 50",
    "scope_flags": f"SELECT concat_ws(',', CASE WHEN avg_scope_chars > 50 THEN 'long items' END, CASE WHEN broad_scope_pct > 0.2 THEN 'broad items' END) AS warnings FROM ({base.ORACLES['scope_figures']})",
    "queue_waiting": f"SELECT unit_no, {base._AGE} AS age_days FROM rule_units WHERE status = 'verified' AND {base._AGE} > 14",
    "queue_lines": f"""SELECT '{{"unit_no":' || unit_no || ',"domain":"' || coalesce(domain, 'unknown') || '","authority":' || coalesce('"' || authority || '"', 'null') || ',"age_days":' || ({base._AGE})::DOUBLE || '}}' AS line FROM rule_units WHERE status = 'verified'""",
    "vocabulary_ranked": "SELECT category, item, row_number() OVER (PARTITION BY category ORDER BY item_no) - 1 AS rank FROM scope_vocabulary",
    "registry_errors": f"WITH {_UPDATES} SELECT doc_id, count(*) AS n_versions FROM (SELECT doc_id, version FROM source_versions UNION SELECT d, n FROM u) GROUP BY 1",
    "ingest_summaries": f"""WITH {base._SECTIONS}, k AS (SELECT doc_id, max(authority_level) AS al FROM source_versions GROUP BY 1),
        c AS (SELECT doc_id, count(*) AS s, count(*) FILTER (level > 1 OR paras = 0) AS n FROM sec GROUP BY 1),
        x AS (SELECT unit_no, coalesce(s, 0) AS s, coalesce(n, 0) AS n, k.doc_id IS NOT NULL AS known, coalesce(al, '') <> '' AS lev FROM rule_units LEFT JOIN c ON c.doc_id = unit_no LEFT JOIN k ON k.doc_id = source_ref.document WHERE text IS NOT NULL),
        y AS (SELECT *, CASE WHEN NOT known THEN 'unknown document' WHEN NOT lev AND n > 0 THEN 'no authority level' END AS error FROM x)
        SELECT unit_no AS doc_id, s AS sections_found, n AS rule_candidates, n AS deterministic_count, CASE WHEN known AND lev THEN n ELSE 0 END AS drafts, error IS NULL AS success, error FROM y""",
    "migration_lines": f"SELECT concat_ws(' ', rel_no, '->', CASE WHEN candidates = '' THEN 'no candidate' ELSE candidates END, '(review)') AS line FROM ({base.ORACLES['migration']})",
}
