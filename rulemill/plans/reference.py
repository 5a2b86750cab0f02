"""Queries of the library over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemill import model
from rulemill.operators import checks, ingest, lifecycle, monitor, search
from rulemill.operators.snapshots import snapshot_steps
from rulemill.session import spread, table
from rulemill.streaming.increments import events_by_window

QUERY, FUZZY_QUERY, AS_OF = "기부 물품 한도", "의학서적 지원금", "2025-06-01T00:00:00"
LEVELS = [("ra", "law"), ("ra", "regulation"), ("ra", "guideline"), ("ra", "sop"), ("edu-legal", "law"), ("edu-legal", "regulation")]
_SCOPE = "list_filter(coalesce(scope, []), lambda x: x IS NOT NULL)"
RULES = f"r AS (SELECT * REPLACE (coalesce(text, '') AS text, {_SCOPE} AS scope) FROM rule_units)"


def _rules(s: SparkSession, d: str) -> DataFrame:
    return model.rules(s, d)


def _edges(s: SparkSession, d: str) -> DataFrame:
    """A hierarchy: a paragraph's main rule is the parent of its items."""
    ids = table(s, d, "rule_units").where(F.col("rule_id").rlike("-item[0-9]+$")).select("rule_id").distinct()
    return ids.select(F.regexp_replace("rule_id", "-item[0-9]+$", "-main").alias("parent"), F.col("rule_id").alias("child"))


_EDGES = "e AS (SELECT DISTINCT regexp_replace(rule_id, '-item[0-9]+$', '-main') AS parent, rule_id AS child FROM rule_units WHERE regexp_matches(rule_id, '-item[0-9]+$'))"


def search_scored(s: SparkSession, d: str) -> DataFrame:
    found = search.search(_rules(s, d), QUERY, "unit_no", table(s, d, "relations"), threshold=0.3, fuzzy=False)
    return found.select("unit_no", "score")


def search_fuzzy(s: SparkSession, d: str) -> DataFrame:
    return search.search(_rules(s, d), FUZZY_QUERY, "unit_no", threshold=0.2).select("unit_no", "score")


def search_top(s: SparkSession, d: str) -> DataFrame:
    found = search.search(_rules(s, d), QUERY, "unit_no", table(s, d, "relations"), threshold=0.3, fuzzy=False, domain="ra")
    return search.top(found, 5).select("unit_no", "rule_id", "score")


def _words_sql() -> tuple[str, str, str]:
    words = QUERY.split()
    df = ", ".join(f"sum((contains(array_to_string(scope, ' ') || ' ' || text, '{w}'))::int) AS d{i}" for i, w in enumerate(words))
    idf = ", ".join(f"CASE WHEN d{i} > 0 THEN greatest(ln(n / d{i}), 0.1) ELSE ln(n + 1) END AS w{i}" for i in range(len(words)))
    parts = " + ".join(f"w{i} * (0.6 * (len(list_filter(scope, lambda x: contains(x, '{w}'))) > 0)::int + 0.4 * contains(text, '{w}')::int)" for i, w in enumerate(words))
    total = " + ".join(f"w{i}" for i in range(len(words)))
    named = " OR ".join(f"contains(condition, '{w}')" for w in words)
    with_ = f"""{RULES}, c AS (SELECT count(*) AS n, {df} FROM r), k AS (SELECT {idf} FROM c),
        pairs AS (SELECT least(coalesce(source_rule, ''), coalesce(target_rule, '')) AS a, greatest(coalesce(source_rule, ''), coalesce(target_rule, '')) AS b, arg_min(condition, rel_no) AS condition
            FROM relations WHERE status = 'approved' AND length(trim(condition)) >= 5 GROUP BY 1, 2),
        hits AS (SELECT rule_id, count(*) AS h FROM (SELECT DISTINCT a, b, unnest(list_distinct([a, b])) AS rule_id FROM pairs WHERE {named}) WHERE rule_id <> '' GROUP BY 1)"""
    score = f"round(({parts}) / ({total}) + least(coalesce(h, 0) / {len(words)}.0 * 0.1, 0.1), 6)"
    return with_, score, "r CROSS JOIN k LEFT JOIN hits USING (rule_id)"


def citations(s: SparkSession, d: str) -> DataFrame:
    asked = table(s, d, "relations").select(F.explode(F.array("source_rule", "target_rule")).alias("rule_id")).where("rule_id IS NOT NULL").distinct()
    return search.cite(asked, _rules(s, d), "unit_no")


def rule_public(s: SparkSession, d: str) -> DataFrame:
    return search.public(_rules(s, d), ["unit_no", "rule_id", "authority", "status"])


def rule_context(s: SparkSession, d: str) -> DataFrame:
    return search.context(_rules(s, d).where("rule_id IS NOT NULL"), _edges(s, d), table(s, d, "relations"), "unit_no")


def rule_siblings(s: SparkSession, d: str) -> DataFrame:
    return search.siblings(_edges(s, d))


def parents_restored(s: SparkSession, d: str) -> DataFrame:
    found = search.search(_rules(s, d), QUERY, "unit_no", threshold=0.3, fuzzy=False).select("rule_id").where("rule_id IS NOT NULL").distinct()
    return search.restore_parents(found, _edges(s, d), _rules(s, d).where("rule_id IS NOT NULL"), "unit_no").select("rule_id", "unit_no")


def relation_orphans(s: SparkSession, d: str) -> DataFrame:
    states = search.latest_status(_rules(s, d).where("rule_id IS NOT NULL"), "unit_no")
    return lifecycle.cascade(lifecycle.orphan_relations(table(s, d, "relations"), states)).select("rel_no", "reason", "new_status")


def migration(s: SparkSession, d: str) -> DataFrame:
    doc = "tvx-edu"
    new = _rules(s, d).where(F.col("source_ref.version") == "v2.0")
    guide = lifecycle.migration_guide(table(s, d, "relations").drop("relation_id").withColumnRenamed("rel_no", "relation_id"), new, doc)
    return guide.withColumnRenamed("relation_id", "rel_no")


def changed_since(s: SparkSession, d: str) -> DataFrame:
    """Every snapshot as a listing, the one before it as its manifest; a file is a rule of a snapshot."""
    states = table(s, d, "rule_snapshots").groupBy("snap_no", "rule_id").agg(F.md5(F.max(F.coalesce("text", F.lit("")))).alias("modified_at"))
    steps = F.broadcast(snapshot_steps(table(s, d, "rule_snapshots"), "snap_no"))  # one row a delivery
    name = lambda n: F.concat_ws("/", F.col(n).cast("string"), F.coalesce("rule_id", F.lit("-")))
    own = states.join(F.broadcast(steps.select(F.col("to").alias("snap_no"))), "snap_no", "left_semi").select(name("snap_no").alias("file_id"), "modified_at")
    before = states.join(steps.withColumnRenamed("s", "snap_no"), "snap_no").select(name("to").alias("file_id"), "modified_at")
    return lifecycle.changed_files(own, before)


def drafts_inserted(s: SparkSession, d: str) -> DataFrame:
    have = _rules(s, d).where("rule_id IS NOT NULL").select("rule_id").distinct()
    new = table(s, d, "draft_units").where("rule_id IS NOT NULL").select("rule_id")
    return lifecycle.insert_absent(have, new, "rule_id")


def rule_errors(s: SparkSession, d: str) -> DataFrame:
    return _rules(s, d).select("unit_no", F.array_join(checks.rule_schema_errors(), ",").alias("errors")).where("errors <> ''")


def relation_errors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "relations").select("rel_no", F.array_join(checks.relation_schema_errors(), ",").alias("errors")).where("errors <> ''")


def source_errors(s: SparkSession, d: str) -> DataFrame:
    return checks.source_errors(_rules(s, d), table(s, d, "source_versions"), "unit_no")


def authority_errors(s: SparkSession, d: str) -> DataFrame:
    return checks.authority_errors(_rules(s, d), s.createDataFrame(LEVELS, "domain string, level string"), "unit_no")


def repeated_ids(s: SparkSession, d: str) -> DataFrame:
    return checks.repeated(_rules(s, d), "rule_id")


def validation_totals(s: SparkSession, d: str) -> DataFrame:
    failing = rule_errors(s, d).select("unit_no").union(source_errors(s, d).select("unit_no")).distinct().withColumn("bad", F.lit(1))
    seen = _rules(s, d).select("unit_no", "rule_id").join(failing, "unit_no", "left")
    return seen.agg(F.count("*").alias("scanned"), (F.count("*") - F.count("bad")).alias("passed"), F.count_distinct("rule_id").alias("unique_ids"))


def checklist_gaps(s: SparkSession, d: str) -> DataFrame:
    items = ["semantic_accuracy", "scope_completeness", "authority_correctness", "relation_validity"]
    rows = _rules(s, d).where("approval IS NOT NULL")
    return rows.select("unit_no", F.size(checks.checklist_errors(F.col("approval.gate2_checklist"), items)).cast("long").alias("n_gaps"))


def ratio_duplicates(s: SparkSession, d: str) -> DataFrame:
    """Drafts against all rules by the Ratcliff/Obershelp ratio."""
    return checks.duplicates(spread(table(s, d, "draft_units")).where("rule_id IS NOT NULL AND text IS NOT NULL"), table(s, d, "rule_units").where("rule_id IS NOT NULL AND text IS NOT NULL"), "unit_no")


def text_fidelity(s: SparkSession, d: str) -> DataFrame:
    """Later deliveries of a rule against its first text."""
    kept = search.first_by_id(_rules(s, d).where("rule_id IS NOT NULL").select("rule_id", "unit_no", "text"), "unit_no").select("rule_id", F.col("text").alias("source"))
    return checks.fidelity(_rules(s, d).select("unit_no", "rule_id", "text").join(kept, "rule_id"), "unit_no", "text", "source")


def queue(s: SparkSession, d: str) -> DataFrame:
    return monitor.queue_report(_rules(s, d), "unit_no", AS_OF).drop("rule_id")


def queue_figures(s: SparkSession, d: str) -> DataFrame:
    return monitor.queue_warnings(monitor.queue_report(_rules(s, d), "unit_no", AS_OF))


def scope_figures(s: SparkSession, d: str) -> DataFrame:
    return monitor.scope_metrics(_rules(s, d).where("status = 'approved'"))


def review_groups(s: SparkSession, d: str) -> DataFrame:
    return monitor.groups_by_document(_rules(s, d))


def tokens_saved(s: SparkSession, d: str) -> DataFrame:
    rules = _rules(s, d)
    return monitor.token_savings(rules, search.search(rules, QUERY, "unit_no", threshold=0.3, fuzzy=False))


def vocabulary_share(s: SparkSession, d: str) -> DataFrame:
    return monitor.vocabulary_consistency(_rules(s, d), "scope", table(s, d, "scope_vocabulary"), "item")


def relation_lines(s: SparkSession, d: str) -> DataFrame:
    return monitor.relation_table(table(s, d, "relations").withColumn("relation_id", F.coalesce("relation_id", F.lit("")))).distinct()


def parsed_sections(s: SparkSession, d: str) -> DataFrame:
    return ingest.sections(_rules(s, d).select("unit_no", "text"), "unit_no", "text")


def rule_candidates(s: SparkSession, d: str) -> DataFrame:
    return ingest.candidates(parsed_sections(s, d)).select("doc_id", "rule_id", "location", "needs_review")


def scopes_found(s: SparkSession, d: str) -> DataFrame:
    rows = _rules(s, d).select("unit_no", "text", F.lit("").alias("heading"), F.coalesce("source_ref.location", F.lit("")).alias("location"))
    return ingest.scope_of(spread(rows), "unit_no", "text", "heading", "location", table(s, d, "scope_vocabulary")).select("unit_no", F.array_join("scope", "|").alias("scope"))


def event_windows(s: SparkSession, d: str) -> DataFrame:
    return events_by_window(table(s, d, "events")).withColumn("total", F.round("total", 4))


_with, _score, _from = _words_sql()
_CITE = """CASE status WHEN 'superseded' THEN '[대체됨: ' || rule_id || '] 이 규칙은 ' || coalesce(superseded_by, 'unknown') || ' 규칙으로 대체되었습니다.'
    WHEN 'suspended' THEN '[재검토중: ' || rule_id || '] 이 규칙은 현재 재검토 중입니다.'
    WHEN 'approved' THEN '[근거: ' || rule_id || '] ' || {t} WHEN 'verified' THEN '[미승인] 자동검증 완료, 인간 승인 대기중. [근거: ' || rule_id || '] ' || {t} END""".format(t=r"regexp_replace(text, '^[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\x{85}]+|[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\x{85}]+$', '', 'g')")
_RULE_ERRORS = """list_filter([CASE WHEN coalesce(NOT regexp_matches(rule_id, '^[a-z0-9][a-z0-9\\-]+$'), true) THEN 'rule_id' END, CASE WHEN length(text) < 10 THEN 'text' END,
    CASE WHEN source_ref.document IS NULL OR source_ref.version IS NULL OR source_ref.location IS NULL THEN 'source_ref' END, CASE WHEN len(scope) < 1 THEN 'scope' END,
    CASE WHEN coalesce(length(authority) < 1, true) THEN 'authority' END, CASE WHEN domain IS NOT NULL AND NOT regexp_matches(domain, '^[a-z][a-z0-9\\-]*$') THEN 'domain' END,
    CASE WHEN coalesce(status NOT IN ('draft', 'verified', 'approved', 'suspended', 'superseded', 'rejected'), true) THEN 'status' END,
    CASE WHEN coalesce(status = 'approved' AND approval IS NULL, true) THEN 'approval' END, CASE WHEN coalesce(status = 'superseded' AND superseded_by IS NULL, true) THEN 'superseded_by' END,
    CASE WHEN coalesce(status = 'rejected' AND rejection_reason IS NULL, true) THEN 'rejection_reason' END], lambda x: x IS NOT NULL)"""
_SOURCE = """SELECT unit_no, CASE WHEN NOT EXISTS (SELECT 1 FROM source_versions s WHERE s.doc_id = source_ref.document) THEN 'unknown document: ' || coalesce(source_ref.document, '')
    WHEN NOT EXISTS (SELECT 1 FROM source_versions s WHERE s.doc_id = source_ref.document AND s.version = source_ref.version) THEN 'unknown version: ' || coalesce(source_ref.version, '') END AS error FROM rule_units"""
_LEVELS = ", ".join(f"('{a}', '{b}')" for a, b in LEVELS)
_AGE = f"round(coalesce((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(TRY_CAST(verified_at AS TIMESTAMPTZ))) / 86400e6, 0), 1)"

QUERIES = {
    f.__name__: f
    for f in (
        search_scored, search_fuzzy, search_top, citations, rule_public, rule_context, rule_siblings, parents_restored, relation_orphans, migration, changed_since,
        drafts_inserted, rule_errors, relation_errors, source_errors, authority_errors, repeated_ids, validation_totals, checklist_gaps, ratio_duplicates, text_fidelity,
        queue, queue_figures, scope_figures, review_groups, tokens_saved, vocabulary_share, relation_lines, parsed_sections, rule_candidates, scopes_found, event_windows,
    )
}
_VISIBLE = "status IN ('approved', 'verified')"
_TOKENS = "greatest(len(regexp_extract_all(text, '[가-힣ㄱ-ㆎ一-鿿]')) + len(regexp_extract_all(text, '[A-Za-z0-9]+')), 1)"
_LAST = "st AS (SELECT rule_id, arg_max(status, unit_no) AS st FROM rule_units WHERE rule_id IS NOT NULL GROUP BY 1)"
_SECTIONS = r"""
    raw AS (SELECT unit_no AS doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM rule_units WHERE text IS NOT NULL),
    l0 AS (SELECT doc_id, n, regexp_replace(line, '^[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\x{85}]+|[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\x{85}]+$', '', 'g') AS line FROM raw),
    l1 AS (SELECT *, regexp_matches(line, '^제[0-9]+조\s*[(（]')::int AS art FROM l0),
    l2 AS (SELECT *, sum(art) OVER (PARTITION BY doc_id ORDER BY n) AS article_seq FROM l1),
    l3 AS (SELECT *, (art = 0 AND regexp_matches(line, '^[①②③④⑤⑥⑦⑧⑨⑩]'))::int AS par FROM l2 WHERE article_seq > 0),
    l4 AS (SELECT *, sum(par) OVER (PARTITION BY doc_id, article_seq ORDER BY n) AS para_seq FROM l3),
    l5 AS (SELECT *, (par = 0 AND para_seq > 0 AND regexp_matches(line, '^[0-9]+\.\s'))::int AS itm FROM l4),
    l6 AS (SELECT *, sum(itm) OVER (PARTITION BY doc_id, article_seq, para_seq ORDER BY n) AS item_seq FROM l5),
    l7 AS (SELECT *, CASE WHEN art + par + itm > 0 THEN 'head' WHEN line = '' THEN 'blank' WHEN item_seq > 0 AND regexp_matches(line, '^[가나다라마바사아자차카타파하]\.\s') THEN 'sub' ELSE 'body' END AS kind FROM l6),
    l8 AS (SELECT *, last_value(nullif(kind, 'blank') IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(nullif(kind, 'blank') IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a,
        max(para_seq) OVER (PARTITION BY doc_id, article_seq) AS paras FROM l7 WINDOW w AS (PARTITION BY doc_id, article_seq, para_seq, item_seq ORDER BY n)),
    l9 AS (SELECT * FROM l8 WHERE (kind <> 'blank' OR (b = 'body' AND a = 'body')) AND (kind = 'head' OR para_seq > 0 OR paras = 0)),
    g AS (SELECT doc_id, article_seq, para_seq, item_seq, string_agg(line, chr(10) ORDER BY n) AS text, arg_min(line, n) AS f FROM l9 GROUP BY ALL),
    h AS (SELECT *, CASE WHEN item_seq > 0 THEN 3 WHEN para_seq > 0 THEN 2 ELSE 1 END AS level,
        CASE WHEN item_seq > 0 THEN regexp_extract(f, '^([0-9]+)\.', 1)::int WHEN para_seq > 0 THEN instr('①②③④⑤⑥⑦⑧⑨⑩', f[1:1])::int ELSE regexp_extract(f, '^제([0-9]+)조', 1)::int END AS number FROM g),
    sec AS (SELECT *, max(CASE level WHEN 1 THEN number END) OVER (PARTITION BY doc_id, article_seq) AS an, max(CASE level WHEN 2 THEN number END) OVER (PARTITION BY doc_id, article_seq, para_seq) AS pn,
        max(para_seq) OVER (PARTITION BY doc_id, article_seq) AS paras, sum((level = 3)::int) OVER (PARTITION BY doc_id, article_seq, para_seq) AS items,
        max((contains(text, '다음 각 호') OR contains(text, '다음 각 목') OR contains(text, '다음 사항'))::int) OVER (PARTITION BY doc_id, article_seq, para_seq) AS marked FROM h)"""
_PLACE = "'제' || an || '조' || CASE WHEN level > 1 THEN ' 제' || pn || '항' ELSE '' END || CASE WHEN level > 2 THEN ' 제' || number || '호' ELSE '' END"
ORACLES = {
    "search_scored": f"WITH {_with} SELECT unit_no, {_score} AS score FROM {_from} WHERE {_VISIBLE} AND {_score} >= 0.3",
    "search_top": f"WITH {_with} SELECT unit_no, rule_id, {_score} AS score FROM {_from} WHERE {_VISIBLE} AND coalesce(nullif(domain, ''), 'ra') = 'ra' AND {_score} >= 0.3 ORDER BY score DESC, unit_no LIMIT 5",
    "citations": f"""WITH {RULES}, f AS (SELECT * FROM r WHERE rule_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY unit_no) = 1),
        q AS (SELECT source_rule AS rule_id FROM relations WHERE source_rule IS NOT NULL UNION SELECT target_rule FROM relations WHERE target_rule IS NOT NULL)
        SELECT rule_id, status, {_CITE} AS citation, coalesce(status IN ('approved', 'verified'), false) AS citable FROM q LEFT JOIN f USING (rule_id)""",
    "rule_public": "SELECT unit_no, rule_id, authority, status FROM rule_units WHERE status NOT IN ('draft', 'rejected')",
    "rule_context": f"""WITH {_EDGES}, f AS (SELECT rule_id, status NOT IN ('draft', 'rejected') AS shown FROM rule_units WHERE rule_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY unit_no) = 1),
        up AS (SELECT child AS rule_id, min(parent) AS parent FROM e GROUP BY 1), down AS (SELECT parent AS rule_id, count(*) AS n_children FROM e GROUP BY 1),
        tied AS (SELECT rule_id, count(*) AS n_relations FROM (SELECT rel_no, unnest(list_distinct([source_rule, target_rule])) AS rule_id FROM relations WHERE status = 'approved') GROUP BY 1)
        SELECT rule_id, shown, parent, coalesce(n_children, 0) AS n_children, coalesce(n_relations, 0) AS n_relations FROM f LEFT JOIN up USING (rule_id) LEFT JOIN down USING (rule_id) LEFT JOIN tied USING (rule_id)""",
    "rule_siblings": f"WITH {_EDGES} SELECT x.child, y.child AS sibling FROM e x JOIN e y ON x.parent = y.parent AND x.child <> y.child",
    "parents_restored": f"""WITH {_with}, {_EDGES}, p AS (SELECT DISTINCT rule_id FROM {_from.replace(' LEFT JOIN hits USING (rule_id)', '')} WHERE {_VISIBLE} AND rule_id IS NOT NULL AND {_score.replace(' + least(coalesce(h, 0) / 3.0 * 0.1, 0.1)', '')} >= 0.3)
        SELECT rule_id, min(unit_no) AS unit_no FROM rule_units WHERE rule_id IN (SELECT parent FROM e JOIN p ON child = rule_id) AND rule_id NOT IN (SELECT rule_id FROM p) GROUP BY 1""",
    "relation_orphans": f"""WITH {_LAST} SELECT rel_no, concat_ws('; ', CASE WHEN s.st IN ('suspended', 'superseded') THEN 'source_rule ''' || source_rule || ''' is ' || s.st END, CASE WHEN t.st IN ('suspended', 'superseded') THEN 'target_rule ''' || target_rule || ''' is ' || t.st END) AS reason,
        CASE WHEN status = 'approved' THEN 'suspended' WHEN status IN ('draft', 'verified') THEN 'rejected' ELSE status END AS new_status
        FROM relations LEFT JOIN st s ON s.rule_id = source_rule LEFT JOIN st t ON t.rule_id = target_rule WHERE status NOT IN ('rejected', 'suspended') AND (s.st IN ('suspended', 'superseded') OR t.st IN ('suspended', 'superseded'))""",
    "migration": """WITH n AS (SELECT substr(rule_id, 9) AS x, max(rule_id) AS id FROM rule_units WHERE starts_with(rule_id, 'tvx-edu-') AND source_ref.version = 'v2.0' GROUP BY 1)
        SELECT rel_no, array_to_string(list_distinct(list_filter([a.id, b.id], lambda x: x IS NOT NULL)), ',') AS candidates, true AS human_review FROM relations
        LEFT JOIN n a ON starts_with(source_rule, 'tvx-edu-') AND a.x = substr(source_rule, 9) LEFT JOIN n b ON starts_with(target_rule, 'tvx-edu-') AND b.x = substr(target_rule, 9)
        WHERE status = 'suspended' AND (starts_with(source_rule, 'tvx-edu-') OR starts_with(target_rule, 'tvx-edu-'))""",
    "changed_since": """WITH s AS (SELECT snap_no, coalesce(rule_id, '-') AS r, md5(max(coalesce(text, ''))) AS modified_at FROM rule_snapshots GROUP BY 1, rule_id), n AS (SELECT snap_no AS p, lead(snap_no) OVER (ORDER BY snap_no) AS snap_no FROM (SELECT DISTINCT snap_no FROM s)),
        b AS (SELECT n.snap_no, r, modified_at AS m FROM s JOIN n ON s.snap_no = p WHERE n.snap_no IS NOT NULL)
        SELECT s.snap_no || '/' || s.r AS file_id, modified_at FROM s LEFT JOIN b ON b.snap_no = s.snap_no AND b.r = s.r WHERE s.snap_no IN (SELECT snap_no FROM n) AND (b.r IS NULL OR m IS DISTINCT FROM modified_at)""",
    "drafts_inserted": "SELECT rule_id FROM rule_units WHERE rule_id IS NOT NULL UNION SELECT rule_id FROM draft_units WHERE rule_id IS NOT NULL",
    "rule_errors": f"WITH {RULES} SELECT unit_no, array_to_string({_RULE_ERRORS}, ',') AS errors FROM r WHERE len({_RULE_ERRORS}) > 0",
    "relation_errors": """WITH x AS (SELECT rel_no, list_filter([%s, CASE WHEN NOT regexp_matches(relation_id, '^rel-[a-z0-9][a-z0-9\\-]+$') THEN 'relation_id' END, CASE WHEN type NOT IN ('overrides', 'excepts', 'supersedes', 'unresolved') THEN 'type' END,
        CASE WHEN length(condition) < 5 THEN 'condition' END, CASE WHEN length(resolution) < 10 THEN 'resolution' END, CASE WHEN status NOT IN ('draft', 'verified', 'approved', 'suspended', 'rejected') THEN 'status' END,
        CASE WHEN status = 'approved' AND approval IS NULL THEN 'approval' END, CASE WHEN status = 'suspended' AND suspension_reason IS NULL THEN 'suspension_reason' END], lambda x: x IS NOT NULL) AS e FROM relations)
        SELECT rel_no, array_to_string(e, ',') AS errors FROM x WHERE len(e) > 0"""
    % ", ".join(f"CASE WHEN {c} IS NULL THEN '{c} missing' END" for c in ("relation_id", "type", "source_rule", "target_rule", "condition", "resolution", "authority_basis", "registered_by", "status")),
    "source_errors": f"SELECT * FROM ({_SOURCE}) WHERE error IS NOT NULL",
    "authority_errors": f"""WITH l(d, a) AS (VALUES {_LEVELS}), r AS (SELECT unit_no, authority, coalesce(nullif(domain, ''), 'ra') AS d FROM rule_units),
        x AS (SELECT unit_no, CASE WHEN d NOT IN (SELECT d FROM l) THEN 'no authority levels' WHEN coalesce(authority, '') = '' THEN 'authority missing' WHEN (d, authority) NOT IN (SELECT d, a FROM l) THEN 'unknown authority' END AS error FROM r)
        SELECT * FROM x WHERE error IS NOT NULL""",
    "repeated_ids": "SELECT rule_id, count(*) AS n FROM rule_units WHERE rule_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "validation_totals": f"WITH {RULES}, bad AS (SELECT unit_no FROM r WHERE len({_RULE_ERRORS}) > 0 UNION SELECT unit_no FROM ({_SOURCE}) WHERE error IS NOT NULL) SELECT count(*) AS scanned, count(*) - count(bad.unit_no) AS passed, count(DISTINCT rule_id) AS unique_ids FROM rule_units LEFT JOIN bad USING (unit_no)",
    "checklist_gaps": """SELECT unit_no, len(list_filter(['semantic_accuracy', 'scope_completeness', 'authority_correctness', 'relation_validity'], lambda k: NOT coalesce(approval.gate2_checklist[k] IN ('pass', 'fail'), false))) AS n_gaps FROM rule_units WHERE approval IS NOT NULL""",
    "queue": f"WITH {RULES} SELECT unit_no, coalesce(domain, 'unknown') AS domain, authority, CASE WHEN length(text) > 80 THEN text[1:80] || '...' ELSE text END AS snippet, {_AGE} AS age_days FROM r WHERE status = 'verified'",
    "queue_figures": f"SELECT count(*) AS n_queued, count(*) FILTER ({_AGE} > 14) AS n_old, count(*) > 10 AS too_long FROM rule_units WHERE status = 'verified'",
    "scope_figures": f"""WITH {RULES}, p AS (SELECT len(scope) AS n, coalesce(list_sum(list_transform(scope, lambda x: length(x))), 0) AS c, len(list_filter(scope, lambda x: length(x) > 50)) AS b FROM r WHERE status = 'approved')
        SELECT count(*) AS total_rules, sum(n)::BIGINT AS total_scope_items, round(sum(c) / greatest(sum(n), 1), 1) AS avg_scope_chars, count(*) FILTER (n = 1) AS single_scope_count, sum(b)::BIGINT AS broad_scope_count, round(sum(b) / greatest(count(*), 1), 3) AS broad_scope_pct FROM p""",
    "review_groups": "SELECT coalesce(source_ref.document, '_unknown') AS document, count(*) AS n, CASE WHEN count(*) <= 5 THEN count(*) ELSE greatest(ceil(count(*) / 10.0), 5)::BIGINT END AS sample, true AS accepted FROM rule_units WHERE status = 'verified' GROUP BY 1",
    "tokens_saved": f"WITH {_with}, b AS (SELECT sum({_TOKENS})::BIGINT AS before FROM r), a AS (SELECT coalesce(sum({_TOKENS}), 0)::BIGINT AS after FROM {_from.replace(' LEFT JOIN hits USING (rule_id)', '')} WHERE {_VISIBLE} AND {_score.replace(' + least(coalesce(h, 0) / 3.0 * 0.1, 0.1)', '')} >= 0.3) SELECT before, after, round((1 - after / before) * 100, 1) AS saved_pct FROM b, a",
    "vocabulary_share": f"""WITH {RULES}, w AS (SELECT DISTINCT unnest(string_split(item, ' ')) AS w FROM scope_vocabulary), k AS (SELECT list(w) AS ws FROM w WHERE length(w) >= 3), i AS (SELECT unnest(scope) AS item FROM r)
        SELECT round(avg((len(list_filter(regexp_split_to_array(item, '[\\s\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{85}}]+'), lambda x: length(x) >= 3 AND list_contains(ws, x))) > 0)::int), 6) AS consistency FROM i, k""",
    "relation_lines": """SELECT DISTINCT coalesce(relation_id, '') AS relation_id, rtrim(concat_ws(' ', rpad(coalesce(relation_id, ''), 20, ' '), rpad(coalesce(type, ''), 12, ' '), rpad(coalesce(status, ''), 10, ' '), rpad(coalesce(source_rule, ''), 30, ' '), rpad(coalesce(target_rule, ''), 30, ' ')), ' ') AS line FROM relations""",
    "parsed_sections": f"WITH {_SECTIONS} SELECT doc_id, article_seq::BIGINT AS article_seq, para_seq::BIGINT AS para_seq, item_seq::BIGINT AS item_seq, level, number, CASE level WHEN 1 THEN f WHEN 2 THEN f[1:1] ELSE f[1:instr(f, '.')] END AS heading, text, {_PLACE} AS location FROM sec",
    "rule_candidates": f"WITH {_SECTIONS} SELECT doc_id, doc_id || '-art' || an || '-p' || coalesce(pn, 1) || '-' || CASE level WHEN 3 THEN 'item' || number ELSE 'main' END AS rule_id, {_PLACE} AS location, level = 2 AND items >= 2 AND marked = 1 AS needs_review FROM sec WHERE level > 1 OR paras = 0",
    "scopes_found": """WITH v AS (SELECT item_no, item, list_filter(string_split(item, ' '), lambda w: length(w) >= 2) AS ws FROM scope_vocabulary),
        m AS (SELECT unit_no, string_agg(item, '|' ORDER BY item_no) AS scope FROM rule_units, v WHERE len(ws) > 0 AND len(list_filter(ws, lambda w: contains(coalesce(text, ''), w))) >= greatest(1, len(ws) // 2) GROUP BY 1)
        SELECT unit_no, coalesce(m.scope, CASE WHEN regexp_matches(coalesce(source_ref.location, ''), '제[0-9]+조') THEN regexp_extract(source_ref.location, '제[0-9]+조') ELSE coalesce(source_ref.location, '') END || ' 적용 범위') AS scope FROM rule_units LEFT JOIN m USING (unit_no)""",
    "event_windows": "SELECT date_trunc('day', ts)::TIMESTAMPTZ AS begin, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
