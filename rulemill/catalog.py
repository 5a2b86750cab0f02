"""The queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from rulemill.functions.looks import look_sql, plain_id_sql
from rulemill.plans import governance_cases, records, reference

FLAGSHIP = "search_scored"
QUERIES = {
    **reference.QUERIES,
    **records.QUERIES,
    "p4_found": governance_cases.p4_found,
    "p5_found": governance_cases.p5_found,
}
ORACLES = {
    **reference.ORACLES,
    **records.ORACLES,
    "p4_found": f"""
        WITH seen AS (
            SELECT snap_no, {plain_id_sql("rule_id")} AS rule_id, delivered_at, row_no, {look_sql("text")} AS t,
                {look_sql("source_ref.document")} AS d, {look_sql("source_ref.version")} AS v, {look_sql("source_ref.location")} AS l
            FROM rule_snapshots WHERE snap_no IS NOT NULL),
        last AS (SELECT * FROM seen WHERE rule_id <> '' QUALIFY row_number() OVER (PARTITION BY snap_no, rule_id ORDER BY delivered_at DESC, row_no DESC) = 1),
        steps AS (SELECT snap_no AS s, lead(snap_no) OVER (ORDER BY snap_no) AS n FROM (SELECT DISTINCT snap_no FROM last)),
        old AS (SELECT n AS snap_no, rule_id, t, d, v, l FROM last JOIN steps ON snap_no = s WHERE n IS NOT NULL),
        new AS (SELECT snap_no, rule_id, t, d, v, l FROM last WHERE snap_no IN (SELECT n FROM steps))
        SELECT snap_no, rule_id, CASE WHEN o.snap_no IS NULL THEN 'added' WHEN w.snap_no IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
        FROM old o FULL JOIN new w USING (snap_no, rule_id)
        WHERE o.snap_no IS NULL OR w.snap_no IS NULL
            OR (o.t, o.d, o.v, o.l) IS DISTINCT FROM (w.t, w.d, w.v, w.l)
    """,
    "p5_found": f"""
        WITH refs AS (
            SELECT 'relations' AS tbl_name, registered_at AS m, rel_no AS row_no, 'source_rule' AS field_name, {plain_id_sql("source_rule")} AS r FROM relations
            UNION ALL SELECT 'relations', registered_at, rel_no, 'target_rule', {plain_id_sql("target_rule")} FROM relations),
        rules AS (SELECT {plain_id_sql("rule_id")} AS r, ingested_at, withdrawn_at FROM rule_units),
        sources AS (SELECT unit_no, ingested_at AS m, nullif(trim(source_ref.document), '') AS d, nullif(trim(source_ref.version), '') AS v FROM rule_units)
        SELECT DISTINCT tbl_name, strftime(m, '%Y-%m') AS period_month, row_no, field_name FROM refs
        WHERE r <> '' AND m IS NOT NULL AND NOT EXISTS (
            SELECT 1 FROM rules WHERE rules.r = refs.r AND ingested_at < date_trunc('month', refs.m) + INTERVAL 1 MONTH
                AND (withdrawn_at IS NULL OR withdrawn_at >= date_trunc('month', refs.m) + INTERVAL 1 MONTH))
        UNION ALL
        SELECT DISTINCT 'rule_units', strftime(m, '%Y-%m'), unit_no, 'source_ref' FROM sources
        WHERE (d IS NOT NULL OR v IS NOT NULL) AND m IS NOT NULL AND NOT EXISTS (
            SELECT 1 FROM source_versions s WHERE (d IS NULL OR s.doc_id = d) AND (v IS NULL OR s.version = v)
                AND registered_at < date_trunc('month', sources.m) + INTERVAL 1 MONTH
                AND (withdrawn_at IS NULL OR withdrawn_at >= date_trunc('month', sources.m) + INTERVAL 1 MONTH))
    """,
}
