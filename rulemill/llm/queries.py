"""The queries of the training-text operators and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemill.functions.looks import look_sql, plain_id_sql
from rulemill.llm.history import draft_cases
from rulemill.llm.leakage import leaked_items
from rulemill.llm.near_duplicates import near_duplicate_groups
from rulemill.llm.packing import CAPACITY, packed_documents
from rulemill.llm.personal import find_places, redact
from rulemill.llm.uniform import spelling_cases
from rulemill.session import cut, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_cases(table(spark, sf_dir, "rule_units"), table(spark, sf_dir, "scope_vocabulary"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "rule_units"), "unit_no", "text", 0.7)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draft_cases(table(spark, sf_dir, "rule_units"), table(spark, sf_dir, "draft_units"), 0.7)


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


def p6_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row about p6_packed: documents with text, those whose pieces are not numbered from 1 on without a gap, containers above the capacity, needless cuts, and whether no more than 1 % of containers could be saved."""
    packed = p6_packed(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id")
    whole = packed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.max("piece_no").alias("last"))
    broken = docs.join(whole, "doc_id", "left").where("pieces IS NULL OR pieces <> last").agg(F.count("*").alias("broken"))
    rooms = packed.groupBy("container_no").agg(F.sum("n_tokens").alias("n"))
    full = rooms.agg(F.count_if(F.col("n") > CAPACITY).alias("overfull"), (F.count("*") <= F.ceil(F.sum("n") / CAPACITY) * 1.01 + 1).alias("tight"))
    needless = packed.groupBy("doc_id").agg(F.count("*").alias("c"), F.sum("n_tokens").alias("n")).agg(F.count_if((F.col("c") > 1) & (F.col("n") <= CAPACITY)).alias("needless"))
    return docs.agg(F.count("*").alias("documents")).crossJoin(broken).crossJoin(full).crossJoin(needless)  # one row each


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row about p8_redacted: documents, null texts, and documents whose placeholders are not as many as their places."""
    documents = table(spark, sf_dir, "documents")
    places = cut(find_places(documents))
    marks = lambda c: F.regexp_count(c, F.lit(r"\[(?:EMAIL|PHONE|ID_NUMBER|ADDRESS|NAME):"))
    done = redact(documents, b"test key", places).select("doc_id", F.col("text").alias("after"))
    met = documents.select("doc_id", "text").join(done, "doc_id").join(places.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left")
    wrong = F.count_if(F.coalesce(marks(F.col("after")) - marks(F.col("text")), F.lit(0)) != F.coalesce("n", F.lit(0)))
    return met.agg(F.count("*").alias("documents"), F.count_if(F.col("after").isNull()).alias("null_texts"), wrong.alias("wrong"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_places(table(spark, sf_dir, "documents")).select("doc_id", "pii_kind", "start_pos").distinct()


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(table(spark, sf_dir, "documents"), b"test key")


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p3_found, p6_packed, p6_invariants, p7_found, p8_found, p8_redacted, p8_invariants)}


def _letters(text: str) -> str:
    return f"regexp_replace(lower({look_sql(text)}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


#: All pairs with a similarity of 0.7 or more among rows t (unit_no, l): brute force over shared runs.
_SIMILAR = """
    s AS (SELECT DISTINCT unit_no, l[k:k + 3] AS g FROM (SELECT unit_no, l, unnest(range(1, length(l) - 2)) AS k FROM t WHERE length(l) >= 40)), z AS (SELECT unit_no, count(*) AS n FROM s GROUP BY 1),
    c AS (SELECT a.unit_no AS a, b.unit_no AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.unit_no < b.unit_no GROUP BY ALL),
    e AS (SELECT a, b FROM c JOIN z x ON x.unit_no = a JOIN z y ON y.unit_no = b WHERE c / (x.n + y.n - c) >= 0.7 - 1e-12)"""
ORACLES = {
    "p1_found": f"""
        WITH t AS (SELECT unit_no, text, {look_sql("text")} AS f FROM rule_units WHERE text IS NOT NULL),
        s AS (SELECT DISTINCT unit_no, i, {look_sql("i")} AS f FROM (SELECT unit_no, unnest(scope) AS i FROM rule_units)),
        v AS (SELECT item_no, item, {look_sql("item")} AS f FROM scope_vocabulary)
        SELECT 'text' AS field_name, a.unit_no AS key_a, b.unit_no AS key_b FROM t a JOIN t b ON a.f = b.f AND a.unit_no < b.unit_no AND a.text <> b.text
        UNION ALL SELECT DISTINCT 'scope', unit_no, item_no FROM s JOIN v USING (f) WHERE i <> item
    """,
    "p2_found": f"""
        WITH RECURSIVE u AS (SELECT unit_no, NULL::INT AS batch_no, rule_id, source_ref, text FROM rule_units UNION ALL SELECT unit_no, batch_no, rule_id, source_ref, text FROM draft_units WHERE batch_no IS NOT NULL),
        t AS (SELECT unit_no, {_letters("text")} AS l FROM u WHERE text IS NOT NULL), {_SIMILAR},
        i AS (SELECT unit_no, {plain_id_sql("rule_id")} AS r, source_ref.version AS v FROM u WHERE rule_id IS NOT NULL AND source_ref.version IS NOT NULL),
        p AS (SELECT a, b FROM e UNION SELECT x.unit_no, y.unit_no FROM i x JOIN i y ON x.r = y.r AND x.v = y.v AND x.r <> '' AND x.unit_no < y.unit_no),
        q AS (SELECT a AS own, b AS other FROM p UNION SELECT b, a FROM p),
        d AS (SELECT unit_no, row_number() OVER (ORDER BY batch_no, unit_no) AS k FROM draft_units WHERE batch_no IS NOT NULL AND unit_no IS NOT NULL),
        m AS (SELECT d.k, d.unit_no, min(other) FILTER (o.k IS NULL) AS old, coalesce(list(other) FILTER (o.k < d.k), []) AS earlier FROM d LEFT JOIN q ON own = d.unit_no LEFT JOIN d o ON o.unit_no = other GROUP BY ALL),
        run AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS taken, NULL::BIGINT AS kept_no, NULL::BIGINT AS unit_no
            UNION ALL SELECT m.k, CASE WHEN old IS NOT NULL OR len(list_intersect(earlier, taken)) > 0 THEN taken ELSE list_append(taken, m.unit_no) END, least(old, list_min(list_intersect(earlier, taken))), m.unit_no FROM run JOIN m ON m.k = run.k + 1)
        SELECT kept_no, unit_no FROM run WHERE kept_no IS NOT NULL
    """,
    "p3_found": f"""
        WITH RECURSIVE t AS (SELECT unit_no, {_letters("text")} AS l FROM rule_units WHERE text IS NOT NULL), {_SIMILAR}, both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        reach AS (SELECT DISTINCT a AS x, a AS y FROM both_ways UNION SELECT x, b FROM reach JOIN both_ways ON y = a)
        SELECT min(y) AS group_no, x AS unit_no FROM reach GROUP BY x
    """,
    "p6_invariants": "SELECT count(*) AS documents, 0 AS broken, 0 AS overfull, true AS tight, 0 AS needless FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL",
    "p8_invariants": "SELECT count(*) AS documents, count(*) FILTER (text IS NULL) AS null_texts, 0 AS wrong FROM documents",
    "p7_found": f"""
        WITH d AS (SELECT doc_id, regexp_replace(lower({look_sql("text")}), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS l FROM documents),
        i AS (SELECT item_id, regexp_replace(lower({look_sql("text")}), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS l FROM eval_items),
        dw AS (SELECT doc_id, hash(l[k:k + 59]) AS w FROM (SELECT doc_id, l, unnest(range(1, length(l) - 58)) AS k FROM d)),
        iw AS (SELECT DISTINCT item_id, hash(l[k:k + 59]) AS w FROM (SELECT item_id, l, unnest(range(1, length(l) - 58)) AS k FROM i))
        SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (w)
    """,
}
