import datetime as dt
import random
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rulemill import session
from rulemill.functions.looks import look, plain_id
from rulemill.model import RULE
from rulemill.operators import checks, ingest, lifecycle, monitor, search
from rulemill.operators.components import connected_components
from rulemill.plans.governance_cases import reference_cases, snapshot_cases
from rulemill.sources import files

REF = "struct<document:string,version:string,location:string>"
T = lambda *a: dt.datetime(*a, tzinfo=dt.timezone.utc)


@pytest.mark.parametrize(("odd", "plain"), [("Ｔｈｅ", "The"), ("café", "café"), ("a​b­c", "abc"), ("a　b c", "a b c"), ("раy", "pay"), ("각", "각"), ("金", "金"), ("a‧b", "a·b"), ("①²", "①²"), ("x\r\ny", "x\ny")])
def test_look(odd, plain):
    assert look(odd) == plain


def test_plain_id():
    assert plain_id(" ＡＢ‐1​ ") == "ab-1"


def snapshots(spark, rows):
    return spark.createDataFrame(rows, f"row_no long, snap_no int, delivered_at timestamp, rule_id string, text string, source_ref {REF}, status string, s string")


def test_snapshots(spark):
    r = ("d", "v", "l")
    rows = [
        (1, 1, T(2024, 1, 1), "a", "x", r, "s", "clash"), (2, 1, T(2024, 1, 1), "b", None, r, "s", None), (3, 1, T(2024, 1, 1), "c", "x", r, "s", None), (9, 1, T(2024, 1, 1), None, "x", r, "s", None),
        (4, 3, T(2024, 3, 1), "Ａ", "ｘ", r, "t", None), (5, 3, T(2024, 3, 1), "b", "", r, "s", None), (6, 3, T(2024, 3, 1), "d", "x", None, "s", None),
        (7, 3, T(2024, 3, 1), "e", "old", r, "s", None), (8, 3, T(2024, 3, 1), "e", "new", r, "s", None), (10, 4, T(2024, 4, 1), "e", "new", r, "s", None), (11, 4, T(2024, 4, 1), "a", "x", None, "s", None),
    ]
    got = {tuple(x) for x in snapshot_cases(snapshots(spark, rows)).collect()}
    assert got == {(3, "b", "changed"), (3, "c", "removed"), (3, "d", "added"), (3, "e", "added"), (4, "a", "changed"), (4, "b", "removed"), (4, "d", "removed")}
    assert snapshot_cases(snapshots(spark, rows).limit(0)).count() == 0
    assert snapshot_cases(snapshots(spark, rows).where("snap_no = 1")).count() == 0


def test_references(spark):
    rel = spark.createDataFrame(
        [(1, "a", "b", T(2024, 1, 5)), (2, "Ａ ", None, T(2024, 1, 5)), (3, " ", "late", T(2024, 1, 31)), (4, "gone", "kept", T(2024, 2, 1)), (5, "a", "a", None)],
        "rel_no long, source_rule string, target_rule string, registered_at timestamp",
    )
    units = spark.createDataFrame(
        [(1, "a", ("d", "1", "l"), T(2024, 1, 9), None), (2, "late", ("d", None, "l"), T(2024, 2, 1), None), (3, "gone", (None, "9", "l"), T(2023, 1, 1), T(2024, 2, 9)), (4, "kept", None, T(2023, 1, 1), T(2024, 3, 1)), (5, None, (None, None, "l"), T(2023, 1, 1), None)],
        f"unit_no long, rule_id string, source_ref {REF}, ingested_at timestamp, withdrawn_at timestamp",
    )
    src = spark.createDataFrame([("d", "1", T(2024, 2, 1), None), ("d", "2", T(2023, 1, 1), None)], "doc_id string, version string, registered_at timestamp, withdrawn_at timestamp")
    got = {tuple(x) for x in reference_cases(rel, units, src).collect()}
    assert got == {
        ("relations", "2024-01", 1, "target_rule"), ("relations", "2024-01", 3, "target_rule"), ("relations", "2024-02", 4, "source_rule"),
        ("rule_units", "2024-01", 1, "source_ref"), ("rule_units", "2023-01", 3, "source_ref"),
    }
    assert reference_cases(rel.limit(0), units.limit(0), src.limit(0)).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (7, 6), (6, 5), (9, 9)] + [(i, i + 1) for i in range(20, 40)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got[3] == 1 and got[7] == 5 and got[9] == 9 and {got[i] for i in range(20, 41)} == {20}


def rules(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, rule_id string, text string, scope array<string>, status string, domain string, superseded_by string")


def test_search_and_citation(spark):
    df = rules(spark, [("r1", "기부 금지", ["기부 물품"], "approved", "ra", None), ("r2", " 다른 글 ", ["강연료"], "verified", None, None), ("r3", "기부", [], "draft", "ra", None), ("r4", "x", ["Advisory Bord"], "approved", "ra", None)])
    assert [r.rule_id for r in search.search(df, "기부", "n", threshold=0.1).collect()] == ["r1"]
    assert search.search(df, "", "n", threshold=0.0).count() == 3
    assert [r.rule_id for r in search.search(df, "Board", "n", threshold=0.3).collect()] == ["r4"]
    with pytest.raises(ValueError):
        search.search(df, "x", "n", threshold=2)
    cited = {r.rule_id: r for r in search.cite(spark.createDataFrame([("r1",), ("r2",), ("r3",), ("no",)], "rule_id string"), df, "n").collect()}
    assert cited["r1"].citation == "[근거: r1] 기부 금지" and cited["r2"].citation.endswith("[근거: r2] 다른 글") and cited["r3"].citation is None and not cited["no"].citable


def test_relation_counts_once(spark):
    rel = spark.createDataFrame([(1, "r1", "r2", "기부 조건", "approved"), (2, "r2", "r1", "기부 조건", "approved"), (3, "r1", "r3", "기부", "approved")], "rel_no int, source_rule string, target_rule string, condition string, status string")
    assert dict(search.relation_hits(rel, ["기부"], "rel_no").collect()) == {"r1": 1, "r2": 1}


def test_parse(spark):
    text = "머리말\n제5조 (기부)\n잃는 줄\n① 다음 각 호\n이어짐\n\n또 이어짐\n1. 첫째\n가. 가지\n2. 둘째\n제6조(끝)\n본문"
    found = ingest.sections(spark.createDataFrame([("d", text), ("e", None), ("f", "")], "id string, text string"), "id", "text")
    got = {(r.location, r.text) for r in found.collect()}
    assert got == {("제5조", "제5조 (기부)"), ("제5조 제1항", "① 다음 각 호\n이어짐\n\n또 이어짐"), ("제5조 제1항 제1호", "1. 첫째\n가. 가지"), ("제5조 제1항 제2호", "2. 둘째"), ("제6조", "제6조(끝)\n본문")}
    assert {(r.rule_id, r.needs_review) for r in ingest.candidates(found).collect()} == {("d-art5-p1-main", True), ("d-art5-p1-item1", False), ("d-art5-p1-item2", False), ("d-art6-p1-main", False)}
    marked = ingest.sections(spark.createDataFrame([("d", "# 제3조 목적\n### 하나\n본문\n#### 안\n말")], "id string, text string"), "id", "text", markdown=True)
    assert {(r.level, r.location, r.text) for r in marked.collect()} == {(1, "제3조", ""), (2, "제3조 제1항", "본문"), (3, "제3조 제1항 제1호", "말")}


def test_duplicates_match_difflib(spark):
    base = "운송비 합산액이 62만원 이상이면 강연자는 적용하지 아니한다 그리고 별도 계정으로 관리한다"
    rows = [(1, "a", base), (2, "b", base.replace("62", "73")), (3, "c", "전혀 다른 글" * 5), (4, "d", ""), (5, "e", "")]
    df = spark.createDataFrame(rows, "id long, rule_id string, text string")
    want = {(a[0], b[0]) for a in rows for b in rows if a[1] != b[1] and SequenceMatcher(None, a[2], b[2]).ratio() >= 0.9}
    assert {(r.id, r.o_id) for r in checks.duplicates(df, df, "id").collect()} == want


def test_repeated_texts_are_compared_once(spark):
    rows = [(i, f"r{i}", "x") for i in range(300)] + [(300, "r0", "x"), (301, "y", "")]
    df = spark.createDataFrame(rows, "id long, rule_id string, text string")
    texts = df.select(F.xxhash64("text").alias("label"), "text").distinct()
    assert checks.duplicate_candidates(texts, texts).count() == 2
    assert checks.duplicates(df, df, "id").count() == 301 * 301 - 301 - 2


def test_bounds_of_duplicates_leave_none_out(spark, monkeypatch):
    for name in ("TILE", "LATER", "LAST", "LOOK"):
        monkeypatch.setattr(checks, name, 7)
    rng = random.Random(5)
    words = ["the", "organiser", "shall", "keep", "EUR", "within", "ward", "visits", "62", "경우에는", "위원회는", "적용하지", "아니한다"]
    texts = ["", "x", "가"]
    for n in (3, 9, 40, 90):
        for words_of in (words[:9], words[9:], words):
            base = " ".join(rng.choices(words_of, k=n))
            for edits in (0, 0.02, 0.05, 0.1, 0.2):
                t = list(base)
                for _ in range(round(edits * len(t))):
                    k = rng.randrange(len(t))
                    t[k : k + 1] = rng.choice(["", t[k] + rng.choice("ab 가"), rng.choice("xyz나")])
                texts.append("".join(t))
    want = {(x, y) for x in texts for y in texts if SequenceMatcher(None, x, y).ratio() >= 0.9}
    held = checks._held(pa.Table.from_batches(checks._profiles([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["label", "text"])])))
    met = [(texts[held["label"][i]], texts[j]) for a, b in checks._near(held, texts, 0.9) for i, j in zip(a, b)]
    assert want <= set(met) and len(met) < len(texts) ** 2 / 4


def test_have_in_common():
    def length(x, y):
        row = [0] * (len(y) + 1)
        for a in x:
            row = [0, *row]
            for k, b in enumerate(y, 1):
                row[k] = row[k] + 1 if a == b else max(row[k - 1], row[k + 1])
            row.pop()
        return row[-1]

    rng = np.random.default_rng(3)
    x = [rng.integers(0, 4, n).astype(np.uint8) for n in (0, 1, 61, 62, 63, 200)]
    y = [np.delete(np.insert(t, len(t) // 2, 9), slice(0, len(t) // 20)).astype(np.uint8) for t in x] + x
    for i, t in enumerate(x):
        for least in (0.5, 0.8, 0.9, 0.97):
            want = [2 * length(t.tolist(), u.tolist()) >= least * (len(t) + len(u)) for u in y]
            assert checks.have_in_common(x, y, np.full(len(y), i), least).tolist() == want


def test_cascade_is_idempotent(spark):
    rel = spark.createDataFrame([("x", "a", "b", "approved"), ("y", "b", "a", "draft"), ("z", "b", "b", "approved")], "relation_id string, source_rule string, target_rule string, status string")
    out = lifecycle.cascade(lifecycle.orphan_relations(rel, spark.createDataFrame([("a", "suspended"), ("b", "approved")], "rule_id string, status string")))
    assert {(r.relation_id, r.new_status) for r in out.collect()} == {("x", "suspended"), ("y", "rejected")}
    assert {r.reason for r in out.collect()} == {"source_rule 'a' is suspended", "target_rule 'a' is suspended"}


def test_manifest_and_insert(spark):
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "file_id string, modified_at string")
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), ("gone", "1")], "file_id string, modified_at string")
    assert [r.file_id for r in lifecycle.changed_files(new, old).collect()] == ["b"]
    assert lifecycle.insert_absent(old, new, "file_id").count() == 4
    assert {r.modified_at for r in lifecycle.insert_absent(old, new, "file_id", force=True).where("file_id = 'b'").collect()} == {"2"}


def test_sample_sizes(spark):
    got = spark.range(1, 101).select("id", monitor.sample_size(F.col("id")).alias("k")).collect()
    assert {r.id: r.k for r in got}[5] == 5 and {r.id: r.k for r in got}[51] == 6 and {r.id: r.k for r in got}[100] == 10 and {r.id: r.k for r in got}[6] == 5


def test_record_files(spark, tmp_path):
    import json

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "r.yaml").write_text(json.dumps({"rule_id": "x", "text": "t", "odd": 1}))
    (tmp_path / "_m.yaml").write_text(json.dumps({"rule_id": "hidden"}))
    (r,) = files.read_records(spark, str(tmp_path), RULE, json.loads).collect()
    assert r.rule_id == "x" and r.extra == ["odd"]


def test_registry(spark):
    v = spark.createDataFrame([("d", "1", "f", None)], "doc_id string, version string, file string, supersedes string")
    assert files.add_version(v, "d", "2", "g", "1").count() == 2
    with pytest.raises(ValueError):
        files.add_version(v, "d", "1", "g")
    with pytest.raises(KeyError):
        files.add_version(v, "e", "1", "g")


def test_spread_runs_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("spread", "spread")
    grouped = spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()
    out = session.spread(grouped)
    assert not tracker.getJobIdsForGroup("spread")
    assert out.count() == 7
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_cut_restores_the_setting_and_appends(spark, tmp_path):
    before = spark.conf.get(session.CLEANUP)
    path = f"file://{tmp_path}/t"
    session.cut(spark.range(3), path)
    assert session.cut(spark.range(4), path).count() == 7 and spark.conf.get(session.CLEANUP) == before
    part = session.cut(spark.range(5))
    session.discard(part)


def test_plain_characters_are_in_written_form(spark):
    import re

    from rulemill.functions import looks

    plain = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and re.match(f"[{looks.PLAIN}]", chr(c))]
    assert len(plain) > 30_000 and "".join(plain) == look("".join(plain))
    rows = ["".join(plain[:300]), "가나", "ｆull", "e\u0301", " Ａ-1\u3000", "", None, "\r\n", "x\n"]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").select("i", looks.look_column(F.col("t")).alias("a"), looks.plain_id_column(F.col("t")).alias("b")).orderBy("i").collect()
    assert [r.a for r in got] == [None if r is None else look(r) for r in rows] and [r.b for r in got] == [None if r is None else plain_id(r) for r in rows]
