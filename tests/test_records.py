import json

import pytest
from pyspark.sql import functions as F

from rulemill import model
from rulemill.operators import gate, hooks, ingest, monitor, search
from rulemill.operators.references import orphans
from rulemill.sources import files
from rulemill.streaming import increments

REF = {"document": "doc", "version": "1", "location": "제1조"}
RULE = {"rule_id": "doc-art1", "text": "a text that is long enough", "source_ref": REF, "scope": ["gifts"], "authority": "law", "domain": None, "status": "draft"}


@pytest.fixture(scope="module")
def rules(spark):
    rows = [RULE, RULE | {"rule_id": "Bad Id", "source_ref": REF | {"version": "9"}}, RULE | {"rule_id": "doc-art2", "status": "verified"}, RULE | {"rule_id": "doc-art3", "authority": "whim", "scope": []}, RULE | {"rule_id": "doc-art4", "status": None}]
    return spark.createDataFrame([r | {"unit_no": i} for i, r in enumerate(rows)], "unit_no long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in model.RULE))


@pytest.fixture(scope="module")
def registry(spark):
    return spark.createDataFrame([("doc", "1", "law")], "doc_id string, version string, authority_level string")


def test_gate_reports_and_applies(spark, rules, registry):
    levels = spark.createDataFrame([("ra", "law")], "domain string, level string")
    twins = spark.createDataFrame([(3, "duplicate of doc-art1")], "unit_no long, error string")
    warned = spark.createDataFrame([(0, "close"), (2, "unseen")], "unit_no long, warning string")
    report = gate.gate_report(rules, registry, levels, "unit_no", twins, warned)
    got = {r.unit_no: r for r in report.collect()}
    assert got[0].passed and got[0].new_status == "verified" and got[0].warnings == ["close"]
    assert got[1].new_status == "rejected" and got[1].errors == ["rule_id", "unknown version: 9"]
    assert not got[2].passed and got[2].new_status == "verified" and got[2].warnings == [] and "current: verified" in got[2].errors[0]
    assert got[3].errors == ["duplicate of doc-art1", "scope", "unknown authority"]
    assert got[4].new_status is None and "current: none" in got[4].errors[0]
    after = {r.unit_no: (r.status, r.verified_at) for r in gate.apply_report(rules, report, "unit_no", "now").collect()}
    assert after[0] == ("verified", "now") and after[1] == ("draft", None) and after[2] == ("verified", None)
    assert gate.gate_report(rules.limit(0), registry, levels, "unit_no").count() == 0


def test_decisions_and_bundles(spark, rules):
    votes = spark.createDataFrame([(2, "me", {"a": "pass", "b": "fail"}), (0, "me", {"a": "pass"})], "unit_no long, reviewer string, checklist map<string,string>")
    got = {r.unit_no: r for r in gate.decide(rules, votes, "unit_no", "now").collect()}
    assert (got[2].status, got[2].rejection_reason, got[2].approval) == ("rejected", "failed in review: b", None) and got[0].status == "draft"
    low = spark.createDataFrame([("doc", 0.5)], "document string, pass_rate double")
    assert {r.status for r in gate.approve_bundles(rules, "unit_no", "me", ["a"], "now", low)[0].where("unit_no = 2").collect()} == {"verified"}
    (row,) = gate.approve_bundles(rules, "unit_no", "me", ["a"], "now")[0].where("unit_no = 2").collect()
    assert row.status == "approved" and row.approval.gate2_checklist == {"a": "pass"} and row.approval.timestamp == "now"


def relation(n, **more):
    return {"rel_no": n, "relation_id": f"rel-{n}x", "type": "excepts", "source_rule": "doc-art1", "target_rule": "doc-art2", "condition": "always so", "resolution": "the first one counts", "authority_basis": "law", "registered_by": "me", "status": "draft"} | more


def relations(spark, rows):
    return spark.createDataFrame(rows, "rel_no long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in model.RELATION))


def test_relations(spark):
    have = relations(spark, [relation(1, status="approved", approval={"reviewer": "old", "timestamp": "t", "notes": None}), relation(2), relation(3, relation_id=None)])
    asked = relations(spark, [relation(1), relation(5, relation_id="rel-55"), relation(6, relation_id="rel-55"), relation(7, relation_id="rel-77", type="odd")])
    assert {r.rel_no: r.outcome for r in gate.create_relations(have, asked, "rel_no").collect()} == {1: "exists", 5: "created", 6: "exists", 7: "type"}
    got = {r.rel_no: r for r in gate.approve_relations(have, have, "me", "now").collect()}
    assert got[1].approval.reviewer == "old" and got[2].status == "approved" and got[2].approval.reviewer == "me" and got[3].status == "draft"
    assert [r.rel_no for r in gate.list_relations(have).collect()] == [1, 2] and gate.list_relations(have, "draft").count() == 1


def test_version_update_reaches_relations(spark, rules, registry):
    old = rules.withColumn("status", F.when(F.col("unit_no") == 0, "approved").otherwise(F.col("status")))
    rels = relations(spark, [relation(1, status="approved", approval={"reviewer": "r", "timestamp": "t", "notes": None}), relation(2), relation(3, source_rule="x", target_rule="y")])
    updates = spark.createDataFrame([("doc", "1", "2", "f.md"), ("none", "1", "2", "g.md")], "document string, old_version string, new_version string, file string")
    done = gate.update_versions(old, registry, rels, updates, "unit_no", "rel_no")
    assert {(r.document, r.rules_found, r.rules_suspended) for r in done.counts.collect()} == {("doc", 4, 1), ("none", 0, 0)}
    assert {r.unit_no for r in done.rules.where("status = 'suspended' AND suspension_reason LIKE '%1 → 2'").collect()} == {0}
    assert {(r.rel_no, r.status) for r in done.relations.collect()} == {(1, "suspended"), (2, "rejected"), (3, "draft")}
    assert {(r.doc_id, r.version) for r in done.versions.collect()} == {("doc", "1"), ("doc", "2"), ("none", "2")}


def test_context_lists(spark, rules):
    links = spark.createDataFrame([("p", ["doc-art2", "doc-art1", "z"], "k", 1), ("p", ["doc-art1", "doc-art2"], "k", 2), ("doc-art1", ["q"], "j", 3)], "parent string, children array<string>, hierarchy_type string, n int")
    asked = spark.createDataFrame([("doc-art1",), ("doc-art2",), ("unknown",)], "rule_id string")
    rels = relations(spark, [relation(1, status="approved", approval={"reviewer": "r", "timestamp": "t", "notes": None}), relation(2)])
    got = {r.rule_id: r for r in search.full_context(asked, rules, links, rels, "unit_no", "n", model.RULE_FIELDS, model.RELATION_FIELDS).collect()}
    one, two, none = got["doc-art1"], got["doc-art2"], got["unknown"]
    assert one.rule is None and two.rule.text == RULE["text"] and not hasattr(two.rule, "approval")
    assert (one.parent, one.children, one.siblings, one.hierarchy_type) == ("p", ["q"], ["doc-art2"], "j") and len(one.relations) == 1
    assert (none.rule, none.parent, none.children, none.siblings, none.relations) == (None, None, [], [], [])
    assert {tuple(r) for r in search.siblings(links.select("parent", F.explode("children").alias("child")).distinct(), asked.limit(1)).collect()} == {("doc-art1", "doc-art2"), ("doc-art1", "z")}


TEXT = "제1조(물품)\n① 다음 각 호의 물품은 제한한다\n1. 여비 지원\n2. 회의비 지원\n제2조(보고)\n보고한다"


def documents(spark):
    return spark.createDataFrame([("doc", "1", None, TEXT), ("lost", "1", "other", TEXT), ("doc2", "1", "other", None)], "doc_id string, version string, domain string, text string")


def test_pipeline_isolates_documents(spark, registry):
    words = spark.createDataFrame([(1, "여비 지원"), (2, "보고 의무 사항")], "item_no long, item string")
    out, summary = ingest.run_pipeline(documents(spark), registry, words)
    rows = {r.rule_id: r for r in out.collect()}
    assert rows["doc-art1-p1-item1"].scope == ["여비 지원"] and rows["doc-art1-p1-main"].needs_review and rows["doc-art2-p1-main"].scope == ["보고 의무 사항"]
    assert rows["doc-art1-p1-item2"].file == "art1-p1-item2.yaml" and rows["doc-art1-p1-item2"].domain is None and rows["lost-art2-p1-main"].domain == "other"
    assert rows["lost-art1-p1-main"].error == "unknown document" and rows["lost-art1-p1-main"].status is None
    told = {r.doc_id: r for r in summary.collect()}
    assert told["doc"].success and told["doc"].drafts == 4 and told["doc"].deterministic_count == 4 and not told["lost"].success and told["lost"].rule_candidates == 4
    (total,) = ingest.batch_summary(summary).collect()
    assert (total.total, total.succeeded, total.failed, total.drafts) == (3, 1, 2, 4)


def test_judges_answer_or_fall_back(spark, registry):
    found = ingest.candidates(ingest.sections(documents(spark).where("doc_id = 'doc'"), "doc_id", "text"))
    merged = hooks.split_judged(found, lambda prompts: ['```json\n{"decision": "MERGE", "reasoning": "one point"}\n```'] * len(prompts)).collect()
    assert {r.rule_id for r in merged} == {"doc-art1-p1-main", "doc-art2-p1-main"} and [r.split_method for r in merged if "art1" in r.rule_id] == ["judged"] and not any(r.needs_review for r in merged)

    def broken(prompts):
        raise OSError("down")

    for judge in (None, broken, lambda p: ["no json"] * len(p), lambda p: []):
        kept = hooks.split_judged(found, judge).collect()
        assert len(kept) == 4 and sum(r.needs_review for r in kept) == 1 and {r.split_method for r in kept} == {"deterministic"}
    rows = spark.createDataFrame([(1, "text", ["a", "b"]), (2, "", ["a"]), (3, None, None)], "n long, text string, scope array<string>")
    reply = json.dumps({"results": [{"scope": "a", "derivable": True}, {"scope": "b", "derivable": False, "reason": "absent"}]})
    assert {tuple(r) for r in hooks.coherence_warnings(rows, "n", lambda p: [reply] * len(p)).collect()} == {(1, "scope 'b' may not be derivable: absent")}
    assert {tuple(r) for r in hooks.coherence_warnings(rows, "n").collect()} == {(1, "scope not judged: no judge")}
    kept = spark.createDataFrame([(1, ["old"]), (2, ["old"]), (3, ["old"])], "n long, scope array<string>")
    assert {(r.n, *r.scope) for r in hooks.scope_judged(rows, "n", "text", kept, lambda p: [json.dumps({"scope": ["new"] if "text" in x.split("\n")[1] else []}) for x in p]).collect()} == {(1, "new"), (2, "old"), (3, "old")}


def test_sync(spark, registry, tmp_path):
    listed = [{"id": "a", "name": "b/1.pdf", "mimeType": "application/pdf", "modifiedTime": "2"}, {"id": "b", "name": "a", "mimeType": "application/vnd.google-apps.document", "modifiedTime": "1"}, {"id": "c", "name": "x", "mimeType": "image/png"}]
    found = files.listing(spark, lambda folder: listed, "f")
    manifest = spark.createDataFrame([("b", "1")], "file_id string, modified_at string")
    plan = files.sync_plan(found, manifest, registry, "new", "md")
    assert {(r.file_id, r.action, r.target, r.register) for r in plan.collect()} == {("a", "download", "b_1.pdf", True), ("b", "keep", "a.md", True)}
    assert {r.action for r in files.sync_plan(found, manifest, registry, "doc", dry_run=True).collect()} == {"list"}
    every = files.sync_plan(found, manifest, registry, "doc", force=True)

    def fetch(file_id, target):
        if file_id == "b":
            raise OSError("gone")
        return b"%PDF"

    got = files.download(every, fetch)
    assert {(r.file_id, r.error) for r in got.collect()} == {("a", None), ("b", "gone")}
    files.save_manifest(manifest, got, found, f"file://{tmp_path}/m")
    assert {tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/m").collect()} == {("a", "2"), ("b", "1")}
    with pytest.raises(ValueError):
        files.sync_plan(found, manifest, registry, "doc", "docx")
    for bad in ({}, {"folders": []}, {"folders": {}}, {"folders": ["x"]}, {"folders": [{"doc_id": "d"}]}):
        with pytest.raises(ValueError):
            files.entries(bad, "folders", ["folder_id", "doc_id"])
    assert files.entries({"folders": [{"folder_id": "f", "doc_id": "d"}]}, "folders", ["folder_id", "doc_id"])
    url = spark.createDataFrame([("https://x/drive/folders/ab_1?x",)], "u string")
    assert url.select(files.folder_id(F.col("u"))).first()[0] == "ab_1"


def test_registry_notes_and_documents(spark, registry, tmp_path):
    more = files.register_source(registry.withColumn("file", F.lit("f")).withColumn("supersedes", F.lit(None).cast("string")), "doc9", "1", "g", "law", ["law"])
    assert files.add_version(more, "doc9", "2", "h", "1").where("doc_id = 'doc9'").count() == 2
    with pytest.raises(ValueError):
        files.register_source(registry, "doc9", "1", "g", "whim", ["law"])
    assert files.register_source(registry, "doc9", "1", "g", "law", ["law"], confirm=lambda x: False).count() == 1
    notes = spark.createDataFrame([(None,), ("x: 1",), ("y",)], "n string").select(files.note_once(F.col("n"), F.lit("x: 1")).alias("n"))
    assert [r.n for r in notes.collect()] == ["x: 1", "x: 1", "y\nx: 1"]
    nested = spark.createDataFrame([("d", [("1", "f", None)])], "doc_id string, versions array<struct<version:string,file:string,supersedes:string>>")
    assert [tuple(r) for r in files.versions_of(nested).collect()] == [("d", "1", "f", None)]
    (tmp_path / "a.md").write_text("# x", encoding="utf-8")
    assert [(r.kind, r.text) for r in files.read_documents(spark, f"file://{tmp_path}").collect()] == [("markdown", "# x")]
    paths = spark.createDataFrame([("a/b-c",), ("a/b/d",)], "path string")
    assert [r.path for r in paths.orderBy(files.path_order()).collect()] == ["a/b/d", "a/b-c"]


def test_monolith_joins_in_order(spark):
    rows = spark.createDataFrame([(2, "g", "b"), (1, "g", "a")], "n long, g string, text string")
    assert monitor.monolithic(rows, "n", "g").first().text == "a\n\nb"


def test_partial_keys_by_declared_semantics(spark):
    refs = spark.createDataFrame([(1, "d", "1"), (2, "d", None), (3, None, "9"), (4, None, None), (5, "e", "1")], "n long, document string, version string").withColumn("period_end", F.to_timestamp(F.lit("2024-02-01")))
    targets = spark.createDataFrame([("d", "1"), ("d", None), (None, None)], "document string, version string").withColumns({"came": F.to_timestamp(F.lit("2024-01-01")), "gone": F.lit(None).cast("timestamp")})
    got = {m: {r.n for r in orphans(refs, targets, ["document", "version"], "came", "gone", m).collect()} for m in ("partial", "simple", "full")}
    assert got == {"partial": {3, 5}, "simple": {5}, "full": {2, 3, 5}}


def test_stream_takes_late_rows_within_the_watermark(spark, tmp_path):
    source, shape = tmp_path / "in", "ts timestamp, event_type string, value double"
    steps = [[("2024-01-01 10:00", "a", 1.0)], [("2024-01-02 10:00", "a", 2.0)], [("2024-01-01 11:00", "a", 4.0)], [("2024-01-09 00:00", "a", 8.0)], [("2024-01-01 12:00", "a", 16.0)], [("2024-01-20 00:00", "a", 32.0)]]
    out = {}
    for step in steps:
        spark.createDataFrame(step, "t string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "event_type", "value").coalesce(1).write.mode("append").parquet(str(source))
        windows = increments.events_by_window(spark.readStream.schema(shape).parquet(str(source)))
        query = windows.writeStream.outputMode("append").foreachBatch(lambda df, i: out.update({str(r.begin)[:10]: r.total for r in df.collect()})).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert out["2024-01-01"] == 5.0 and out["2024-01-02"] == 2.0 and out["2024-01-09"] == 8.0


def test_followed_log_hands_on_last_states(spark, tmp_path):
    log = tmp_path / "log"
    got = []
    for rows in ([("a", "1"), ("a", "2"), ("b", "1")], [("a", "3")]):
        spark.createDataFrame(rows, "file_id string, modified_at string").coalesce(1).write.mode("append").parquet(str(log))
        increments.follow(spark.readStream.schema("file_id string, modified_at string").parquet(str(log)), lambda df, i: got.append({tuple(r) for r in df.collect()}), str(tmp_path / "c")).awaitTermination()
    assert got == [{("a", "2"), ("b", "1")}, {("a", "3")}]


def test_command_line(spark):
    from rulemill.__main__ import main

    lines = main(["기부 물품 한도", "--sf-dir", "/root/testdata/sf0.001", "--limit", "3"], spark)
    assert len(lines) == 3 and all("[" in x for x in lines)
