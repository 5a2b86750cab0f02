import random
import unicodedata
from functools import lru_cache

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rulemill.functions.looks import look
from rulemill.llm import codepoints, history, leakage, near_duplicates, packing, personal, uniform

R = random.Random(7)
WORDS = "기부 물품 한도 초과분 별도 계정 관리 협의 제한 심의 위원회 보고 sponsor shall settle travel grants under section audit report device".split()


def letters(t):
    return "".join(c for c in look(t).lower() if unicodedata.category(c)[0] in "LN")


def similarity(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x and y else 0


@lru_cache(None)
def shingles(t):
    s = letters(t)
    return {s[i : i + 4] for i in range(len(s) - 3)} if len(s) >= 40 else None


def sentence(n=24):
    return " ".join(R.choice(WORDS) + str(R.randrange(90)) for _ in range(n))


def edited(t, k):
    w = t.split()
    for _ in range(k):
        w[R.randrange(len(w))] = R.choice(WORDS) + "x"
    return " ".join(w)


def test_form_equals_look():
    pool = [chr(c) for c in range(1, 0x3400)] + [chr(c) for c in range(0xAC00, 0xAC80)] + [chr(c) for c in range(0xF900, 0x10000)] + list("\r\né") * 60
    marks = [chr(c) for c in range(0x300, 0x370)] + list("ᅡᆨᄀ") * 9
    rows = ["".join(R.choice(pool) if R.random() < 0.5 else R.choice(marks) for _ in range(R.randint(0, 12))) for _ in range(4000)] + [None, "", "a" * 100_000]
    assert codepoints.look_array(pa.array(rows)).to_pylist() == [None if r is None else look(r.replace("\0", "")) for r in rows]
    assert codepoints.letters_array(pa.array(rows)).to_pylist() == [None if r is None else letters(r) for r in rows]
    assert codepoints.look_array(pa.array(rows)[10:20]).to_pylist() == [look(r) for r in rows[10:20]]
    assert codepoints.look_array(pa.array([], pa.string())).to_pylist() == []


def test_uniform_and_spelling_pairs(spark):
    df = spark.createDataFrame([(1, "Ａ b", ["기​부", None], "x"), (2, "A b", None, "y"), (3, "A b", [], "z"), (4, None, ["기부"], None), (5, "A b", ["기부"], None), (5, "A b", ["기부"], None)], "unit_no long, text string, scope array<string>, form string")
    assert [r.text for r in uniform.uniform(df, ["text"], ["scope"]).orderBy("unit_no").collect()][:3] == ["A b"] * 3
    vocab = spark.createDataFrame([(9, "기부", "c"), (8, None, "c")], "item_no long, item string, form string")
    got = {tuple(r) for r in uniform.spelling_cases(df, vocab).collect()}
    assert got == {("text", 1, 2), ("text", 1, 3), ("text", 1, 5), ("text", 2, 3), ("text", 2, 5), ("scope", 1, 9)}
    assert uniform.spelling_cases(df.limit(0), vocab.limit(0)).count() == 0


@pytest.fixture(scope="module")
def units():
    rows, n = [], 0
    for _ in range(25):
        base = sentence()
        for k in (0, 0, 1, 2, 4, 6):
            n += 1
            rows.append((n, edited(base, k)))
    rows += [(n + 1, None), (n + 2, ""), (n + 3, "short"), (n + 4, "short"), (n + 5, "긴 글 " * 20_000), (n + 6, "긴  글" * 20_000)]
    return rows


def groups(rows, t=0.7):
    top = {i: i for i, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if x and y and similarity(x, y) >= t:
                p, q = find(a), find(b)
                top[max(p, q)] = min(p, q)
    roots = [find(i) for i, _ in rows]
    return {(r, i) for r, (i, _) in zip(roots, rows) if roots.count(r) > 1}


def test_near_duplicates_match_brute_force(spark, units):
    df = spark.createDataFrame([(i, t, 0) for i, t in units], "unit_no long, text string, rep int")
    assert {tuple(r) for r in near_duplicates.near_duplicate_groups(df, "unit_no", "text").collect()} == groups(units)
    assert near_duplicates.near_duplicate_groups(df.limit(0), "unit_no", "text").count() == 0


def test_centre_rounds_lose_nothing(spark, units, monkeypatch):
    """With one symbol a key nearly all texts meet under a few keys, most of them unlike."""
    monkeypatch.setattr(near_duplicates, "error_keys", lambda s, chunks, size, errors: (s[:, [c * size for c in chunks]] % 4).astype("uint64") << 32 | 7)
    df = spark.createDataFrame(units[:60], "unit_no long, text string")
    assert {tuple(r) for r in near_duplicates.near_duplicate_groups(df, "unit_no", "text").collect()} == groups(units[:60])


def test_ranges_in_runs_meet_as_in_one(spark, monkeypatch):
    """A key that comes in several runs of a range meets the same members as one that comes at once."""
    import numpy as np

    from rulemill.llm import buckets

    monkeypatch.setattr(buckets, "CENTRES", 4)  # fewer than the rows of any key here

    class Direct:
        def repartitionById(self, n, part):
            return self

        def mapInArrow(self, run, shape):
            self.run = run
            return self

    rng = np.random.default_rng(1)
    rows = [(0, *(x.tobytes() for x in (rng.integers(0, 9, 30, np.uint32), np.zeros(30, np.uint64), np.arange(30 * k, 30 * k + 30)))) for k in range(4)]
    blobs = pa.RecordBatch.from_pylist([dict(zip(("part", "keys", "marks", "ids"), r)) for r in rows])
    outcome = []
    for size in (1 << 21, 10):
        buckets.RANGE_KEYS, keep = size, buckets.RANGE_KEYS
        got = [r for b in buckets.meetings(Direct(), 1, 64).run([blobs]) for r in b.to_pylist()]
        buckets.RANGE_KEYS = keep
        outcome.append(({(r["a"], r["b"]) for r in got if r["key"] is None}, sorted((r["key"], r["b"], r["a"]) for r in got if r["key"] is not None)))
    assert outcome[0] == outcome[1] and len(outcome[0][1]) == 120


def test_members_have_no_false_negatives(spark):
    from rulemill.llm import buckets

    import numpy as np

    got = buckets.members(spark.range(0, 5000, 3, 3), buckets.ids_of)
    assert got.may_have(np.arange(0, 5000, 3)).all() and got.may_have(np.arange(10**6, 10**6 + 10**4)).sum() < 20
    assert not buckets.members(spark.range(0), buckets.ids_of).may_have(np.arange(99)).any()


def test_signature_guarantee():
    import numpy as np

    size, chunks = near_duplicates.SYMBOLS, near_duplicates.CHUNKS
    a = np.random.default_rng(3).integers(0, 256, (300, size * chunks)).astype(np.uint8)
    b = a.copy()
    for row in b:  # the most errors that the pigeonhole allows
        row[R.sample(range(size * chunks), 2 * chunks - 1)] ^= 1
    x, y = (near_duplicates.error_keys(s, range(chunks), size, 1) for s in (a, b))
    assert (x == y).any(axis=1).all()


def greedy(old, drafts, t=0.7):
    accepted, out = list(old), set()
    for d in sorted(drafts, key=lambda d: (d[1], d[0])):
        key = lambda r: (look(r[2]).strip().lower(), r[3]) if r[2] and r[2].strip() and r[3] is not None else None
        hits = [a[0] for a in accepted if key(d) and key(a) == key(d) or d[4] and a[4] and similarity(d[4], a[4]) >= t]
        if hits:
            out.add((min(hits), d[0]))
        else:
            accepted.append(d)
    return out


def test_history_matches_greedy(spark, units, tmp_path):
    old = [(i, 0, f"R-{i % 20}", "v", t) for i, t in units[:70]]
    new = [(1000 + i, R.randint(1, 3), R.choice([f"r-{i % 20}", f"ｎ-{i % 9}", None, " "]), R.choice(["v", "w", None]), t) for i, t in units[60:]]
    shape = "unit_no long, batch_no int, rule_id string, version string, text string"
    o, n = spark.createDataFrame(old, shape), spark.createDataFrame(new, shape)
    want = greedy(old, new)
    path = f"file://{tmp_path}/history"
    kept = history.hold_batches(history.accept_all(o.drop("batch_no"), 0.7, path), n)
    assert {tuple(r) for r in kept.collect()} == want
    # Another session opens the stored tables; the units themselves are not read again.
    again = [(5000 + d[0], 9, None, None, d[4]) for d in new]
    other = spark.newSession()
    kept2 = history.hold_batches(history.History.load(other, path), other.createDataFrame(again, shape))
    accepted = old + [d for d in new if d[0] not in {u for _, u in want}]
    assert {tuple(r) for r in kept2.collect()} == greedy(accepted, again)
    assert {f.split("history/")[1].split("/")[0] for f in history.History.load(other, path).pivots.inputFiles()} == {"pivots"}
    none = history.hold_batches(history.accept_all(o.limit(0).drop("batch_no"), 0.7), n.limit(0))
    assert none.count() == 0


def test_smallest_similar_goes_on_past_the_front(spark, units):
    rows = cut_prints(spark, units)
    reps, letters = rows
    got = {tuple(r) for r in history.smallest_similar(reps, letters, reps, letters, 0.7, front=1).collect()}
    have = [(r.rep, dict(units)[r.rep]) for r in reps.collect()]
    assert got == {(a, min(b for b, y in have if similarity(x, y) >= 0.7)) for a, x in have}


def cut_prints(spark, units):
    prints = near_duplicates.fingerprints(spark.createDataFrame(units, "unit_no long, text string"), "unit_no", "text", keep_letters=True)
    return near_duplicates.representatives(prints), prints.select("id", "letters")


def test_leaks_match_substrings(spark):
    items = [(k, sentence(30)) for k in range(12)] + [(50, "short"), (51, None)]
    docs = [(k, sentence(10) + items[k % 12][1][k : k + 60 + 2 * k] + sentence(5)) for k in range(40)] + [(90, None), (91, ""), (92, items[0][1].upper().replace(" ", "\n")), (93, sentence(4000) + items[3][1])]
    runs = lambda t: {t[i : i + 60] for i in range(len(t) - 59)}
    have, asked = ([(k, runs(letters(t))) for k, t in rows if t] for rows in (docs, items))
    want = {(d, i) for d, x in have for i, y in asked if x & y}
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert want and {tuple(r) for r in leakage.leaked_items(a, b).collect()} == want
    assert {tuple(r) for r in leakage.leaked_items(a, b, block=500).collect()} == want
    assert leakage.leaked_items(a, b.limit(0)).count() == 0 and leakage.leaked_items(a.limit(0), b).count() == 0


def test_packing_is_whole(spark):
    sizes = [(i, R.choice([0, 3, 7, 50, 90, 100, 101, 250, None])) for i in range(400)]
    rows = packing.pack(spark.createDataFrame(sizes, "doc_id long, n long"), "doc_id", "n", 100, parts=4).collect()
    room, whole = {}, {}
    for r in rows:
        room[r.container_no] = room.get(r.container_no, 0) + r.n_tokens
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.n_tokens
        assert r.piece_no == 1 or dict(sizes)[r.doc_id] > 100
    assert whole == {i: n for i, n in sizes if n is not None} and max(room.values()) <= 100
    assert set(room) == set(range(1, len(room) + 1)) and len(room) <= sum(whole.values()) / 100 * 1.1
    assert packing.pack(spark.createDataFrame([], "doc_id long, n long"), "doc_id", "n").count() == 0


def test_token_counts(spark):
    text = "hello world 기부 금지 조건"
    (row,) = spark.createDataFrame([(text,)], "t string").select(packing.token_counts()(F.col("t")).alias("n")).collect()
    assert row.n == len(packing.tokenizer(packing.TOKENIZER).encode_ordinary(text)) and b"".join(packing.tokenizer(packing.TOKENIZER).decode_tokens_bytes(packing.tokenizer(packing.TOKENIZER).encode_ordinary(text))).decode() == text


LINES = ["담당자 안가담 부장에게 010-1234-5678로 연락한다.", "문의: 김나별 원장, 전화 02)077-3126, 전자우편 kim.x@example.com.", "According to Joren Okrent, lunch was paid. ask for Ilka Brask."]


def test_personal_information(spark):
    odd = "김​나별의 번호는 ０１０－１２３４－５６７８, 900101-1234567, ID 912-28-5893 and Okrent, Joren at 12 Mill Bend, Ambrook 95257; hong(골뱅이)lab [dot] invalid; 010-****-1234; 사업자등록번호 000-28-51572; 가람시 다온구 새터로 34, 16층"
    docs = [(i, x) for i, x in enumerate(LINES * 3)] + [(50, odd), (51, None), (52, ""), (53, "가" * 50_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.pii_kind, odd[r.start_pos - 1 : r.end_pos]) for r in personal.find_places(df).where("doc_id = 50").collect()}
    assert got == {
        ("name", "김​나별"), ("phone", "０１０－１２３４－５６７８"), ("id_number", "900101-1234567"), ("id_number", "912-28-5893"), ("name", "Okrent, Joren"),
        ("address", "12 Mill Bend, Ambrook 95257"), ("email", "hong(골뱅이)lab [dot] invalid"), ("address", "가람시 다온구 새터로 34, 16층"),
    }
    out = {r.doc_id: r.text for r in personal.redact(df, b"k").collect()}
    assert out[51] is None and out[52] == "" and out[0] == out[3] and "안가담" not in out[0] and out[0].endswith("로 연락한다.") and "[PHONE:010-" in out[0]
    assert personal.find_places(df.limit(0)).count() == 0


def test_surrogates_stay_distinct(spark):
    many = spark.createDataFrame([("name", f"김가{chr(0xAC00 + k)}", "") for k in range(3000)] + [("name", f"jo {k}", "m") for k in range(500)], "pii_kind string, canon string, gender string")
    got = personal.surrogates(many, b"k").collect()
    assert len(got) == 3500 == len({r.stand_in for r in got}) and not {r.stand_in for r in got} & {r.canon for r in got}
