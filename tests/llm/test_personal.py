import pytest

from rulemill.llm import personal


def found(text):
    return {(k, text[a:z]) for a, z, k, sure in personal.spans(text) if sure}


@pytest.mark.parametrize("number", ["X0092820", "M00875358", "AB1234567", "M123A4567", "QQ 12 34 56 C", "QQ123456C", "MORGA657054SM9IJ", "912-28-5893", "11-22-333333-44", "900101-1234567", "912345678"])
def test_each_identity_number_is_found_alone(number):
    assert found(f"The speaker's number is {number}.") == {("id_number", number)}


def test_short_foreign_phone_is_found_alone():
    assert found("Call +47 22 85 50.") == {("phone", "+47 22 85 50")}


@pytest.mark.parametrize("address", ["desk AT office.hdma.test", "joren+fc at example.com", "a@b.kr", "a (At) b.kr", "a{at}b [dot] kr", "a 골뱅이 b 점 kr", "a앳b.kr".replace("앳", " 앳 "), "a at b-c dot kr"])
def test_each_form_of_mail_address_is_found_alone(address):
    assert found(f"Reply to: {address}") == {("email", address)}


def test_numbers_behind_at_are_no_hosts():
    assert not found("A fee set at 12.50 or at 3.5x. It is held at noon. See you at work.")


def test_a_name_in_a_context_is_a_place_without_a_lexicon():
    assert found("According to Ivo Harte, it was paid. Reviewed by Ethics Committee.") == {("name", "Ivo Harte")}
    assert found("담당자 김나별 원장에게 보냈다. 선우 가 담(인) 제조사 대표의 뜻이다.") == {("name", "김나별"), ("name", "선우 가 담")}


def test_copies_raise_no_bar_for_other_names(spark):
    copies = [(k, "The patient, Mara Quist, signed.") for k in range(300)]
    others = [(1000, "According to Ivo Harte, yes."), (1001, "Neither Ivo Harte nor the host came."), (1002, "Late again: Harte, Ivo and Mara Quist.")]
    got = personal.find_places(spark.createDataFrame(copies + others, "doc_id long, text string")).where("doc_id = 1002 AND pii_kind = 'name'")
    assert {r.entity for r in got.collect()} == {"Harte, Ivo", "Mara Quist"}


def test_forms_of_names_need_the_lexicon(spark):
    learn = ["According to Ivo Harte, yes.", "According to Ivo Quist, yes.", "According to Mara Quist, yes.", "According to Mara Harte, yes.", "담당자 김나별 원장에게 보냈다. 담당자 박나별 원장에게, 담당자 김가솜 원장에게, 담당자 박가별 원장에게 보냈다.", "The patient, Zebulon Quixley, left."]
    text = "Medical Ivo Quist Hall met HARTE, MARA; Z. Quixley, M. Harte, A. Medical, Zebulon Quixley and Medical Devices. 박나별은 김고움과 제조사를 보았다."
    docs = spark.createDataFrame([*enumerate(learn), (99, text)], "doc_id long, text string")
    got = {r.entity for r in personal.find_places(docs).where("doc_id = 99").collect()}
    assert got == {"Ivo Quist", "HARTE, MARA", "Z. Quixley", "M. Harte", "Zebulon Quixley", "박나별"}


@pytest.mark.parametrize("address", ["221B Baker Street, London NW1 6XE", "Flat 3, 12 Mill Bend, Ambrook 95257", "7 Station Road"])
def test_english_addresses(address):
    assert found(f"Send it to {address}.") == {("address", address)}


PLACES = [
    ("name", "O. Brask"), ("name", "J.Okrent"), ("name", "Okrent, Joren"), ("name", "Ilka BRASK"), ("name", "김 나 별"), ("email", "A.B@C.KR"),
    ("phone", "+82 10-1234-5678"), ("phone", "+82 (0)10-1234-5678"), ("phone", "+353 1 222 3333"), ("phone", "+44 20 7946 0958"), ("phone", "(617) 555-0118"), ("phone", "+12025550143"),
    ("address", "12 Mill Bend, Ambrook 95257"), ("address", "221B Baker Street, London NW1 6XE"), ("address", "새터로 34, 16층"), ("id_number", "QQ 12 34 56 C"),
]


@pytest.mark.parametrize("kind,entity", PLACES)
def test_what_is_put_in_the_text_is_the_stand_in_that_was_checked(kind, entity):
    canon = personal.canonical(kind, entity)
    for attempt in range(8):
        stand_in = personal.surrogate(kind, canon, "", attempt, b"k")
        put = personal.dressed(kind, entity, canon, stand_in)
        assert personal.canonical(kind, put) == stand_in
        assert kind != "phone" or put.startswith(entity[: entity.index(" ")] if entity.startswith("+") and " " in entity else entity[:2])


@pytest.mark.parametrize(("address", "form"), [("Flat 3, 12 Mill Bend, Ambrook 95257", r"Flat [1-9], [1-9]\d \w+ Bend, \w+ [1-9]\d{4}"), ("221B Baker Street, London NW1 6XE", r"[1-9]\d\dB \w+ Street, \w+ NW[1-9] [1-9]XE"), ("가람시 다온구 새터로 34, 16층", r"[가-힣]{2}시 [가-힣]{2}구 [가-힣]{2}로 [1-9]\d, [1-9]\d층"), ("한강로 12번길 3-4", r"[가-힣]{2}로 [1-9]\d번길 [1-9]-[1-9]")])
def test_surrogate_addresses_keep_the_form(address, form):
    import re

    canon = personal.canonical("address", address)
    put = personal.dressed("address", address, canon, personal.surrogate("address", canon, "", 0, b"k"))
    assert re.fullmatch(form, put) and put != address


def test_initials_and_addresses_stay_distinct_in_the_text(spark):
    names = [f"{i}. {f}{e}" for i in "ABCDEFGHIJ" for f in ("Smith", "Baker", "Brask") for e in ("", "son", "wick")]
    entities = [("name", n) for n in names] + [("name", "J.Okrent"), ("name", "J. Okrent")] + [("address", f"{k} Mill Street") for k in range(1, 200)]
    docs = [(k, e) for k, (_, e) in enumerate(entities)]
    places = spark.createDataFrame([(k, kind, 1, len(e), e, "") for k, (kind, e) in enumerate(entities)], "doc_id long, pii_kind string, start_pos int, end_pos int, entity string, gender string")
    out = {r.doc_id: r.text[r.text.index(":") + 1 : -1] for r in personal.redact(spark.createDataFrame(docs, "doc_id long, text string"), b"k", places).collect()}
    assert out[len(names)].replace(" ", "") == out[len(names) + 1].replace(" ", "")
    assert len(set(out.values())) == len(entities) - 1 and not set(out.values()) & {e for _, e in entities}
