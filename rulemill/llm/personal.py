"""Personal information in free text (problem 8): finding it and putting keyed surrogates in its place.

Places are found on the text as it looks, with every character traced back to
where it stands in the original. E-mail addresses, identity and telephone
numbers and street addresses have forms of their own. Names are found in
contexts that name a person, which are fixed; the parts of names seen there,
over all documents, make a lexicon, with which names are found anywhere else.
One pass gives the sure places and all that has the form of a name; the lexicon
is a table that the latter are joined to.

Each distinct entity gets one surrogate of its type, drawn by a keyed hash in
the script, gender and format of the original: the same entity has the same
surrogate in every document, and collisions are checked so that two entities
never share one and none equals a real one. Put into the text it is marked as a
typed placeholder, [NAME:...], with all other text kept.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rulemill.functions.looks import glyphs
from rulemill.session import cut, spread

# Common Korean family names, those of two syllables first.
FAMILY = "남궁 황보 제갈 사공 선우 서문 독고 동방 김 이 박 최 정 강 조 윤 장 임 한 오 서 신 권 황 안 송 류 유 홍 전 고 문 손 양 배 백 허 남 심 노 하 곽 성 차 주 우 구 민 진 지 엄 채 원 천 방 공 현 함 변 염 여 추 도 소 석 선 설 마 길 연 위 표 명 기 반 왕 금 옥 육 인 맹 제 모 탁 국".split()
# Titles and forms of address after a Korean name.
TITLES = "팀장 부장 과장 차장 대리 사원 주임 책임 선임 수석 실장 본부장 국장 소장 원장 부원장 병원장 이사 상무 전무 대표 사장 회장 의장 위원 위원장 간사 총무 교수 박사 선생님 선생 의사 약사 간호사 변호사 기자 님 씨 귀하".split()
# Kinds of street.
STREETS = "Street St Road Rd Lane Ln Avenue Ave Drive Dr Court Ct Row Bend Place Pl Way Close Terrace Square Sq Hill Crescent Boulevard Blvd Gardens Grove Mews Parade Walk".split()

KO = "(?:" + "|".join(n for n in FAMILY if len(n) > 1) + "|[" + "".join(n for n in FAMILY if len(n) == 1) + "])"
KO_FIRST = "[" + "".join(sorted({n[0] for n in FAMILY})) + "]"
KO_NAME = rf"(?<![가-힣])({KO}(?: [가-힣] [가-힣]| ?[가-힣][가-힣]))"
TITLE = "(?:" + "|".join(sorted(TITLES, key=len, reverse=True)) + ")"
LETTER = r"[^\W\d_]"
CAPITAL = "[A-ZÀ-ÖØ-Þ]"
LONG = rf"{CAPITAL}(?:{LETTER}|['’])+(?:-{CAPITAL}(?:{LETTER}|['’])*)*"
EN_NAME = rf"((?:{LONG}, {LONG}|(?:{CAPITAL}\. |{LONG} ){LONG}))"
SPOKEN = "공영일이삼사오육륙칠팔구"

# Signs of an address and of its dots, plain or spelled out.
AT, DOT = r"(?:at|AT|At|골뱅이|앳)", r"(?:dot|DOT|Dot|점|닷)"
#: Implied by every form of EMAIL: what follows a bare ' at ' has a plain dot or a word for one.
MAY_BE_EMAIL = re.compile(rf"@|골뱅이|앳|[(\[{{] ?at|{DOT}| at [a-z0-9-]+\.[a-z0-9]", re.I)
EMAIL = re.compile(
    r"(?<![\w.%+*@-])(?<![@*] )[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_])?"
    rf"(?: ?@ ?| ?[(\[{{] ?{AT} ?[)\]}}] ?| (?:AT|at|골뱅이|앳) )"
    r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
    rf"(?:(?: ?[(\[{{] ?{DOT} ?[)\]}}] ?| {DOT} |\.)[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+"
)
#: What ends in a number behind a bare 'at' ('set at 12.50') is no host.
NO_HOST = re.compile(r" (?:AT|at) (?:\S+\.)?\d[\w-]*$")
PHONE = re.compile(
    rf"(?=[+(0-9{SPOKEN}])(?:"
    r"\+82[- .]?(?:\(0\)[- .]?|0)?\d{1,2}[- .)]{0,2}\d{3,4}[- .]?\d{4}"
    r"|\(?0(?:1[016789]|2|[3-6]\d|70|80|50\d)\)?[-. )]{0,2}\d{3,4}[-. ]{1,2}\d{4}"
    r"|01[016789]\d{7,8}|0(?:2|[3-6]\d)\d{7,8}"
    r"|\+1[-. ]?\(?\d{3}\)?[-. ]{0,2}\d{3}[-. ]?\d{4}"
    r"|(?:1[-. ]?)?\(\d{3}\) ?\d{3}[-. ]\d{4}"
    r"|(?:1[-. ])?[2-9]\d\d([-. ])\d{3}\1\d{4}|1[2-9]\d\d[2-9]\d{6}"
    r"|\+44[- .]?(?:\(0\))?[- .]?\d{2,5}[- .]?\d{3,4}[- .]?\d{3,4}"
    r"|\(?0(?:20|1\d{2,3}|7\d{3})\)? \d{3,4} \d{3,4}"
    r"|\+(?!82|1[^\d]|44)\d{1,3}[- .]\d{1,4}(?:[- .]\d{2,4}){2,4}"
    rf"|[{SPOKEN}]{{2,3}}[-. ][{SPOKEN}]{{3,4}}[-. ][{SPOKEN}]{{4}})"
)
DATE6 = r"\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])"
ID = re.compile(
    rf"(?=[A-Z0-9])(?:{DATE6}(?: ?[-–] ?| )?[1-8]\d{{6}}"
    r"|[1-9]\d-\d\d-\d{6}-\d\d|[A-Z]{1,2}\d{7,8}|[A-Z]\d{3}[A-Z]\d{4}|\d{3}[- ]\d\d-\d{4}"
    r"|[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|[A-Z]{5}\d{6}[A-Z0-9]{5}|9\d{8})"
)
PART = r"[가-힣]{1,6}(?:시|도|군|구|읍|면)"
ROAD = r"[가-힣]{1,8}(?:로|길)"
ROOM = r"(?:, ?(?:지하 ?)?\d+(?:층|호|동))*"
KO_ADDRESS = re.compile(
    rf"(?<![가-힣])(?:(?:{PART}\s{{1,3}}){{1,5}}(?:{ROAD} ?\d+(?:번길 ?\d+)?(?:-\d+)?{ROOM}|[가-힣]{{1,6}}(?:동|리|가) ?\d+(?:-\d+)?(?:번지)?{ROOM})"
    rf"|[가-힣]{{1,6}}(?:동|리) ?\d+(?:-\d+)?번지{ROOM}"
    rf"|{ROAD} ?\d+(?:번길 ?\d+(?:-\d+)?|(?:-\d+)?, ?\d+(?:층|호))"
    rf"|{ROAD} \d+(?:-\d+)?(?=(?:에|에서|로|으로|\(으\)로|이며|이다|입니다)?(?:[ ,.|\r\n]|$)))"
)
#: A town and a postcode of the United States or the United Kingdom behind a street.
TOWN = rf"(?:, ?(?:{CAPITAL}[a-z]+ ?){{1,2}}(?: ?\d{{5}}| ?[A-Z]{{1,2}}\d[A-Z\d]? \d[A-Z]{{2}})?)?"
MAY_BE_KO_ADDRESS = re.compile(r"(?:로|길|동|리|가) ?\d")
EN_ADDRESS = re.compile(
    rf"(?=[0-9FASU])(?:(?:Flat|Apt\.?|Unit|Suite) \d+[A-Za-z]?, ?)?(?<![\w$.,-])\d{{1,5}}[A-Za-z]? (?:{CAPITAL}[\w'’-]+ ){{1,3}}(?:{'|'.join(STREETS)})\b(?:\.(?=,| [a-z]))?{TOWN}"
    rf"|(?=[FASU])(?:Flat|Apt\.?|Unit|Suite) \d+[A-Za-z]?, ?\d{{1,5}}[A-Za-z]? (?:{CAPITAL}[\w'’-]+ ){{1,3}}(?:{'|'.join(STREETS)})\b(?:\.(?=,| [a-z]))?{TOWN}"
)
#: Contexts in which only a person can stand. Names found there are places, and teach the lexicon.
#: What begins with the name is found from its end: signs that follow a name, which is looked for before them.
KO_BEFORE = [
    re.compile(rf" {TITLE}(?:(?=[ ,.\r\n]|$)|(?=(?:에게|께|의|은|는|이|가|을|를|과|와)[ ,.]))"),
    re.compile(r"\(인\)"),
]
KO_ENDS = re.compile(rf"{KO_NAME}\Z")
KO_CONTEXTS = [
    re.compile(rf"받는 사람은 {KO_NAME}이다"),
    re.compile(rf"성명:? {KO_NAME} ?[/,|]"),
]
EN_CONTEXTS = [
    re.compile(p)
    for p in (
        rf"(?:Reviewed|Signed|Approved) by {EN_NAME}(?= and |[.,])",
        rf"According to {EN_NAME}, ",
        rf"ask for {EN_NAME}\.",
        rf"holder {EN_NAME}\.",
        rf"The patient, {EN_NAME}, ",
        rf"Attendee {EN_NAME} \(",
        rf"Neither {EN_NAME} nor ",
        rf"Contact: {EN_NAME},",
        rf"heard from {EN_NAME} that",
        rf"(?:Dr|Mr|Mrs|Ms|Prof)\. {EN_NAME}(?= [a-z]|[.,])",
        rf"regards,\s+{EN_NAME}(?=\s|$)",
    )
]
# Words that stand in such contexts as a name does and are none.
NO_NAMES = frozenset(
    "제조사 공급사 유통사 고객사 주관사 전문가 연구원 연구소 연구팀 기획팀 구매팀 홍보팀 인사팀 임상팀 안전팀 심의회 심사단 조직위 이사회 "
    "Act Agency Article Association Board Centre Center Clinic Code Committee Company Council Department Devices Director Foundation Group Guideline "
    "Hospital Institute Manager Medical Ministry Office Policy Secretariat Section Service Services Society Team Union University".split()
)
#: What may follow a Korean name without a blank.
AFTER = rf"(?=(?:{TITLE})?(?:이|가|은|는|을|를|의|와|과|도|만|에게|에게서|한테|께|께서|이다|입니다|이라고|로|으로|이나|등)?(?:은|는|이|가|을|를|의|도)?(?![가-힣]))"
#: A number that goes on, or a code of letters and digits, is another number.
NUMBER_BEFORE = re.compile(r"\d[-. ]?$|[A-Za-z*+-]$")
NUMBER_AFTER = re.compile(r"[-.]?[\d*]|[A-Za-z]")
CLUSTER = re.compile(r"[ᄀ-ᄒ][ᅡ-ᅵ][ᆨ-ᇂ]?|[가-힣][ᆨ-ᇂ]|.[\u0300-\u036f]+", re.S)


@lru_cache(1)
def odd_characters() -> frozenset[str]:
    return frozenset(map(chr, glyphs())) | frozenset(map(chr, (*range(0x300, 0x370), *range(0x1100, 0x1200))))


def fold(text: str) -> tuple[str, list[int] | range]:
    """The text as it looks, line ends as they are, and where each of its characters begins in ``text``."""
    if odd_characters().isdisjoint(text):
        return text, range(len(text))
    glyph = glyphs()
    out, at = [], []
    for i, c in enumerate(text):
        for g in glyph.get(ord(c), c):
            out.append(g)
            at.append(i)
    folded = "".join(out)
    if CLUSTER.search(folded):
        out, places, end = [], [], 0
        for m in CLUSTER.finditer(folded):
            out.append(folded[end : m.start()])
            places += at[end : m.start()]
            whole = unicodedata.normalize("NFC", m.group())
            out.append(whole)
            places += [at[m.start()]] * len(whole)
            end = m.end()
        out.append(folded[end:])
        folded, at = "".join(out), places + at[end:]
    return folded, at


def context_names(folded: str) -> list[tuple[int, int]]:
    """(start, end) of the names that stand in contexts of persons."""
    found = []
    for pattern in KO_BEFORE:
        for m in pattern.finditer(folded):
            if name := KO_ENDS.search(folded, max(0, m.start() - 6), m.start()):
                found.append(name.span(1))
    for pattern in KO_CONTEXTS + EN_CONTEXTS:
        found += [m.span(1) for m in pattern.finditer(folded)]
    return [(a, z) for a, z in found if NO_NAMES.isdisjoint(re.split("[ ,]+", folded[a:z]))]


WORD = re.compile(rf"(?<![\w'’.-])(?:{CAPITAL}\. ?)?({LONG})(?![\w'’]|-\w)")
KO_FORM = re.compile(rf"(?={KO_FIRST})(?<![가-힣])({KO})(?: ([가-힣]) ([가-힣])| ?([가-힣])([가-힣])){AFTER}")
#: A part of names counts for names elsewhere if that many different names in contexts have it.
LEAST = 2


def parts_of(name: str) -> tuple[str, str, str]:
    """(script, first, last) of a name as it looks: 'ko' with the two given syllables and the family name in front, else given and family name in lower case, an initial with its dot."""
    if "가" <= name[0] <= "힣":
        packed = name.replace(" ", "")
        return "ko", packed[-2:], packed[:-2]
    if ", " in name:
        last, first = name.split(", ", 1)
    elif m := re.match(rf"({CAPITAL}\.) ?(.+)", name):
        first, last = m[1], m[2]
    else:
        first, last = name.split(" ", 1)
    return "en", first.lower(), last.lower()


def name_forms(folded: str) -> list[tuple[int, int]]:
    """(start, end) of all that has the form of a name; some overlap."""
    found = [m.span() for m in KO_FORM.finditer(folded)]
    end_before, start_before = -1, -1
    for m in WORD.finditer(folded):
        start, word, end = m.start(), m.start(1), m.end()
        if word > start:
            found.append((start, end))
        elif end_before > 0 and folded[end_before:start] in (" ", ", "):
            found.append((start_before, end))
        start_before, end_before = word, end
    return found


def spans(folded: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, sure) in order. Sure places do not overlap, forms of names only each other."""
    found = [(*m.span(), "email") for m in EMAIL.finditer(folded) if not NO_HOST.search(m[0])] if MAY_BE_EMAIL.search(folded) else []
    for pattern, kind in (ID, "id_number"), (PHONE, "phone"):
        for m in pattern.finditer(folded):
            before, after = folded[max(0, m.start() - 2) : m.start()], folded[m.end() : m.end() + 2]
            if not NUMBER_BEFORE.search(before) and not NUMBER_AFTER.match(after):
                # A bracket that closes behind the number is not part of it.
                outer = m[0][0] == "(" and (")" not in m[0] or after[:1] == ")")
                found.append((m.start() + outer, m.end(), kind))
    if MAY_BE_KO_ADDRESS.search(folded):
        found += [(*m.span(), "address") for m in KO_ADDRESS.finditer(folded)]
    found += [(*m.span(), "address") for m in EN_ADDRESS.finditer(folded)]
    found += [(a, z, "name") for a, z in context_names(folded)]
    rank = {"email": 0, "id_number": 1, "phone": 2, "address": 3, "name": 4}
    kept: list[tuple[int, int, str, bool]] = []
    taken = bytearray(len(folded))
    for a, z, kind in sorted(found, key=lambda s: (rank[s[2]], s[0], -s[1])):
        if not any(taken[a:z]):
            taken[a:z] = b"\1" * (z - a)
            kept.append((a, z, kind, True))
    kept += [(a, z, "name", False) for a, z in name_forms(folded) if not any(taken[a:z])]
    return sorted(kept)


def gender_before(text: str) -> str:
    title = re.search(r"(?:\b(Mr)|\b(Mrs|Ms|Miss|Madam))\.? $", text[-8:])
    return "" if not title else "m" if title[1] else "f"


def _texts(documents: DataFrame) -> DataFrame:
    return spread(documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text"))


PLACES = "doc_id long, pii_kind string, start_pos int, end_pos int, entity string, gender string"


def read_places(texts: DataFrame) -> DataFrame:
    """Sure places and forms of names of (doc_id, text), in one pass: PLACES, sure, script, first, last, chain. Forms that overlap have one chain."""

    def run(batches):
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                folded, at = fold(text)
                chain, reach = 0, 0
                for a, z, kind, sure in spans(folded):
                    end = at[z] if z < len(at) else len(text)
                    chain += a >= reach
                    reach = max(reach, z)
                    name = kind == "name"
                    rows.append((doc, kind, at[a] + 1, end, folded[a:z], gender_before(folded[max(0, a - 8) : a]) if name else "", sure, *(parts_of(folded[a:z]) if name else (None, None, None)), chain))
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.int32()]
            names = ["doc_id", "pii_kind", "start_pos", "end_pos", "entity", "gender", "sure", "script", "first", "last", "chain"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return texts.mapInArrow(run, f"{PLACES}, sure boolean, script string, first string, last string, chain int")


def lexicon(names: DataFrame, least: int = LEAST) -> DataFrame:
    """(script, role, part) of the parts that ``least`` different names (script, first, last) have.

    Counted over different names, so copies of a text weigh as one. Korean
    parts are the family name and the first and the second given syllable, of
    which there are no more than Unicode has syllables.
    """
    role = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("part"))
    ko = F.array(role("last", F.col("last")), role("one", F.substring("first", 1, 1)), role("two", F.substring("first", 2, 1)))
    en = F.array(role("last", F.col("last")), role("first", F.when(~F.endswith("first", F.lit(".")), F.col("first"))))
    each = names.select("script", "first", "last").distinct().select("script", F.explode(F.when(F.col("script") == "ko", ko).otherwise(en)).alias("x"))
    return each.select("script", "x.*").where("part IS NOT NULL").groupBy("script", "role", "part").agg(F.count("*").alias("n")).where(F.col("n") >= least).drop("n")


def find_places(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """p8: (doc_id, pii_kind, start_pos, end_pos, entity, gender) of each place in (doc_id, text); positions count code points from 1.

    entity is the place as it looks, gender that of a title before a name. Null ids and texts have no places.

    What has the form of a name and stands in no context of a person is one if
    a context elsewhere names the same person, written out or by initial, or if
    its parts are in the lexicon. Different forms are joined to the lexicon
    first, so a form that is everywhere costs one row there.
    """
    found = cut(read_places(_texts(documents)))
    sure = found.where("sure")
    names = sure.where("pii_kind = 'name'").select("script", "first", "last").distinct()
    parts = cut(lexicon(names, least))
    part = lambda script, role, name: parts.where((F.col("script") == script) & (F.col("role") == role)).select(F.col("part").alias(name))
    forms = found.where("NOT sure").select("script", "first", "last").distinct()
    ko = forms.where("script = 'ko'").withColumns({"one": F.substring("first", 1, 1), "two": F.substring("first", 2, 1)})
    for role in ("last", "one", "two"):
        ko = ko.join(F.broadcast(part("ko", role, role)), role, "left_semi")  # syllables and family names: bounded by Unicode and FAMILY
    en = forms.where("script = 'en'")
    whole = en.where("first NOT LIKE '%.'").join(part("en", "first", "first"), "first", "left_semi").join(part("en", "last", "last"), "last", "left_semi")
    short = en.where("first LIKE '%.'").join(part("en", "last", "last"), "last", "left_semi")
    initials = names.where("script = 'en'").select("script", F.concat(F.substring("first", 1, 1), F.lit(".")).alias("first"), "last")
    order = ["script", "first", "last"]
    known = cut(ko.select(order).union(whole.select(order)).union(short.select(order)).union(forms.join(names.union(initials).distinct(), order, "left_semi").select(order)).distinct())
    more = found.where("NOT sure").join(known, order, "left_semi")
    # Of forms that overlap the first stands.
    before = F.lag("end_pos").over(Window.partitionBy("doc_id", "chain").orderBy("start_pos", "end_pos"))
    more = more.withColumn("_before", before).where("_before IS NULL OR _before < start_pos")
    columns = [c.split()[0] for c in PLACES.split(", ")]
    return sure.select(columns).union(more.select(columns))


# Parts of surrogate names, by script and gender, and of surrogate addresses.
KO_GIVEN = {"m": "준호 민수 성훈 재석 동욱 상철 영호 태민 진우 승현".split(), "f": "지영 수진 민지 은경 혜진 미영 소연 유진 정은 현주".split(), "": "지원 현수 승민 재영 은우 도현 서진 유정 민경 태희".split()}
KO_SYLLABLES = "가강건경고광구규근기나남노다대덕도동라로마명모문미민박배백범병보복봉부빈사산상서석선설성세소수숙순승시신아안애양언여연영예오옥완용우운원월유윤은을의이익인일자장재전정제조종주준중지진차찬창채천철초춘충치태택평하학한해향허헌현형혜호홍화환효후훈휘흥희"
EN_GIVEN = {"m": "James Robert Peter Thomas Henry Walter Oscar Martin".split(), "f": "Mary Susan Alice Helen Clara Ruth Nora Edith".split(), "": "Robin Alex Casey Jordan Morgan Riley Quinn Avery".split()}
EN_FAMILY = "Smith Baker Carter Mason Fisher Turner Cooper Walker Porter Hunter Archer Fletcher Sawyer Chandler Potter Weaver".split()
EN_STREETS = "Station Church Park Mill Bridge Garden Orchard Harbour Meadow Abbey Castle Forest".split()
EN_TOWNS = "Ashford Brookfield Fairview Greenville Kingston Lakeside Milton Newport Oakdale Riverton".split()
SPOKEN_DIGITS = str.maketrans("공영일이삼사오육륙칠팔구", "001234566789")
PAST_POOL = 4  # attempts after which surrogate names get a part more


def country_code(phone: str) -> str:
    """Of a telephone number that begins with +; codes of other countries end at the first sign."""
    return re.match(r"\+(82|44|1(?!\d\d?[- .])|\d{1,3}(?=[- .])|\d)", phone)[1]


def canonical(kind: str, entity: str) -> str:
    """What is the same for all spellings of one entity."""
    flat = " ".join(entity.split())
    if kind == "email":
        flat = re.sub(rf" ?[(\[{{]? ?{AT} ?[)\]}}] ?| (?:AT|at|골뱅이|앳) ", "@", flat)
        flat = re.sub(rf" ?[(\[{{] ?{DOT} ?[)\]}}] ?| {DOT} ", ".", flat)
        return flat.replace(" ", "").lower()
    if kind == "phone":
        flat = flat.translate(SPOKEN_DIGITS)
        digits = "".join(c for c in flat if c.isdecimal())
        if flat.startswith("+") and (code := country_code(flat)) != "1":
            own = digits[len(code) :]
            if code == "82" or "(0)" in flat:
                own = own.removeprefix("0")
            return "0" + own if code == "82" else f"+{code} {own}"
        return digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
    if kind == "id_number":
        return "".join(c for c in flat if c.isalnum()).upper()
    if kind == "name" and "가" <= flat[0] <= "힣":
        return flat.replace(" ", "")
    if kind == "name" and ", " in flat:
        last, first = flat.split(", ", 1)
        flat = f"{first} {last}"
    if kind == "name":
        flat = re.sub(r"^(\w\.) ?", r"\1 ", flat)
    return flat.lower()


#: Of a Korean address the words that name a place, by their ending; of an English one house, street and town.
KO_PLACE = re.compile(r"(?<![가-힣\d])[가-힣]+?(특별시|광역시|시|도|군|구|읍|면|로|길|동|리|가)(?![가-힣])")
EN_PLACE = re.compile(rf"(.*?\d+[a-z]?) .+? ({'|'.join(STREETS).lower()})\b(\.?)(?:(, ?)([a-z ]+?)( ?(?:\d{{5}}|[a-z]{{1,2}}\d[a-z\d]? \d[a-z]{{2}}))?)?$")


def address_like(canon: str, ko: bool, draw, attempt: int) -> str:
    """An address of the same form: places, streets and towns are drawn, digits too; flats, floors, kinds of street and forms of postcode stay."""
    if ko:
        out = KO_PLACE.sub(lambda m: "".join(KO_SYLLABLES[draw(len(KO_SYLLABLES))] for _ in "12") + m[1], canon)
    elif m := EN_PLACE.match(canon):
        out = f"{m[1]} {EN_STREETS[draw(len(EN_STREETS))]} {m[2]}{m[3]}" + (f"{m[4]}{EN_TOWNS[draw(len(EN_TOWNS))]}{m[6] or ''}" if m[5] else "")
    else:
        out = canon
    out = re.sub(r"\d+", lambda m: str(draw(9) + 1) + "".join(str(draw(10)) for _ in m[0][1:]), out.lower())
    if attempt >= PAST_POOL:  # a longer house number
        out = re.sub(r"\d+", lambda m: m[0] + str(draw(10)) * (attempt - PAST_POOL + 1), out, count=1)
    return out


def surrogate(kind: str, canon: str, gender: str, attempt: int, key: bytes) -> str:
    """The canonical form of a keyed stand-in of the same kind and script. Attempts give other ones."""
    seed = int.from_bytes(hmac.new(key, f"{kind}\n{canon}\n{attempt}".encode(), hashlib.sha512).digest(), "big")

    def draw(n: int) -> int:
        nonlocal seed
        seed, got = divmod(seed, n)
        return got

    if kind == "email":
        return f"user{draw(16**10):010x}@example.com"
    if kind == "phone":  # the network or area stays, so does the length
        head = canon.index(" ") + 2 if canon[0] == "+" else 3 if canon.startswith("01") else 2
        return canon[:head] + "".join(str(draw(10)) for _ in canon[head:])
    if kind == "id_number":
        if re.fullmatch(r"\d{13}", canon):  # a date and the digit of century and gender stay valid
            return f"{draw(100):02d}{draw(12) + 1:02d}{draw(28) + 1:02d}{canon[6]}{draw(10**6):06d}"
        return "".join(str(draw(10)) if c.isdecimal() else c for c in canon)
    ko = any("가" <= c <= "힣" for c in canon)
    if kind == "address":
        return address_like(canon, ko, draw, attempt)
    if ko:
        given = KO_GIVEN[gender][draw(10)] if attempt < 2 else "".join(KO_SYLLABLES[draw(len(KO_SYLLABLES))] for _ in range(2 + (attempt >= PAST_POOL)))
        return FAMILY[8 + draw(30)] + given
    family = EN_FAMILY[draw(16)] if attempt < 2 else "-".join(EN_FAMILY[draw(16)] for _ in range(2 + max(0, attempt - PAST_POOL)))
    given = f"{chr(ord('a') + draw(26))}." if re.match(r"\w\. ", canon) else EN_GIVEN[gender][draw(8)]
    return f"{given} {family}".lower()


def dressed(kind: str, entity: str, canon: str, stand_in: str) -> str:
    """The stand-in in the format of the entity: signs between digits, letter case, order and blanks of a name.

    ``canonical`` of it is the stand-in again, so what is distinct there is distinct in the text.
    """
    if kind in ("phone", "id_number"):
        source = entity.translate(SPOKEN_DIGITS) if kind == "phone" else entity
        pool = [c for c in stand_in.split(" ")[-1] if c.isalnum()]
        # What the entity has more in front - a country code, a zero in brackets - stays, and what it writes less falls away.
        code = len(country_code(source)) if kind == "phone" and source[0] == "+" else 0
        places = [i for i, c in enumerate(source) if c.isalnum()][code:]
        out = list(source)
        for i, c in zip(places[::-1], pool[::-1]):
            out[i] = c
        return "".join(out)
    if kind == "email":
        return stand_in.upper() if entity.isupper() else stand_in
    if kind == "name" and canon[0].isascii() is False and "가" <= canon[0] <= "힣":
        return " ".join(stand_in) if entity.count(" ") >= 2 else stand_in
    if kind == "name":
        first, last = (w.title() for w in stand_in.split(" ", 1))
        last = last.upper() if re.search(r"\b[^\W\d_a-zß-ÿ]{3,}", entity) else last
        return f"{last}, {first}" if "," in entity else f"{first} {last}"
    if stand_in.isascii():
        return re.sub(r"\b[A-Za-z]{1,2}\d[A-Za-z\d]? \d[A-Za-z]{2}\b", lambda m: m[0].upper(), re.sub(r"[a-z]+", lambda m: m[0].capitalize(), stand_in))
    return stand_in


def surrogates(entities: DataFrame, key: bytes, rounds: int = 20) -> DataFrame:
    """(pii_kind, canon, stand_in) for distinct (pii_kind, canon, gender): no two share one, and none is a real entity.

    Of those that drew the same stand-in the smallest keeps it, the others
    draw again, and so do those that drew a real one.
    """

    def draw(batches):
        for b in batches:
            drawn = [surrogate(*r, key) for r in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(drawn, pa.string())], [*b.schema.names, "stand_in"])

    real = entities.select("pii_kind", F.col("canon").alias("stand_in"))
    state = entities.select("pii_kind", "canon", "gender", F.lit(0).alias("attempt"))
    for _ in range(rounds):
        drawn = cut(spread(state).mapInArrow(draw, "pii_kind string, canon string, gender string, attempt int, stand_in string"))
        first = drawn.groupBy("pii_kind", "stand_in").agg(F.min("canon").alias("owner"))
        judged = drawn.join(first, ["pii_kind", "stand_in"]).join(real.withColumn("taken", F.lit(True)), ["pii_kind", "stand_in"], "left")
        again = F.col("taken").isNotNull() | (F.col("owner") != F.col("canon"))
        judged = cut(judged.select("pii_kind", "canon", "gender", "stand_in", F.col("attempt") + F.when(again, 1).otherwise(0).alias("attempt"), again.alias("again")).toDF("pii_kind", "canon", "gender", "stand_in", "attempt", "again"))
        if not judged.where("again").head(1):
            return judged.select("pii_kind", "canon", "stand_in")
        state = judged.select("pii_kind", "canon", "gender", "attempt")
    raise ValueError("surrogates keep colliding; give them a larger range")


def by_rows(function):
    """A column function that gives ``function`` of the values of its columns, Arrow batch by Arrow batch."""

    @F.arrow_udf("string")
    def one(a: pa.Array) -> pa.Array:
        return pa.array([function(x) for x in a.to_pylist()], pa.string())

    @F.arrow_udf("string")
    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([function(*x) for x in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.string())

    @F.arrow_udf("string")
    def four(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        return pa.array([function(*x) for x in zip(*(y.to_pylist() for y in (a, b, c, d)), strict=True)], pa.string())

    return lambda *columns: {1: one, 2: two, 4: four}[len(columns)](*columns)


def redact(documents: DataFrame, key: bytes, places: DataFrame | None = None) -> DataFrame:
    """(doc_id, text) with each place replaced by [KIND:surrogate] and all other text kept. Null texts stay null.

    doc_id must be unique. An initial with a family name is an entity of its own.
    """
    places = cut(places if places is not None else find_places(documents))
    canon = by_rows(canonical)
    named = cut(places.where("start_pos <= end_pos").withColumn("canon", canon("pii_kind", "entity")))
    table = surrogates(named.groupBy("pii_kind", "canon").agg(F.max("gender").alias("gender")), key)
    dress = by_rows(dressed)
    fitted = named.join(table, ["pii_kind", "canon"]).select("doc_id", "start_pos", "end_pos", F.concat(F.lit("["), F.upper("pii_kind"), F.lit(":"), dress("pii_kind", "entity", "canon", "stand_in"), F.lit("]")).alias("put"))
    by_doc = fitted.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "put"))).alias("puts"))

    def splice(text: str | None, puts: list[dict] | None) -> str | None:
        if text is None or not puts:
            return text
        out, at = [], 0
        for p in puts:
            out += [text[at : p["start_pos"] - 1], p["put"]]
            at = p["end_pos"]
        return "".join([*out, text[at:]])

    return documents.select("doc_id", "text").join(by_doc, "doc_id", "left").select("doc_id", by_rows(splice)("text", "puts").alias("text"))
