"""Text as a reader sees it.

Two texts look the same when the reader sees the same letters, digits, signs
and blanks in the same order. ``look`` gives the one written form of a text:

* canonical composition (combining accents, conjoining Hangul letters and
  compatibility ideographs come out as the usual single characters);
* full-width and half-width forms and radicals as the plain character;
* letters of other scripts that look like a Latin letter as that letter;
* what cannot be seen (zero-width, soft hyphen, control) removed;
* every blank as one space, every line end as a line feed.

Case, accents, the number of blanks, line breaks and raised or circled digits
can be seen and stay.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of other scripts and the Latin letter each looks like.
LOOKALIKES = {
    "АВЕЅІЈКМНОРСТҮХԌԚԜ": "ABESIJKMHOPCTYXGQW",
    "аеорсухѕіјүһԁԛԝ": "aeopcyxsijyhdqw",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ": "ABEZHIKMNOPTYXCJ",
    "ορϲνϳ": "opcvj",
    "һӏӀ": "hlI",
    "ՕՏԼ": "OSL",
    "օսոհ": "ounh",
    "ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ": "ABCDEHJKLMPRSTVWZ",
    "ɡıȷɑ": "gija",
}
# Signs that look like a common sign.
SIGNS = {"‐‑﹣": "---", "‧⋅ㆍ・･∙": "·" * 6}
#: Letters that render as empty space.
BLANK_LETTERS = "\u3164\uffa0\u2800"
LINE_ENDS = "\u000b\u000c\u0085\u2028\u2029"
#: Joiners, fillers, direction marks and selectors inside other categories.
UNSEEN = [(0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0xFE00, 0xFE0F), (0xE0100, 0xE01EF)]
#: Where code points that change lie: all but the large blocks of ideographs and syllables and the planes of rare scripts.
CHANGEABLE = [(0, 0x3400), (0xA000, 0xAC00), (0xE000, 0x10000), (0x1BCA0, 0x1BCB0), (0x1D160, 0x1D180), (0xE0000, 0xE0200)]


def is_unseen(code: int) -> bool:
    kind = unicodedata.category(chr(code))
    return kind == "Cf" or kind == "Cc" and code not in (9, 10, 13, *map(ord, LINE_ENDS)) or any(a <= code <= b for a, b in UNSEEN)


@lru_cache(1)
def glyphs() -> dict[int, str]:
    """Code point to what stands for it, for all that changes."""
    out: dict[int, str] = {}
    for code in chain(*(range(a, b) for a, b in CHANGEABLE)):
        char = chr(code)
        parts = unicodedata.decomposition(char).split()
        if is_unseen(code):
            out[code] = ""
        elif char in LINE_ENDS:
            out[code] = "\n"
        elif char == "\t" or unicodedata.category(char) == "Zs" or char in BLANK_LETTERS:
            out[code] = " "
        elif parts and (parts[0] in ("<wide>", "<narrow>") or parts[0] == "<compat>" and (0x2E80 <= code < 0x2FE0 or 0xFB00 <= code <= 0xFB06 or 0x2160 <= code < 0x2180)):
            out[code] = "".join(chr(int(x, 16)) for x in parts[1:])
    for table in (LOOKALIKES, SIGNS):
        for theirs, ours in table.items():
            out.update({ord(a): b for a, b in zip(theirs, ours, strict=True)})
    return {a: b for a, b in out.items() if chr(a) != b}


def look(text: str) -> str:
    if text.isascii() and text.isprintable():
        return text
    text = unicodedata.normalize("NFD", text.replace("\r\n", "\n").replace("\r", "\n"))
    return unicodedata.normalize("NFC", text.translate(glyphs()))


def plain_id(text: str) -> str:
    """A rule id as it looks, without blanks around it, in lower case."""
    return look(text).strip().lower()


#: Characters that are in written form and compose with nothing in this set: a text of these alone needs no rewriting.
PLAIN = " -~\n가-힣一-鿿À-ÖØ-öø-ÿ①-⑮「」『』“”‘’·※→㎡"


def _mapped(function, texts: Column) -> Column:
    """``function`` of the texts that may need it; what is plain passes by in the JVM. Null stays null."""

    @F.pandas_udf("string")
    def udf(rows: pd.Series) -> pd.Series:
        return rows.map(function, na_action="ignore")

    plain = texts.rlike(rf"\A[{PLAIN}]*\z")
    return F.when(plain, texts).otherwise(udf(F.when(~plain, texts)))


def look_column(column: Column) -> Column:
    """``look`` of a string column; null stays null."""
    return _mapped(look, column)


def plain_id_column(column: Column) -> Column:
    """``plain_id`` of a string column; null stays null, blank gives ''."""
    return F.lower(F.regexp_replace(look_column(column), r"(?U)\A\s+|\s+\z", ""))


def look_sql(text: str) -> str:
    """The same in DuckDB SQL for a string expression, short of radicals without a single counterpart."""
    gone = "".join(chr(c) for c, to in glyphs().items() if not to and c < 0x10000 and c > 0)
    pairs = [(chr(c), to) for c, to in sorted(glyphs().items()) if len(to) == 1]
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return f"nfc_normalize(translate(replace(replace({text}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), {quoted(''.join(a for a, _ in pairs) + gone)}, {quoted(''.join(b for _, b in pairs))}))"


def plain_id_sql(text: str) -> str:
    return f"lower(trim({look_sql(text)}))"
