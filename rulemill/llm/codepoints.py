"""Whole Arrow columns of text as code-point arrays, and their one written form.

A column's UTF-8 buffer becomes one numpy array of code points with a zero
after each row. Every step works on that array: a gather from lookup tables
replaces each code point by its expansion (canonical parts, the letter it
looks like, or nothing), expansion offsets place the parts, and marks and
Hangul letters are then composed in place. No string method is called a row.
``form`` equals ``rulemill.functions.looks.look`` row by row.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from rulemill.functions.looks import glyphs

MAX = sys.maxunicode + 1
# Hangul composition.
L0, V0, T0, S0, L_N, V_N, T_N = 0x1100, 0x1161, 0x11A7, 0xAC00, 19, 21, 28
CR, LF = 13, 10


class Tables(NamedTuple):
    first: np.ndarray  # code point -> where its expansion starts
    size: np.ndarray  # code point -> length of its expansion
    parts: np.ndarray  # all expansions, one after another
    order: np.ndarray  # code point -> canonical combining class
    second: np.ndarray  # code point -> can be the second of a pair
    pair: np.ndarray  # sorted first * 2^21 + second
    whole: np.ndarray  # what each pair composes to


class Letters(NamedTuple):
    low: np.ndarray  # code point -> its lower case
    kept: np.ndarray  # code point -> is a letter, a digit or a row end


def _expansions(changed: dict[int, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first, size = np.arange(MAX, dtype=np.int32), np.ones(MAX, np.uint8)
    extra, at = [np.arange(MAX, dtype=np.int32)], MAX
    for code, text in changed.items():
        codes = np.array([ord(c) for c in text], np.int32)
        first[code], size[code] = at, len(codes)
        extra.append(codes)
        at += len(codes)
    return first, size, np.concatenate(extra)


@lru_cache(1)
def tables() -> Tables:
    """Built from the Unicode database of the running Python and the glyph map."""
    glyph = glyphs()
    changed = {c: t for c, t in glyph.items()}
    order, second = np.zeros(MAX, np.uint8), np.zeros(MAX, bool)
    pairs: dict[int, int] = {}
    for code in range(0x30000):
        if 0x3400 <= code < 0xA000 or 0xAC00 <= code < 0xE000 or 0x20000 <= code < 0x2F800:
            continue  # ideographs, syllables and surrogates have no parts here
        char = chr(code)
        if k := unicodedata.combining(char):
            order[code] = k
        if (split := unicodedata.decomposition(char)) and split[0] != "<":
            parts = unicodedata.normalize("NFD", char)
            changed[code] = "".join(glyph.get(ord(c), c) for c in parts)
            two = [int(x, 16) for x in split.split()]
            if len(two) == 2 and unicodedata.normalize("NFC", char) == char:
                pairs[two[0] << 21 | two[1]] = code
                second[two[1]] = True
    keys = np.array(sorted(pairs), np.int64)
    changed = {c: t for c, t in changed.items() if t != chr(c)}
    changed[0] = ""  # the row end is set apart before
    return Tables(*_expansions(changed), order, second, keys, np.array([pairs[k] for k in keys.tolist()], np.int32))


@lru_cache(1)
def letter_tables() -> Letters:
    """Lower case of letters and digits (Unicode L and N); all else goes. No lower case has more than one letter or digit."""
    low, kept = np.arange(MAX, dtype=np.int32), np.zeros(MAX, bool)
    kept[0] = True
    for code in range(0x32400):  # beyond lie private use and selectors
        char = chr(code)
        if unicodedata.category(char)[0] in "LN":
            kept[code] = True
            (low[code],) = (ord(c) for c in char.lower() if unicodedata.category(c)[0] in "LN")
    return Letters(low, kept)


@lru_cache(1)
def odd_table() -> np.ndarray:
    """Code point -> a text with it may not be in written form yet."""
    t = tables()
    odd = (t.size != 1) | (t.parts[:MAX] != t.parts[t.first]) | (t.order > 0) | t.second
    odd[0x1100:0x1200] = True
    odd[CR] = True
    odd[0] = False
    return odd


def decode(column: pa.Array) -> np.ndarray:
    """Code points of all rows, a zero after each. Zeros inside a text are dropped; null counts as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    ends = heads[offsets[1:] - offsets[0]]
    codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.int32)
    if len(codes) and not codes.all():
        kept = codes != 0
        ends = np.concatenate([[0], np.cumsum(kept)])[ends]
        codes = codes[kept]
    out = np.zeros(len(codes) + n, np.int32)
    at = np.arange(len(codes)) + np.repeat(np.arange(n), np.diff(ends, prepend=0))
    out[at] = codes
    return out


def encode(codes: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The inverse of ``decode``; ``valid`` marks the rows that are not null."""
    ends = np.flatnonzero(codes == 0)
    kept = codes != 0
    text = codes[kept]
    widths = np.zeros(len(codes), np.int64)
    widths[kept] = 1 + (text > 0x7F) + (text > 0x7FF) + (text > 0xFFFF)
    offsets = np.concatenate([[0], np.cumsum(widths)[ends]]).astype(np.int64)
    data = text.astype("<i4").tobytes().decode("utf-32-le").encode("utf-8")
    mask = None if valid is None or valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data), mask)


def expand(codes: np.ndarray, first: np.ndarray, size: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Each code point replaced by its expansion; row ends stay."""
    count = size[codes].astype(np.int64)
    count[codes == 0] = 1
    start = first[codes]
    start[codes == 0] = 0
    if (count == 1).all():
        return parts[start]
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    within = np.arange(total) - np.repeat(ends - count, count)
    return parts[np.repeat(start, count) + within]


def _hangul(codes: np.ndarray) -> np.ndarray:
    lead = (codes >= L0) & (codes < L0 + L_N)
    vowel = (codes >= V0) & (codes < V0 + V_N)
    pair = np.flatnonzero(lead[:-1] & vowel[1:])
    if len(pair):
        codes = codes.copy()
        codes[pair] = S0 + ((codes[pair] - L0) * V_N + codes[pair + 1] - V0) * T_N
        kept = np.ones(len(codes), bool)
        kept[pair + 1] = False
        codes = codes[kept]
    tail = (codes > T0) & (codes < T0 + T_N)
    if tail.any():
        open_ = (codes >= S0) & (codes < S0 + L_N * V_N * T_N) & ((codes - S0) % T_N == 0)
        pair = np.flatnonzero(open_[:-1] & tail[1:])
        codes = codes.copy()
        codes[pair] += codes[pair + 1] - T0
        kept = np.ones(len(codes), bool)
        kept[pair + 1] = False
        codes = codes[kept]
    return codes


def _find(t: Tables, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What each pair composes to, or 0."""
    key = a.astype(np.int64) << 21 | b
    at = np.minimum(np.searchsorted(t.pair, key), len(t.pair) - 1)
    return np.where(t.pair[at] == key, t.whole[at], 0)


def compose(codes: np.ndarray) -> np.ndarray:
    """Canonical composition of fully decomposed code points; rows end with zero."""
    t = tables()
    if t.second[codes].any():
        codes = _neighbours(t, codes)
    order = t.order[codes]
    marks = np.flatnonzero(order)
    if len(marks):
        # Canonical order: within each run of marks by class, stable.
        if (order[marks[1:]] < order[marks[:-1]])[np.diff(marks) == 1].any():
            run = np.cumsum(np.concatenate([[True], np.diff(marks) > 1]))
            by = np.lexsort((order[marks], run))
            codes = codes.copy()
            codes[marks] = codes[marks][by]
            order = t.order[codes]
        codes = _marks(t, codes, order, marks)
    if t.second[codes].any():
        codes = _neighbours(t, codes)
    return _hangul(codes)


def _marks(t: Tables, codes: np.ndarray, order: np.ndarray, marks: np.ndarray) -> np.ndarray:
    new_run = np.concatenate([[True], np.diff(marks) > 1])
    starts = np.flatnonzero(new_run)
    base = marks[starts] - 1  # the starter of each run, -1 at the very begin
    lengths = np.diff(np.concatenate([starts, [len(marks)]]))
    codes = codes.copy()
    kept = np.ones(len(codes), bool)
    blocked = np.zeros(len(starts), np.int16)  # class of the last mark left standing
    runs = np.flatnonzero((base >= 0) & (codes[base] != 0))
    k = 0
    while len(runs):
        at = marks[starts[runs]] + k
        host = base[runs]
        free = blocked[runs] < order[at]
        whole = np.where(free, _find(t, codes[host], codes[at]), 0)
        hit = whole > 0
        codes[host[hit]] = whole[hit]
        kept[at[hit]] = False
        blocked[runs[~hit]] = order[at[~hit]]
        k += 1
        runs = runs[lengths[runs] > k]
    return codes[kept]


def _neighbours(t: Tables, codes: np.ndarray) -> np.ndarray:
    """Pairs of two starters, as vowel signs of some scripts, from left to right."""
    while True:
        at = np.flatnonzero(t.second[codes[1:]] & (t.order[codes[1:]] == 0) & (codes[:-1] != 0))
        whole = _find(t, codes[at], codes[at + 1]) if len(at) else np.empty(0, np.int32)
        at, whole = at[whole > 0], whole[whole > 0]
        if not len(at):
            return codes
        alone = np.concatenate([[True], np.diff(at) > 1])
        at, whole = at[alone], whole[alone]
        codes = codes.copy()
        codes[at] = whole
        codes = np.delete(codes, at + 1)


def form(codes: np.ndarray) -> np.ndarray:
    """The one written form, as code points. Rows without an odd character are in it and pass by."""
    odd = odd_table()[codes]
    if not odd.any():
        return codes
    ends = np.flatnonzero(codes == 0)
    row_odd = np.logical_or.reduceat(odd, np.concatenate([[0], ends[:-1] + 1]))
    if row_odd.all():
        return _form(codes)
    sizes = np.diff(ends, prepend=-1)
    mine = np.repeat(row_odd, sizes)
    done = _form(codes[mine])
    new = sizes.copy()
    new[row_odd] = np.diff(np.flatnonzero(done == 0), prepend=-1)
    place = np.repeat(row_odd, new)
    out = np.empty(len(place), np.int32)
    out[place] = done
    out[~place] = codes[~mine]
    return out


def _form(codes: np.ndarray) -> np.ndarray:
    cr = codes == CR
    if cr.any():
        follows = np.concatenate([codes[1:] == LF, [False]])
        codes = np.where(cr, LF, codes)[~(cr & follows)]
    t = tables()
    return compose(expand(codes, t.first, t.size, t.parts))


def letters(codes: np.ndarray) -> np.ndarray:
    """Of a written form the letters and digits in lower case."""
    t = letter_tables()
    return t.low[codes[t.kept[codes]]]


def valid_rows(column: pa.Array) -> np.ndarray:
    return np.asarray(column.is_valid())


def look_array(column: pa.Array) -> pa.Array:
    """Written form of a string column; null stays null."""
    return encode(form(decode(column)), valid_rows(column))


def letters_array(column: pa.Array) -> pa.Array:
    """Letters of a string column; null stays null."""
    return encode(letters(form(decode(column))), valid_rows(column))


def row_bounds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First position and length of each row in an array with row ends."""
    ends = np.flatnonzero(codes == 0)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    return starts, ends - starts
