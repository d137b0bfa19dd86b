"""Text normalisation, as column expressions, with plain-Python twins for the Arrow functions that need them.

Expressions stay in the JVM.  Unicode decomposition is a ``translate`` over the characters that decompose to one ASCII
character (a table built from ``unicodedata``); text with a character that decomposes to several takes a second,
lazily evaluated branch.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from medspan.functions import lexicon as lx

_CONFUSABLE = str.maketrans(lx.CONFUSABLE_FROM, lx.CONFUSABLE_TO)
_STOP = frozenset(lx.CONTEXT_WORDS)


@lru_cache(maxsize=1)
def decompositions() -> tuple[str, str, dict[str, str]]:
    """Characters that decompose to one ASCII character, what they become, and those that become several."""
    one_from, one_to, many = [], [], {}
    for code in range(128, 0x110000):
        c = chr(code)
        if not unicodedata.decomposition(c):
            continue
        ascii_part = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if len(ascii_part) == 1:
            one_from.append(c)
            one_to.append(ascii_part)
        elif ascii_part:
            many[c] = ascii_part
    return "".join(one_from), "".join(one_to), many


def _class_of(chars) -> str:
    """Character class of a set of characters, runs as ranges."""
    codes, runs = sorted(map(ord, chars)), []
    for c in codes:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in runs) + "]"


def fold(text: Column, lookalikes: bool = True) -> Column:
    """ASCII form of a text: look-alikes (if asked) and decompositions replaced, everything else outside ASCII deleted.

    Plain ASCII passes through after one scan.  Characters that decompose to several are looked for in what is left of
    a text without its ASCII characters, and looked up for those alone.
    """
    one_from, one_to, many = decompositions()
    plain = F.translate(text, lx.CONFUSABLE_FROM, lx.CONFUSABLE_TO) if lookalikes else text
    table = F.from_json(F.lit(json.dumps(many)), "map<string,string>")  # a literal: folded once
    spread = F.array_join(F.transform(F.split(plain, ""), lambda c: F.when(c < "\x80", c).otherwise(F.coalesce(F.try_element_at(table, c), c))), "")
    full = F.when(F.regexp_replace(plain, r"[\x00-\x7F]+", "").rlike(_class_of(many)), spread).otherwise(plain)
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(full, one_from, one_to), r"[^\x00-\x7F]+", "")).otherwise(text)


def normalize(text: Column) -> Column:
    """Lower-case ASCII letters and digits, single spaces between; null stays null."""
    return F.trim(F.regexp_replace(F.lower(fold(text)), "[^a-z0-9]+", " "))


def words(norm: Column) -> Column:
    """Words of a normalised text; an empty text has none."""
    return F.filter(F.split(norm, " "), lambda w: w != "")


def strip_context(norm: Column) -> Column:
    """A normalised text without route, schedule, form and glue words."""
    return F.array_join(F.filter(words(norm), lambda w: ~w.isin(lx.CONTEXT_WORDS)), " ")


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def clause_parts(line: Column, start: Column, end: Column) -> tuple[Column, Column, Column]:
    return F.substring(line, F.lit(1), start), F.substring(line, start + 1, end - start), F.substring(line, end + 1, F.length(line))


def clause_around(line: Column, start: Column, end: Column) -> Column:
    """Text around a span up to the nearest of ``. ; : ! ? ,`` on each side."""
    left, own, right = clause_parts(line, start, end)
    return strip_space(F.concat(F.regexp_extract(left, r"(?s)[^.;:!?,]*\z", 0), own, F.regexp_extract(right, r"(?s)^[^.;:!?,]*", 0)))


def segment_around(line: Column, start: Column, end: Column) -> Column:
    """Text around a span, narrowed by each segment break in turn; the whole line if under 3 characters are left."""
    left, own, right = clause_parts(line, start, end)
    for mark in lx.SEGMENT_BREAKS:
        left = F.regexp_extract(left, rf"(?is)^(?:.*{mark})?(.*)\z", 1)
        right = F.regexp_extract(right, rf"(?is)^(.*?)(?:{mark}.*)?\z", 1)
    own_segment = strip_space(F.concat(left, own, right))
    return F.when(F.length(own_segment) < 3, strip_space(line)).otherwise(own_segment)


def normalize_py(text: str) -> str:
    if text.isascii():
        return " ".join(re.findall("[a-z0-9]+", text.lower()))
    decomposed = unicodedata.normalize("NFKD", text.translate(_CONFUSABLE))
    return " ".join(re.findall("[a-z0-9]+", decomposed.encode("ascii", "ignore").decode().lower()))


def strip_context_py(norm: str) -> str:
    return " ".join(w for w in norm.split() if w not in _STOP)


_SPELLED = re.compile(r"(?<!\S)(?:[a-z] ){2,}[a-z](?!\S)")
_BORDER = re.compile(r"(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])")
_SPLIT_UNIT = re.compile(r"\b([0-9]+) *(m *c *g|m *g|m *l)\b")
LETTER_O = re.compile(rf"[0-9o]+(?:{lx.UNIT})?")


def _pair(first: str, second: str) -> str | None:
    """The word that two neighbours make together, if they may be one word torn apart."""
    if not (first.isalpha() and second.isalpha() and 2 <= len(first) <= 6 and 2 <= len(second) <= 8):
        return None
    if first in _STOP or second in _STOP:
        return None
    whole = first + second
    return lx.TOKEN_REPLACEMENTS.get(whole) or (whole if len(whole) >= 7 else None)


def noisy_py(text: str) -> str:
    """Normalised text with spelled-out words, torn words, units, shorthands and zeros repaired."""
    norm = _SPELLED.sub(lambda m: m[0].replace(" ", ""), normalize_py(text))
    norm = _SPLIT_UNIT.sub(lambda m: f"{m[1]} {m[2].replace(' ', '')}", _BORDER.sub(" ", norm))
    queue = norm.split()[::-1]
    out: list[str] = []
    while queue:
        word = queue.pop()
        word = word.replace("o", "0") if LETTER_O.fullmatch(word) else word
        whole = lx.TOKEN_REPLACEMENTS.get(word)
        if whole is None and queue:
            whole = _pair(word, queue[-1])
            if whole is not None:
                queue.pop()
        out.append(word if whole is None else whole)
    return " ".join(out)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def noisy(text: Column) -> Column:
    """Column form of ``noisy_py``; null stays null.

    Which neighbours are joined depends on the words before them.  Each word is marked by whether it could be joined to the next, and one
    scan of the marks, taking two at a time where the first says so, does what a walk over the words would.
    """
    table = F.from_json(F.lit(json.dumps(lx.TOKEN_REPLACEMENTS)), "map<string,string>")
    norm = F.regexp_replace(normalize(text), "(?<=(?:^| )[a-z] [a-z]) (?=[a-z](?: |$))|(?<=(?:^| )[a-z]) (?=[a-z] [a-z](?: |$))", "")
    norm = F.regexp_replace(norm, "(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])", " ")
    for unit in ("mg", "mcg", "ml"):
        norm = F.regexp_replace(norm, rf"\b([0-9]+) *{' *'.join(unit)}\b", f"$1 {unit}")
    zeros = rf"^[0-9o]+(?:{lx.UNIT})?$"

    def joins(first: Column, second: Column) -> Column:
        whole = F.concat(first, second)
        able = F.try_element_at(table, first).isNull() & first.rlike("^[a-z]{2,6}$") & second.rlike("^[a-z]{2,8}$") & ~first.isin(lx.CONTEXT_WORDS) & ~second.isin(lx.CONTEXT_WORDS)
        return able & ((F.length(whole) >= 7) | F.try_element_at(table, whole).isNotNull())

    def repaired(raw: Column, own: Column, marks: Column) -> Column:
        def made(word: Column, i: Column) -> Column:
            whole = F.concat(word, F.get(raw, i + 1))
            return F.when(F.get(marks, i) == "J", F.coalesce(F.try_element_at(table, whole), whole)).when(F.get(marks, i) == "0", F.coalesce(F.try_element_at(table, word), word))

        return F.array_join(F.transform(own, made), " ")  # words that were joined to the one before are null and left out

    def over(raw: Column) -> Column:
        fixed = F.transform(raw, lambda w: F.when(w.contains("o") & w.rlike(zeros), F.translate(w, "o", "0")).otherwise(w))
        return bound(fixed, lambda own: bound(marks_of(raw, own), lambda marks: repaired(raw, own, marks)))

    def marks_of(raw: Column, own: Column) -> Column:
        flags = F.array_join(F.transform(own, lambda w, i: F.when(F.coalesce(joins(w, F.get(raw, i + 1)), F.lit(False)), "1").otherwise("0")), "")
        return F.split(F.regexp_replace(flags, "1.", "JS"), "")

    return bound(words(norm), over)
