"""Names in other spellings: an audit that sees through escapes, case, composition and characters that don't show.

A text is read as a JSON or HTML reader would read it, a character at a time, and
each character of the result knows where in the text it came from. One automaton
over the keys, spelled the same way, then finds them with their places in the text
as it stands. Single hits are what it gives; a key within another is one too.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.batches import in_parts
from ..sources.scratch import written
from .replace import MOST

#: What stands for another character: JSON's escapes (pairs of them beyond U+FFFF), HTML's references, and characters without width.
_UNIT = re.compile(r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\[\"\\/bfnrt]|&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};|&[A-Za-z][A-Za-z0-9]{1,31};|[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")
_JSON = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


def _meant(unit: str) -> str:
    if unit[0] == "&":
        return html.unescape(unit)
    if unit[0] != "\\":
        return ""
    if unit[1] != "u":
        return _JSON.get(unit[1], unit[1])
    code = bytes.fromhex(unit.replace("\\u", ""))
    try:
        return code.decode("utf-16-be")
    except UnicodeDecodeError:  # half of a pair
        return unit


def _composed(chars: list[str], places: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """Each letter with its marks as one, in lower case, and the place of each character."""
    out, where, i = [], [], 0
    while i < len(chars):
        j = i + 1
        while j < len(chars) and unicodedata.combining(chars[j]):
            j += 1
        new = unicodedata.normalize("NFC", unicodedata.normalize("NFC", "".join(chars[i:j])).casefold())
        out.append(new)
        where += [(places[i][0], places[j - 1][1])] * len(new)
        i = j
    return "".join(out), where


def spelled(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The text as readers take it, and where in the text each of its characters stands: from, to."""
    if text.isascii() and not _UNIT.search(text):
        return text.lower(), [(i, i + 1) for i in range(len(text))]
    chars: list[str] = []
    places: list[tuple[int, int]] = []
    at = 0
    for m in _UNIT.finditer(text):
        meant = _meant(m.group())
        if meant == m.group():  # no reference that readers know: its characters are themselves
            continue
        for i in range(at, m.start()):
            chars.append(text[i])
            places.append((i, i + 1))
        for c in meant:
            chars.append(c)
            places.append(m.span())
        at = m.end()
    for i in range(at, len(text)):
        chars.append(text[i])
        places.append((i, i + 1))
    return _composed(chars, places)


def spelled_hits(texts: DataFrame, key: Column, text: Column, keys: Column, of: DataFrame, most: int = MOST) -> DataFrame:
    """(id, key, place, length): where each of the keys stands in the texts in whatever spelling, in characters of the text as it stands. Keys are searched for in parts of about `most`, each one pass. Null texts have no hits, empty keys none either."""
    own = written(of.select(keys.alias("key")).where("key <> ''").distinct(), "keys")
    plain = texts.select(key.alias("id"), text.alias("text")).where("text is not null")
    kind, own_kind = plain.schema["id"].dataType.simpleString(), to_arrow_type(plain.schema["id"].dataType)
    parts = max(1, -(-own.count() // most))
    found = None
    for number in range(parts):
        part = [r.key for r in own.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == number).collect()]
        shared = texts.sparkSession.sparkContext.broadcast(part)

        def rows(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for k in shared.value:
                if form := spelled(k)[0]:
                    automaton.add_word(form, (len(form), [*automaton.get(form, (0, []))[1], k]))
            if len(automaton):
                automaton.make_automaton()
            for part in in_parts(batches):
                hits = []
                for row, t in enumerate(part["text"]):
                    form, places = spelled(t)
                    for end, (n, names) in automaton.iter(form) if len(automaton) else ():
                        begin, stop = places[end - n + 1][0], places[end][1]
                        hits += [(row, k, begin, stop - begin) for k in names]
                ids = pa.array([part["id"][h[0]] for h in hits], own_kind)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([h[i] for h in hits], t) for i, t in ((1, pa.string()), (2, pa.int64()), (3, pa.int64())))], names=["id", "key", "place", "length"])

        hits = plain.mapInArrow(rows, f"id {kind}, key string, place long, length long")
        found = hits if found is None else found.union(hits)
    return found
