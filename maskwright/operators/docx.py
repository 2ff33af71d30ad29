"""DOCX files: their text, and replacement in their runs, with the standard library alone.

A paragraph's text stands in runs that styles divide. A key inside one run is
replaced there; a key over several runs ends in the first of them, together
with the rest of the last, and the runs between become empty. Body, tables at
any depth, headers and footers are edited.
"""

from __future__ import annotations

import heapq
import io
import re
import zipfile
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.batches import in_parts, lists_in_parts
from ..sources.scratch import written
from .audit import key_hits
from .catalogue import MapTooLarge, ordered_pairs
from .replace import MOST, Keys, replaced_and_counted, surroundings

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
EDITED = re.compile(r"word/(document|header\d*|footer\d*)\.xml")
RAW_PARTS = ("word/document.xml", "word/header1.xml", "word/footer1.xml")


def replace_in_runs(runs: list[str], keys: Keys, all_crossing: bool = True) -> tuple[list[str], int]:
    """The runs' texts after replacement, and how many (run, key) and crossing replacements were made.

    all_crossing: a key that crosses runs is replaced wherever it does; without,
    only where it does first, which leaves later ones readable. Keys are found by
    one automaton, in each run and then over all, never tried one by one.
    """
    runs, made = list(runs), 0
    for i, text in enumerate(runs):
        runs[i], n = replaced_and_counted(text, keys)
        made += n
    joined = "".join(runs)
    waiting = sorted(keys.found(joined))
    queued = set(waiting)
    while waiting:
        rank = heapq.heappop(waiting)
        k, v = keys.pairs[rank]
        parts, searched = [], 0
        while (at := joined.find(k, searched)) >= 0:
            parts.append(joined[searched:at])
            joined = joined[:at] + v + joined[at + len(k) :]
            _across(runs, at, at + len(k), v)
            made += 1
            searched = at + len(v)
            if not all_crossing:
                break
        for window in surroundings(joined, [*parts, ""], v, keys.reach) if parts else ():
            for n in keys.found(window):
                if n > rank and n not in queued:
                    queued.add(n)
                    heapq.heappush(waiting, n)
    return runs, made


def _across(runs: list[str], start: int, end: int, value: str) -> None:
    """Puts value for the characters from start to end of the joined runs."""
    ends = list(accumulate(map(len, runs)))
    first, last = bisect_right(ends, start), bisect_left(ends, end)
    head, tail = runs[first][: len(runs[first]) + start - ends[first]], runs[last][len(runs[last]) + end - ends[last] :]
    for j in range(first, last + 1):
        runs[j] = ""
    runs[first] = head + value + tail


def _text(node: ET.Element) -> str:
    out = []
    for e in node.iter():
        if e.tag == W + "t":
            out.append(e.text or "")
        elif e.tag == W + "tab":
            out.append("\t")
        elif e.tag in (W + "br", W + "cr"):
            out.append("\n")
    return "".join(out)


def paragraph_text(paragraph: ET.Element) -> str:
    """Of the runs that stand in the paragraph itself or in its links."""
    return "".join(_text(r) for r in paragraph.iter(W + "r"))


def read_docx(data: bytes) -> str:
    """Body paragraphs, then the cells of the body's tables row by row, a line each. A file whose XML is broken gives what raw_docx finds."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            body = ET.fromstring(z.read("word/document.xml")).find(W + "body")
        lines = [paragraph_text(p) for p in body.findall(W + "p")]
        for table in body.findall(W + "tbl"):
            for cell in (c for row in table.findall(W + "tr") for c in row.findall(W + "tc")):
                lines.append("\n".join(paragraph_text(p) for p in cell.findall(W + "p")))
        return "\n".join(lines)
    except (ET.ParseError, KeyError, AttributeError):
        return raw_docx(data)


def raw_docx(data: bytes) -> str:
    """The text of the document, first header and first footer with every tag as a space; parts without text are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        parts = [re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", z.read(n).decode("utf-8", "replace"))).strip() for n in RAW_PARTS if n in names]
    return "\n\n".join(p for p in parts if p)


def _set(run: ET.Element, text: str) -> None:
    for child in [c for c in run if c.tag in (W + "t", W + "tab", W + "br", W + "cr")]:
        run.remove(child)
    if text:
        t = ET.SubElement(run, W + "t")
        t.text = text
        t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")


def _rewritten_part(xml: bytes, keys: Keys) -> tuple[bytes, int]:
    for _, (prefix, uri) in ET.iterparse(io.BytesIO(xml), ["start-ns"]):
        if not re.fullmatch(r"ns\d+", prefix):
            ET.register_namespace(prefix, uri)
    root = ET.fromstring(xml)
    made = 0
    for paragraph in root.iter(W + "p"):
        runs = list(paragraph.iter(W + "r"))
        before = [_text(r) for r in runs]
        after, n = replace_in_runs(before, keys)
        made += n
        for run, old, new in zip(runs, before, after, strict=True):
            if new != old:
                _set(run, new)
    return ET.tostring(root, encoding="UTF-8", xml_declaration=True), made


def rewrite_docx(data: bytes, keys: Keys) -> tuple[bytes, int]:
    """The file with every pair replaced, and how many replacements were made."""
    made, out = 0, io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as to:
        for info in z.infolist():
            content = z.read(info)
            if EDITED.fullmatch(info.filename):
                content, n = _rewritten_part(content, keys)
                made += n
            to.writestr(info, content)
    return out.getvalue(), made


# --- on frames -------------------------------------------------------------


def docx_text(files: DataFrame, content: str = "content", into: str = "text") -> DataFrame:
    """The files with their text; null for what is no DOCX file."""

    @F.arrow_udf("string")
    def read(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def text(d: bytes | None) -> str | None:
            try:
                return None if d is None else read_docx(d)
            except (zipfile.BadZipFile, EOFError, NotImplementedError, zlib.error):
                return None

        for data in lists_in_parts(arrays):
            yield pa.array([text(d) for d in data], pa.string())

    return files.withColumn(into, read(F.col(content)))


def _held(mapping: DataFrame, most: int):
    """The map's pairs in order, for every worker."""
    row = ordered_pairs(mapping, most).first()
    return mapping.sparkSession.sparkContext.broadcast([(p["k"], p["v"]) for p in (row["pairs"] if row and row["pairs"] else [])])


def docx_rewritten(files: DataFrame, mapping: DataFrame, path: str = "path", content: str = "content", most: int = MOST) -> DataFrame:
    """(path, content, n_replaced, error): the edited files. A file that can't be edited has an error and no content: originals never pass through.

    mapping: (k, v, ord, place) of any size, as long as the files have at most `most` of its keys: a
    larger one is first cut down to the keys that stand in the files, and to those that editing brings up.
    """
    if mapping.count() <= most:
        return _rewritten(files, _held(mapping, most), path, content)
    held = written(mapping, "map")
    keys, done = None, files.select(F.col(content).alias("content"))
    while True:
        hits = key_hits(docx_strings(done), "text", held, "k", most).where("n_texts > 0").select(F.col("key").alias("k"))
        keys, before = written(hits if keys is None else keys.union(hits).distinct(), "keys-of-files"), 0 if keys is None else keys.count()
        if (n := keys.count()) > most:
            raise MapTooLarge(f"the files have {n} keys, over the bound of {most}")
        edited = _rewritten(files, _held(held.join(F.broadcast(keys), "k", "left_semi"), most), path, content)
        if n == before:
            return edited
        done = written(edited.select("content"), "edited-files")


def docx_strings(files: DataFrame) -> DataFrame:
    """(text) of everything that is edited in the files (content): each part's paragraphs, a line each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_parts(batches):
            out = []
            for data in part["content"]:
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        out += ["\n".join(paragraph_text(p) for p in ET.fromstring(z.read(n)).iter(W + "p")) for n in z.namelist() if EDITED.fullmatch(n)]
                except Exception:  # noqa: BLE001  a file that can't be read won't be edited either
                    continue
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["text"])

    return files.where("content is not null").select("content").mapInArrow(rows, "text string")


EDITED_FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType()), T.StructField("n_replaced", T.LongType()), T.StructField("error", T.StringType())])


def _rewritten(files: DataFrame, shared, path: str, content: str) -> DataFrame:
    arrow = to_arrow_schema(EDITED_FILES)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = Keys(shared.value)
        for part in in_parts(batches):
            out = []
            for name, data in zip(part["path"], part["content"], strict=True):
                try:
                    out.append((name, *rewrite_docx(data, keys), None))
                except Exception as error:  # noqa: BLE001  whatever is wrong with a file, the row says so
                    out.append((name, None, 0, f"{type(error).__name__}: {error}"))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return files.select(F.col(path).cast("string").alias("path"), F.col(content).alias("content")).mapInArrow(rows, EDITED_FILES)


RUNS = T.StructType([T.StructField("runs", T.ArrayType(T.StringType())), T.StructField("n_replaced", T.LongType())])


def runs_replaced(df: DataFrame, column: str, mapping: DataFrame, all_crossing: bool = True, most: int = MOST) -> DataFrame:
    """Replacement in arrays of runs (one array a paragraph), inside and across them; adds n_replaced."""
    shared = _held(mapping, most)

    @F.arrow_udf(RUNS)
    def replaced(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        keys = Keys(shared.value)
        for column in lists_in_parts(arrays):
            out = [(None, 0) if runs is None else replace_in_runs([r or "" for r in runs], keys, all_crossing) for runs in column]
            yield pa.StructArray.from_arrays([pa.array([o[0] for o in out], pa.list_(pa.string())), pa.array([o[1] for o in out], pa.int64())], names=["runs", "n_replaced"])

    return df.withColumn("_r", replaced(F.col(column))).withColumns({column: F.col("_r.runs"), "n_replaced": F.col("_r.n_replaced")}).drop("_r")
