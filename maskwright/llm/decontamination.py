"""Benchmark decontamination with one Aho-Corasick automaton.

Texts and items are folded (A-Z to lower case) and cut into words. Every window
of ten consecutive words of an item, or the whole of a shorter item, is a
pattern. The automaton runs over word numbers: words that no item has share one
number, so a text is scanned once, a step a word, whatever the number of items.
Matches are runs of words; the words keep their offsets in the original text,
so a hit is also a span of characters there.

Nulls: a null text or item has no words and no hits. Equal items are all
reported. A document of any length is scanned whole. An empty benchmark gives
documents without hits, an empty document table an empty result. Columns other
than the text are passed through; one with the name of an output column gives way to it.

The benchmark goes to the workers as a broadcast variable. Its size is checked:
blocks of at most block_bytes are scanned one after another, each with its own
automaton, and their hits are joined. The driver holds two blocks at a time, and
the hits so far are written between passes, so a large benchmark costs passes
and neither the workers' nor the driver's memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FOLD, map_columns, table, written

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10


#: Bytes of words as they are, A-Z in lower case, all others as spaces. UTF-8's longer sequences have no byte under 0x80.
_SPLIT = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def folded_words(text: str | None) -> list[bytes]:
    """What WORD finds in the folded text, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_SPLIT).split() if text else []


class Scanner:
    """The automaton over the items' windows."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        patterns: dict[tuple[int, ...], set] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in folded_words(text)]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                patterns.setdefault(tuple(ids[at : at + window]), set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for ids, owners in patterns.items():
            self.automaton.add_word(ids, (len(ids), owners))
        self.empty = not patterns
        if patterns:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Runs of hit words as (first, end), apart from each other and in order, and the items found."""
        if self.empty or not words:
            return [], set()
        runs: list[list[int]] = []
        found: set = set()
        number = self.number.get
        for last, (length, owners) in self.automaton.iter(tuple([number(w, 0) for w in words])):
            first = last - length + 1
            while runs and runs[-1][1] >= first:
                first = min(first, runs.pop()[0])
            runs.append([first, last + 1])
            found |= owners
        return [(a, b) for a, b in runs], found


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def offsets(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character spans of runs of words in the text as it is."""
    if not runs:
        return []
    places = [m.span() for m in WORD.finditer(text.translate(FOLD))]
    return [(places[a][0], places[b - 1][1]) for a, b in runs]


def blocks_of(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[object, str | None]]]:
    """The items in blocks of at most block_bytes of text (or one item), fetched a partition at a time."""
    block: list[tuple[object, str | None]] = []
    size = 0
    for row in benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).toLocalIterator():
        n = len(row.t or "") * 2 + 64
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((row.i, row.t))
        size += n
    if block:
        yield block


_scanners: dict[tuple[int, str], Scanner] = {}


def _scanner(shared, window: int) -> Scanner:
    """The automaton of a block, built once in a worker; one block's is kept."""
    items = shared.value
    key = (window, hashlib.sha256(repr(items).encode("utf-8", "surrogatepass")).hexdigest())
    if key not in _scanners:
        _scanners.clear()
        _scanners[key] = Scanner(items, window)
    return _scanners[key]


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = 32 << 20, keep: list[str] | None = None) -> DataFrame:
    """The documents (their columns in keep; all, by default) with n_words, hit_runs (runs of words), hit_spans (characters of the original text) and hit_items (distinct, in text order)."""
    new = {"n_words", "hit_runs", "hit_spans", "hit_items"}
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in new))
    pair = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("hit_runs", pair), T.StructField("hit_spans", pair), T.StructField("hit_items", T.ArrayType(T.StringType()))])
    context = docs.sparkSession.sparkContext
    # The text leaves the workers only where a later pass or the caller needs it.
    last = T.StructType([f for f in schema.fields if keep is None or f.name in keep or f.name in new])
    blocks = blocks_of(benchmark, item, item_text, block_bytes)
    out, block, again = docs, next(blocks, []), False
    while True:
        following = next(blocks, None)
        kept = last if following is None else schema
        out = map_columns(out, _pass(context.broadcast(block), text, window, again, kept.names), kept)
        if following is None:
            return out
        out, block, again = written(out, "hits"), following, True


def _pass(shared, text: str, window: int, again: bool, names: list[str]):
    """One pass over the documents with one block's automaton; later passes add to the hits so far."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        scanner = _scanner(shared, window)
        for batch in batches:
            before = (batch["hit_runs"].to_pylist(), batch["hit_items"].to_pylist()) if again else ([], [])
            counts, all_runs, spans, items = [], [], [], []
            for i, t in enumerate(batch[text].to_pylist()):
                words = folded_words(t)
                runs, found = scanner.scan(words)
                owners = {str(x) for x in found}
                if again:
                    runs = merged([*runs, *((r["first"], r["end"]) for r in before[0][i])])
                    owners |= set(before[1][i])
                counts.append(len(words))
                all_runs.append([{"first": a, "end": b} for a, b in runs])
                spans.append([{"first": a, "end": b} for a, b in offsets(t, runs)])
                items.append(sorted(owners))
            made = {"n_words": counts, "hit_runs": all_runs, "hit_spans": spans, "hit_items": items}
            yield {n: made[n] if n in made else batch[n] for n in names}

    return rows


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document stands in the benchmark, and in which items."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark", "item_id", "text"), keep=["doc_id"])
    n_hit = F.aggregate("hit_runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["first"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.size("hit_runs") > 0).alias("contaminated"),
    )


OP6_SQL = r"""
with fold as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w, row_number() over () r from documents),
items as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
wins as (select distinct item_id, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') k, least(len(w), 10) n
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from items where len(w) > 0)),
lens as (select distinct n from wins),
hits as (select r, i, n, item_id from
  (select r, i, n, array_to_string(w[i:i + n - 1], ' ') k from (select r, w, n, unnest(range(1, len(w) - n + 2)) i from fold, lens where len(w) >= n)) join wins using (k, n)),
words as (select r, count(distinct p) n_hit from (select r, unnest(range(i, i + n)) p from hits) group by r),
names as (select r, count(*) n_items, string_agg(x, ',' order by x) xs from (select distinct r, cast(item_id as varchar) x from hits) group by r)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(xs, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from fold left join words using (r) left join names using (r)
"""
