"""Applying a replacement map to texts: exactly the pairs one after another, however many there are.

A few pairs are folded by a built-in expression over one broadcast row. More go to
the workers with an automaton over their keys: it finds the keys that a text has, a
heap gives them in order, and after each replacement only the characters around
what was put in are searched again, as nowhere else can a key have come up. The time
depends on the keys that a text has, not on those it lacks.

A map too large for one worker is searched for in parts. Each text is folded over the
keys found in it, and the surroundings of everything put in are searched again, by
all parts; texts in which that finds a further key are folded anew with it. When
nothing is found, the keys of a text were all that it ever had, and the result is
that of the whole map.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import replace_in_order
from ..sources.batches import in_parts, lists_in_parts
from ..sources.scratch import written
from .catalogue import identity_catalogue, key_order, ordered_pairs, replacement_map, with_pseudonym

#: From this many keys on, folding in Python is faster (measured; see the README).
SWITCH = 30
#: Of the keys that one worker's automaton holds.
MOST = 100_000


class Keys:
    """Pairs in order, and what finds their keys in a text. Empty keys are left out."""

    def __init__(self, pairs: Iterable[tuple[str, str]]):
        self.pairs = [(k, v) for k, v in pairs if k]
        self.reach = max((len(k) for k, _ in self.pairs), default=1) - 1
        self._automaton = ahocorasick.Automaton()
        for rank, (k, _) in enumerate(self.pairs):
            if k not in self._automaton:
                self._automaton.add_word(k, rank)
        if self.pairs:
            self._automaton.make_automaton()

    def found(self, text: str) -> set[int]:
        """The places in order of the keys that a text has."""
        return {rank for _, rank in self._automaton.iter(text)} if self.pairs else set()

    def any_in(self, text: str) -> bool:
        return bool(self.pairs) and next(self._automaton.iter(text), None) is not None


def surroundings(text: str, parts: list[str], put_in: str, reach: int) -> Iterator[str]:
    """The stretches of a text around what was put in between its parts, `reach` characters to either side; those that meet are one."""
    at, begin, end = 0, 0, -1
    for part in parts[:-1]:
        at += len(part)
        if at - reach > end:
            if end >= 0:
                yield text[begin:end]
            begin = max(0, at - reach)
        at += len(put_in)
        end = at + reach
    if end >= 0:
        yield text[begin:end]


def replaced_and_counted(text: str, keys: Keys) -> tuple[str, int]:
    """The text after all pairs in order, each on what the last has left, and how many keys that replaced."""
    waiting = sorted(keys.found(text))
    queued, made = set(waiting), 0
    while waiting:
        rank = heapq.heappop(waiting)
        k, v = keys.pairs[rank]
        parts = text.split(k)
        if len(parts) == 1:  # an earlier key took it away
            continue
        text = v.join(parts)
        made += 1
        for window in surroundings(text, parts, v, keys.reach):
            for n in keys.found(window):
                if n > rank and n not in queued:
                    queued.add(n)
                    heapq.heappush(waiting, n)
    return text, made


def replaced(text: str, keys: Keys) -> str:
    return replaced_and_counted(text, keys)[0]


def apply_pairs(df: DataFrame, pairs: DataFrame, columns: Iterable[str], switch: int = SWITCH) -> DataFrame:
    """The frame with every named string column replaced. pairs: one row, as ordered_pairs makes it."""
    columns = list(columns)
    row = pairs.select("pairs", F.size("pairs").alias("n")).first()
    n = row["n"] if row else 0
    if not n or n < 0:
        return df
    if n <= switch:
        joined = df.crossJoin(F.broadcast(pairs.select(F.col("pairs").alias("_pairs"))))
        return joined.withColumns({c: replace_in_order(F.col(c), F.col("_pairs")) for c in columns}).drop("_pairs")
    shared = df.sparkSession.sparkContext.broadcast([(p["k"], p["v"]) for p in row["pairs"]])

    @F.arrow_udf("string")
    def folded(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        keys = Keys(shared.value)
        for texts in lists_in_parts(arrays):
            yield pa.array([None if t is None else replaced(t, keys) for t in texts], pa.string())

    return df.withColumns({c: folded(F.col(c)) for c in columns})


def apply_map(df: DataFrame, mapping: DataFrame, columns: Iterable[str], most: int = MOST) -> DataFrame:
    """The same for a map of any size (k, v, ord, place), as replacement_map makes it."""
    columns = list(columns)
    n, longest = mapping.agg(F.count("*"), F.max(F.length("k"))).first()
    if n <= most:
        return apply_pairs(df, ordered_pairs(mapping, most), columns)
    held = written(mapping, "map")
    return folded_in_rounds(df, columns, lambda texts: key_places(texts, held, key_order(), n, most), longest - 1)


def key_places(texts: DataFrame, mapping: DataFrame, order, n: int, most: int = MOST) -> DataFrame:
    """(_row, at) of rows (_row, texts): each key that some text of the row has, with `order`, a struct that ends in k and v. The n keys are searched for in parts of about `most`."""
    kept = mapping.where("k <> ''").select(order.alias("at"))
    fields = kept.schema["at"].dataType
    arrow = to_arrow_schema(fields)
    parts = max(1, -(-n // most))
    found = None
    for number in range(parts):
        part = kept.where(F.pmod(F.xxhash64("at.k"), F.lit(parts)) == number).collect()
        shared = texts.sparkSession.sparkContext.broadcast([tuple(r["at"]) for r in part])

        def rows(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = shared.value
            keys = Keys(p[-2:] for p in held)
            for part in in_parts(batches):
                hits = [(row, held[p]) for row, ts in zip(part["_row"], part["texts"], strict=True) for p in sorted(set().union(*(keys.found(t) for t in ts if t)))]
                yield pa.RecordBatch.from_arrays([pa.array([row for row, _ in hits], pa.int64()), *(pa.array([p[i] for _, p in hits], f.type) for i, f in enumerate(arrow))], names=["_row", *arrow.names])

        schema = T.StructType([T.StructField("_row", T.LongType()), *fields])
        hits = texts.mapInArrow(rows, schema)
        found = hits if found is None else found.union(hits)
    return found.select("_row", F.struct(*(F.col(f.name) for f in fields)).alias("at"))



def folded_in_rounds(df: DataFrame, columns: list[str], look: Callable[[DataFrame], DataFrame], reach: int, windows: str | None = None) -> DataFrame:
    """The frame with its columns folded over the keys that `look` finds: from rows (_row, texts) it makes rows (_row, at), where at is a struct in whose order keys apply and whose last two fields are k and v.

    reach: one less than the longest key's length, or more. A row holds the keys that its texts have, no more.
    windows: a further column with the surroundings of all that was put in.
    """
    rows = written(df.withColumn("_row", F.monotonically_increasing_id()), "rows-to-replace")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_parts(batches):
            new, windows = [], []
            for ts, ps in zip(part["texts"], part["pairs"], strict=True):
                out, around = [], []
                for t in ts:
                    for p in ps if t is not None and ps is not None else ():
                        parts = t.split(p["k"])
                        if len(parts) > 1:
                            t = p["v"].join(parts)
                            around += surroundings(t, parts, p["v"], reach)
                    out.append(t)
                new.append(out)
                windows.append(around)
            yield pa.RecordBatch.from_arrays([pa.array(part["_row"], pa.int64()), pa.array(new, pa.list_(pa.string())), pa.array(windows, pa.list_(pa.string()))], names=["_row", "texts", "windows"])

    open_ = rows.select("_row", F.array(*columns).alias("texts"))
    known = written(look(open_).distinct(), "keys-found")
    done = None
    while True:
        pairs = known.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list("at")), lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v"))).alias("pairs"))
        step = written(open_.join(pairs, "_row", "left").mapInArrow(fold, "_row long, texts array<string>, windows array<string>"), "rows-replaced")
        seen = look(step.where(F.size("windows") > 0).select("_row", F.col("windows").alias("texts"))).distinct()
        more = written(seen.join(known, ["_row", "at"], "left_anti"), "keys-found")
        again = more.select("_row").distinct()
        ready = step
        if more.isEmpty():
            done = ready if done is None else done.union(ready)
            break
        ready = ready.join(again, "_row", "left_anti")
        done = ready if done is None else done.union(ready)
        open_ = open_.join(again, "_row", "left_semi")
        known = written(known.join(again, "_row", "left_semi").union(more), "keys-found")
    kept = rows.drop(*columns).join(done, "_row")
    around = [F.col("windows").alias(windows)] if windows else []
    return kept.select(*(c for c in df.columns if c not in columns), *(F.get("texts", F.lit(i)).alias(c) for i, c in enumerate(columns)), *around).select(*df.columns, *([windows] if windows else []))


def apply_to_documents(df: DataFrame, pairs: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """Replaces in a struct's JSON text as a whole and parses it again, so field names are replaced too; a text that no longer parses is an error."""
    as_text = df.withColumn(column, F.to_json(F.col(column), {"ignoreNullFields": "false"}))
    done = apply_pairs(as_text, pairs, [column])
    return done.withColumn(column, F.from_json(F.col(column), schema, {"mode": "FAILFAST"}))


def python_json(texts: pd.Series) -> pd.Series:
    """JSON texts as Python's json.dumps writes them, with ', ' and ': ' and non-ASCII letters kept."""
    return texts.map(lambda t: None if t is None else json.dumps(json.loads(t), ensure_ascii=False))


def pseudonymise(df: DataFrame, columns: Iterable[str], entities: DataFrame, salt: DataFrame, most: int = MOST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, catalogue, map): the frame with the columns pseudonymised by the entities, and what reverses it."""
    named = with_pseudonym(entities, salt)
    mapping = replacement_map(named)
    return apply_map(df, mapping, columns, most), identity_catalogue(named), mapping
