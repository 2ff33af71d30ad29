"""Bringing names back into returned reports and records.

A catalogue that fits a worker is applied as a map, in its order. For a larger one
the codes that stand in a text are read off it (what ends in `_` and eight digits,
once for each length that types have, so that a type that ends another type is seen
too), and joined to the catalogue by the code; each text is folded over its own codes
in the catalogue's order. What names put in is searched again, as `replace` does.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import without_banner, without_banner_block
from ..sources.batches import in_parts
from ..sources.scratch import written
from .catalogue import key_order, reverse_pairs
from .replace import MOST, apply_pairs, folded_in_rounds, key_places

#: How codes end; with (?=) those that overlap are found too.
_END = re.compile("(?=_[0-9A-F]{8})")


def codes_in(text: str, lengths: list[int]) -> Iterator[str]:
    """Everything in a text that can be a code whose type has one of these lengths."""
    for m in _END.finditer(text):
        for n in lengths:
            if n <= m.start():
                yield text[m.start() - n : m.start() + 9]


def _code_places(texts: DataFrame, codes: DataFrame, lengths: list[int]) -> DataFrame:
    """(_row, at) of rows (_row, texts): the codes (k, at) that stand in them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_parts(batches):
            hits = [(row, k) for row, ts in zip(part["_row"], part["texts"], strict=True) for k in sorted({k for t in ts if t for k in codes_in(t, lengths)})]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in hits], pa.int64()), pa.array([k for _, k in hits], pa.string())], names=["_row", "k"])

    found = written(texts.mapInArrow(rows, "_row long, k string"), "codes-found")
    # Fewer than a thousand codes stand in over one in a thousand places each: they go to every task, the others meet in a join without common keys.
    total = found.count()
    common = found.groupBy("k").count().where(F.col("count") * 1000 > total).select("k")
    few = codes.join(F.broadcast(common), "k", "left_semi")
    return found.join(F.broadcast(few), "k").union(found.join(F.broadcast(common), "k", "left_anti").join(codes, "k")).select("_row", "at")


def replace_codes(df: DataFrame, columns: Iterable[str], catalogue: DataFrame, by_length: bool = False, most: int = MOST) -> DataFrame:
    """The frame with every code of the catalogue (pseudonym, canonical_name, ord) replaced by its name: in the catalogue's order, or longest first. The catalogue may have any size."""
    columns = list(columns)
    mapping = catalogue.select(F.col("pseudonym").alias("k"), F.col("canonical_name").alias("v"), "ord", F.lit(0).alias("place"))
    formed = F.col("k").rlike("(?s)^.+_[0-9A-F]{8}$")
    n, longest, odd = mapping.agg(F.count("*"), F.max(F.length("k")), F.count_if(~formed)).first()
    if n <= most:
        return apply_pairs(df, reverse_pairs(catalogue, by_length, most), columns)
    mapping = written(mapping, "catalogue")
    order = key_order() if by_length else F.struct("ord", "k", "v")
    codes = mapping.where(formed).select("k", order.alias("at"))
    lengths = sorted(r[0] - 9 for r in codes.select(F.length("k")).distinct().collect())  # at most as many as the longest type has letters

    def look(texts: DataFrame) -> DataFrame:
        found = _code_places(texts, codes, lengths)
        return found.union(key_places(texts, mapping.where(~formed), order, odd, most)) if odd else found

    return folded_in_rounds(df, columns, look, longest - 1)


def reidentify_texts(df: DataFrame, column: str, catalogue: DataFrame, strip_banner: bool = True, anywhere: bool = False, most: int = MOST) -> DataFrame:
    """Pseudonyms to names in the catalogue's order, then the recipient's banner off. Variations come back as the name itself.

    anywhere: finds the banner whatever stands before it, where the default
    knows it only at the text's start.
    """
    done = replace_codes(df, [column], catalogue, most=most)
    if not strip_banner:
        return done
    return done.withColumn(column, (without_banner_block if anywhere else without_banner)(F.col(column)))


def reidentify_records(df: DataFrame, column: str, catalogue: DataFrame, schema: T.StructType, most: int = MOST) -> DataFrame:
    """The same for a struct, by its JSON text; a name that breaks the JSON is an error."""
    as_text = df.withColumn(column, F.to_json(F.col(column), {"ignoreNullFields": "false"}))
    done = replace_codes(as_text, [column], catalogue, most=most)
    return done.withColumn(column, F.from_json(F.col(column), schema, {"mode": "FAILFAST"}))


def reidentify_json(df: DataFrame, column: str, catalogue: DataFrame, most: int = MOST) -> DataFrame:
    """The same for texts that are JSON documents of any form: names come in as JSON spells them, quotes and all, and a text that is no JSON, before or after, is an error."""
    spelled = F.expr("substring(j, 7, length(j) - 8)")
    escaped = catalogue.withColumn("j", F.to_json(F.struct(F.col("canonical_name").alias("n")))).withColumn("canonical_name", spelled).drop("j")
    checked = lambda c: F.when(F.col(c).isNull() | F.try_parse_json(F.col(c)).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit("a text is not JSON")))
    done = replace_codes(df.withColumn(column, checked(column)), [column], escaped, most=most)
    return done.withColumn(column, checked(column))
