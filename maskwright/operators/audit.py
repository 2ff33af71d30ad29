"""Audits of pseudonymised and re-identified texts. Keys come as data, so plans show no names."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.batches import in_parts
from ..sources.scratch import written
from .reidentify import replace_codes
from .replace import MOST, apply_map


def key_hits(texts: DataFrame, text: str, keys: DataFrame, key: str, most: int = MOST) -> DataFrame:
    """(key, n_texts, n_hits): in how many texts each key stands, and how often (hits of one key don't overlap). Keys that stand nowhere have zeros.

    The keys go to every worker in parts of at most `most`; with more, each part
    is one more pass over the texts. Every pass finds all of a part's keys with
    one automaton, and hits are summed per task before they are shuffled.
    """
    own = keys.select(F.col(key).alias("key")).where("key <> ''").distinct()
    n = own.count()
    parts = max(1, -(-n // most))
    if parts > 1:
        own = written(own, "keys")
    found = None
    for number in range(parts):
        part = [r.key for r in own.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == number).collect()]
        hits = texts.select(F.col(text).alias("text")).mapInArrow(_counted(texts.sparkSession.sparkContext.broadcast(part)), "key string, n_texts long, n_hits long")
        found = hits if found is None else found.union(hits)
    counts = found.groupBy("key").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_hits").alias("n_hits"))
    zero = F.lit(0).cast("long")
    return own.join(counts, "key", "left").select("key", F.coalesce("n_texts", zero).alias("n_texts"), F.coalesce("n_hits", zero).alias("n_hits"))


def _counted(shared):
    """Counts of the keys that a task's texts have."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(shared.value)
        n_texts: Counter[str] = Counter()
        n_hits: Counter[str] = Counter()
        for part in in_parts(batches):
            for t in part["text"]:
                if t:
                    for k in find(t):
                        n_texts[k] += 1
                        n_hits[k] += t.count(k)
        yield pa.RecordBatch.from_arrays([pa.array(list(n_texts), pa.string()), pa.array(list(n_texts.values()), pa.int64()), pa.array([n_hits[k] for k in n_texts], pa.int64())], names=["key", "n_texts", "n_hits"])

    return rows


def _finder(keys: list[str]) -> Callable[[str], set[str]]:
    """The distinct keys that a text has."""
    if not keys:
        return lambda text: set()
    automaton = ahocorasick.Automaton()
    for k in keys:
        automaton.add_word(k, k)
    automaton.make_automaton()
    return lambda text: {k for _, k in automaton.iter(text)}


def shared_leaks(texts: DataFrame, text: str, mapping: DataFrame, catalogue: DataFrame, most: int = MOST) -> DataFrame:
    """The keys that stand in texts outside of pseudonyms: a key such as a short name may well stand inside one, but must not stand beside it. Map and catalogue may have any size."""
    gap = catalogue.select("pseudonym", F.lit("\0").alias("canonical_name"), "ord")
    return leaks(replace_codes(texts.select(text), [text], gap, by_length=True, most=most), text, mapping, most)


def leaks(texts: DataFrame, text: str, mapping: DataFrame, most: int = MOST) -> DataFrame:
    """The keys of the map that still stand in pseudonymised texts. Every key is looked for, not only names."""
    return key_hits(texts, text, mapping, "k", most).where("n_texts > 0")


def missing_pseudonyms(texts: DataFrame, text: str, catalogue: DataFrame) -> DataFrame:
    """The catalogue's pseudonyms that stand in no text."""
    return key_hits(texts, text, catalogue, "pseudonym").where("n_texts = 0").select(F.col("key").alias("pseudonym"))


def unrestored_names(texts: DataFrame, text: str, catalogue: DataFrame) -> DataFrame:
    """The catalogue's names that stand in no re-identified text."""
    return key_hits(texts, text, catalogue, "canonical_name").where("n_texts = 0").select(F.col("key").alias("canonical_name"))


def residual_pseudonyms(texts: DataFrame, text: str, catalogue: DataFrame) -> DataFrame:
    """The catalogue's pseudonyms that still stand in re-identified texts."""
    return key_hits(texts, text, catalogue, "pseudonym").where("n_texts > 0")


def safe_legend(catalogue: DataFrame, mapping: DataFrame, most: int = MOST) -> DataFrame:
    """(ord, pseudonym, entity_type, relationship_context) with the context pseudonymised too, so that a shared legend shows no names."""
    legend = catalogue.select("ord", "pseudonym", "entity_type", F.coalesce("relationship_context", F.lit("")).alias("relationship_context"))
    return apply_map(legend, mapping, ["relationship_context"], most)
