"""Where transcripts, chronologies and entities come from: interfaces, and forms that need no language model.

A model may stand behind each interface. `SuppliedEntities` gives a table of
entities as it is; `RegexGazetteer` looks for patterns and listed names, which
is a substitute with another recall, not the same thing.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalogue import ENTITIES
from .chronology import EVENT_COLUMNS, placed, unify


class Extractor(Protocol):
    def extract(self, files: DataFrame) -> DataFrame: ...


class Cataloguer(Protocol):
    def catalogue(self, transcripts: list[DataFrame]) -> DataFrame: ...


class Discoverer(Protocol):
    def discover(self, texts: DataFrame, text: str) -> DataFrame: ...


class TextExtractor:
    """Transcripts of text files: an event for each line that is not blank, with the speaker before a first colon."""

    def extract(self, files: DataFrame) -> DataFrame:
        lines = files.select("chronology", F.col("path").alias("source_file"), F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("ord", "line")).where("trim(line) <> ''")
        spoken = F.regexp_extract("line", r"^\s*([^:]{1,40}):\s", 1)
        return lines.select(
            "chronology",
            F.col("ord").cast("long"),
            F.concat(F.lit("line "), F.col("ord") + 1).alias("timestamp"),
            F.lit("transcript").alias("category"),
            "source_file",
            F.when(spoken == "", "Unknown").otherwise(spoken).alias("speaker"),
            F.when(spoken == "", F.trim("line")).otherwise(F.regexp_replace("line", r"^\s*[^:]{1,40}:\s+", "")).alias("event_details"),
        )


class TimeCataloguer:
    """All events together with their parsed time; order is by time, source and place."""

    def catalogue(self, transcripts: list[DataFrame]) -> DataFrame:
        return unify(transcripts)


#: Kinds of events and what tells them, first match first; patterns that Java and RE2 read alike. The four names of kinds.
CATEGORY_RULES = (
    ("Intake Form", r"(?i)\b(intake|form|registration|date of birth|admission)\b"),
    ("Physical Assessment", r"(?i)\b(blood pressure|pulse|temperature|weight|examination|examined)\b"),
    ("Subject Activity", r"(?i)\b(walks?|sits?|stands?|looks?|nods?|visual action)\b"),
    ("Clinical Interview", r"\S"),
)


@dataclass
class RuleCataloguer:
    """All events together, each with the category of the first rule whose pattern its speaker, source or details have. A substitute for a model that reads."""

    rules: tuple[tuple[str, str], ...] = CATEGORY_RULES

    def catalogue(self, transcripts: list[DataFrame]) -> DataFrame:
        told = F.concat_ws(" ", "speaker", "source_file", "event_details")
        kind = F.col("category")
        for name, pattern in reversed(self.rules):
            kind = F.when(told.rlike(pattern), F.lit(name)).otherwise(kind)
        return unify(transcripts).withColumn("category", kind)


@dataclass
class StrictCataloguer:
    """Another cataloguer's events, those without a time placed among the others of their source, so that sources interleave strictly."""

    of: Cataloguer = field(default_factory=TimeCataloguer)

    def catalogue(self, transcripts: list[DataFrame]) -> DataFrame:
        return placed(self.of.catalogue(transcripts))


@dataclass
class SuppliedEntities:
    entities: DataFrame

    def discover(self, texts: DataFrame, text: str) -> DataFrame:
        return self.entities.select(*ENTITIES.names)


#: Kinds of strings that stand for a person or a machine. Patterns that Java and RE2 read alike.
PATTERNS = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "IP": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "PHONE": r"\+[0-9]{1,3}[ -][0-9][0-9 -]{6,12}[0-9]",
}


#: Words before or after a name that are no part of it.
TITLES = ("dr", "prof", "professor", "doctor", "mr", "mrs", "ms", "miss", "mx", "sir", "madam", "nurse", "sister", "brother", "jr", "sr", "md", "phd")


def name_words(name: Column) -> Column:
    """A name's words in lower case, without titles and marks."""
    words = F.split(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}#'-]+", " "), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*TITLES))


def resolved(mentions: DataFrame) -> DataFrame:
    """(canonical_name, entity_type, variations) of mentions (name, entity_type, n): which strings name the same.

    Within a type, mentions with the same words but for titles are one name. One
    with a first letter only (J. Doe) goes to the full name with that letter and last
    word, a single word (Doe, Jane) to the full name that begins or ends with it, if
    there is one such name and no other. The most frequent spelling of the full name
    is the canonical one, then the longest, then the last by its letters. Mentions of title words only stay alone.

    Names meet by keys of their words, never in pairs, and a key that many names have
    is told by two of them: no block grows with the data.
    """
    m = mentions.groupBy("name", "entity_type").agg(F.sum("n").alias("n")).withColumn("w", name_words(F.col("name")))
    size, first, last = F.size("w"), F.get("w", F.lit(0)), F.element_at("w", -1)
    kind = F.when(size == 0, "none").when(size == 1, "single").when(F.length(first) == 1, "initial").otherwise("full")
    m = m.where(size > 0).withColumns({"kind": kind, "form": F.array_join("w", " "), "first": first, "last": last}).unionByName(
        m.where(size == 0).withColumns({"kind": kind, "form": F.col("name"), "first": F.lit(None).cast("string"), "last": F.lit(None).cast("string")})
    )
    m = m.withColumn("key", F.when(F.col("kind") == "initial", F.concat_ws(" ", "first", "last")).otherwise(F.col("form")))
    named = lambda k, v: F.struct(F.lit(k).alias("kind"), v.alias("key"))
    ways = F.array(named("initial", F.concat_ws(" ", F.substring("first", 1, 1), "last")), named("single", F.col("first")), named("single", F.col("last")))
    leads = m.where("kind = 'full'").select("entity_type", "form", F.explode(ways).alias("k")).groupBy("entity_type", "k.kind", "k.key").agg(F.min("form").alias("to"), F.max("form").alias("other")).where("to = other").drop("other")
    joined = m.join(leads, ["entity_type", "kind", "key"], "left").withColumn("own", F.col("to").isNull()).withColumn("root", F.coalesce("to", "form"))
    rank = F.struct("own", "n", F.length("name"), "name")
    found = joined.groupBy("entity_type", "root").agg(F.max_by("name", rank).alias("canonical_name"), F.array_sort(F.collect_list("name")).alias("names"))
    return found.select("canonical_name", "entity_type", F.filter("names", lambda x: x != F.col("canonical_name")).alias("variations"))


@dataclass
class RegexGazetteer:
    """Entities by pattern, and by names from a table (name, entity_type) that stand in the texts; names of one person or place are one entity with its variations."""

    patterns: Mapping[str, str]
    names: DataFrame | None = None

    def discover(self, texts: DataFrame, text: str) -> DataFrame:
        # One scan for all patterns; equal strings are summed per task before they are shuffled.
        def of(kind: str, pattern: str) -> Column:
            return F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), lambda m: F.struct(F.lit(kind).alias("entity_type"), m.alias("canonical_name")))

        found = F.flatten(F.array(*(of(k, p) for k, p in self.patterns.items())))
        rows = texts.select(F.explode(found).alias("f")).select("f.*").distinct().withColumn("variations", F.array().cast("array<string>"))
        if self.names is not None:
            from .audit import key_hits

            hits = key_hits(texts, text, self.names, "name").where("n_texts > 0").select(F.col("key").alias("name"), F.col("n_texts").alias("n"))
            rows = rows.unionByName(resolved(self.names.select("name", "entity_type").distinct().join(hits, "name")))
        # The order of discovery is by text: the same in every run, without sorting all in one task.
        return rows.select(
            F.conv(F.substring(F.md5(F.concat_ws(" ", "entity_type", "canonical_name").cast("binary")), 1, 15), 16, 10).cast("long").alias("ord"),
            "canonical_name",
            "entity_type",
            F.lit("").alias("relationship_context"),
            "variations",
        )


@dataclass(frozen=True)
class AgentOptions:
    """Which model answers, from arguments, then the environment, then defaults. Unknown backends are errors."""

    backend: str
    model: str | None
    key: str | None
    base_url: str | None

    BACKENDS = ("supplied", "ollama", "gemini")

    @classmethod
    def resolve(cls, backend: str | None = None, model: str | None = None, key: str | None = None, base_url: str | None = None, env: Mapping[str, str] | None = None) -> AgentOptions:
        env = os.environ if env is None else env
        chosen = (backend or env.get("AGENT_BACKEND") or "supplied").strip().lower()
        if chosen not in cls.BACKENDS:
            raise ValueError(f"unknown backend {chosen!r}; there are {', '.join(cls.BACKENDS)}")
        prefix = chosen.upper()
        found = cls(chosen, model or env.get(f"{prefix}_MODEL"), key or env.get(f"{prefix}_API_KEY"), base_url or env.get(f"{prefix}_BASE_URL"))
        if chosen == "gemini" and not found.key:
            raise ValueError("this backend needs a key")
        return found


__all__ = ["CATEGORY_RULES", "EVENT_COLUMNS", "PATTERNS", "AgentOptions", "Cataloguer", "Discoverer", "Extractor", "RegexGazetteer", "RuleCataloguer", "StrictCataloguer", "SuppliedEntities", "TextExtractor", "TimeCataloguer", "resolved"]
