"""URL verdicts: a Bloom filter cascade holds the blocked URLs, which rules and listed keys name.

The cascade gives exact membership over a complete key universe: the first
level encodes the listed keys, the second the keys of the universe that the
first level takes in wrongly, the third the listed keys that the second takes
in wrongly, and so on until a level has no false positives. A key is looked up
level by level; the first level that lacks it decides. Keys from outside the
universe may get a wrong answer, so the universe must hold every key that is
asked for.

A key is a URL's host and path as one string; the universe are the distinct
keys of all pages. The verdict of every page comes from the cascade. A filter
that is too large for every worker is parted by the keys' hash: each part has a
cascade of its own, and the rows go through one part after another.

Nulls: a null or malformed url has an empty host and an empty path, so an empty
key, which is a key like any other. Urls of any length are read whole. Repeated
rows are judged each. Empty tables give empty results; a cascade of no listed
keys has no levels and lists nothing. Input columns pass through; one with the
name of an output column gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, free_name, table, written

#: Fixed values: (verdict, host, path) of the registered query.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Domains whose URLs, those of subdomains included, the registered query lists beside what rules block.
LISTED_DOMAINS = ("spam-farm.example.org", "cheap-pills.example.com")


def host_of(url: Column) -> Column:
    """What stands after the first :// up to / ? or #, A-Z in lower case; empty for null or without ://."""
    rest = _after_scheme(url)
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """What stands after the host up to ? or #; empty for null or without ://."""
    return F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + F.lit(3), F.length(url))).otherwise("")


def rule_columns(host: Column, path: Column, rules: Iterable[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (host and path as one string) that fits, and its verdict; null where none fits.

    Rules are tried from long to short, so the first that fits is the longest;
    of equally long ones, the first in text order.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    name = verdict = F.lit(None).cast("string")
    for what, at, prefix in reversed(ordered):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(prefix)
        name, verdict = F.when(fits, at + prefix).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


@dataclass(frozen=True)
class Level:
    """One Bloom filter: words of 32 bits, kept as an array that workers get with the task."""

    seed: int
    bits: int
    words: np.ndarray

    def holds(self, first: np.ndarray, step: np.ndarray, hashes: int) -> np.ndarray:
        found = np.ones(len(first), bool)
        for i in range(hashes):
            at = _place(first, step, i, self.seed, self.bits)
            found &= (self.words[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1
        return found


def _place(first: np.ndarray, step: np.ndarray, i: int, seed: int, bits: int) -> np.ndarray:
    """The i-th bit of a key in a level: two hashes mixed with the level's number."""
    with np.errstate(over="ignore"):
        x = first + np.uint64(2 * i + 1) * (step | np.uint64(1)) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(bits)).astype(np.int64)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]
    hashes: int

    @property
    def size_bytes(self) -> int:
        return sum(level.words.nbytes for level in self.levels)

    def lists(self, first: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Whether each key, given by its two hashes, is listed."""
        out = np.full(len(first), len(self.levels) % 2 == 1)
        open_ = np.ones(len(first), bool)
        for depth, level in enumerate(self.levels):
            missing = open_.copy()
            missing[open_] = ~level.holds(first[open_], step[open_], self.hashes)
            out[missing] = depth % 2 == 1
            open_ &= ~missing
        return out


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("_first"), F.xxhash64(key, F.lit("step")).alias("_step")]


def _as_words(first: pd.Series, step: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    return first.to_numpy(np.int64).view(np.uint64), step.to_numpy(np.int64).view(np.uint64)


def build_cascade(listed: DataFrame, universe: DataFrame, key: str, hashes: int = 4, bits_per_key: int = 8, max_bytes: int = 64 << 20) -> Cascade:
    """The cascade of the listed keys over the universe. Both are frames with a column key; repeats and nulls in it are dropped.

    Every level is counted and filled by Spark: only its words come to the
    driver, bits_per_key bits a key. A level larger than max_bytes raises an
    error, since each worker holds the whole cascade; `mark_listed` parts the
    keys so that none is.
    """
    inside = written(_keys(listed, key), "cascade-listed")
    return _cascade(inside, written(_keys(universe, key).join(inside.select("_key"), "_key", "left_anti"), "cascade-universe"), hashes, bits_per_key, max_bytes)


def _keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).alias("_key")).where("_key is not null").distinct().select("_key", *_hashes(F.col("_key")))


def _cascade(inside: DataFrame, outside: DataFrame, hashes: int, bits_per_key: int, max_bytes: int) -> Cascade:
    levels: list[Level] = []
    # A collision of both 64-bit hashes would never resolve; the cap on levels turns that into an error.
    for depth in range(64):
        n = inside.count()
        if n == 0:
            return Cascade(tuple(levels), hashes)
        bits = max(64, n * bits_per_key)
        if bits // 8 > max_bytes:
            raise ValueError(f"level {depth} needs {bits // 8} bytes, over the bound of {max_bytes}")
        level = Level(depth + 1, bits, _filled(inside, depth + 1, bits, hashes))
        levels.append(level)
        inside, outside = written(_passing(outside, level, hashes), "cascade-level"), inside
    raise ValueError("the cascade does not end: two keys share both hashes")


def _filled(keys: DataFrame, seed: int, bits: int, hashes: int, chunk_bits: int = 1 << 21) -> np.ndarray:
    """The words of a level. Tasks send places packed by chunk of the filter; a chunk is filled where it is gathered, and comes to the driver as words."""

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            first, step = _as_words(batch["_first"], batch["_step"])
            at = np.sort(np.concatenate([_place(first, step, i, seed, bits) for i in range(hashes)]))
            chunks, begins = np.unique(at // chunk_bits, return_index=True)
            parts = np.split((at % chunk_bits).astype(np.uint32), begins[1:])
            yield pd.DataFrame({"chunk": chunks, "data": [x.tobytes() for x in parts][: len(chunks)]})

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, words = None, np.zeros(0, np.uint32)
        for batch in batches:
            for c, data in zip(batch["chunk"], batch["data"], strict=True):
                if c != chunk:
                    if chunk is not None:
                        yield pd.DataFrame([(chunk, words.tobytes())], columns=["chunk", "data"])
                    chunk, words = c, np.zeros(chunk_bits // 32, np.uint32)
                at = np.frombuffer(data, np.uint32)
                np.bitwise_or.at(words, at >> 5, np.left_shift(np.uint32(1), at & np.uint32(31)))
        if chunk is not None:
            yield pd.DataFrame([(chunk, words.tobytes())], columns=["chunk", "data"])

    out = np.zeros(-(-bits // chunk_bits) * (chunk_bits // 32), np.uint32)
    packed = keys.select("_first", "_step").mapInPandas(places, "chunk long, data binary")
    for row in packed.repartition("chunk").sortWithinPartitions("chunk").mapInPandas(fill, "chunk long, data binary").collect():
        at = row["chunk"] * (chunk_bits // 32)
        out[at : at + chunk_bits // 32] = np.frombuffer(row["data"], np.uint32)
    return out[: -(-bits // 32)]


def _passing(keys: DataFrame, level: Level, hashes: int) -> DataFrame:
    def passing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[level.holds(*_as_words(batch["_first"], batch["_step"]), hashes)]

    return keys.mapInPandas(passing, keys.schema)


def listed_by(cascade: Cascade, key: Column) -> Column:
    """Whether the cascade lists the key; the filter goes to the workers as a broadcast variable."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast(cascade)

    @F.pandas_udf("boolean")
    def lists(first: pd.Series, step: pd.Series) -> pd.Series:
        return pd.Series(shared.value.lists(*_as_words(first, step)))

    return lists(*_hashes(key))


def mark_listed(rows: DataFrame, key: str, universe: DataFrame, listed: str, into: str = "listed", hashes: int = 4, bits_per_key: int = 8, max_bytes: int = 64 << 20) -> DataFrame:
    """The rows with a column that says whether their key is listed.

    universe: every key that rows have, with the boolean column `listed`. Keys
    are parted by their hash into as many cascades as max_bytes asks for, all
    levels together; with more than one, the rows are written after each part,
    so a worker holds one part's cascade at a time.
    """
    marked = universe.select(F.col(key).alias("_key"), F.col(listed).alias("_in")).where("_key is not null").groupBy("_key").agg(F.max("_in").alias("_in"))
    marked = written(marked.select("_key", "_in", *_hashes(F.col("_key"))), "cascade-universe")
    n = marked.where("_in").count()
    # The levels after the first are a small share of it.
    parts = max(1, -(-n * bits_per_key // (4 * max_bytes)))
    part = lambda first: F.pmod(F.hash(first), F.lit(parts))
    out = rows.withColumn(into, F.lit(False))
    for number in range(parts):
        own = marked.where(part(F.col("_first")) == number)
        cascade = _cascade(own.where("_in"), own.where("not _in"), hashes, bits_per_key, max_bytes)
        if not cascade.levels:
            continue
        answer = F.coalesce(listed_by(cascade, F.col(key)), F.lit(False))
        if parts > 1:
            answer = F.when(part(_hashes(F.col(key))[0]) == number, answer).otherwise(F.col(into))
        out = out.withColumn(into, answer)
        if number < parts - 1:
            out = written(out, "cascade-part")
    return out


def under_domains(host: Column, domains: Iterable[str]) -> Column:
    fits = F.lit(False)
    for d in domains:
        fits = fits | (host == d) | host.endswith("." + d)
    return fits


def judge_urls(pages: DataFrame, url: str = "url", rules: Iterable[tuple[str, str, str]] = RULES, domains: Iterable[str] = LISTED_DOMAINS, listed: DataFrame | None = None, max_bytes: int = 64 << 20) -> DataFrame:
    """The input's rows with host, path, rule, listed and verdict.

    Blocked keys are those that a block rule takes and, where no rule fits,
    those under the domains or in listed (a frame with a column key: host and
    path as one string). They are the cascade's listed keys over the universe of
    all pages' keys; the verdict is block where the cascade lists the page's
    key, else allow.
    """
    rules, domains = list(rules), list(domains)
    key, blocked = (free_name(n, pages.columns) for n in ("_url_key", "_blocked"))
    parts = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}) if url not in ("host", "path") else pages.withColumn(key, F.col(url)).withColumns({"host": host_of(F.col(key)), "path": path_of(F.col(key))})
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    parts = parts.withColumns({"rule": rule, key: F.concat("host", "path")})
    universe = parts.select(key, F.coalesce(verdict == "block", under_domains(F.col("host"), domains)).alias(blocked), verdict.isNotNull().alias("_ruled")).distinct()
    if listed is not None:
        named = listed.select(F.col("key").alias(key)).where(F.col(key).isNotNull()).distinct().withColumn("_named", F.lit(True))
        universe = universe.join(named, key, "left").withColumn(blocked, F.col(blocked) | (~F.col("_ruled") & F.coalesce("_named", F.lit(False))))
    judged = mark_listed(parts, key, universe, blocked, "listed", max_bytes=max_bytes)
    return judged.withColumn("verdict", F.when(F.col("listed"), "block").otherwise("allow")).drop(key)


def op10_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, longest rule and verdict."""
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = """
with a as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
b as (select page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) path from a),
c as (select *, '.' || host dotted from b),
d as (select page_id, host, path, case
  when ends_with(dotted, '.example.net') and starts_with(path, '/de/8') then 'example.net/de/8'
  when ends_with(dotted, '.example.com') and starts_with(path, '/en/7') then 'example.com/en/7'
  when ends_with(dotted, '.com') and starts_with(path, '/en/') then 'com/en/'
  when ends_with(dotted, '.net') and starts_with(path, '/de/') then 'net/de/'
  when ends_with(dotted, '.org') and starts_with(path, '/es/') then 'org/es/' end as rule, dotted from c)
select page_id, host, path, rule, case
  when rule in ('example.net/de/8', 'com/en/', 'org/es/') then 'block'
  when rule is not null then 'allow'
  when ends_with(dotted, '.spam-farm.example.org') or ends_with(dotted, '.cheap-pills.example.com') then 'block'
  else 'allow' end verdict
from d
"""
