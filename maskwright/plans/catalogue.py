"""Registered queries over the test tables, and SQL that must give the same rows.

The entities of most queries are a fixed table: names that occur in the
synthetic texts, with the cases that matter (a repeated name, one name of two
types, blank and repeated variations, a key that stands inside pseudonyms).
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import audit, chronology, pages
from ..operators import catalogue as C
from ..operators.discovery import PATTERNS, RegexGazetteer, RuleCataloguer, StrictCataloguer, SuppliedEntities, resolved
from ..operators.docx import docx_rewritten, docx_text, runs_replaced
from ..operators.incremental import Ledger
from ..operators.order import ranked
from ..operators.reidentify import reidentify_records, reidentify_texts
from ..operators.replace import apply_map, apply_pairs, apply_to_documents, pseudonymise
from ..operators.spelling import spelled_hits
from ..sources import files
from ..sources.batches import in_parts
from ..sources.scratch import scratch_path
from ..streaming.pseudonymise import pseudonymise_stream
from . import pipeline

#: For tests only; a real salt comes from the secure folder.
TEST_SALT = "00112233445566778899aabbccddeeff"

ENTITIES = (
    (0, "Thth Thndor", "PATIENT", "the case", ("thth", " thndor ", "")),
    (1, "Ertion", "DOCTOR", "treats thth", ("ertion", "er")),
    (2, "Heed Ndea", "RELATIVE", "sister of Thth Thndor", ("heed", "ndea", "heed")),
    (3, "Queaux", "FACILITY", "where Ertion works", ("queaux", "que")),
    (4, " thth thndor", "patient ", "named again", ("Thndor", "thth")),
    (5, "Heed Ndea", "ORGANISATION", "the same name of another type", ("Heed",)),
    (6, "Docu", "LOCATION", "its key stands in pseudonyms", ("DOC",)),
)


def _read(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet").select(*columns)


def _entities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*e[:4], list(e[4])) for e in ENTITIES], C.ENTITIES)


def _named(spark: SparkSession) -> DataFrame:
    return C.with_pseudonym(_entities(spark), C.salt_frame(spark, TEST_SALT))


def _map(spark: SparkSession) -> DataFrame:
    return C.replacement_map(_named(spark))


def _pairs(spark: SparkSession) -> DataFrame:
    return C.ordered_pairs(C.replacement_map(_named(spark)))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _entities_sql(entities: tuple) -> str:
    """ents, named, rmap, pairs and cat from a list of entities, for the SQL below."""
    return (
    "ents(ord, name, kind, ctx, vars) as (values "
    + ", ".join(f"({o}, {_quoted(n)}, {_quoted(k)}, {_quoted(c)}, [{', '.join(map(_quoted, v))}])" for o, n, k, c, v in entities)
    + f"), named as (select *, upper(trim(kind)) || '_' || upper(substr(sha256('{TEST_SALT}' || lower(trim(name))), 1, 8)) pseudonym from ents)"
    + """,
keys as (select ord, place, trim(k) k, pseudonym from (select ord, pseudonym, unnest(list_concat(vars, [name])) k, unnest(range(len(vars) + 1)) place from named) where trim(k) <> ''),
rmap as (select k, arg_max(pseudonym, ord * 1000 + place) v, min(ord * 1000 + place) first_at from keys group by k),
pairs as (select list({'k': k, 'v': v} order by -length(k), first_at) p from rmap),
cat as (select pseudonym, min(ord)::bigint ord, arg_max(name, ord) canonical_name, arg_max(kind, ord) entity_type, arg_max(ctx, ord) relationship_context from named group by pseudonym),
back as (select list({'k': pseudonym, 'v': canonical_name} order by ord) p from cat)
"""
    )


_SQL = _entities_sql(ENTITIES)


def _fold(text: str, pairs: str = "p") -> str:
    return f"list_reduce({pairs}, lambda a, x: {{'k': replace(a.k, x.k, x.v), 'v': ''}}, {{'k': {text}, 'v': ''}}).k"


def _counted(text: str, n: str, crossing: bool) -> str:
    """SQL: a fold that counts: keys that a run has, or in the second pass their occurrences."""
    made = "(length(a.k) - length(replace(a.k, x.k, ''))) // length(x.k)" if crossing else "contains(a.k, x.k)::bigint"
    pairs = "list_transform(p, lambda y: {'k': y.k, 'v': y.v, 'n': 0::bigint})"
    return f"list_reduce({pairs}, lambda a, x: {{'k': replace(a.k, x.k, x.v), 'v': '', 'n': a.n + {made}}}, {{'k': {text}, 'v': '', 'n': {n}}})"


QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- pseudonyms, catalogue, map --------------------------------------------


@_query(f"select c_custkey, upper(substr(sha256('{TEST_SALT}' || lower(trim(c_name))), 1, 8)) hash from customer")
def pseudonym_hash(spark: SparkSession, d: str) -> DataFrame:
    df = C.with_pseudonym(_read(spark, d, "customer", "c_custkey", "c_name").withColumn("t", F.lit("X")), C.salt_frame(spark, TEST_SALT), "c_name", "t")
    return df.select("c_custkey", F.substring("pseudonym", 3, 8).alias("hash"))


_NAMES_SQL = "select s_suppkey::bigint id, s_name name, ' supplier' kind from supplier union all select n_nationkey::bigint, n_name, 'Location ' from nation union all select r_regionkey::bigint, r_name, 'LOCATION' from region"


def _names(spark: SparkSession, d: str) -> DataFrame:
    part = lambda t, key, name, kind: _read(spark, d, t, F.col(key).cast("long").alias("id"), F.col(name).alias("name"), F.lit(kind).alias("kind"))
    return part("supplier", "s_suppkey", "s_name", " supplier").unionByName(part("nation", "n_nationkey", "n_name", "Location ")).unionByName(part("region", "r_regionkey", "r_name", "LOCATION"))


@_query(f"select id, name, upper(trim(kind)) || '_' || upper(substr(sha256('{TEST_SALT}' || lower(trim(name))), 1, 8)) pseudonym from ({_NAMES_SQL})")
def pseudonym_typed(spark: SparkSession, d: str) -> DataFrame:
    return C.with_pseudonym(_names(spark, d), C.salt_frame(spark, TEST_SALT), "name", "kind").select("id", "name", "pseudonym")


_CUSTOMERS_SQL = (
    "select c_custkey * 2 ord, c_name name, c_mktsegment kind, 'customer' ctx from customer union all "
    "select c_custkey * 2 + 1, upper(c_name), c_mktsegment, 'again' from customer where c_nationkey < 5"
)


def _customers(spark: SparkSession, d: str) -> DataFrame:
    own = _read(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    first = own.select((F.col("c_custkey") * 2).alias("ord"), F.col("c_name").alias("canonical_name"), F.col("c_mktsegment").alias("entity_type"), F.lit("customer").alias("relationship_context"))
    again = own.where("c_nationkey < 5").select((F.col("c_custkey") * 2 + 1).alias("ord"), F.upper("c_name").alias("canonical_name"), F.col("c_mktsegment").alias("entity_type"), F.lit("again").alias("relationship_context"))
    return first.unionByName(again).withColumn("variations", F.array("canonical_name"))


@_query(
    f"with named as (select *, upper(trim(kind)) || '_' || upper(substr(sha256('{TEST_SALT}' || lower(trim(name))), 1, 8)) pseudonym from ({_CUSTOMERS_SQL})) "
    "select min(ord) ord, pseudonym, arg_max(name, ord) canonical_name, arg_max(kind, ord) entity_type, arg_max(ctx, ord) relationship_context from named group by pseudonym"
)
def identity_catalogue(spark: SparkSession, d: str) -> DataFrame:
    named = C.with_pseudonym(_customers(spark, d), C.salt_frame(spark, TEST_SALT))
    return C.identity_catalogue(named).drop("variations")


@_query(
    f"with named as (select *, upper(substr(sha256('{TEST_SALT}' || lower(trim(name))), 1, 3)) pseudonym from ({_CUSTOMERS_SQL})) "
    "select pseudonym, count(distinct lower(trim(name))) n_names from named group by pseudonym having count(distinct lower(trim(name))) > 1"
)
def collision_audit(spark: SparkSession, d: str) -> DataFrame:
    """On the first three digits of the hash, so that there are collisions to find."""
    named = C.with_pseudonym(_customers(spark, d).withColumn("entity_type", F.lit("X")), C.salt_frame(spark, TEST_SALT))
    return C.collisions(named.withColumn("pseudonym", F.substring("pseudonym", 3, 3)))


_PARTS_SQL = f"""named as (select p_partkey ord, p_name name, upper(trim(p_brand)) || '_' || upper(substr(sha256('{TEST_SALT}' || lower(trim(p_name))), 1, 8)) pseudonym, [p_brand || ' ' || p_size, '  ' || p_type || ' ', ''] vars from part),
keys as (select ord, place, trim(k) k, pseudonym from (select ord, pseudonym, unnest(list_concat(vars, [name])) k, unnest(range(len(vars) + 1)) place from named) where trim(k) <> ''),
rmap as (select k, arg_max(pseudonym, ord * 1000 + place) v, (min(ord * 1000 + place) // 1000)::bigint ord, (min(ord * 1000 + place) % 1000)::int place from keys group by k)"""


def _part_map(spark: SparkSession, d: str) -> DataFrame:
    entities = _read(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size").select(
        F.col("p_partkey").alias("ord"),
        F.col("p_name").alias("canonical_name"),
        F.col("p_brand").alias("entity_type"),
        F.lit("").alias("relationship_context"),
        F.array(F.concat_ws(" ", "p_brand", "p_size"), F.concat(F.lit("  "), "p_type", F.lit(" ")), F.lit("")).alias("variations"),
    )
    return C.replacement_map(C.with_pseudonym(entities, C.salt_frame(spark, TEST_SALT)))


@_query(f"with {_PARTS_SQL} select k, v, ord, place from rmap")
def replacement_map(spark: SparkSession, d: str) -> DataFrame:
    return _part_map(spark, d)


@_query(f"with {_PARTS_SQL} select k, v, row_number() over (order by -length(k), ord, place) as number from rmap")
def key_order(spark: SparkSession, d: str) -> DataFrame:
    """The place of every key in the order of replacement, numbered by ranges."""
    placed = ranked(_part_map(spark, d).withColumns({"all": F.lit(0), "shorter": -F.length("k")}), "all", ["shorter", "ord", "place"], into="number")
    return placed.select("k", "v", (F.col("number") + 1).alias("number"))


@_query(f"with {_PARTS_SQL}, more as (select k from rmap union select distinct upper(substr(sha256(p_name), 1, 2)) from part) select k, v from more, (select distinct v from rmap) where contains(v, k)")
def cascade_audit(spark: SparkSession, d: str) -> DataFrame:
    """The keys of the parts' map, and pairs of hex digits, that stand in its pseudonyms."""
    mapping = _part_map(spark, d).select("k", "v")
    digits = _read(spark, d, "part", F.upper(F.substring(F.sha2("p_name", 256), 1, 2)).alias("k"), F.lit(None).cast("string").alias("v")).distinct()
    return C.keys_in_pseudonyms(mapping.unionByName(digits)).distinct()


@_query(
    "with kinds as (select distinct upper(trim(k)) kind from (select c_mktsegment k from customer union select ' out' || c_mktsegment from customer where c_nationkey < 5 union select p_type from part union select right(p_type, 4) from part)) "
    "select a.kind, b.kind ends_with from kinds a, kinds b where a.kind <> b.kind and ends_with(a.kind, b.kind)"
)
def type_suffix_audit(spark: SparkSession, d: str) -> DataFrame:
    customers = _read(spark, d, "customer", "c_mktsegment", "c_nationkey")
    parts = _read(spark, d, "part", "p_type")
    kinds = [customers.select("c_mktsegment"), customers.where("c_nationkey < 5").select(F.concat(F.lit(" out"), "c_mktsegment")), parts, parts.select(F.right("p_type", F.lit(4)))]
    return C.suffix_types(reduce(DataFrame.union, kinds).toDF("entity_type"))


# --- replacement -----------------------------------------------------------


@_query(f"with {_SQL} select doc_id, {_fold('text')} as text from documents, pairs")
def sequential_replace(spark: SparkSession, d: str) -> DataFrame:
    return apply_pairs(_read(spark, d, "documents", "doc_id", "text"), _pairs(spark), ["text"])


@_query(f"with {_SQL} select doc_id, {_fold('text')} as text from documents, pairs")
def sequential_replace_vectorised(spark: SparkSession, d: str) -> DataFrame:
    return apply_pairs(_read(spark, d, "documents", "doc_id", "text"), _pairs(spark), ["text"], switch=0)


@_query(f"with {_SQL} select doc_id, {_fold('text')} as text from documents, pairs")
def sequential_replace_scalable(spark: SparkSession, d: str) -> DataFrame:
    """By the form for maps of any size: keys in parts, rounds until no further key comes up."""
    return apply_map(_read(spark, d, "documents", "doc_id", "text"), C.replacement_map(_named(spark)), ["text"], most=4)


@_query(f"with {_SQL} select conv_id, turn, role as speaker, {_fold('text')} as text from conversations, pairs")
def pseudonymise_conversations(spark: SparkSession, d: str) -> DataFrame:
    turns = _read(spark, d, "conversations", "conv_id", "turn", F.col("role").alias("speaker"), "text")
    return pseudonymise(turns, ["text"], _entities(spark), C.salt_frame(spark, TEST_SALT))[0]


@_query(f"with {_SQL} select k as key, count(*) filter (contains(text, k)) n_texts, coalesce(sum((length(text) - length(replace(text, k, ''))) // length(k)), 0)::bigint n_hits from rmap, documents group by k")
def occurrence_count(spark: SparkSession, d: str) -> DataFrame:
    return audit.key_hits(_read(spark, d, "documents", "text"), "text", C.replacement_map(_named(spark)), "k")


@_query(f"with {_SQL} select conv_id, turn, {_fold('role')} as speaker, {_fold('text')} as text from conversations, pairs")
def document_mode_replace(spark: SparkSession, d: str) -> DataFrame:
    turns = _read(spark, d, "conversations", "conv_id", "turn", F.struct("role", "text", "turn").alias("r"))
    done = apply_to_documents(turns, _pairs(spark), "r", turns.schema["r"].dataType)
    return done.select("conv_id", "turn", F.col("r.role").alias("speaker"), "r.text")


_FOUND_SQL = "found as (select distinct kind, name from (" + " union all ".join(f"select {_quoted(k)} kind, unnest(regexp_extract_all(text, {_quoted(p)})) as name from documents" for k, p in PATTERNS.items()) + "))"


@_query(f"with {_FOUND_SQL} select kind entity_type, name canonical_name from found")
def regex_discover(spark: SparkSession, d: str) -> DataFrame:
    return RegexGazetteer(PATTERNS).discover(_read(spark, d, "documents", "text"), "text").select("entity_type", "canonical_name")


@_query(
    f"with {_FOUND_SQL}, named as (select kind, name, ('0x' || substr(md5(kind || ' ' || name), 1, 15))::bigint ord, kind || '_' || upper(substr(sha256('{TEST_SALT}' || lower(name)), 1, 8)) pseudonym from found), "
    "rmap as (select name k, arg_max(pseudonym, ord) v, min(ord) first_at from named group by name), pairs as (select coalesce(list({'k': k, 'v': v} order by -length(k), first_at), []) p from rmap) "
    f"select doc_id, {_fold('text')} as text from documents, pairs"
)
def discover_and_pseudonymise(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents", "doc_id", "text")
    return pseudonymise(docs, ["text"], RegexGazetteer(PATTERNS).discover(docs, "text"), C.salt_frame(spark, TEST_SALT))[0]


# --- re-identification and audits ------------------------------------------


def _reidentified(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    turns = _read(spark, d, "conversations", "conv_id", "turn", "text")
    named = _named(spark)
    catalogue = C.identity_catalogue(named)
    done = apply_pairs(turns, _pairs(spark), ["text"])
    return done, reidentify_texts(done, "text", catalogue, strip_banner=False), catalogue


_TURNS_SQL = f"{_SQL}, done as (select conv_id, turn, {_fold('text')} as text from conversations, pairs), back_again as (select conv_id, turn, {_fold('text')} as text from done, back)"


@_query(f"with {_TURNS_SQL} select * from back_again")
def reidentify_text(spark: SparkSession, d: str) -> DataFrame:
    return _reidentified(spark, d)[1]


@_query(f"with {_TURNS_SQL} select * from back_again")
def reidentify_joined(spark: SparkSession, d: str) -> DataFrame:
    """By the form for catalogues of any size: codes are read off the texts and joined to the catalogue."""
    done, _, catalogue = _reidentified(spark, d)
    return reidentify_texts(done, "text", catalogue, strip_banner=False, most=0)


@_query(f"with {_TURNS_SQL} select conv_id, turn, text from back_again")
def reidentify_record(spark: SparkSession, d: str) -> DataFrame:
    done, _, catalogue = _reidentified(spark, d)
    records = done.select("conv_id", "turn", F.struct("text", "turn").alias("r"))
    return reidentify_records(records, "r", catalogue, records.schema["r"].dataType).select("conv_id", "turn", "r.text")


@_query(
    f"with {_TURNS_SQL} select 'name' as what, canonical_name as key, count(*) filter (contains(text, canonical_name)) > 0 as found from cat, back_again group by all "
    "union all select 'pseudonym', pseudonym, count(*) filter (contains(text, pseudonym)) > 0 from cat, back_again group by all"
)
def roundtrip_audit(spark: SparkSession, d: str) -> DataFrame:
    _, back, catalogue = _reidentified(spark, d)
    part = lambda what, column: audit.key_hits(back, "text", catalogue, column).select(F.lit(what).alias("what"), "key", (F.col("n_texts") > 0).alias("found"))
    return part("name", "canonical_name").unionByName(part("pseudonym", "pseudonym"))


@_query(f"with {_TURNS_SQL} select k as key, count(*) n_texts, sum((length(text) - length(replace(text, k, ''))) // length(k))::bigint n_hits from rmap, done where contains(text, k) group by k")
def leak_audit(spark: SparkSession, d: str) -> DataFrame:
    return audit.leaks(_reidentified(spark, d)[0], "text", C.replacement_map(_named(spark)))


@_query(f"with {_TURNS_SQL} select pseudonym from (select pseudonym from cat union all select 'GUEST_' || r_regionkey from region) where not exists (select 1 from done where contains(text, pseudonym))")
def pseudonym_presence(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue's pseudonyms, and some of people who were never there."""
    done, _, catalogue = _reidentified(spark, d)
    guests = _read(spark, d, "region", F.concat(F.lit("GUEST_"), "r_regionkey").alias("pseudonym"))
    return audit.missing_pseudonyms(done, "text", catalogue.select("pseudonym").union(guests))


@_query(
    f"with {_TURNS_SQL}, planted as (select conv_id, turn, case when conv_id % 7 = 0 then text || ' Docu' else text end as text from done), "
    "bare as (select list_reduce((select list({'k': pseudonym, 'v': chr(1)} order by -length(pseudonym), ord) from cat), lambda a, x: {'k': replace(a.k, x.k, x.v), 'v': ''}, {'k': text, 'v': ''}).k as text from planted) "
    "select k as key, count(*) n_texts, sum((length(text) - length(replace(text, k, ''))) // length(k))::bigint n_hits from rmap, bare where contains(text, k) group by k"
)
def shared_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Keys outside of pseudonyms, where a name was left in some texts on purpose."""
    done, _, catalogue = _reidentified(spark, d)
    some = done.withColumn("text", F.when(F.col("conv_id") % 7 == 0, F.concat("text", F.lit(" Docu"))).otherwise(F.col("text")))
    return audit.shared_leaks(some, "text", C.replacement_map(_named(spark)), catalogue)


def _framed(spark: SparkSession, d: str) -> DataFrame:
    lines = F.repeat(F.lit("a line before\n"), (F.col("conv_id") % 40).cast("int"))
    return _read(spark, d, "conversations", "conv_id", "turn", "text").withColumn("text", F.concat(lines, F.lit(chronology.BANNER), F.lit("  "), "text", F.lit("\n ")))


@_query(
    "with framed as (select conv_id, turn, repeat('a line before' || chr(10), (conv_id % 40)::int) || " + _quoted(chronology.BANNER).replace("\n", "' || chr(10) || '") + " || '  ' || text || chr(10) || ' ' as text from conversations), "
    "cut as (select *, string_split(text, chr(10)) l from framed), "
    "places as (select *, list_min(list_filter(range(6, greatest(6, least(30, len(l)))), lambda i: contains(l[i + 1], repeat('=', 80)))) i from cut) "
    r"select conv_id, turn, case when i is null then text else regexp_replace(array_to_string(l[i + 2:], chr(10)), '^\s+|\s+$', '', 'g') end as text from places"
)
def banner_strip(spark: SparkSession, d: str) -> DataFrame:
    return _framed(spark, d).withColumn("text", X.without_banner(F.col("text")))


@_query(r"select conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') as text from conversations")
def banner_strip_anywhere(spark: SparkSession, d: str) -> DataFrame:
    return _framed(spark, d).withColumn("text", X.without_banner_block(F.col("text")))


# --- chronologies and reports ----------------------------------------------


def _events(spark: SparkSession, d: str) -> DataFrame:
    own = _read(spark, d, "events", "event_id", "ts", "user_id", "event_type", "props").select(
        F.col("user_id").alias("chronology"), F.col("event_id").alias("ord"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("event_type").alias("category"),
        F.lit("events").alias("source_file"), F.concat(F.lit("user "), "user_id").alias("speaker"), F.col("props").alias("event_details"),
    )
    turns = _read(spark, d, "conversations", "conv_id", "turn", "role", "text").select(
        F.col("conv_id").alias("chronology"), F.col("turn").alias("ord"), F.concat(F.lit("turn "), "turn").alias("timestamp"), F.lit("Interview").alias("category"),
        F.lit("conversations").alias("source_file"), F.col("role").alias("speaker"), F.col("text").alias("event_details"),
    )
    docs = _read(spark, d, "documents", "doc_id", "lang", "n_chars").select(
        F.col("doc_id").alias("chronology"), F.lit(0).cast("long").alias("ord"), F.lit("Intake Day").alias("timestamp"), F.lit("Intake document").alias("category"),
        F.lit("documents").alias("source_file"), F.col("lang").alias("speaker"), F.concat(F.col("n_chars"), F.lit(" characters")).alias("event_details"),
    )
    return chronology.unify([own, turns, docs])


_EVENTS_SQL = """unified as (select user_id chronology, event_id ord, strftime(ts, '%Y-%m-%d %H:%M:%S') as timestamp, event_type category, 'events' source_file, 'user ' || user_id speaker, props event_details from events
union all select conv_id, turn, 'turn ' || turn, 'Interview', 'conversations', role, text from conversations
union all select doc_id, 0, 'Intake Day', 'Intake document', 'documents', lang, n_chars || ' characters' from documents),
numbered as (select *, try_cast(timestamp as timestamp) ts, row_number() over (partition by chronology order by try_cast(timestamp as timestamp) asc nulls last, source_file, ord, event_details) as number from unified)"""


@_query(f"with {_EVENTS_SQL} select chronology, number, timestamp, category, source_file, speaker, event_details, ts is null as undated from numbered")
def unified_chronology(spark: SparkSession, d: str) -> DataFrame:
    return chronology.numbered(_events(spark, d)).select("chronology", "number", "timestamp", "category", "source_file", "speaker", "event_details", F.col("ts").isNull().alias("undated"))


@_query(f"with {_EVENTS_SQL} select chronology, number, category, source_file from numbered where number <= 2")
def first_events(spark: SparkSession, d: str) -> DataFrame:
    return chronology.numbered(_events(spark, d)).where("number <= 2").select("chronology", "number", "category", "source_file")


@_query(
    f"with {_EVENTS_SQL}, one as (select *, row_number() over (order by ts asc nulls last, source_file, chronology * 10000000 + ord, event_details) n from numbered) "
    "select 'case' as chronology, n as number, md5('Event #' || n || chr(10) || 'Timestamp: ' || timestamp || chr(10) || 'Category:  ' || category || chr(10) || 'Speaker:   ' || coalesce(speaker, 'None') || chr(10) || 'Details:   ' || coalesce(event_details, 'None') || chr(10) || repeat('-', 80) || chr(10) || chr(10)) text_md5 from one"
)
def one_case_report(spark: SparkSession, d: str) -> DataFrame:
    """All events of all tables as one case: a report that no row could hold, by its lines."""
    events = _events(spark, d).withColumn("ord", F.col("chronology") * 10_000_000 + F.col("ord")).withColumn("chronology", F.lit("case"))
    heads = spark.createDataFrame([("case", "all", None)], "chronology string, patient_summary string, categories_found array<string>")
    return chronology.timeline_report(heads, events).where("number > 0").select("chronology", "number", F.md5("text").alias("text_md5"))


_STRICT_SQL = """given as (select user_id % 20 chronology, event_id ord, case event_id % 4 when 0 then strftime(ts, '%Y-%m-%d %H:%M:%S') when 1 then 'page ' || (event_id * 7 % 11) when 2 then 'later' else 'Session 1 - 00:05' end as timestamp, 'log ' || event_id % 3 source_file, props event_details from events
union all select conv_id % 20, conv_id * 1000 + turn, 'turn ' || turn, 'talk ' || conv_id % 2, text from conversations),
known as (select *, try_cast(timestamp as timestamp) ts from given),
followed as (select *, last_value(ts ignore nulls) over w known_ts, first_value(ts ignore nulls) over (partition by chronology, source_file order by ord, event_details rows between unbounded preceding and unbounded following) first_ts from known window w as (partition by chronology, source_file order by ord, event_details rows between unbounded preceding and current row)),
staged as (select *, coalesce(ts, known_ts, first_ts) placed, case when ts is not null then 1 when known_ts is not null then 2 else 0 end stage, case when ts is null then nullif(regexp_extract(timestamp, '(?i)\\b(?:page|line|turn)\\s+([0-9]{1,9})', 1), '')::bigint end page from followed)"""


@_query(f"with {_STRICT_SQL} select chronology, row_number() over (partition by chronology order by placed asc nulls last, source_file, stage, page asc nulls last, ord, event_details) as number, ord, source_file, timestamp from staged")
def strict_chronology(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose events mostly have no time, interleaved by what is known of it."""
    r = F.col("event_id") % 4
    own = _read(spark, d, "events", "event_id", "ts", "user_id", "props").select(
        (F.col("user_id") % 20).alias("chronology"), F.col("event_id").alias("ord"),
        F.when(r == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(r == 1, F.concat(F.lit("page "), F.col("event_id") * 7 % 11)).when(r == 2, "later").otherwise("Session 1 - 00:05").alias("timestamp"),
        F.lit("c").alias("category"), F.concat(F.lit("log "), F.col("event_id") % 3).alias("source_file"), F.lit("s").alias("speaker"), F.col("props").alias("event_details"),
    )
    talk = _read(spark, d, "conversations", "conv_id", "turn", "text").select(
        (F.col("conv_id") % 20).alias("chronology"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.concat(F.lit("turn "), "turn").alias("timestamp"),
        F.lit("c").alias("category"), F.concat(F.lit("talk "), F.col("conv_id") % 2).alias("source_file"), F.lit("s").alias("speaker"), F.col("text").alias("event_details"),
    )
    return chronology.numbered(StrictCataloguer().catalogue([own, talk])).select("chronology", "number", "ord", "source_file", "timestamp")


@_query(f"with {_EVENTS_SQL} select chronology, array_to_string(list(distinct category order by category), '; ') categories from unified group by chronology")
def categories_found(spark: SparkSession, d: str) -> DataFrame:
    return chronology.categories(_events(spark, d)).select("chronology", F.array_join("categories_found", "; ").alias("categories"))


@_query(
    "select event_id, case when contains(lower(c), 'intake') then 'badge-intake' when contains(lower(c), 'interview') then 'badge-interview' when contains(lower(c), 'assessment') then 'badge-assessment' "
    "when contains(lower(c), 'activity') then 'badge-activity' else 'badge-unknown' end badge from (select event_id, case event_id % 5 when 0 then event_type || ' INTAKE interview' when 1 then 'Interview' when 2 then 'Risk assessment' when 3 then 'activity ' || event_type end c from events)"
)
def timeline_badge(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("event_id") % 5
    kind = F.when(r == 0, F.concat("event_type", F.lit(" INTAKE interview"))).when(r == 1, "Interview").when(r == 2, "Risk assessment").when(r == 3, F.concat(F.lit("activity "), "event_type"))
    return _read(spark, d, "events", "event_id", "event_type").select("event_id", X.badge(kind).alias("badge"))


@_query("select event_id, coalesce(nullif(event_type, 'click'), 'N/A') as timestamp, coalesce(nullif(event_type, 'view'), 'Unknown') speaker, coalesce(nullif(event_type, 'click'), '') category, coalesce(props, '') event_details from events")
def event_defaults(spark: SparkSession, d: str) -> DataFrame:
    gone = lambda v: F.nullif(F.col("event_type"), F.lit(v))
    return _read(spark, d, "events", "event_id", "event_type", "props").select(
        "event_id", X.with_default("timestamp", gone("click")).alias("timestamp"), X.with_default("speaker", gone("view")).alias("speaker"), X.with_default("category", gone("click")).alias("category"), X.with_default("event_details", F.col("props")).alias("event_details")
    )


@_query(
    "with t as (select event_id, case event_id % 5 when 0 then strftime(ts, '%Y-%m-%d %H:%M:%S') when 1 then 'Intake Day' when 2 then 'page ' || event_id when 3 then 'Session 1 - ' || strftime(ts, '%H:%M:%S') else strftime(ts, '%Y-') || '13-40 10:00:00' end raw from events) "
    "select event_id, raw, epoch(try_cast(raw as timestamp))::bigint as seconds from t"
)
def parsed_timestamps(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("event_id") % 5
    raw = F.when(r == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(r == 1, "Intake Day").when(r == 2, F.concat(F.lit("page "), "event_id")).when(r == 3, F.concat(F.lit("Session 1 - "), F.date_format("ts", "HH:mm:ss"))).otherwise(F.concat(F.date_format("ts", "yyyy-"), F.lit("13-40 10:00:00")))
    return _read(spark, d, "events", "event_id", "ts").select("event_id", raw.alias("raw")).withColumn("seconds", F.unix_timestamp(X.parsed_time(F.col("raw"))))


def _headers(spark: SparkSession, d: str) -> DataFrame:
    found = chronology.categories(_events(spark, d))
    return found.withColumn("patient_summary", F.concat(F.lit("case "), "chronology"))


def _sql_text(text: str) -> str:
    return _quoted(text).replace("\n", "' || chr(10) || '")


_REPORT_SQL = f"{_EVENTS_SQL}, heads as (select chronology, 'case ' || chronology summary, list(distinct category order by category) kinds from unified group by chronology)"


@_query(
    f"with {_REPORT_SQL}, blocks as (select chronology, string_agg('[' || number || '] ' || timestamp || '  |  Speaker: ' || coalesce(speaker, 'Unknown') || '  |  Category: ' || category || chr(10) || coalesce(event_details, '') || chr(10), chr(10) order by number) b from numbered group by chronology) "
    f"select chronology, md5({_sql_text('=' * 72 + chr(10) + 'DE-IDENTIFIED TRANSCRIPTION' + chr(10) + '=' * 72 + chr(10) * 2 + 'PATIENT SUMMARY:' + chr(10))} || summary || chr(10) || chr(10) || 'CATEGORIES: ' || array_to_string(kinds, ', ') || chr(10) || chr(10) || "
    f"{_sql_text('-' * 72 + chr(10) + 'CHRONOLOGICAL EVENTS' + chr(10) + '-' * 72 + chr(10) * 2)} || b) report_md5 from heads join blocks using (chronology)"
)
def deid_transcript(spark: SparkSession, d: str) -> DataFrame:
    return chronology.whole(chronology.transcription(_headers(spark, d), _events(spark, d))).select("chronology", F.md5("report").alias("report_md5"))


@_query(
    f"with {_REPORT_SQL}, blocks as (select chronology, string_agg('Event #' || number || chr(10) || 'Timestamp: ' || timestamp || chr(10) || 'Category:  ' || category || chr(10) || 'Speaker:   ' || coalesce(speaker, 'None') || chr(10) || 'Details:   ' || coalesce(event_details, 'None') || chr(10) || repeat('-', 80) || chr(10) || chr(10), '' order by number) b from numbered group by chronology) "
    f"select chronology, md5({_sql_text(chronology.BANNER + 'PATIENT SYNTHESIS SUMMARY:' + chr(10))} || summary || {_sql_text(chr(10) * 2 + '=' * 80 + chr(10) + 'UNIFIED CLINICAL TIMELINE (PSEUDONYMISED)' + chr(10) + '=' * 80 + chr(10) * 2)} || b) report_md5 from heads join blocks using (chronology)"
)
def timeline_report(spark: SparkSession, d: str) -> DataFrame:
    return chronology.whole(chronology.timeline_report(_headers(spark, d), _events(spark, d))).select("chronology", F.md5("report").alias("report_md5"))


_SUPPLIERS_SQL = f"""ents as (select s_suppkey ord, s_name as name, 'SUPPLIER' kind, 'delivers with ' || lag(s_name, 1, s_name) over (order by s_suppkey) || ' to nation ' || s_nationkey ctx from supplier),
named as (select *, kind || '_' || upper(substr(sha256('{TEST_SALT}' || lower(trim(name))), 1, 8)) pseudonym from ents), pairs as (select list({{'k': name, 'v': pseudonym}} order by -length(name), ord) p from named)"""


@_query(f"with {_SUPPLIERS_SQL} select ord, pseudonym, kind entity_type, {_fold('ctx')} as relationship_context from named, pairs")
def safe_legend(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers whose contexts name other suppliers."""
    own = _read(spark, d, "supplier", "s_suppkey", "s_name", "s_nationkey")
    before = own.select((F.col("s_suppkey") + 1).alias("s_suppkey"), F.col("s_name").alias("other"))
    context = F.concat(F.lit("delivers with "), F.coalesce("other", "s_name"), F.lit(" to nation "), "s_nationkey")
    entities = own.join(before, "s_suppkey", "left").select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("canonical_name"), F.lit("SUPPLIER").alias("entity_type"), context.alias("relationship_context"), F.array().cast("array<string>").alias("variations"))
    named = C.with_pseudonym(entities, C.salt_frame(spark, TEST_SALT))
    return audit.safe_legend(C.identity_catalogue(named), C.replacement_map(named))


@_query(
    f"with {_SQL}, {_REPORT_SQL}, legend as (select string_agg('  ' || pseudonym || '  [' || entity_type || ']  ' || {_fold('relationship_context')} || chr(10), '' order by ord) t from cat, pairs) "
    f"select chronology, md5({_sql_text(chronology.BANNER + 'PATIENT SYNTHESIS SUMMARY:' + chr(10))} || summary || chr(10) || chr(10) || 'IDENTIFIED CATEGORIES:' || chr(10) || array_to_string(list_transform(kinds, lambda c: '- ' || c || chr(10)), '') || chr(10) || "
    f"{_sql_text('=' * 80 + chr(10) + 'PSEUDONYM HASH LEGEND' + chr(10) + '=' * 80 + chr(10) * 2)} || t || chr(10)) report_md5 from heads, legend"
)
def synthesis_summary(spark: SparkSession, d: str) -> DataFrame:
    legend = chronology.legend_lines(audit.safe_legend(C.identity_catalogue(_named(spark)), _map(spark)))
    return chronology.whole(chronology.synthesis_summary(_headers(spark, d), legend)).select("chronology", F.md5("report").alias("report_md5"))


# --- files and scalar rules ------------------------------------------------

_EXTENSIONS = (".txt", ".CSV", ".docx", ".pdf", ".png", ".mp3", ".mov", ".xyz", "", ".tar.JSON")


def _paths(spark: SparkSession, d: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, _EXTENSIONS)), (F.col("page_id") % len(_EXTENSIONS) + 1).cast("int"))
    name = F.concat(F.when(F.col("page_id") % 7 == 0, ".hidden").otherwise("deidentified_file"), F.col("page_id"), ext)
    return _read(spark, d, "pages", "page_id").select("page_id", F.concat(F.lit("/data/in/"), name).alias("path"))


_PATHS_SQL = (
    f"names as (select page_id, case when page_id % 7 = 0 then '.hidden' else 'deidentified_file' end || page_id || ([{', '.join(map(_quoted, _EXTENSIONS))}])[page_id % {len(_EXTENSIONS)} + 1] as name from pages), "
    "parts as (select *, lower(regexp_extract(name, '[^.].*?(\\.[^.]*)$', 1)) ext from names)"
)


@_query(
    f"with {_PATHS_SQL} select page_id, ext as extension, case when ext in ('.txt', '.csv', '.json') then 'text' when ext = '.docx' then 'docx' when ext = '.pdf' then 'document' when ext = '.png' then 'image' when ext = '.mp3' then 'audio' when ext = '.mov' then 'video' else 'unsupported' end route, "
    "not starts_with(name, '.') is_input, ext in ('.pdf', '.docx') is_editable from parts"
)
def file_router(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return _paths(spark, d).select("page_id", X.extension(p).alias("extension"), X.route(p).alias("route"), X.is_input(p).alias("is_input"), X.is_editable(p).alias("is_editable"))


_MIMES = ("image/gif", "audio/ogg", "video/ogg", "application/pdf", "text/x-c", "application/zip", None)


@_query(
    f"with m as (select page_id, ([{', '.join('null' if m is None else _quoted(m) for m in _MIMES)}])[page_id % {len(_MIMES)} + 1] m, page_id % 2 = 0 good from pages) "
    "select page_id, m as mime, case when m like 'image/%' then 'image' when m like 'audio/%' then 'audio' when m like 'video/%' then 'video' when m = 'application/pdf' then 'document' when m like 'text/%' then 'text' when m is not null then case when good then 'text' else 'document' end else 'unsupported' end route, "
    "case when m like 'text/%' and not good then 'its bytes are not UTF-8' when m is null then 'its kind is not known' end reason from m"
)
def mime_router(spark: SparkSession, d: str) -> DataFrame:
    """Files of an unknown extension, by MIME type and then by their bytes: the page's, half of them with one that UTF-8 doesn't have."""
    kind = F.element_at(F.array(*map(F.lit, _MIMES)), (F.col("page_id") % len(_MIMES) + 1).cast("int"))
    content = F.when(F.col("page_id") % 2 == 0, F.encode("html", "utf-8")).otherwise(F.concat(F.encode("html", "utf-8"), F.unhex(F.lit("FF"))))
    files = _read(spark, d, "pages", "page_id", "html").select("page_id", kind.alias("mime"), F.coalesce(content, F.lit("").cast("binary")).alias("content"))
    routed = files.withColumn("route", X.resolved_route(X.route(F.lit("/a/file.odd"), F.col("mime")), F.col("content")))
    return routed.select("page_id", "mime", "route", X.unreadable(F.col("route"), F.col("content")).alias("reason"))


@_query(f"with {_PATHS_SQL} select page_id, 'verbatim_' || name || '.json' verbatim, 'deidentified_' || name deidentified, 'reidentified_' || regexp_replace(name, '^deidentified_', '') reidentified, substr(name, 1, length(name) - length(ext)) stem from parts")
def derived_names(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return _paths(spark, d).select("page_id", X.verbatim_name(p).alias("verbatim"), X.deidentified_name(p).alias("deidentified"), X.reidentified_name(p).alias("reidentified"), X.stem(p).alias("stem"))


@_query(r"select page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) as text from pages")
def markup_strip(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "pages", "page_id", X.plain_markup(F.col("html")).alias("text"))


@_query("select o_orderkey, left(c, 4) || '····' || right(c, 4) masked, coalesce(nullif(nullif(o_orderstatus, 'F'), 'O'), nullif(o_orderpriority, ''), 'none') first_given from (select *, o_orderpriority || o_orderkey || 'secret' c from orders)")
def masked_and_first(spark: SparkSession, d: str) -> DataFrame:
    orders = _read(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    status = F.when(F.col("o_orderstatus") == "F", "").when(F.col("o_orderstatus") != "O", F.col("o_orderstatus"))
    return orders.select("o_orderkey", X.masked_secret(F.concat("o_orderpriority", "o_orderkey", F.lit("secret"))).alias("masked"), X.first_given(status, F.col("o_orderpriority"), F.lit("none")).alias("first_given"))


@_query("select p_partkey, v as version, a >= 3 and (a > 3 or b >= 12) as enough from (select p_partkey, case p_partkey % 4 when 0 then 'v' else '' end || (p_size % 5) || case p_partkey % 3 when 0 then '' else '.' || (p_partkey % 20) || '.1' end v, p_size % 5 a, case p_partkey % 3 when 0 then 0 else p_partkey % 20 end b from part)")
def version_check(spark: SparkSession, d: str) -> DataFrame:
    minor = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("."), F.col("p_partkey") % 20, F.lit(".1")))
    version = F.concat(F.when(F.col("p_partkey") % 4 == 0, "v").otherwise(""), F.col("p_size") % 5, minor)
    return _read(spark, d, "part", "p_partkey", "p_size").select("p_partkey", version.alias("version"), X.version_at_least(version, 3, 12).alias("enough"))


@_query("select doc_id, round(n_chars / 1024.0, 2)::double kb from documents")
def size_in_kb(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents", "doc_id", X.kilobytes(F.col("n_chars")).alias("kb"))


# --- runs, pages, files ----------------------------------------------------


@_query(
    f"with {_SQL}, runs as (select conv_id, turn, unnest(string_split(text, ' ')) run, unnest(range(len(string_split(text, ' ')))) place from conversations) "
    f"select conv_id, turn, array_to_string(list({_fold('run')} order by place), '|') runs from runs, pairs group by conv_id, turn"
)
def run_replace(spark: SparkSession, d: str) -> DataFrame:
    """Inside runs only, by built-in expressions: the first pass of editing a paragraph."""
    turns = _read(spark, d, "conversations", "conv_id", "turn", F.split("text", " ").alias("runs"))
    joined = turns.crossJoin(F.broadcast(_pairs(spark)))
    return joined.select("conv_id", "turn", F.array_join(F.transform("runs", lambda r: X.replace_in_order(r, F.col("pairs"))), "|").alias("runs"))


def _crossed(spark: SparkSession, d: str) -> DataFrame:
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("text") - 1) / 5).cast("int"))), lambda i: F.substring(F.col("text"), i * 5 + 1, F.lit(5)))
    turns = _read(spark, d, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", runs.alias("runs"))
    return runs_replaced(turns, "runs", _map(spark))


@_query()
def cross_run_replace(spark: SparkSession, d: str) -> DataFrame:
    """Inside and across runs of five characters."""
    return _crossed(spark, d).select("conv_id", "turn", F.array_join("runs", "|").alias("runs"), "n_replaced")


@_query(
    f"with {_SQL}, runs as (select conv_id, turn, unnest(range(greatest(1, (length(text) + 4) // 5))) i, text from conversations), "
    f"first as (select conv_id, turn, i, {_counted('substr(text, i * 5 + 1, 5)', '0::bigint', False)} r from runs, pairs), "
    "joined as (select conv_id, turn, string_agg(r.k, '' order by i) k, sum(r.n)::bigint n from first group by conv_id, turn), "
    f"both_ as (select conv_id, turn, {_counted('k', 'n', True)} r from joined, pairs) "
    "select conv_id, turn, r.k as text, r.n n_replaced from both_"
)
def cross_run_text(spark: SparkSession, d: str) -> DataFrame:
    """What cross_run_replace leaves, as one text."""
    return _crossed(spark, d).select("conv_id", "turn", F.array_join("runs", "").alias("text"), "n_replaced")


_FONTS = ("Helvetica", "Arial-BoldMT", "Courier-Oblique", "SansSerif-Bold", "TimesNewRoman,BoldItalic", "Symbol", "ZapfDingbats", "DejaVuSansMono-Bold", "Gotham-Black", "Lato-Italic")


@_query(
    f"with f as (select p_partkey, lower(([{', '.join(map(_quoted, _FONTS))}])[p_partkey % {len(_FONTS)} + 1]) n from part), "
    "g as (select p_partkey, n, (n like '%bold%' or n like '%black%' or n like '%heavy%') b, (n like '%italic%' or n like '%oblique%') i from f) "
    "select p_partkey, case when n like '%courier%' or n like '%mono%' then case when b and i then 'cobi' when b then 'cobo' when i then 'coit' else 'cour' end "
    "when n like '%times%' or n like '%serif%' then case when b and i then 'tibi' when b then 'tibo' when i then 'tiit' else 'tiro' end "
    "when n like '%symbol%' then 'symb' when n like '%zapf%' then 'zadb' else case when b and i then 'hebi' when b then 'hebo' when i then 'heit' else 'helv' end end base_font from g"
)
def font_map(spark: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, _FONTS)), (F.col("p_partkey") % len(_FONTS) + 1).cast("int"))
    return _read(spark, d, "part", "p_partkey", X.base_font(name).alias("base_font"))


@_query("select p_partkey, ((c >> 16) & 255) / 255.0::double r, ((c >> 8) & 255) / 255.0::double g, (c & 255) / 255.0::double b from (select p_partkey, (p_partkey * 7919) % 16777216 c from part)")
def rgb_unpack(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "part", "p_partkey", X.rgb((F.col("p_partkey") * 7919) % 16777216).alias("c")).select("p_partkey", "c.r", "c.g", "c.b")


@_query(
    "with spans as (select l_orderkey page, l_linenumber ord, l_quantity x0, l_quantity + 10 x1, l_linenumber::double y0, l_linenumber + 2.0 y1, l_shipdate::date::varchar font from lineitem), "
    "hits as (select o_orderkey page, 0 hit, 10.0 x0, 30.0 x1, 2.0 y0, 4.0 y1 from orders), "
    "areas as (select h.page, h.hit, s.font, s.ord, greatest(least(h.x1, s.x1) - greatest(h.x0, s.x0), 0) * greatest(least(h.y1, s.y1) - greatest(h.y0, s.y0), 0) area from hits h join spans s using (page)), "
    "best as (select page, hit, first(font order by area desc, ord, font desc) font from areas where area > 0 group by page, hit) "
    "select page, coalesce(font, 'helv') font from hits left join best using (page, hit)"
)
def best_style(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    n = F.col("l_linenumber").cast("double")
    spans = _read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_shipdate").select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("ord"), q.alias("span_x0"), (q + 10).alias("span_x1"), n.alias("span_y0"), (n + 2).alias("span_y1"), F.col("l_shipdate").cast("date").cast("string").alias("font"), F.lit(10.0).alias("size"), F.lit(0).alias("color")
    )
    hits = _read(spark, d, "orders", F.col("o_orderkey").alias("page"), F.lit(0).alias("hit"), F.lit(10.0).alias("hit_x0"), F.lit(30.0).alias("hit_x1"), F.lit(2.0).alias("hit_y0"), F.lit(4.0).alias("hit_y1"))
    return pages.best_styles(hits, spans).select("page", "font")


@_query(f"with {_SQL} select lang as document, bool_or(exists (select 1 from rmap where contains(text, k))) searchable from documents group by lang")
def searchable_check(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents", F.col("lang").alias("document"), "text")
    return pages.searchable(docs, C.replacement_map(_named(spark)))


@_query(
    "with h as (select distinct l_orderkey page, l_linenumber hit, l_linenumber % 3 y0, l_linenumber % 3 + l_linenumber % 2 + 1 y1, floor(l_quantity / 5) x0, floor(l_quantity / 5) + l_linenumber x1 from lineitem) "
    "select page, hit from h where not exists (select 1 from h o where o.page = h.page and o.hit <> h.hit and o.y0 <= h.y0 and o.y1 >= h.y1 and o.x0 <= h.x0 and o.x1 >= h.x1 and not (o.x0 = h.x0 and o.x1 = h.x1 and o.y0 = h.y0 and o.y1 = h.y1 and o.hit < h.hit))"
)
def outer_hits(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    x0 = F.floor(F.col("l_quantity") / 5)
    hits = _read(spark, d, "lineitem", F.col("l_orderkey").alias("page"), n.alias("hit"), (n % 3).alias("hit_y0"), (n % 3 + n % 2 + 1).alias("hit_y1"), x0.alias("hit_x0"), (x0 + n).alias("hit_x1"), F.repeat(F.lit("k"), n).alias("k")).distinct()
    return pages.outer_hits(hits).select("page", "hit")


@_query(
    "with f as (select o_orderkey, o_orderstatus = 'F' s, o_custkey % 2 = 0 r, count(l_orderkey) filter (l_quantity > 25) h from orders left join lineitem on l_orderkey = o_orderkey group by all) "
    "select o_orderkey, case when s and h > 0 then 'redacted' when not s and r and h > 0 then 'redacted_after_ocr' else 'withheld' end outcome from f"
)
def edit_outcome(spark: SparkSession, d: str) -> DataFrame:
    """Orders as documents, of which some are searchable and some were recognised; some of their lines are hits."""
    hits = _read(spark, d, "lineitem", "l_orderkey", "l_quantity").where("l_quantity > 25").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("h"))
    files = _read(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_custkey").join(hits, "o_orderkey", "left")
    return files.select("o_orderkey", pages.outcome(F.col("o_orderstatus") == "F", F.col("o_custkey") % 2 == 0, F.coalesce("h", F.lit(0))).alias("outcome"))


def docx_file(paragraphs: list[list[str]], cells: list[str] = (), header: str = "") -> bytes:
    """A small DOCX file, for tests and the queries below: paragraphs as lists of runs, table rows of three cells, one header."""
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    safe = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")
    p = lambda runs: "<w:p>" + "".join(f'<w:r><w:t xml:space="preserve">{safe(r)}</w:t></w:r>' for r in runs) + "</w:p>"
    rows = [cells[i : i + 3] for i in range(0, len(cells), 3)]
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p([c])}</w:tc>" for c in row) + "</w:tr>" for row in rows) + "</w:tbl>" if cells else ""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {space}><w:body>{''.join(map(p, paragraphs))}{table}</w:body></w:document>")
        if header:
            z.writestr("word/header1.xml", f"<w:hdr {space}>{p([header])}</w:hdr>")
    return out.getvalue()


def _docx_files(spark: SparkSession, d: str) -> DataFrame:
    """A file for every turn, of all its words: the first 200 as paragraphs of two runs, the rest as cells; null texts are files of one empty word."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_parts(batches):
            words = [(t or "").split(" ") for t in part["text"]]
            content = [docx_file([[w[:3], w[3:] + " "] for w in ws[:200]], ws[200:], "thth heads this") for ws in words]
            yield pa.RecordBatch.from_arrays([pa.array(part["path"], pa.string()), pa.array(content, pa.binary())], names=["path", "content"])

    return _read(spark, d, "conversations", F.concat_ws("-", "conv_id", "turn").alias("path"), "text").mapInArrow(made, "path string, content binary")


_WORDS_SQL = "words as (select concat_ws('-', conv_id, turn) as path, string_split(coalesce(text, ''), ' ') w from conversations), lines as (select path, list_transform(w, lambda x, i: case when i <= 200 then x || ' ' else x end) l from words)"


@_query(f"with {_WORDS_SQL} select path, array_to_string(l, chr(10)) as text from lines")
def docx_extract(spark: SparkSession, d: str) -> DataFrame:
    return docx_text(_docx_files(spark, d)).select("path", "text")


@_query(
    f"with {_SQL}, {_WORDS_SQL}, runs as (select path, unnest(w) word, unnest(range(1, len(w) + 1)) i from words union all select path, 'thth heads this', 0 from words), "
    f"first as (select path, i, {_counted("case when i between 1 and 200 then left(word, 3) else word end", '0::bigint', False)} head, {_counted("case when i between 1 and 200 then substr(word, 4) || ' ' else '' end", '0::bigint', False)} tail from runs, pairs), "
    f"both_ as (select path, i, {_counted('head.k || tail.k', 'head.n + tail.n', True)} r from first, pairs) "
    "select path, string_agg(r.k, chr(10) order by i) filter (i > 0) as text, sum(r.n)::bigint n_replaced, null::varchar as error from both_ group by path"
)
def docx_rewrite(spark: SparkSession, d: str) -> DataFrame:
    done = docx_rewritten(_docx_files(spark, d), _map(spark))
    return docx_text(done).select("path", "text", "n_replaced", "error")


@_query(f"with {_SQL} select conv_id, turn, {_fold('text')} as text from conversations, pairs")
def incremental_pseudonymise(spark: SparkSession, d: str) -> DataFrame:
    """Two runs into one ledger, each with half of the conversations and of the entities: what one run over all gives."""
    ledger = Ledger(spark, scratch_path(spark, "ledger"))
    turns = _read(spark, d, "conversations", F.concat_ws(":", "conv_id", "turn").alias("id"), "text", "conv_id")
    for half, some in ((0, "ord < 3"), (1, "ord >= 3")):
        entities = _entities(spark).where(some).withColumn("ord", F.col("ord") - 3 * half)
        ledger.add(turns.where(F.col("conv_id") % 2 == half), entities, C.salt_frame(spark, TEST_SALT))
    part = lambda i: F.split_part("id", F.lit(":"), F.lit(i)).cast("long")
    return ledger.texts().select(part(1).alias("conv_id"), part(2).alias("turn"), "text")


@_query(f"with {_SQL} select conv_id, turn, {_fold('text')} as text from conversations, pairs")
def streaming_pseudonymise(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as a stream: what has arrived is replaced batch by batch into the shared folder, and read from there."""
    source = f"{d}/conversations.parquet"
    schema = spark.read.parquet(source).schema
    root = scratch_path(spark, "stream")
    out, state = f"{root}/rows", f"{root}/state"
    stream = spark.readStream.schema(schema).parquet(f"{source}*").select("conv_id", "turn", "text")
    from ..streaming.pseudonymise import write_available

    write_available(pseudonymise_stream(stream, _pairs(spark), ["text"]), out, state).awaitTermination()
    return spark.read.parquet(out)


@_query(
    "with parts as (select p_partkey, split_part(p_name, ' ', 1) a, split_part(p_name, ' ', 2) b, p_brand kind from part), "
    "said as (select kind, case p_partkey % 6 when 0 then a || ' ' || b when 1 then 'Dr. ' || upper(a) || ' ' || b when 2 then upper(left(a, 1)) || '. ' || b when 3 then 'Mr. ' || upper(b) when 4 then upper(a) else a || '-' || b end as name from parts), "
    "m as (select name, kind, count(*) n, list_filter(string_split(regexp_replace(lower(name), '[^\\p{L}\\p{N}#''-]+', ' ', 'g'), ' '), lambda w: w <> '' and not list_contains(['dr', 'mr'], w)) w from said group by all), "
    "f as (select *, array_to_string(w, ' ') form, case when len(w) = 1 then 'single' when length(w[1]) = 1 then 'initial' else 'full' end k from m), "
    "ways as (select distinct kind, form, unnest([{'k': 'initial', 'v': left(w[1], 1) || ' ' || w[-1]}, {'k': 'single', 'v': w[1]}, {'k': 'single', 'v': w[-1]}]) x from f where k = 'full'), "
    "leads as (select kind, x.k k, x.v v, min(form) target from ways group by all having count(distinct form) = 1), "
    "joined as (select f.*, target is null own, coalesce(target, form) root from f left join leads l on l.kind = f.kind and l.k = f.k and l.v = case when f.k = 'initial' then w[1] || ' ' || w[-1] else form end), "
    "best as (select kind, root, max({'own': own, 'n': n, 'l': length(name), 'name': name}).name canonical, list(name order by name) ns from joined group by all) "
    "select kind entity_type, canonical canonical_name, array_to_string(list_filter(ns, lambda x: x <> canonical), '; ') variations from best"
)
def resolved_entities(spark: SparkSession, d: str) -> DataFrame:
    """Parts as people of two words, mentioned with titles, first letters or one word only."""
    a, b = (F.split_part("p_name", F.lit(" "), F.lit(i)) for i in (1, 2))
    r = F.col("p_partkey") % 6
    said = (
        F.when(r == 0, F.concat_ws(" ", a, b)).when(r == 1, F.concat(F.lit("Dr. "), F.upper(a), F.lit(" "), b)).when(r == 2, F.concat(F.upper(F.substring(a, 1, 1)), F.lit(". "), b))
        .when(r == 3, F.concat(F.lit("Mr. "), F.upper(b))).when(r == 4, F.upper(a)).otherwise(F.concat_ws("-", a, b))
    )
    mentions = _read(spark, d, "part", "p_partkey", "p_name", "p_brand").select(said.alias("name"), F.col("p_brand").alias("entity_type"), F.lit(1).alias("n"))
    return resolved(mentions).select("entity_type", "canonical_name", F.array_join("variations", "; ").alias("variations"))


_CODED_SQL = f"with named as (select *, upper(trim(kind)) k, upper(sha256('{TEST_SALT}' || lower(trim(name)))) h from ({_CUSTOMERS_SQL}))"


@_query(
    f"{_CODED_SQL}, hs as (select distinct k, h from named), met as (select a.k, a.h, max(list_min(list_filter(range(3, 65), lambda i: left(a.h, i) <> left(b.h, i)))) n from hs a join hs b on a.k = b.k and a.h <> b.h and left(a.h, 3) = left(b.h, 3) group by all) "
    "select ord, name, k || '_' || left(h, coalesce(n, 3)::int) pseudonym from named left join met using (k, h)"
)
def distinct_pseudonyms(spark: SparkSession, d: str) -> DataFrame:
    """Codes of three digits and as many more as it takes to tell names apart, so that there are collisions to undo."""
    return C.with_distinct_pseudonym(_customers(spark, d), C.salt_frame(spark, TEST_SALT), digits=3).select("ord", F.col("canonical_name").alias("name"), "pseudonym")


@_query(
    "with s as (select c_custkey, c_name, 'note ' || c_custkey || ': ' as pre, case c_custkey % 6 when 0 then chr(92) || 'u0043' || substr(c_name, 2) when 1 then '&#67;' || substr(c_name, 2) when 2 then upper(c_name) when 3 then left(c_name, 4) || chr(8203) || substr(c_name, 5) when 4 then c_name else replace(c_name, '#', '&num;') end said from customer) "
    "select c_custkey id, c_name as key, length(pre)::bigint place, length(said)::bigint length from s"
)
def spelled_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Customers named in escapes, references, capitals and with characters that don't show, at their places in the text as it stands."""
    own = _read(spark, d, "customer", "c_custkey", "c_name")
    rest, r = F.substring("c_name", 2, 1000), F.col("c_custkey") % 6
    said = (
        F.when(r == 0, F.concat(F.lit("\\u0043"), rest)).when(r == 1, F.concat(F.lit("&#67;"), rest)).when(r == 2, F.upper("c_name"))
        .when(r == 3, F.concat(F.substring("c_name", 1, 4), F.lit("\u200b"), F.substring("c_name", 5, 1000))).when(r == 4, F.col("c_name")).otherwise(F.replace("c_name", F.lit("#"), F.lit("&num;")))
    )
    texts = own.select("c_custkey", F.concat(F.lit("note "), "c_custkey", F.lit(": "), said, F.lit(" end")).alias("text"))
    return spelled_hits(texts, F.col("c_custkey"), F.col("text"), F.col("c_name"), own)


@_query(
    f"with {_SQL}, turns as (select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 ord, role, trim(regexp_replace(text, '[\\r\\n]+', ' ', 'g'), ' ') as text from conversations), "
    "lines as (select *, regexp_matches(role || ': ' || text, '^\\s*[^:]{1,40}:\\s') spoken from turns), "
    f"done as (select conv_id, ord, {_fold('role', 'pairs.p')} speaker, {_fold('text', 'pairs.p')} details from lines, pairs) "
    f"select conv_id, ord, speaker, details as event_details, {_fold('details', 'back.p')} as restored from done, back"
)
def mock_run(spark: SparkSession, d: str) -> DataFrame:
    """The whole run over files, and back: every conversation a text file, from the folder of inputs to shared events, and the shared texts returned with their names."""
    root = scratch_path(spark, "run")
    line = F.concat("role", F.lit(": "), F.trim(F.regexp_replace("text", r"[\r\n]+", " ")))
    talks = _read(spark, d, "conversations", "conv_id", "turn", "role", "text").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    files.write_texts(talks.withColumn("name", F.concat(F.lit("talk-"), "conv_id", F.lit(".txt"))), f"{root}/in")
    files.write_text(spark, f"{root}/secure/salt.txt", TEST_SALT)
    run = pipeline.deidentify(spark, f"{root}/in", f"{root}/secure", f"{root}/out", SuppliedEntities(_entities(spark)), cataloguer=StrictCataloguer(RuleCataloguer()), allow_leaks=True)
    back = reidentify_texts(run.events.withColumn("restored", F.col("event_details")), "restored", run.catalogue, strip_banner=False)
    talk = F.regexp_extract("source_file", r"([0-9]+)\.txt$", 1).cast("long")
    return back.select(talk.alias("conv_id"), "ord", "speaker", "event_details", "restored")
