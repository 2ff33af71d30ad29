"""From discovered entities to the identity catalogue and the replacement map.

Entities are rows (ord, canonical_name, entity_type, relationship_context,
variations); ord is the order in which they were found and decides every tie.
The salt is a one-row frame, never a literal, so neither plans nor logs show it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import pseudonym, strip

ENTITIES = T.StructType(
    [
        T.StructField("ord", T.LongType()),
        T.StructField("canonical_name", T.StringType()),
        T.StructField("entity_type", T.StringType()),
        T.StructField("relationship_context", T.StringType()),
        T.StructField("variations", T.ArrayType(T.StringType())),
    ]
)


class MapTooLarge(ValueError):
    """The replacement map has more keys than one row should hold."""


def salt_frame(spark: SparkSession, salt: str) -> DataFrame:
    return spark.createDataFrame([(salt,)], "salt string")


def with_pseudonym(entities: DataFrame, salt: DataFrame, name: str = "canonical_name", kind: str = "entity_type") -> DataFrame:
    """The entities with their pseudonym. salt has one row, whatever the entities' number."""
    return entities.crossJoin(F.broadcast(salt.select("salt").limit(1))).withColumn("pseudonym", pseudonym(F.col(name), F.col(kind), F.col("salt"))).drop("salt")


def with_distinct_pseudonym(entities: DataFrame, salt: DataFrame, name: str = "canonical_name", kind: str = "entity_type", digits: int = 8) -> DataFrame:
    """As with_pseudonym, but no two names of a type share a code: names whose first digits are the same have as many more as it takes to tell them from all others; all other codes stay as they are.

    Only names with the same first digits meet, which are few however many names there are.
    """
    upper = F.upper(strip(F.col(kind)))
    coded = entities.crossJoin(F.broadcast(salt.select("salt").limit(1))).withColumns({"_kind": upper, "_hash": F.upper(F.sha2(F.concat(F.col("salt"), F.lower(strip(F.col(name)))).cast("binary"), 256))}).drop("salt")
    near = Window.partitionBy("_kind", F.substring("_hash", 1, digits)).orderBy("_hash")
    hashes = coded.select("_kind", "_hash").distinct().select("_kind", "_hash", F.lag("_hash").over(near).alias("a"), F.lead("_hash").over(near).alias("b"))
    told = lambda other: F.when(F.col(other).isNull(), digits).otherwise(F.array_min(F.filter(F.sequence(F.lit(digits), F.lit(64)), lambda i: F.substring("_hash", F.lit(1), i) != F.substring(other, F.lit(1), i))))
    longer = hashes.where("a is not null or b is not null").select("_kind", "_hash", F.greatest(told("a"), told("b")).alias("_n"))
    joined = coded.join(longer, ["_kind", "_hash"], "left")
    return joined.withColumn("pseudonym", F.concat("_kind", F.lit("_"), F.substring("_hash", F.lit(1), F.coalesce("_n", F.lit(digits))))).select(*entities.columns, "pseudonym")


def identity_catalogue(named: DataFrame) -> DataFrame:
    """A row for each pseudonym: the last entity's values at the first one's place."""
    value = F.struct("canonical_name", "entity_type", "relationship_context", "variations")
    return named.groupBy("pseudonym").agg(F.min("ord").alias("ord"), F.max_by(value, "ord").alias("v")).select("ord", "pseudonym", "v.*")


def replacement_map(named: DataFrame) -> DataFrame:
    """(k, v, ord, place): every stripped variation, then the name itself, to the pseudonym. A key that comes again keeps its first place and takes the last value; empty keys are left out."""
    keys = F.concat(F.transform(F.coalesce("variations", F.array().cast("array<string>")), strip), F.array(strip(F.col("canonical_name"))))
    rows = named.select("ord", "pseudonym", F.posexplode(keys).alias("place", "k")).where("k <> ''")
    at = F.struct("ord", "place")
    return rows.groupBy("k").agg(F.max_by("pseudonym", at).alias("v"), F.min(at).alias("at")).select("k", "v", "at.ord", "at.place")


def key_order() -> Column:
    """Longest keys first; of equal ones the first found."""
    return F.struct((-F.length("k")).alias("by_length"), "ord", "place", "k", "v")


def ordered_pairs(mapping: DataFrame, most: int = 100_000) -> DataFrame:
    """One row with the array of pairs, in the order in which they are replaced. Its size is checked first, since the row goes to every worker."""
    n = mapping.count()
    if n > most:
        raise MapTooLarge(f"{n} keys, over the bound of {most}")
    pairs = F.transform(F.array_sort(F.collect_list(key_order())), lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v")))
    return mapping.agg(pairs.alias("pairs"))


def reverse_pairs(catalogue: DataFrame, by_length: bool = False, most: int = 100_000) -> DataFrame:
    """One row with pseudonym to name: in the catalogue's order as reports have it, or longest first as document editors do."""
    mapping = catalogue.select(F.col("pseudonym").alias("k"), F.col("canonical_name").alias("v"), "ord", F.lit(0).alias("place"))
    if by_length:
        return ordered_pairs(mapping, most)
    n = mapping.count()
    if n > most:
        raise MapTooLarge(f"{n} keys, over the bound of {most}")
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("ord", "k", "v"))), lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v")))
    return mapping.agg(pairs.alias("pairs"))


def collisions(named: DataFrame) -> DataFrame:
    """(pseudonym, n_names): pseudonyms of more than one name. With 32 hash bits they must be expected from some ten thousand names of a type on."""
    return named.groupBy("pseudonym").agg(F.count_distinct(F.lower(strip(F.col("canonical_name")))).alias("n_names")).where("n_names > 1")


def keys_in_pseudonyms(mapping: DataFrame) -> DataFrame:
    """(k, v): keys that stand in some pseudonym and so would be replaced again inside it. Found by the pseudonyms' own parts, without a cross join."""
    values = mapping.select("v").distinct()
    size = F.length("v")
    parts = values.select("v", F.explode(F.sequence(F.lit(1), size)).alias("a")).select("v", F.explode(F.transform(F.sequence(F.lit(1), F.length("v") - F.col("a") + 1), lambda n: F.substring(F.col("v"), F.col("a"), n))).alias("k")).distinct()
    return mapping.select("k").join(parts, "k").select("k", "v")


def suffix_types(named: DataFrame) -> DataFrame:
    """(kind, ends_with): types that end in another type; with equal names the shorter's pseudonym stands in the longer's."""
    kinds = named.select(F.upper(strip(F.col("entity_type"))).alias("kind")).distinct()
    ends = kinds.select("kind", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.length("kind"), F.lit(2))), lambda i: F.substring(F.col("kind"), i, F.length("kind")))).alias("ends_with"))
    return ends.where("ends_with <> ''").join(kinds.select(F.col("kind").alias("ends_with")), "ends_with").select("kind", "ends_with")
