"""One catalogue over several runs: later inputs and later entities, with only those texts replaced again that they change.

A ledger is a folder of versions. Each holds the run's own entities and texts, the
map as it was then, and the replaced texts that the run made or made anew; a text
stands as its last version has it. A version counts once its marker is there, which
is written last and all at once, so a run that dies leaves the ledger as it was.

Entities of a later run come after all earlier ones: a key or pseudonym that comes again
keeps its first place and takes the last value, as in one run over everything. An
earlier text can only come out otherwise if a key that is new, or has another value,
comes up in it: in the text as it was, or around what was put in, which is kept with
every text. So changed keys are searched for there, and the texts that have one are
folded anew over the whole map. Ids must differ over all runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from ..sources.scratch import written
from .catalogue import ENTITIES, identity_catalogue, key_order, replacement_map, with_pseudonym
from .replace import MOST, folded_in_rounds, key_places

#: How far around what was put in texts are kept, at least: keys up to one more may come later without more texts being folded anew.
REACH = 255


class Ledger:
    def __init__(self, spark: SparkSession, folder: str, most: int = MOST):
        self.spark, self.folder, self.most = spark, folder.rstrip("/"), most

    def versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/done")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(path)) if fs.exists(path) else []

    def _read(self, what: str, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{version:06d}/{what}")

    def _all(self, what: str) -> DataFrame:
        return reduce(DataFrame.unionByName, (self._read(what, v).withColumn("version", F.lit(v)) for v in self.versions()))

    def named(self, salt: DataFrame) -> DataFrame:
        """All entities so far, in order over all runs, with their pseudonyms."""
        return with_pseudonym(self._all("entities").drop("version"), salt)

    def catalogue(self, salt: DataFrame) -> DataFrame:
        return identity_catalogue(self.named(salt))

    def _standing(self) -> DataFrame:
        """(id, text, windows, reach) as each text's last version has it."""
        return self._all("replaced").groupBy("id").agg(F.max_by(F.struct("text", "windows", "reach"), "version").alias("r")).select("id", "r.*")

    def texts(self) -> DataFrame:
        """(id, text) of all runs, replaced by the whole catalogue."""
        return self._standing().select("id", "text")

    def add(self, texts: DataFrame, entities: DataFrame, salt: DataFrame) -> int:
        """A run with further texts (id, text) and entities. Gives the number of earlier texts that were replaced anew."""
        known = self.versions()
        version = known[-1] + 1 if known else 1
        here = f"{self.folder}/{version:06d}"
        first = (self._all("entities").agg(F.max("ord")).first()[0] if known else None) or 0
        own = entities.select(*ENTITIES.names).withColumn("ord", F.col("ord") + F.lit(first + 1 if known else 0))
        own.write.mode("overwrite").parquet(f"{here}/entities")  # what a run that died has left under this number
        texts.select("id", "text").write.mode("overwrite").parquet(f"{here}/texts")
        everyone = self._read("entities", version) if not known else self._all("entities").drop("version").unionByName(self._read("entities", version))
        replacement_map(with_pseudonym(everyone, salt)).write.mode("overwrite").parquet(f"{here}/map")
        mapping = self._read("map", version)
        n, longest = mapping.agg(F.count("*"), F.max(F.length("k"))).first()
        reach = max(REACH, (longest or 1) - 1)
        look = lambda rows, keys=mapping, n=n: key_places(rows, keys, key_order(), n, self.most)
        open_ = self._read("texts", version)
        redone = 0
        if known:
            before = self._read("map", known[-1]).select("k", F.col("v").alias("was"))
            changed = written(mapping.join(before, "k", "left").where("was is null or was <> v").drop("was"), "changed-keys")
            originals = self._all("texts").drop("version").withColumnRenamed("text", "original")
            standing = written(originals.join(self._standing(), "id").select("id", "original", F.concat(F.array("original"), "windows").alias("texts"), ((F.size("windows") > 0) & (F.col("reach") < reach)).alias("short"), F.monotonically_increasing_id().alias("_row")), "standing")
            hit = look(standing.select("_row", "texts"), changed, changed.count()).select("_row").union(standing.where("short").select("_row")).distinct()
            again = written(standing.join(hit, "_row", "left_semi").select("id", F.col("original").alias("text")), "texts-again")
            redone = again.count()
            open_ = open_.unionByName(again)
        done = folded_in_rounds(open_, ["text"], look, reach, windows="windows")
        done.select("id", "text", "windows", F.lit(reach).alias("reach")).write.mode("overwrite").parquet(f"{here}/replaced")
        files.write_text(self.spark, f"{self.folder}/done/{version}", f"{redone}\n")
        return redone
