"""Sharded tables with size-tiered compaction and atomically committed manifests.

An arrival is written as small shards (Parquet files) that are never changed.
Compaction sorts live shards into tiers, each tier_factor times the size of the
one below; a tier that holds at least min_run shards is merged into files of
about target_bytes, without a shuffle: tasks take whole runs of shards. Shards
of target_bytes or more are left alone, so a row is rewritten about once a
tier. The table is what its newest manifest lists. A manifest is written beside
the others and renamed to its version's name, which fails if that version
exists: a writer that lost the race, or died before the rename, leaves the
table as it was and only files that no manifest lists, which vacuum deletes.

Only DataFrame operations touch rows. The driver lists files and keeps one line
a shard: about target_bytes of data each, once compacted.

Nulls, repeated rows and texts of any length are kept as they are. An arrival without rows commits
a version without shards. Columns keep their names whatever they are; an
arrival whose columns differ from the table's is an error before it is written.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_path, table


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    rows: int
    #: The version that added it.
    version: int


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    shards: tuple[Shard, ...] = ()
    schema: str | None = None

    @property
    def rows(self) -> int:
        return sum(s.rows for s in self.shards)


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class ShardTable:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, smallest_bytes: int = 1 << 20, tier_factor: int = 4, min_run: int = 4):
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.smallest, self.factor, self.min_run = target_bytes, smallest_bytes, tier_factor, min_run
        self.jvm = spark._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    # --- files, by Hadoop's interface: any store that Spark reads

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _files(self, folder: str) -> list[tuple[str, int]]:
        path = self._path(folder)
        fs = path.getFileSystem(self.conf)
        if not fs.exists(path):
            return []
        return sorted((f.getPath().toString(), f.getLen()) for f in fs.listStatus(path) if f.isFile())

    def _read_text(self, path: str) -> str:
        p = self._path(path)
        stream = p.getFileSystem(self.conf).open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    # --- manifests

    def versions(self) -> list[int]:
        names = [f.rpartition("/")[2] for f, _ in self._files(f"{self.root}/manifests")]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest manifest, or that of a version; an empty one before the first commit."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return Manifest()
        data = json.loads(self._read_text(f"{self.root}/manifests/v{version:010d}.json"))
        return Manifest(data["version"], tuple(Shard(**s) for s in data["shards"]), data["schema"])

    def commit(self, new: Manifest) -> Manifest:
        """Makes a manifest the table's, all at once, if its version is not there yet."""
        fs = self.jvm.org.apache.hadoop.fs
        waiting = self._path(f"{self.root}/manifests/_{uuid.uuid4().hex}")
        out = waiting.getFileSystem(self.conf).create(waiting, False)
        out.write(bytearray(json.dumps({"version": new.version, "schema": new.schema, "shards": [asdict(s) for s in new.shards]}).encode()))
        out.hsync()
        out.close()
        options = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        options[0] = fs.Options.Rename.NONE
        try:
            fs.FileContext.getFileContext(waiting.toUri(), self.conf).rename(waiting, self._path(f"{self.root}/manifests/v{new.version:010d}.json"), options)
        except Exception as error:
            waiting.getFileSystem(self.conf).delete(waiting, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"version {new.version} is already there") from None
            raise
        return new

    # --- rows

    def _written(self, df: DataFrame, version: int) -> tuple[Shard, ...]:
        """The rows as new shards; files without rows are not listed."""
        folder = f"{self.root}/data/{version:010d}-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        sizes = {path: n for path, n in self._files(folder) if path.endswith(".parquet")}
        if not sizes:
            return ()
        counted = self.spark.read.schema(df.schema).parquet(folder).groupBy(F.col("_metadata.file_name").alias("file")).count().collect()
        rows = {r["file"]: r["count"] for r in counted}
        return tuple(Shard(path, n, rows[path.rpartition("/")[2]], version) for path, n in sizes.items() if rows.get(path.rpartition("/")[2]))

    def append(self, df: DataFrame) -> Manifest:
        """Commits an arrival. Its shards are as many as its partitions."""
        before = self.manifest()
        schema = df.schema.json()
        names = [(f.name, f.dataType) for f in df.schema.fields]
        if before.schema and names != [(f.name, f.dataType) for f in T.StructType.fromJson(json.loads(before.schema)).fields]:
            raise ValueError("the arrival's columns are not the table's")
        added = self._written(df, before.version + 1)
        return self.commit(Manifest(before.version + 1, before.shards + added, before.schema or schema))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest manifest, or of a version that vacuum has left."""
        return self._rows(self.manifest(version))

    def _rows(self, manifest: Manifest) -> DataFrame:
        if manifest.schema is None:
            raise ValueError("nothing has been committed")
        schema = T.StructType.fromJson(json.loads(manifest.schema))
        if not manifest.shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(s.path for s in manifest.shards))

    def tier(self, shard: Shard) -> int:
        return max(0, math.floor(math.log(max(shard.bytes, 1) / self.smallest, self.factor)) + 1) if shard.bytes >= self.smallest else 0

    def due(self, manifest: Manifest) -> list[list[Shard]]:
        """The runs to merge: tiers with at least min_run shards under the target's size."""
        tiers: dict[int, list[Shard]] = {}
        for s in manifest.shards:
            if s.bytes < self.target:
                tiers.setdefault(self.tier(s), []).append(s)
        return [run for _, run in sorted(tiers.items()) if len(run) >= self.min_run]

    def compact(self) -> Manifest:
        """Merges every run that is due, each in one commit, until none is."""
        manifest = self.manifest()
        while runs := self.due(manifest):
            run = runs[0]
            files = max(1, round(sum(s.bytes for s in run) / self.target))
            if files >= len(run):  # nothing would become fewer
                break
            merged = self._written(self._rows(replace(manifest, shards=tuple(run))).coalesce(files), manifest.version + 1)
            if sum(s.rows for s in merged) != sum(s.rows for s in run):
                raise RuntimeError("merged shards don't have the rows of their run")
            gone = {s.path for s in run}
            manifest = self.commit(Manifest(manifest.version + 1, tuple(s for s in manifest.shards if s.path not in gone) + merged, manifest.schema))
        return manifest

    def vacuum(self, keep: int = 1) -> int:
        """Deletes files that none of the newest `keep` manifests lists, and older manifests. Not while others write or read older versions."""
        versions = self.versions()
        live = {s.path for v in versions[-keep:] for s in self.manifest(v).shards}
        gone = 0
        root = self._path(f"{self.root}/data")
        fs = root.getFileSystem(self.conf)
        for folder in fs.listStatus(root) if fs.exists(root) else []:
            inside = [f for f, _ in self._files(folder.getPath().toString())]
            if not any(f in live for f in inside):
                fs.delete(folder.getPath(), True)
                gone += len(inside)
            else:
                for f in inside:
                    if f.endswith(".parquet") and f not in live:
                        fs.delete(self._path(f), False)
                        gone += 1
        for v in versions[:-keep]:
            fs.delete(self._path(f"{self.root}/manifests/v{v:010d}.json"), False)
        return gone


#: In how many parts of the id range the registered query's arrivals come: a half, a quarter and so on, the last two alike.
SHARES = (0.5, 0.75, 0.875, 0.9375)


def op7_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as the table has them after five arrivals, each followed by compaction."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    ends = docs.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    a, b = ends["a"] or 0, ends["b"] or 0
    place = F.when(F.col("doc_id").isNull(), 0.0).otherwise((F.col("doc_id") - a) / F.lit(max(b - a, 1)).cast("double"))
    arrival = sum(((place >= s).cast("int") for s in SHARES[1:]), (place >= SHARES[0]).cast("int"))
    shards = ShardTable(spark, shared_path(spark, "shards"))
    arrived = docs.withColumn("arrival", arrival)
    for number in range(len(SHARES) + 1):
        shards.append(arrived.where(F.col("arrival") == number))
        shards.compact()
        shards.vacuum()
    return shards.read().select("doc_id", "arrival", "lang", "source", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"))


OP7_SQL = """
with ends as (select coalesce(min(doc_id), 0) a, greatest(coalesce(max(doc_id), 0) - coalesce(min(doc_id), 0), 1)::double w from documents),
placed as (select *, case when doc_id is null then 0.0 else (doc_id - a)::double / w end p from documents, ends)
select doc_id, (p >= 0.5)::int + (p >= 0.75)::int + (p >= 0.875)::int + (p >= 0.9375)::int arrival, lang, source,
  coalesce(strlen(text), 0)::bigint n_bytes, md5(text) text_md5
from placed
"""
