"""What several operators share: tables, the folder that all machines see, and ASCII folding."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Byte-free lower-casing of A-Z only; other letters stay as they are.
FOLD = {ord(c): c.lower() for c in UPPER}

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a test table, and no others."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def free_name(name: str, taken: Iterable[str]) -> str:
    """The name, with as many underscores behind it as set it off from those taken (in any case, as Spark compares names)."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name += "_"
    return name


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where the session has none and runs in one process, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = _own.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="maskwright-")
        _own[spark.sparkContext.applicationId] = root
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def mounted(path: str) -> str:
    """A shared path as workers open it. Operators that map or seek in files need the folder mounted on every machine."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: this operator needs spark.checkpoint.dir on a file system that all machines mount")
    return path


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows of df, written to the shared folder and read again, so that their lineage ends there."""
    spark = df.sparkSession
    path = shared_path(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_columns(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow for a function that gives columns by name. Keys pass through as they are: pandas would make floats of integers beside nulls."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(fields)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in function(batches):
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for f, x in ((f, columns[f.name]) for f in arrow)], schema=arrow)

    return df.mapInArrow(rows, fields)


def ranked(df: DataFrame, group: str, order: Iterable[str], purpose: str) -> DataFrame:
    """df with `rank`, from 0, within its group (a column without nulls) by the order's columns, nulls first. No task holds a whole group.

    Rows are dealt by ranges, sorted, numbered within each task's runs and written
    once. Only a range's first group can have begun in ranges before it, so what
    must be added is one row a range at most, and goes to every task.
    """
    at = df.columns.index(group)
    # Equal rows may be many: a number of no meaning lets ranges divide them.
    dealt = df.withColumn("_salt", F.monotonically_increasing_id())
    keys = [group, *order, "_salt"]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            codes = b.column(at).dictionary_encode().indices.to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1])
            run = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes))))
            if b.column(at)[0].as_py() == last:
                run[: starts[1] if len(starts) > 1 else len(run)] += seen
            last, seen = b.column(at)[-1].as_py(), int(run[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(run, pa.int64()), pa.array(np.full(len(run), part), pa.int32())], names=[*b.schema.names, "rank", "_part"])

    fields = T.StructType([*df.schema.fields, T.StructField("rank", T.LongType()), T.StructField("_part", T.IntegerType())])
    rows = written(dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt").mapInArrow(numbered, fields), purpose)
    runs = rows.groupBy("_part", group).agg(F.max("rank").alias("_n"))
    before = F.sum(F.col("_n") + 1).over(Window.partitionBy(group).orderBy("_part")) - F.col("_n") - 1
    offsets = runs.withColumn("_before", before).where("_before > 0").select("_part", group, "_before")
    return rows.join(F.broadcast(offsets), ["_part", group], "left").withColumn("rank", F.col("rank") + F.coalesce("_before", F.lit(0))).drop("_part", "_before").select(*df.columns, "rank")


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the CRC-32 of ASCII text, which must be short: byte by byte and bit by bit."""
    bits = f"list_concat([4294967295], flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])))"
    return f"xor(list_reduce({bits}, lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, (a & 1) * 3988292384) end), 4294967295)"
