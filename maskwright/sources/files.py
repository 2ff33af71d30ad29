"""Files in and out. Reading and writing go through Spark or Hadoop's interface, so any store will do."""

from __future__ import annotations

import json
import os
import secrets
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import base_name, extension, is_input, mime, resolved_route, route, unreadable
from ..operators.catalogue import salt_frame
from .batches import in_parts


class PdfEditor(Protocol):
    """A plug-in around a PDF library; none comes with this package."""

    def pages(self, content: bytes) -> list[str]: ...

    def redact(self, content: bytes, pairs: list[tuple[str, str]]) -> tuple[bytes, int]: ...

    def recognise(self, content: bytes) -> bytes: ...


class Unsupported(RuntimeError):
    """The file's kind needs a plug-in that is not there."""


def list_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, extension, length, route) of the folder's own files that are not hidden, without their content."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length").where(is_input(F.col("path")))
    return files.withColumns({"name": base_name(F.col("path")), "extension": extension(F.col("path")), "route": route(F.col("path"), mime(F.col("path")))})


def read_contents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content, route, reason): routes by name, then by content; the reason why a file can't be read, or null. One broken file is a row, not the end of a job."""
    files = spark.read.format("binaryFile").load(folder).where(is_input(F.col("path"))).select("path", "length", "content")
    routed = files.withColumn("route", resolved_route(route(F.col("path"), mime(F.col("path"))), F.col("content")))
    return routed.withColumn("reason", unreadable(F.col("route"), F.col("content")))


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of the text files, whole; bytes that are not UTF-8 are an error."""
    return read_contents(spark, folder).where("route = 'text'").select("path", F.decode("content", "utf-8").alias("text"))


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON documents of one or more lines; broken ones and missing files are errors."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_json(df: DataFrame, path: str) -> None:
    """Fails loudly, and never over what is there."""
    df.write.json(path)


def write_report(lines: DataFrame, path: str, key: str = "chronology") -> None:
    """Reports (key, number, text) as text: for each key a folder of part files which, one after another by their names, are the report. Texts end with a line's end each, as reports do."""
    rows = lines.select(key, "number", F.regexp_replace("text", r"\n\z", "").alias("value"))
    rows.repartitionByRange(key, "number").sortWithinPartitions(key, "number").select(key, "value").write.partitionBy(key).text(path)


def write_texts(texts: DataFrame, path: str, name: str = "name", text: str = "text") -> None:
    """Texts as files of their names in a folder; each ends with a line's end. A name that comes twice, or is none, is an error before anything is written.

    Where tasks can open the folder (a mounted one), each writes its files under their
    names, and the folder gets its name when all are there. In other stores, and for a
    folder that is there already, files are moved to their names one by one.
    """
    spark = texts.sparkSession
    rows = texts.select(F.col(name).alias("name"), F.concat(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\n\z", ""), F.lit("\n")).alias("text"))
    unusable = F.col("name").isNull() | F.col("name").isin("", ".", "..") | F.contains("name", F.lit("/"))
    for bad in rows.groupBy("name").agg(F.count("*").alias("n")).where((F.col("n") > 1) | unusable).limit(1).collect():
        raise ValueError(f"{bad.name}: several texts have this name" if bad.n > 1 else f"{bad.name!r} is no file's name")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getScheme() != "file" or fs.exists(target):
        _write_and_move(rows, path)
        return
    waiting = target.suffix(f".{uuid.uuid4().hex}")
    fs.mkdirs(waiting)
    try:
        rows.mapInArrow(_files_in(waiting.toUri().getPath()), "n long").agg(F.sum("n")).collect()
        if fs.exists(target) or not fs.rename(waiting, target):
            raise FileExistsError(path)
    except Exception:
        fs.delete(waiting, True)
        raise


def _files_in(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for part in in_parts(batches):
            for name, text in zip(part["name"], part["text"], strict=True):
                # A task that is tried again, or twice at once, leaves whole files only.
                own = os.path.join(folder, f"_{uuid.uuid4().hex}")
                with open(own, "wb") as file:
                    file.write(text.encode())
                os.replace(own, os.path.join(folder, name))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return write


def _write_and_move(rows: DataFrame, path: str) -> None:
    spark = rows.sparkSession
    waiting = f"{path.rstrip('/')}/_{uuid.uuid4().hex}"
    rows.repartition("name").select("name", F.regexp_replace("text", r"\n\z", "").alias("value")).write.partitionBy("name").text(waiting)
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs_path = jvm.org.apache.hadoop.fs.Path
    fs = fs_path(waiting).getFileSystem(conf)
    unescaped = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    for folder in fs.listStatus(fs_path(waiting)):
        own = folder.getPath().getName()
        if own.startswith("name="):
            (part,) = [f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")]
            to = fs_path(f"{path}/{unescaped(own[5:])}")
            if fs.exists(to) or not fs.rename(part, to):
                raise FileExistsError(to.toString())
    fs.delete(fs_path(waiting), True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small text as one file, all at once: under another name first, then renamed; an error where the name is taken."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs
    target = fs.Path(path)
    waiting = fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = waiting.getFileSystem(conf).create(waiting, False)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    options[0] = fs.Options.Rename.NONE
    try:
        fs.FileContext.getFileContext(target.toUri(), conf).rename(waiting, target, options)
    except Exception:
        waiting.getFileSystem(conf).delete(waiting, False)
        raise


def write_pretty_json(spark: SparkSession, path: str, value: object) -> None:
    """One document, two spaces an indent, letters as they are."""
    write_text(spark, path, json.dumps(value, indent=2, ensure_ascii=False))


def write_contents(files: DataFrame, path: str) -> None:
    """Edited files as rows (path, content, ...). Those without content are withheld and stay out."""
    files.where("content is not null").write.parquet(path)


def salt(spark: SparkSession, folder: str) -> DataFrame:
    """One row with the folder's salt; a new one is made where there is none. Two that start at once use the same."""
    path = f"{folder.rstrip('/')}/salt.txt"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        try:
            write_text(spark, path, secrets.token_hex(16))
        except Exception as error:
            if "FileAlreadyExists" not in str(error):
                raise
    stream = fs.open(p)
    try:
        return salt_frame(spark, bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode().strip())
    finally:
        stream.close()
