"""WARC archives with revisit records, and a two-level capture index over them.

Every page is a record, compressed on its own. Of pages with equal payloads the
one with the smallest id holds the payload (response); the others say where it
is (revisit). Workers write archives to the shared folder and give an index
line for every record: its key (the URL with its host reversed, then the id)
and where the record stands.

The index has two levels. Lines are sorted by key over all workers and stored
in compressed blocks; a sparse directory has the first key and the place of
each block. A lookup searches the directory, then the block, and then reads the
record's own bytes. The directory goes to every worker: lines_per_block grows
with the corpus, so it never has more than max_blocks entries.

Nulls: a null html is an empty payload, a null url an empty key, and a null id
stands after all others. Pages with one id and one payload tie and are all
responses. Repeated rows are written and found each. Pages of any length are
whole records. Only the id, url and html are read, so other columns can't clash.
Empty tables give no records. A task that is run again writes new files; the index names only those
of runs that counted.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import os
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mounted, shared_path, table, written

VERSION = b"WARC/1.1"
DATE = "2020-01-01T00:00:00Z"
CDX = "key string, page_id long, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """The URL with its host's labels reversed, so that a host's subdomains stand beside it; without scheme, www. and fragment. White space and control characters are escaped."""
    if not url:
        return ")"
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url).partition("#")[0]
    host, slash, path = re.match(r"([^/?]*)(/?)(.*)", rest, re.S).groups()
    host, _, port = host.rpartition("@")[2].lower().partition(":")
    labels = host.removeprefix("www.").split(".")
    key = ",".join(reversed(labels)) + (f":{port}" if port and port not in ("80", "443") else "") + ")" + slash + path
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", key)


def block_key(key: str, page_id: int | None) -> str:
    """What lines are sorted by: the key, then the id. Python orders strings as Spark does, by code points."""
    return f"{key} {'~' if page_id is None else format(page_id + (1 << 63), '020d')}"


# --- records ---------------------------------------------------------------


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One record as a gzip member. A revisit has the digest and the length of its payload, but not the payload."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        f"Payload-Length: {len(payload)}",
    ]
    if is_revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = b"" if is_revisit else payload
    head += ["Content-Type: text/html;charset=utf-8", f"Content-Length: {len(body)}"]
    raw = VERSION + b"\r\n" + "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    body: bytes

    @property
    def page_id(self) -> int | None:
        return _page(self.headers["WARC-Record-ID"])

    @property
    def refers_to(self) -> int | None:
        return _page(self.headers["WARC-Refers-To"]) if "WARC-Refers-To" in self.headers else None


def _page(name: str) -> int | None:
    return int(name[10:-1]) if name[10:-1] else None


def parse_record(member: bytes) -> Record:
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0].encode() != VERSION:
        raise ValueError("no WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    size = int(headers["Content-Length"])
    if len(rest) != size + 4:
        raise ValueError("a record's length is not what it says")
    return Record(headers, rest[:size])


# --- writing ---------------------------------------------------------------


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html", broadcast_rows: int = 200_000) -> DataFrame:
    """Writes a record per page into folder; returns the index lines, written to the shared folder.

    Payloads of under least_bytes are all responses. Only digests and ids are
    aggregated. First holders of repeated payloads go to every task while they
    are at most broadcast_rows, so pages stay where they are; of more, the most
    common ones do (fewer than a thousand), and the other pages meet theirs in a
    join in which no digest is common.
    """
    spark = pages.sparkSession
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    own = own.withColumn("digest", F.sha1(F.encode("html", "utf-8")))
    counted = own.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    holders = written(counted.where("n > 1"), "holders")
    size = holders.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("pages")).first()
    columns = ("page_id", "url", "html", "first")
    if size["rows"] <= broadcast_rows:
        marked = own.join(F.broadcast(holders.select("digest", "first")), "digest", "left").select(*columns)
    else:
        common = F.col("n") > size["pages"] // 1000
        most = F.broadcast(holders.where(common).select("digest", "first"))
        rest = own.join(most.select("digest"), "digest", "left_anti").join(holders.where(~common).select("digest", "first"), "digest", "left")
        marked = own.join(most, "digest").select(*columns).union(rest.select(*columns))
    place = mounted(folder)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = f"pages-{uuid.uuid4().hex}.warc.gz"
        file, at = None, 0
        try:
            for batch in batches:
                lines = []
                for pid, u, text, first in zip(batch["page_id"], batch["url"], batch["html"], batch["first"], strict=True):
                    pid, first = (None if pd.isna(x) else int(x) for x in (pid, first))
                    payload = text.encode("utf-8", "surrogatepass")
                    revisit = first is not None and pid != first and len(payload) >= least_bytes
                    member = record(pid, u, payload, first, revisit)
                    if file is None:
                        os.makedirs(place, exist_ok=True)
                        file = open(os.path.join(place, name), "wb")  # noqa: SIM115
                    file.write(member)
                    lines.append((url_key(u), pid, name, at, len(member)))
                    at += len(member)
                out = pd.DataFrame(lines, columns=["key", "page_id", "file", "offset", "length"])
                out["page_id"] = pd.array([x[1] for x in lines], dtype="Int64")
                yield out
        finally:
            if file is not None:
                file.flush()
                os.fsync(file.fileno())
                file.close()

    return written(marked.mapInPandas(rows, CDX), "cdx-lines")


def line_order() -> Column:
    """The order of lines: `block_key`, as a column."""
    padded = F.lpad((F.col("page_id").cast("decimal(20,0)") + F.expr(f"cast('{1 << 63}' as decimal(20,0))")).cast("decimal(20,0)").cast("string"), 20, "0")
    return F.concat_ws(" ", "key", F.coalesce(padded, F.lit("~")))


def build_index(lines: DataFrame, folder: str, lines_per_block: int = 3000, max_blocks: int = 100_000) -> list[tuple[str, str, int, int]]:
    """Writes the sorted lines as compressed blocks; returns the directory: (first key, file, offset, length), sorted."""
    n = lines.count()
    per_block = max(lines_per_block, -(-n // max_blocks))
    place = mounted(folder)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = f"cdx-{uuid.uuid4().hex}.gz"
        state = {"at": 0, "file": None}

        def flush(block: list[tuple[str, str]]) -> tuple[str, str, int, int]:
            if state["file"] is None:
                os.makedirs(place, exist_ok=True)
                state["file"] = open(os.path.join(place, name), "wb")  # noqa: SIM115
            packed = zlib.compress("\n".join(line for _, line in block).encode("utf-8", "surrogatepass"), 4)
            state["file"].write(packed)
            entry = (block[0][0], name, state["at"], len(packed))
            state["at"] += len(packed)
            return entry

        block: list[tuple[str, str]] = []
        try:
            for batch in batches:
                entries = []
                for order, file, offset, length in zip(batch["order"], batch["file"], batch["offset"], batch["length"], strict=True):
                    block.append((order, f"{order}\t{file}\t{offset}\t{length}"))
                    if len(block) == per_block:
                        entries.append(flush(block))
                        block = []
                yield pd.DataFrame(entries, columns=["first", "file", "offset", "length"])
            if block:
                yield pd.DataFrame([flush(block)], columns=["first", "file", "offset", "length"])
        finally:
            if state["file"] is not None:
                state["file"].flush()
                os.fsync(state["file"].fileno())
                state["file"].close()

    parts = max(1, min(-(-n // per_block), int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ordered = lines.select(line_order().alias("order"), "file", "offset", "length").repartitionByRange(parts, "order", "file", "offset").sortWithinPartitions("order", "file", "offset")
    found = ordered.mapInPandas(rows, "first string, file string, offset long, length long").collect()
    return sorted((r["first"], r["file"], r["offset"], r["length"]) for r in found)


# --- reading ---------------------------------------------------------------


class CaptureIndex:
    """Lookups by binary search: in the directory, in a block, then a range read. Keeps a few blocks and open archives."""

    def __init__(self, directory: list[tuple[str, str, int, int]], index_folder: str, archive_folder: str, blocks: int = 8):
        self.directory, self.firsts = directory, [d[0] for d in directory]
        self.index_folder, self.archive_folder = mounted(index_folder), mounted(archive_folder)
        self.most, self.blocks, self.open = blocks, OrderedDict(), OrderedDict()

    def block(self, number: int) -> list[list[str]]:
        if number not in self.blocks:
            _, file, offset, length = self.directory[number]
            packed = _range(os.path.join(self.index_folder, file), offset, length)
            lines = zlib.decompress(packed).decode("utf-8", "surrogatepass").split("\n")
            self.blocks[number] = [line.split("\t") for line in lines]
            if len(self.blocks) > self.most:
                self.blocks.popitem(last=False)
        self.blocks.move_to_end(number)
        return self.blocks[number]

    def places(self, order: str) -> list[tuple[str, int, int]]:
        """Where the records of this key and id stand. Equal lines may run over several blocks."""
        found: list[tuple[str, int, int]] = []
        number = max(0, bisect.bisect_left(self.firsts, order) - 1)
        while number < len(self.firsts) and self.firsts[number] <= order:
            block = self.block(number)
            at = bisect.bisect_left(block, order, key=lambda line: line[0])
            while at < len(block) and block[at][0] == order:
                found.append((block[at][1], int(block[at][2]), int(block[at][3])))
                at += 1
            number += 1
        return found

    def captures(self, order: str) -> list[Record]:
        return [parse_record(self._member(*place)) for place in self.places(order)]

    def _member(self, file: str, offset: int, length: int) -> bytes:
        if file not in self.open:
            self.open[file] = open(os.path.join(self.archive_folder, file), "rb")  # noqa: SIM115
            if len(self.open) > 64:
                self.open.popitem(last=False)[1].close()
        handle = self.open[file]
        handle.seek(offset)
        return handle.read(length)

    def close(self) -> None:
        for handle in self.open.values():
            handle.close()
        self.open.clear()


def _range(path: str, offset: int, length: int) -> bytes:
    with open(path, "rb") as file:
        file.seek(offset)
        return file.read(length)


FOUND = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType())])


def look_up(wanted: DataFrame, directory: list[tuple[str, str, int, int]], index_folder: str, archive_folder: str, parts: int | None = None) -> DataFrame:
    """The captures of every wanted (url, page_id), read through the index. Requests are sorted as the index is, so a worker unpacks a block once.

    parts: into how many ranges requests are dealt; what is read for them is
    much larger than they are, so their own size should not decide.
    """
    shared = wanted.sparkSession.sparkContext.broadcast(directory)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = CaptureIndex(shared.value, index_folder, archive_folder)
        try:
            for batch in batches:
                out = []
                for order in batch["order"]:
                    for found in index.captures(order):
                        kind, length, digest = found.headers["WARC-Type"], int(found.headers["Payload-Length"]), found.headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and (len(found.body) != length or digest_of(found.body) != digest):
                            raise ValueError(f"the record under {order} is damaged")
                        out.append((found.page_id, length, digest, kind, found.refers_to))
                made = pd.DataFrame(out, columns=FOUND.names)
                for name in ("page_id", "refers_to"):
                    made[name] = pd.array([r[FOUND.names.index(name)] for r in out], dtype="Int64")
                yield made
        finally:
            index.close()

    @F.pandas_udf("string")
    def keys(urls: pd.Series) -> pd.Series:
        return urls.map(url_key, na_action=None)

    asked = wanted.select(keys("url").alias("key"), "page_id").select(line_order().alias("order")).distinct()
    dealt = asked.repartitionByRange(parts, "order") if parts else asked.repartitionByRange("order")
    return dealt.sortWithinPartitions("order").mapInPandas(rows, FOUND)


def archive_and_find(pages: DataFrame, least_bytes: int = 0, part_bytes: int = 8 << 20) -> DataFrame:
    """Writes archives and index, and finds every page again: page_id, payload_bytes, payload_digest, record_type, refers_to. part_bytes: of records that one task reads back."""
    spark = pages.sparkSession
    archives, index = shared_path(spark, "warc"), shared_path(spark, "cdx")
    lines = write_archives(pages, archives, least_bytes)
    directory = build_index(lines, index)
    parts = -(-(lines.agg(F.sum("length")).first()[0] or 1) // part_bytes)
    return look_up(pages.select(F.col("url"), F.col("page_id").cast("long").alias("page_id")), directory, index, archives, parts)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as it reads back from the archives."""
    return archive_and_find(table(spark, sf_dir, "pages", "page_id", "url", "html"))


OP9_SQL = """
with p as (select page_id, coalesce(html, '') html from pages),
d as (select page_id, strlen(html) n, sha1(html) hex from p),
f as (select hex, min(page_id) first from d group by hex),
digits as (select unnest(generate_series(0, 31)) i),
codes as (select hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
  ((strpos('0123456789abcdef', substr(hex, 1 + (i * 5) // 4, 1)) - 1) * 16 + greatest(strpos('0123456789abcdef', substr(hex, 2 + (i * 5) // 4, 1)) - 1, 0))
  // cast(pow(2, 3 - (i * 5) % 4) as integer)) % 32, 1), '' order by i) code
  from f, digits group by hex)
select page_id, n::bigint payload_bytes, code payload_digest, case when page_id = first then 'response' else 'revisit' end record_type,
  case when page_id = first then null else first end refers_to
from d join f using (hex) join codes using (hex)
"""
