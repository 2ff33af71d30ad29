"""Matroska media columns: packet tables, payloads and a lossless writer of 8-bit PCM.

The parser reads variable-length EBML elements (unknown sizes included),
segment information, tracks, clusters, simple blocks and block groups with
no, Xiph, fixed-size or EBML lacing, and cues. A packet is a frame of a block:
its track, its time in nanoseconds, and the byte range of its data in the
file. Frames of a laced block after the first get the time of the frames
before them, by the track's default duration.

Nulls and empty values are files without packets; bytes that are not Matroska
give no packets and an error text instead of an exception. Numbers that don't
fit into the table's 64 bits are null there. Files and texts of any length are
read whole. Repeated rows are parsed each. Empty tables give empty results. Only
the columns that are named are read; a key with the name of an output column
keeps it, and the output's gets an underscore.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, map_columns, table, text_or_empty

# Element identifiers of the Matroska format.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
NO_LACING, XIPH_LACING, FIXED_LACING, EBML_LACING = 0, 1, 2, 3
TOP_LEVEL = frozenset((INFO, TRACKS, CLUSTER, CUES))

FRAME_BYTES, BLOCK_FRAMES, CLUSTER_BLOCKS, SAMPLES_PER_MS = 512, 8, 8, 8


# --- reading ---------------------------------------------------------------


def read_id(data: bytes, at: int) -> tuple[int, int]:
    """An element's identifier, its length marker kept, and where it ends."""
    if at >= len(data) or data[at] == 0:
        raise ValueError(f"no element identifier at byte {at}")
    n = 9 - data[at].bit_length()
    if n > 4 or at + n > len(data):
        raise ValueError(f"a broken element identifier at byte {at}")
    return int.from_bytes(data[at : at + n], "big"), at + n


def read_size(data: bytes, at: int) -> tuple[int | None, int]:
    """A variable-length integer and where it ends; None for the reserved value of unknown sizes."""
    if at >= len(data) or data[at] == 0:
        raise ValueError(f"no size at byte {at}")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise ValueError(f"a broken size at byte {at}")
    mask = (1 << 7 * n) - 1
    value = int.from_bytes(data[at : at + n], "big") & mask
    return (None if value == mask else value), at + n


@dataclass
class Track:
    number: int = 0
    kind: int = 0
    codec: str = ""
    rate: float = 0.0
    channels: int = 1
    bits: int = 0
    default_ns: int = 0


@dataclass
class Media:
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, Track] = field(default_factory=dict)
    clusters: list[tuple[int, int]] = field(default_factory=list)
    #: (track, time in ns, first byte, bytes, key frame, position in the lace)
    packets: list[tuple[int, int, int, int, bool, int]] = field(default_factory=list)
    #: (time in ns, track, first byte of the cluster)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    lacings: set[int] = field(default_factory=set)
    error: str | None = None


def elements(data: bytes, at: int, end: int, stop: frozenset[int] = frozenset()) -> Iterator[tuple[int, int, int]]:
    """(identifier, first byte of the content, end) of each element. One of unknown size ends before an identifier in stop."""
    while at < end:
        kind, at = read_id(data, at)
        size, at = read_size(data, at)
        if size is None:
            until = end if kind == SEGMENT else _end_of_unknown(data, at, end, stop)
        else:
            until = at + size
        if until > end:
            raise ValueError(f"an element at byte {at} runs past its parent")
        yield kind, at, until
        at = until


def _end_of_unknown(data: bytes, at: int, end: int, stop: frozenset[int]) -> int:
    while at < end:
        kind, content = read_id(data, at)
        if kind in stop:
            return at
        size, content = read_size(data, content)
        if size is None:
            raise ValueError(f"unknown sizes nest at byte {at}")
        at = content + size
    return end


def _number(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def _real(data: bytes, at: int, end: int) -> float:
    return struct.unpack(">f" if end - at == 4 else ">d", data[at:end])[0] if end - at in (4, 8) else 0.0


def parse(data: bytes | None) -> Media:
    """Everything that the packet table needs. What was read before an error is kept."""
    media = Media()
    if not data:
        return media
    try:
        for kind, at, end in elements(data, 0, len(data)):
            if kind == SEGMENT:
                _segment(data, at, end, media)
    except ValueError as error:
        media.error = str(error)
    return media


def _segment(data: bytes, start: int, end: int, media: Media) -> None:
    for kind, a, b in elements(data, start, end, TOP_LEVEL):
        if kind == INFO:
            for k, c, d in elements(data, a, b):
                if k == TIMESTAMP_SCALE:
                    media.scale = _number(data, c, d)
                elif k == DURATION:
                    media.duration = _real(data, c, d)
        elif kind == TRACKS:
            for k, c, d in elements(data, a, b):
                if k == TRACK_ENTRY:
                    track = _track(data, c, d)
                    media.tracks[track.number] = track
        elif kind == CLUSTER:
            _cluster(data, a, b, media)
        elif kind == CUES:
            for k, c, d in elements(data, a, b):
                if k == CUE_POINT:
                    _cue(data, c, d, start, media)


def _track(data: bytes, at: int, end: int) -> Track:
    track = Track()
    for k, a, b in elements(data, at, end):
        if k == TRACK_NUMBER:
            track.number = _number(data, a, b)
        elif k == TRACK_TYPE:
            track.kind = _number(data, a, b)
        elif k == CODEC_ID:
            track.codec = data[a:b].decode("ascii", "replace")
        elif k == DEFAULT_DURATION:
            track.default_ns = _number(data, a, b)
        elif k == AUDIO:
            for j, c, d in elements(data, a, b):
                if j == SAMPLING_FREQUENCY:
                    track.rate = _real(data, c, d)
                elif j == CHANNELS:
                    track.channels = _number(data, c, d)
                elif j == BIT_DEPTH:
                    track.bits = _number(data, c, d)
    return track


def _cue(data: bytes, at: int, end: int, segment: int, media: Media) -> None:
    time, places = 0, []
    for k, a, b in elements(data, at, end):
        if k == CUE_TIME:
            time = _number(data, a, b)
        elif k == CUE_TRACK_POSITIONS:
            inner = {j: _number(data, c, d) for j, c, d in elements(data, a, b)}
            places.append((inner.get(CUE_TRACK, 0), segment + inner.get(CUE_CLUSTER_POSITION, 0)))
    media.cues += [(time * media.scale, track, place) for track, place in places]


def _cluster(data: bytes, at: int, end: int, media: Media) -> None:
    time = 0
    media.clusters.append((at, end))
    for k, a, b in elements(data, at, end):
        if k == TIMESTAMP:
            time = _number(data, a, b)
        elif k == SIMPLE_BLOCK:
            _block(data, a, b, time, None, media)
        elif k == BLOCK_GROUP:
            inner = [(j, c, d) for j, c, d in elements(data, a, b)]
            refers = any(j == REFERENCE_BLOCK for j, _, _ in inner)
            for j, c, d in inner:
                if j == BLOCK:
                    _block(data, c, d, time, not refers, media)


def _block(data: bytes, at: int, end: int, cluster_time: int, key: bool | None, media: Media) -> None:
    number, at = read_size(data, at)
    if at + 3 > end:
        raise ValueError(f"a block at byte {at} has no header")
    offset, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing = flags >> 1 & 3
    media.lacings.add(lacing)
    if key is None:
        key = bool(flags & 0x80)
    lengths, at = _lace(data, at, end, lacing)
    time = (cluster_time + offset) * media.scale
    track = media.tracks.get(number or 0)
    step = track.default_ns if track else 0
    for i, n in enumerate(lengths):
        media.packets.append((number or 0, time + i * step, at, n, key, i))
        at += n


def _lace(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """The lengths of a block's frames and where the first begins."""
    if lacing == NO_LACING:
        return [end - at], at
    if at >= end:
        raise ValueError(f"a laced block at byte {at} has no frame count")
    n, at = data[at] + 1, at + 1
    if lacing == FIXED_LACING:
        if (end - at) % n:
            raise ValueError(f"the lace at byte {at} does not divide into {n} frames")
        return [(end - at) // n] * n, at
    lengths: list[int] = []
    for i in range(n - 1):
        if lacing == XIPH_LACING:
            total = 0
            while True:
                if at >= end:
                    raise ValueError("a lace runs past its block")
                total, at = total + data[at], at + 1
                if data[at - 1] != 255:
                    break
            lengths.append(total)
        else:
            first = at
            value, at = read_size(data, at)
            if value is None:
                value = (1 << 7 * (at - first)) - 1
            lengths.append(value if i == 0 else lengths[-1] + value - ((1 << 7 * (at - first) - 1) - 1))
    rest = end - at - sum(lengths)
    if rest < 0 or any(x < 0 for x in lengths):
        raise ValueError("a lace runs past its block")
    return [*lengths, rest], at


def payload(data: bytes, media: Media, track: int | None = None) -> bytes:
    """The data of a track's packets (of all, by default), in file order."""
    return b"".join([data[at : at + n] for number, _, at, n, _, _ in media.packets if track is None or number == track])


# --- writing ---------------------------------------------------------------


def size_bytes(value: int, length: int = 0) -> bytes:
    """A variable-length integer; the all-ones value of each length stays free for unknown sizes."""
    n = length or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(kind: int, content: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + size_bytes(len(content)) + content


def uint(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


_HEADER = element(
    EBML,
    uint(EBML_VERSION, 1) + uint(EBML_READ_VERSION, 1) + uint(EBML_MAX_ID, 4) + uint(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_TYPE_VERSION, 4) + uint(DOC_TYPE_READ_VERSION, 2),
)
_TRACKS = element(
    TRACKS,
    element(
        TRACK_ENTRY,
        uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT")
        + uint(DEFAULT_DURATION, FRAME_BYTES // SAMPLES_PER_MS * 1_000_000)
        + element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", 1000.0 * SAMPLES_PER_MS)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8)),
    ),
)


def lace_header(lengths: list[int], lacing: int) -> bytes:
    """What stands between a block's flags and its frames."""
    if lacing == NO_LACING:
        return b""
    out = bytes([len(lengths) - 1])
    if lacing == XIPH_LACING:
        return out + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in lengths[:-1])
    if lacing == EBML_LACING:
        out += size_bytes(lengths[0])
        for before, n in zip(lengths, lengths[1:-1], strict=False):
            d = n - before
            size = next(k for k in range(1, 9) if abs(d) < (1 << 7 * k - 1) - 1)
            out += size_bytes(d + (1 << 7 * size - 1) - 1, size)
    return out


def write_pcm(samples: bytes) -> bytes:
    """A file with the samples (8 bits, mono, 8 kHz) as its one track. Full blocks use fixed-size lacing, others EBML or Xiph lacing by turns, single frames none."""
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, b"maskwright") + element(WRITING_APP, b"maskwright") + element(DURATION, struct.pack(">d", len(samples) / SAMPLES_PER_MS)))
    parts, cues, size = [info, _TRACKS], [], len(info) + len(_TRACKS)
    block_bytes = FRAME_BYTES * BLOCK_FRAMES
    cluster_bytes = block_bytes * CLUSTER_BLOCKS
    for number, start in enumerate(range(0, len(samples), cluster_bytes)):
        time = start // SAMPLES_PER_MS
        content = [uint(TIMESTAMP, time)]
        for at in range(start, min(start + cluster_bytes, len(samples)), block_bytes):
            data = samples[at : at + block_bytes]
            lengths = [min(FRAME_BYTES, len(data) - i) for i in range(0, len(data), FRAME_BYTES)]
            lacing = NO_LACING if len(lengths) == 1 else FIXED_LACING if lengths[0] == lengths[-1] else (EBML_LACING, XIPH_LACING)[number % 2]
            content.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", at // SAMPLES_PER_MS - time, 0x80 | lacing << 1) + lace_header(lengths, lacing) + data))
        cues.append(element(CUE_POINT, uint(CUE_TIME, time) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, size))))
        parts.append(element(CLUSTER, b"".join(content)))
        size += len(parts[-1])
    parts.append(element(CUES, b"".join(cues)))
    return _HEADER + element(SEGMENT, b"".join(parts))


def padded(text: str, unit: int = 64) -> bytes:
    """The text in UTF-8 with bytes 0 up to a positive multiple of unit."""
    data = text.encode("utf-8", "surrogatepass")
    return data.ljust(max(unit, -(-len(data) // unit) * unit), b"\0")


def feature(media: Media, samples: bytes) -> str:
    """What a media table shows of a file: its packets, clusters, cues and length, and the level and zero crossings of its samples."""
    wave = np.frombuffer(samples, np.uint8).astype(np.int16) - 128
    crossings = int(np.count_nonzero((wave[1:] < 0) != (wave[:-1] < 0)))
    total = int(wave.sum())
    power = int((wave.astype(np.int64) ** 2).sum())
    track = next(iter(media.tracks.values()), Track())
    return f"{track.codec};packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};lacings={''.join(map(str, sorted(media.lacings)))};ms={media.duration:.0f};sum={total};power={power};crossings={crossings}"


# --- operators -------------------------------------------------------------

PACKETS = "track long, timestamp_ns long, byte_from long, byte_count long, is_key boolean, lace_index int"


def _after(key: str, kind: T.DataType, ddl: str) -> T.StructType:
    """The key, then the columns, none of which has the key's name."""
    fields = T.StructType.fromDDL(ddl).fields
    return T.StructType([T.StructField(key, kind), *(T.StructField(free_name(f.name, [key]), f.dataType) for f in fields)])


def _fits(x: int | None) -> int | None:
    return x if x is not None and -(1 << 63) <= x < 1 << 63 else None


def packet_table(files: DataFrame, key: str, content: str) -> DataFrame:
    """A row for each packet of each file: the key, its number in the file, and where and when it is. Files without packets have no rows."""
    schema = _after(key, files.schema[key].dataType, f"packet long, {PACKETS}")
    number, *names = schema.names[1:]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for i, data in enumerate(batch[1]):
                found = parse(data.as_py()).packets
                if found:
                    own = batch[0].take(pa.array([i] * len(found)))
                    yield {key: own, number: list(range(len(found))), **{n: list(map(_fits, x)) for n, x in zip(names, zip(*found, strict=True), strict=True)}}

    return map_columns(files.select(F.col(key).alias("key"), F.col(content).alias("content")), rows, schema)


def store_as_media(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Every text as a file: (key, content). Null and empty texts are 64 samples of 0."""
    schema = _after(key, texts.schema[key].dataType, "content binary")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield {key: batch[0], schema.names[1]: [write_pcm(padded(t or "")) for t in batch[1].to_pylist()]}

    return map_columns(texts.select(F.col(key).alias("key"), F.col(text).alias("text")), rows, schema)


DIGESTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digests(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Stores every text as a file, reads the file back through its packets, and describes both. A null text counts as an empty one."""
    schema = _after(key, texts.schema[key].dataType, DIGESTS)

    def describe(t: str | None) -> tuple[int, int, str, int, int, str, str]:
        stored = write_pcm(padded(t or ""))
        media = parse(stored)
        back = payload(stored, media)
        return len((t or "").encode("utf-8", "surrogatepass")), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(media, back)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        names = schema.names[1:]
        for batch in batches:
            found = list(map(describe, batch[1].to_pylist()))
            yield {key: batch[0], **dict(zip(names, map(list, zip(*found, strict=True)) if found else [[]] * len(names), strict=True))}

    return map_columns(texts.select(F.col(key).alias("key"), F.col(text).alias("text")), rows, schema)


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a Matroska file and described by what reads back from it."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return media_digests(docs.select("doc_id", text_or_empty("text").alias("text")), "doc_id", "text")
