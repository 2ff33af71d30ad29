import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from maskwright.llm import matroska as M


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=70_000))
def test_round_trip(data):
    samples = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
    stored = M.write_pcm(samples)
    media = M.parse(stored)
    assert media.error is None
    assert M.payload(stored, media) == samples
    assert media.duration == len(samples) / 8
    assert sum(p[3] for p in media.packets) == len(samples)


def test_times_ranges_and_cues():
    samples = bytes(range(256)) * 400
    stored = M.write_pcm(samples)
    media = M.parse(stored)
    at = 0
    for track, time, a, n, key, _ in media.packets:
        assert (track, key, time) == (1, True, at // 8 * 1_000_000)
        assert stored[a : a + n] == samples[at : at + n]
        at += n
    assert [c[2] for c in media.cues] == [a - len(M.CLUSTER.to_bytes(4, "big")) - len(M.size_bytes(b - a)) for a, b in media.clusters]
    assert [c[0] for c in media.cues] == [i * 8 * 8 * 512 // 8 * 1_000_000 for i in range(len(media.clusters))]
    assert media.tracks[1].codec == "A_PCM/INT/LIT"


@pytest.mark.parametrize("lacing", [M.NO_LACING, M.XIPH_LACING, M.FIXED_LACING, M.EBML_LACING])
def test_lacings_in_blocks_and_groups(lacing):
    frames = [b"a" * 300] if lacing == M.NO_LACING else [b"a" * 300, b"b" * 300, b"c" * 300] if lacing == M.FIXED_LACING else [b"a" * 300, b"b" * 5, b"c" * 7000, b"d"]
    body = b"\x82" + struct.pack(">hB", -3, lacing << 1) + M.lace_header([len(f) for f in frames], lacing) + b"".join(frames)
    group = M.element(M.BLOCK_GROUP, M.element(M.BLOCK, body))
    after = M.element(M.BLOCK_GROUP, M.element(M.REFERENCE_BLOCK, b"\x01") + M.element(M.BLOCK, body))
    tracks = M.element(M.TRACKS, M.element(M.TRACK_ENTRY, M.uint(M.TRACK_NUMBER, 2) + M.uint(M.DEFAULT_DURATION, 500)))
    cluster = M.element(M.CLUSTER, M.uint(M.TIMESTAMP, 10) + M.element(M.SIMPLE_BLOCK, body) + group + after)
    data = M.element(M.SEGMENT, tracks + cluster)
    media = M.parse(data)
    assert media.error is None
    assert [data[a : a + n] for _, _, a, n, _, _ in media.packets] == frames * 3
    assert [p[1] for p in media.packets] == [7_000_000 + i * 500 for i in range(len(frames))] * 3
    assert [p[4] for p in media.packets] == [False] * len(frames) + [True] * len(frames) + [False] * len(frames)


def test_unknown_sizes():
    body = b"\x81" + struct.pack(">hB", 0, 0x80) + b"frame"
    cluster = M.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + M.uint(M.TIMESTAMP, 4) + M.element(M.SIMPLE_BLOCK, body)
    data = M.SEGMENT.to_bytes(4, "big") + b"\xff" + cluster + cluster + M.element(M.CUES, b"")
    media = M.parse(data)
    assert media.error is None
    assert [data[a : a + n] for _, _, a, n, _, _ in media.packets] == [b"frame"] * 2


@pytest.mark.parametrize("data", [None, b"", b"\0\0", b"\x1a\x45", b"not a file", M.write_pcm(b"x" * 640)[:-100]])
def test_broken_files_do_not_raise(data):
    media = M.parse(data)
    assert (media.error is None) == (not data)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=300))
def test_any_bytes_do_not_raise(data):
    M.parse(data)
    M.parse(M.write_pcm(b"y" * 128)[:40] + data)


def test_digests_and_packet_table(spark):
    texts = [(1, "hello"), (2, ""), (3, None), (4, "é" * 32), (5, "x" * 20_000), (1, "hello")]
    docs = spark.createDataFrame([(i, t, "f") for i, t in texts], "doc_id long, text string, feature string")
    got = sorted(M.media_digests(docs, "doc_id", "text").collect())
    for row, (_, text) in zip(got, sorted(texts, key=lambda x: (x[0], x[1] or "")), strict=True):
        raw = (text or "").encode()
        pad = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (row.n_bytes, row.payload_bytes) == (len(raw), len(pad))
        assert row.payload_sha256 == hashlib.sha256(pad).hexdigest()
        assert row.tail_crc32 == zlib.crc32(pad[-64:])
    assert got[0] == got[1]
    files = M.store_as_media(docs, "doc_id", "text")
    table = M.packet_table(files, "doc_id", "content")
    assert {r.doc_id: r.n for r in table.groupBy("doc_id").agg({"byte_count": "sum"}).toDF("doc_id", "n").collect()}[5] == 20_032
    assert M.media_digests(docs.where("false"), "doc_id", "text").count() == 0


def test_packet_table_of_odd_files(spark):
    """Numbers over 64 bits are null, keys may have the names of results, nulls and empty tables have no packets."""
    block = M.element(M.SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", 0, 0x80) + b"data")
    odd = M._HEADER + M.element(M.SEGMENT, M.element(M.CLUSTER, M.element(M.TIMESTAMP, b"\xff" * 8) + block))
    assert len(M.parse(odd).packets) == 1
    files = spark.createDataFrame([(1, bytearray(odd), "x"), (2, bytearray(M.write_pcm(M.padded("w" * 300_000))), "x"), (3, None, "x"), (4, bytearray(b""), "x")], "track long, content binary, packet string")
    table = M.packet_table(files, "track", "content")
    assert table.columns[:3] == ["track", "packet", "track_"]
    rows = table.collect()
    assert {r.track for r in rows} == {1, 2}
    assert [r.timestamp_ns for r in rows if r.track == 1] == [None]
    assert sum(r.byte_count for r in rows if r.track == 2) == len(M.padded("w" * 300_000))
    assert M.packet_table(files.where("false"), "track", "content").count() == 0
    assert M.media_digests(files, "track", "packet").columns[0] == "track"
