import base64
import hashlib

import pytest

from maskwright.llm import warc_index as W
from maskwright.llm.common import mounted, shared_path


def test_keys_reverse_hosts():
    assert W.url_key("https://www.B.Example.org:443/P?q#f") == "org,example,b)/P?q"
    assert W.url_key("http://example.org:8080") == "org,example:8080)"
    assert W.url_key(None) == W.url_key("") == ")"
    assert W.url_key("http://a/x y\n") == "a)/x%20y%0A"


def test_records_read_back():
    for payload in (b"", b"x" * 70_000, "é\r\n\r\n".encode()):
        r = W.parse_record(W.record(7, "http://a/\n", payload, None, False))
        assert (r.page_id, r.body, r.refers_to, r.headers["WARC-Type"]) == (7, payload, None, "response")
        r = W.parse_record(W.record(None, None, payload, -3, True))
        assert (r.page_id, r.body, r.refers_to, r.headers["WARC-Type"]) == (None, b"", -3, "revisit")
        assert int(r.headers["Payload-Length"]) == len(payload)
    with pytest.raises(ValueError, match="length"):
        import zlib

        packer = zlib.compressobj(4, zlib.DEFLATED, 31)
        W.parse_record(packer.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nx\r\n\r\n") + packer.flush())


ROWS = [(5, "http://a.example/x", "same"), (2, "http://b.example/y", "same"), (9, "http://a.example/x", "same"), (3, "http://a.example/x#1", "other"), (4, None, None), (6, "", ""), (7, "http://c/", "é" * 9000), (2, "http://b.example/y", "same"), (8, "http://a.example/x", "lone"), (None, "http://n/", "same"), (-1, "http://z/", "neg")]


def expected(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        f = first.get(h or "")
        revisit = f is not None and i != f
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(map(str, out))


def test_every_page_is_found_again(spark):
    pages = spark.createDataFrame([(*r, "k", 1) for r in ROWS], "page_id long, url string, html string, key string, length int")
    assert sorted(str(tuple(r)) for r in W.archive_and_find(pages).collect()) == expected(ROWS)
    assert W.archive_and_find(pages.where("false")).count() == 0


@pytest.mark.parametrize("per_block", [1, 2, 3000])
def test_directory_and_blocks(spark, per_block):
    rows = [(i, f"http://h{i % 5}.example/{i % 7}", f"<p>{i}</p>") for i in range(60)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives, index = shared_path(spark, "warc"), shared_path(spark, "cdx")
    lines = W.write_archives(pages, archives)
    directory = W.build_index(lines, index, lines_per_block=per_block)
    assert directory == sorted(directory)
    if per_block == 1:
        assert len(directory) == 120
    found = W.CaptureIndex(directory, index, archives)
    for i, u, h in rows[:60]:
        records = found.captures(W.block_key(W.url_key(u), i))
        assert [(r.page_id, r.body.decode()) for r in records] == [(i, h)] * 2
    assert found.captures(W.block_key("none)", 1)) == []
    found.close()
    limited = W.build_index(lines, shared_path(spark, "cdx"), lines_per_block=1, max_blocks=10)
    assert len(limited) <= 10 + spark.sparkContext.defaultParallelism


def test_least_bytes_and_order_of_keys(spark):
    pages = spark.createDataFrame([(1, "http://a/", "x"), (2, "http://a/", "x")], "page_id long, url string, html string")
    assert {r.record_type for r in W.archive_and_find(pages, least_bytes=2).collect()} == {"response"}
    ids = [None, -5, 0, 3, 2**62]
    frame = spark.createDataFrame([("k)", i) for i in ids], "key string, page_id long").select(W.line_order().alias("o"))
    assert sorted(r.o for r in frame.collect()) == sorted(W.block_key("k)", i) for i in ids)
    assert W.block_key("k)", None) > W.block_key("k)", 2**62)


def test_the_shared_folder_must_be_mounted():
    assert mounted("file:///a/b") == mounted("file:/a/b") == mounted("/a/b") == "/a/b"
    with pytest.raises(ValueError, match="mount"):
        mounted("hdfs://n/a")


def test_many_holders_give_the_same_records(spark):
    rows = [(i, f"http://h{i % 3}.example/{i}", "same" if i % 2 else f"page {i // 8}") for i in range(60)] + [(None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")

    def kinds(broadcast_rows):
        archives, index = W.shared_path(spark, "warc"), W.shared_path(spark, "cdx")
        lines = W.write_archives(pages, archives, broadcast_rows=broadcast_rows)
        found = W.look_up(pages.select("url", "page_id"), W.build_index(lines, index), index, archives, 3)
        return sorted(((r.page_id is not None, r.page_id), r.record_type, r.refers_to or -1) for r in found.collect())

    got = kinds(200_000)
    assert got == kinds(0) == kinds(3)
    assert len(got) == len(rows)
