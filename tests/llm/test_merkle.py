import hashlib
import random
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskwright.llm import merkle
from maskwright.llm.common import ranked

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(data):
    return hashlib.sha256(data).hexdigest()


def levels(nodes):
    out = [list(nodes)]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 16]).encode()) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(levels_, at):
    """(node's place, run) level by level, straight from whole levels."""
    for nodes in levels_[:-1]:
        begin = at // 16 * 16
        yield at - begin, nodes[begin : begin + 16]
        at //= 16


def brute_force(docs):
    """{(doc_id, leaf): row} of (doc_id, text, lang, source, n_chars) rows, from whole levels in memory."""
    value = lambda v: b"-" if v is None else str(len(str(v).encode())).encode() + b":" + str(v).encode()
    leaf = lambda i, t, lang, s, n: digest(b"".join(map(value, (i, s, lang, n, t))))
    folded = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    by = {}
    for d in docs:
        by.setdefault(d[3], []).append((d[0] is not None, d[0] or 0, leaf(*d), d))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels(x[2] for x in sorted(by[s], key=lambda x: x[:3])) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for at, s in enumerate(sources):
        for place, (_, _, own, (i, t, lang, _, n)) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            claimed = leaf(i, t and t.translate(folded), lang, s, n) if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else own
            path = [*siblings(trees[s], place), *siblings(top, at)]
            root = claimed
            for a, run in path:
                root = digest("".join([*run[:a], root, *run[a + 1 :]]).encode())
            proof = digest("".join(x for a, run in path for x in run[:a] + run[a + 1 :]).encode())
            out.append((i, own, trees[s][-1][0], top[-1][0], proof, root, root == top[-1][0]))
    return out


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.integers(1, 70), st.sampled_from([255, 256, 257, 300, 4095, 4096])))
def test_traversal_gives_every_path_of_a_block(n):
    leaves = [digest(str(i).encode()).encode() for i in range(n)]
    whole = levels(x.decode() for x in leaves)
    paths = list(merkle.traversed(leaves, merkle.height_of(n, 0)))
    assert len(paths) == n
    for i in {0, n // 3, n // 2, n - 1}:
        assert [(a, [x.decode() for x in run]) for a, run in paths[i]] == list(siblings(whole, i))
        assert merkle.folded(leaves[i], paths[i]).decode() == whole[-1][0]


def test_a_traversal_holds_few_nodes():
    tree = merkle.Treehash(3)
    for i in range(4095):
        tree.add(str(i).encode())
        assert sum(map(len, tree.waiting)) <= 45


def rows(n=700):
    random.seed(3)
    docs = [(i, f"Text {random.random()}", "en", random.choice(["b", "a", "é", "Z", None, "a", "a"]), i % 9) for i in range(n)]
    docs += [(None, None, None, None, None), (None, "NULL id", "en", "a", 1), (7, docs[7][1], "en", docs[7][3], 7), (8, "again, ANOTHER text", "fr", "a", 2), (2000, "", "en", "only", 0), (2001, "Long " * 100_000, "en", "a", 5)]
    return docs + [(5 * i, None, "en", "empty", 0) for i in range(20)]


def test_query_is_the_definition(spark, tmp_path):
    docs = rows()
    spark.createDataFrame(docs, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in merkle.op11_merkle(spark, str(tmp_path)).collect()]
    want = brute_force(docs)
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert any(not r[-1] for r in got)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, con.sql(merkle.OP11_SQL).fetchall()), key=key) == sorted(want, key=key)


def test_a_source_of_many_blocks_meets_in_upper_tiers(spark):
    """Over 2 * 4096 leaves of one source, the last block of one leaf; every path is folded to the root."""
    n = 2 * merkle.BLOCK + 1
    frame = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("one").alias("source"), F.lit(1).alias("grp"), F.lit(2).alias("rank"))
    tree = merkle.merkle_tree(frame, F.col("doc_id"), F.col("source"), merkle.leaf(F.col("doc_id")))
    whole = levels(digest(f"{len(str(i))}:{i}".encode()) for i in range(n))
    assert tree.root == whole[-1][0]
    assert [tuple(r) for r in tree.manifest().collect()] == [("=one", n, whole[-1][0])]
    got = {r.key: r for r in tree.proofs(paths=True).collect()}
    assert len(got) == n
    assert {r.folded_root for r in got.values()} == {tree.root}
    for i in (0, 4095, 4096, n - 1):
        assert [(x["at"], [d.hex() for d in x["run"]]) for x in got[i].path] == list(siblings(whole, i))


def test_an_empty_table_has_no_rows(spark):
    tree = merkle.merkle_tree(spark.createDataFrame([], SCHEMA), F.col("doc_id"), F.col("source"), merkle.leaf(F.col("text")))
    assert tree.root == digest(b"")
    assert tree.proofs().count() == 0


@pytest.mark.parametrize("group", ["x", None])
def test_ranks_over_partitions(spark, group):
    """Equal rows in hot groups, which ranges divide, are numbered without gaps."""
    frame = spark.range(3000).select(F.coalesce(F.when(F.col("id") % 3 == 0, F.lit(group)), F.lit("")).alias("g"), F.lit(1).alias("o")).union(spark.range(50).select(F.concat(F.lit("h"), F.col("id") % 7), F.col("id").cast("int"))).repartition(6)
    got = ranked(frame, "g", ["o"], "test").groupBy("g").agg(F.count("*").alias("n"), F.count_distinct("rank").alias("d"), F.max("rank").alias("m"), F.min("rank").alias("z")).collect()
    assert len(got) == (9 if group else 8)
    assert all((r.n, r.m, r.z) == (r.d, r.n - 1, 0) for r in got)
