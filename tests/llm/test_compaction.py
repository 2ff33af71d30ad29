import pytest

from maskwright.llm.compaction import OP7_SQL, Conflict, Manifest, Shard, ShardTable, op7_compaction


@pytest.fixture
def table(spark, tmp_path):
    return ShardTable(spark, f"file://{tmp_path}/t", target_bytes=40_000, smallest_bytes=500, tier_factor=4, min_run=3)


def rows(spark, a, b, parts=1):
    return spark.range(a, b, 1, parts).selectExpr("id", "cast(id as string) text", "if(id % 3 = 0, null, 'x') version")


def test_arrivals_compaction_and_versions(spark, table):
    for i in range(8):
        table.append(rows(spark, i * 50, i * 50 + 50))
    before = table.manifest()
    assert (before.version, before.rows, len(before.shards)) == (8, 400, 8)
    after = table.compact()
    assert after.version > 8
    assert after.rows == 400
    assert len(after.shards) < 8
    assert not table.due(after) or len(after.shards) <= 3
    assert sorted(r.id for r in table.read().collect()) == list(range(400))
    assert sorted(r.id for r in table.read(3).collect()) == list(range(150))
    assert table.vacuum() > 0
    assert table.versions() == [after.version]
    assert table.read().count() == 400
    assert table.read().where("version is null").count() == 134


def test_tiers_merge_only_similar_sizes(table):
    shard = lambda name, size: Shard(name, size, 1, 1)
    runs = table.due(Manifest(1, (shard("a", 400), shard("b", 450), shard("c", 100), shard("d", 9000), shard("e", 60_000), shard("f", 70_000), shard("g", 80_000))))
    assert [[s.path for s in r] for r in runs] == [["a", "b", "c"]]
    assert [table.tier(shard("x", n)) for n in (1, 499, 500, 1999, 2000, 8000)] == [0, 0, 1, 1, 2, 3]


def test_a_version_is_committed_once(spark, table):
    table.append(rows(spark, 0, 5))
    with pytest.raises(Conflict):
        table.commit(Manifest(1, (), None))
    assert table.read().count() == 5


def test_writes_that_were_never_committed_do_not_count(spark, table):
    table.append(rows(spark, 0, 5))
    table._written(rows(spark, 5, 9), 2)
    assert table.read().count() == 5
    assert table.vacuum() == 1 or table.read().count() == 5
    assert table.read().count() == 5


def test_empty_arrivals_nulls_repeats_and_other_columns(spark, table):
    with pytest.raises(ValueError, match="nothing"):
        table.read()
    table.append(rows(spark, 0, 0))
    assert table.read().count() == 0
    again = spark.createDataFrame([(None, None, None), (1, "a", None), (1, "a", None)], "id long, text string, version string")
    table.append(again.selectExpr("id", "text", "version"))
    assert table.read().count() == 3
    with pytest.raises(ValueError, match="columns"):
        table.append(spark.range(1))
    assert table.compact().rows == 3


def test_query_returns_every_document(spark, tmp_path):
    import duckdb

    docs = [(i, None if i % 7 == 0 else f"text {i} é", "en", "s") for i in range(40)] + [(None, "no id", None, None), (3, "text 3 é", "en", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op7_compaction(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(OP7_SQL).fetchall()
    assert sorted(map(str, ((r.doc_id, r.arrival, r.lang, r.source, r.n_bytes, r.text_md5) for r in got.collect()))) == sorted(map(str, want))
