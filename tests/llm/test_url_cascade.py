import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import url_cascade as U

URLS = [
    (1, "https://a.Example.COM/en/1?x#y", "a.example.com", "/en/1", "com/en/", "block"),
    (2, "http://example.com/en/77", "example.com", "/en/77", "example.com/en/7", "allow"),
    (3, "http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
    (4, "http://x.example.net/de/8", "x.example.net", "/de/8", "example.net/de/8", "block"),
    (5, "http://x.net/de/", "x.net", "/de/", "net/de/", "allow"),
    (6, "http://spam-farm.example.org/fr/1", "spam-farm.example.org", "/fr/1", None, "block"),
    (7, "http://www.cheap-pills.example.com?q=/en/", "www.cheap-pills.example.com", "", None, "block"),
    (8, "no scheme/en/", "", "", None, "allow"),
    (9, None, "", "", None, "allow"),
    (10, "://", "", "", None, "allow"),
    (11, "ftp://org/es/#f", "org", "/es/", "org/es/", "block"),
    (11, "ftp://org/es/#f", "org", "/es/", "org/es/", "block"),
    (12, "x://h/a://com/en/", "h", "/a://com/en/", None, "allow"),
]


def test_hosts_paths_rules_and_verdicts(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u, *_ in URLS], "page_id long, url string, note string")
    got = sorted((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(pages).where("url is not null").collect())
    assert got == sorted(x for x in URLS if x[1] is not None)
    assert U.judge_urls(pages).where("url is null").first().verdict == "allow"
    assert U.judge_urls(pages.where("false")).count() == 0


@pytest.mark.parametrize(("listed", "universe"), [(0, 500), (1, 1), (300, 4000), (4000, 4000)])
def test_cascade_is_exact_over_its_universe(spark, listed, universe):
    keys = spark.range(universe).select(F.concat(F.lit("host"), "id").alias("k"), "id")
    # Few bits a key, so that several levels are needed.
    cascade = U.build_cascade(keys.where(F.col("id") < listed), keys, "k", hashes=2, bits_per_key=4)
    assert bool(cascade.levels) == bool(listed)
    got = keys.select("id", U.listed_by(cascade, F.col("k")).alias("l")).collect()
    assert all(r.l == (r.id < listed) for r in got)


def test_a_level_over_the_bound_is_an_error(spark):
    keys = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    with pytest.raises(ValueError, match="bound"):
        U.build_cascade(keys, keys, "k", max_bytes=10)


def test_lookup_alternates():
    full = U.Level(1, 64, np.full(2, 0xFFFFFFFF, np.uint32))
    none = U.Level(2, 64, np.zeros(2, np.uint32))
    x = np.arange(5, dtype=np.uint64)
    assert U.Cascade((full,), 2).lists(x, x).all()
    assert U.Cascade((full, none), 2).lists(x, x).all()
    assert not U.Cascade((none,), 2).lists(x, x).any()
    assert not U.Cascade((full, full), 2).lists(x, x).any()


def test_parts_of_a_cascade_give_the_same_answers(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), F.col("id") % 2000).alias("k"), (F.col("id") % 2000 < 700).alias("yes"), F.col("id"))
    got = U.mark_listed(keys, "k", keys.select("k", "yes"), "yes", "found", max_bytes=70).collect()
    assert len(got) == 3000
    assert all(r.found == r.yes for r in got)


def test_the_cascade_of_urls_has_several_levels_and_gives_all_verdicts(spark):
    urls = spark.range(4000).select("id", F.concat(F.lit("http://h"), F.col("id") % 9, F.lit(".example."), F.when(F.col("id") % 3 == 0, "com").otherwise("net"), F.lit("/en/"), "id").alias("url"))
    parts = urls.select(F.concat(U.host_of(F.col("url")), U.path_of(F.col("url"))).alias("k"), "id")
    cascade = U.build_cascade(parts.where("id % 3 = 0"), parts, "k")
    assert len(cascade.levels) >= 3
    got = {r.id: r.verdict for r in U.judge_urls(urls).collect()}
    # example.com/en/7 is allowed by the longer rule.
    assert got == {i: "block" if i % 3 == 0 and str(i)[0] != "7" else "allow" for i in range(4000)}


def test_a_list_of_keys_and_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.de/x"), (2, "http://a.de/y"), (3, "http://b.net/de/1"), (4, None)], "id long, url string")
    listed = spark.createDataFrame([("a.de/x",), ("a.de/x",), ("b.net/de/1",), ("not/there",), (None,)], "key string")
    got = {r.id: (r.rule, r.verdict) for r in U.judge_urls(pages, listed=listed).collect()}
    assert got == {1: (None, "block"), 2: (None, "allow"), 3: ("net/de/", "allow"), 4: (None, "allow")}


def test_clashing_columns_give_way_and_others_stay(spark):
    names = ["host", "path", "rule", "listed", "verdict", "_url_key", "_blocked", "_key"]
    pages = spark.createDataFrame([(1, "http://org/es/1", *["mine"] * len(names)), (2, "http://" + "long." * 20_000 + "org/fr", *["mine"] * len(names))], ["id", "url", *names])
    got = {r.id: r.asDict() for r in U.judge_urls(pages).collect()}
    assert sorted(got[1]) == sorted(["id", "url", *names])
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["listed"], got[1]["verdict"]) == ("org", "/es/1", "org/es/", True, "block")
    assert got[2]["verdict"] == "allow"
    assert len(got[2]["host"]) == 100_003
    assert all(got[1][n] == "mine" for n in ("_url_key", "_blocked", "_key"))
