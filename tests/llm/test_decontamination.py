import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from maskwright.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        n = min(len(w), window)
        for i in range(len(w) - n + 1) if w else ():
            for j in range(len(own) - n + 1):
                if own[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(item)
    return len(own), hit, found


TEXT = st.text(alphabet="ab AB.é1\n", max_size=80)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.lists(TEXT, max_size=5))
def test_scanner_equals_brute_force(text, items):
    items = list(enumerate(items))
    scanner = D.Scanner(items, window=3)
    runs, found = scanner.scan(D.folded_words(text))
    n, hit, owners = brute(text, items, 3)
    assert n == len(D.folded_words(text))
    assert {i for a, b in runs for i in range(a, b)} == hit
    assert found == owners
    spans = D.offsets(text, runs)
    assert [words(text[a:b]) for a, b in spans] == [words(text)[a:b] for a, b in runs]


def test_blocks_null_texts_and_extra_columns(spark):
    long = " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([(1, long), (2, "Short ITEM!"), (3, None), (4, ""), (5, long), (10, "w5 w6")], "item_id long, text string")
    rows = [(1, "x " * 5000 + long + " y"), (2, "a short-item, b"), (3, None), (4, ""), (5, "clean"), (2, "a short-item, b"), (6, "w29 w5 w6 w0")]
    docs = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, item_id long")
    whole = D.find_contamination(docs, bench).orderBy("doc_id").collect()
    assert whole == D.find_contamination(docs, bench, block_bytes=1).orderBy("doc_id").collect()
    items = [(r.item_id, r.text) for r in bench.collect()]
    for r in whole:
        n, hit, owners = brute(r.text, items)
        assert r.n_words == n
        assert sum(x["end"] - x["first"] for x in r.hit_runs) == len(hit)
        assert r.hit_items == sorted(map(str, owners))
        assert r.item_id == r.doc_id
    assert D.find_contamination(docs, bench.where("false")).agg({"n_words": "sum"}).first()[0] > 0
    assert D.find_contamination(docs.where("false"), bench).count() == 0
    assert Counter(r.doc_id for r in whole)[2] == 2


def test_clashing_columns_give_way(spark):
    docs = spark.createDataFrame([(1, "a b", 9, "mine")], "doc_id long, text string, N_words long, hit_spans string")
    got = D.find_contamination(docs, spark.createDataFrame([(1, "a b")], "item_id long, text string"))
    assert got.columns == ["doc_id", "text", "n_words", "hit_runs", "hit_spans", "hit_items"]
    assert got.first().n_words == 2
