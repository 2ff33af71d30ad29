import os
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest

from maskwright.llm import kneser_ney as K
from maskwright.llm.common import shared_root


def brute(train, order):
    """Probability functions straight from the definition."""
    seqs = [["<s>", *t.lower().split(), "</s>"] for t in train]
    counts = {order: Counter(tuple(s[i : i + order]) for s in seqs for i in range(len(s) - order + 1))}
    if order == 1:
        counts[1] = Counter((w,) for s in seqs for w in s[1:])
    for k in range(order - 1, 0, -1):
        c = Counter(g[1:] for g in counts[k + 1])
        if k > 1:
            c.update(tuple(s[:k]) for s in seqs if len(s) >= k)
        counts[k] = c
    types = len({w for s in seqs for w in s[1:]})

    def discounts(c):
        n = [sum(1 for x in c.values() if x == i) for i in (1, 2, 3, 4)]
        if not (n[0] and n[1]):
            return [0, 0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
        return [0, *(min(max(x, 0), i) for i, x in enumerate(d, 1))]

    ds = {k: discounts(c) for k, c in counts.items()}
    sums = {k: defaultdict(lambda: [0, 0, 0, 0]) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            s = sums[k][g[:-1]]
            s[0] += n
            s[min(n, 3)] += 1

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / (types + 1)
        total, n1, n2, n3 = sums[k].get(gram[:-1], (0, 0, 0, 0))
        low = p(gram[1:])
        if not total:
            return low
        c, d = counts[k][gram], ds[k]
        return max(c - d[min(c, 3)], 0) / total + (d[1] * n1 + d[2] * n2 + d[3] * n3) / total * low

    def score(text):
        s = ["<s>", *text.lower().split(), "</s>"]
        return sum(log10(p(tuple(s[max(0, i - order + 1) : i + 1]))) for i in range(1, len(s)))

    return score


TEXTS = ["the cat sat on the mat", "The dog sat on the cat", "a cat and a dog", "", None, "the the the the", "dog", "the cat sat on the mat", "x " * 300, "unknown words here now", "on the mat the cat sat and the dog sat"]


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("hot_share", [4, 4096])
def test_equals_the_definition(spark, order, hot_share):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = [t or "" for i, t in rows if i not in (5, 9)]
    model = K.count_ngrams(docs.where("doc_id not in (5, 9)"), order=order, bucket_bytes=64, hot_share=hot_share, at_once=20)
    want = brute(train, order)
    tokens = Counter(w for t in train for w in [*t.lower().split(), "</s>"])
    assert (model.tokens, model.types) == (sum(tokens.values()), len(tokens))
    for row in K.score_texts(docs, model, at_once=30).collect():
        text = TEXTS[row.doc_id] or ""
        own = [*text.lower().split(), "</s>"]
        assert row.score == pytest.approx(want(text), rel=1e-9)
        assert row.n_tokens == len(own)
        assert row.n_known == sum(w in tokens for w in own)
        assert row.base_score == pytest.approx(sum(log10((tokens[w] + 1) / (sum(tokens.values()) + len(tokens) + 1)) for w in own), rel=1e-9)


def test_no_training_texts_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, score_note string")
    model = K.count_ngrams(docs.where("false"))
    row = K.score_texts(docs, model).first()
    assert (row.n_tokens, row.n_known, row.base_score, row.score, row.score_note) == (3, 0, 0.0, 0.0, "x")
    assert K.score_texts(docs.where("false"), model).count() == 0


def test_op8_splits_by_crc32(spark, tmp_path):
    rows = [(i, f"word{i % 5} shared text") for i in range(40)] + [(None, "lone")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = K.op8_kneser_ney(spark, str(tmp_path)).collect()
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    train = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    assert {r.train_tokens for r in got} == {sum(len(t.split()) + 1 for t in train)}


def test_op8_uses_contexts_of_two_words(spark, tmp_path):
    rows = [(i, f"w{i % 3} and then{i % 3}") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = brute([t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2], 3)
    for r in K.op8_kneser_ney(spark, str(tmp_path)).collect():
        assert r.score == pytest.approx(want(rows[r.doc_id][1]), rel=1e-9)


def test_columns_with_the_names_of_results_give_way(spark):
    docs = spark.createDataFrame([(1, "a b a", "old", 9), (2, None, "old", 9)], "doc_id long, text string, score string, N_TOKENS int")
    got = K.score_texts(docs, K.count_ngrams(docs, order=2))
    assert got.columns == ["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"]
    assert {r.doc_id: r.n_tokens for r in got.collect()} == {1: 4, 2: 1}


def test_order_four_large_counts_and_contexts_of_many_words(spark):
    texts = ["a b c d e"] * 300 + [f"a b w{i} w{i % 7} a b" for i in range(40)] + ["", "b", "a b", "c a b zz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = K.count_ngrams(docs, order=4, bucket_bytes=64 * 200, hot_share=4096, at_once=500)
    assert model.deal.hot < K.FIRST_ID + model.types
    want = brute(texts, 4)
    for row in K.score_texts(docs, model, at_once=300).collect():
        assert row.score == pytest.approx(want(texts[row.doc_id]), rel=1e-9)


def test_a_model_is_few_bytes_an_ngram_and_leaves_nothing_else(spark):
    words = np.random.default_rng(1).zipf(1.3, 200_000) % 30_000
    docs = spark.createDataFrame([(" ".join(map(str, part)),) for part in words.reshape(-1, 100)], "text string")
    root = shared_root(spark).removeprefix("file://")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(root) for f in fs)
    before = size()
    model = K.count_ngrams(docs, order=3)
    assert size() - before < 16 * sum(level.distinct for level in model.levels)


def test_equal_ngrams_are_searched_once(spark, monkeypatch):
    texts = ["a b c d e f"] * 50 + ["b c d zz a"]
    model = K.count_ngrams(spark.createDataFrame([(t,) for t in texts], "text string"), order=3)
    rows, search = [], K.Reader.search
    monkeypatch.setattr(K.Reader, "search", lambda self, k, columns: rows.append((k, len(columns[0]))) or search(self, k, columns))
    K.Reader(model).probabilities(*K.sequences(texts))
    grams = lambda k: {g for t in texts for s in [["<s>", *t.split(), "</s>"]] for g in zip(*(s[i:] for i in range(k)), strict=False)}
    assert [k for k, _ in rows] == [1, 2, 3]
    assert all(n <= len(grams(k)) for k, n in rows[1:])


def test_numbers_of_many_words_are_sorted_as_one_key(monkeypatch):
    rng = np.random.default_rng(2)
    pool = rng.integers(1 << 26, 1 << 27, 500).astype(np.uint32)
    columns, counts = [rng.choice(pool[: 20 + 200 * i], 5_000) for i in range(3)], rng.integers(1, 9, 5_000)
    want = Counter()
    for row, n in zip(zip(*(c.tolist() for c in columns), strict=True), counts.tolist(), strict=True):
        want[row] += n
    monkeypatch.setattr(np, "lexsort", None)
    got, sums = K.summed(columns, counts)
    assert list(zip(zip(*(c.tolist() for c in got), strict=True), sums.tolist(), strict=True)) == sorted(want.items())


def test_rows_that_fit_no_key_are_summed_too():
    columns = [np.random.default_rng(i).permutation(40_000).astype(np.uint32) << 12 for i in range(5)]
    columns = [np.append(c, c[:7]) for c in columns]
    want = sorted(Counter(zip(*(c.tolist() for c in columns), strict=True)).items())
    for got, sums in (K.summed(columns, np.ones(40_007, np.int64)), K.tallied(columns, 1 << 28)):
        assert list(zip(zip(*(c.tolist() for c in got), strict=True), sums.tolist(), strict=True)) == want


def test_words_end_at_ascii_white_space_only():
    texts = ["".join(f"{chr(i)}Wo{chr(i)}" for i in range(128)), None, "", " \t\n", " x y\u0085Äİ \x1cB", " lead", "trail "]
    flat, place, words = K.sequences(texts)
    want = [[K.START, *(K.xxhash.xxh64_intdigest(w, 42) for w in (t or "").encode().lower().split()), K.END] for t in texts]
    assert words[flat].tolist() == [int(h) for text in want for h in text]
    assert place.tolist() == [i for text in want for i in range(len(text))]
    assert [len(x) for x in K.sequences([])[:2]] == [0, 0]


def test_ranges_of_few_and_many_words_are_searched_alike():
    rng = np.random.default_rng(3)
    parts = [np.unique(rng.integers(0, 4_000, n)).astype(np.uint32) for n in (0, 1, 3, 900, 2_000)]
    array, begin = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
    of = np.sort(np.concatenate([np.repeat([1, 3], 5 * K.MANY), rng.integers(0, 5, 60), [4]]))
    q = rng.integers(0, 4_100, len(of))
    at, hit = K._find(array, begin[of], begin[of + 1], q)
    want = [int(begin[i] + np.searchsorted(parts[i], x)) for i, x in zip(of, q, strict=True)]
    assert at.tolist() == want
    assert hit.tolist() == [bool(x in parts[i]) for i, x in zip(of, q, strict=True)]
