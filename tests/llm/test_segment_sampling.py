import itertools
import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from maskwright.llm import segment_sampling as S


@pytest.fixture(scope="module")
def v():
    return S.vocabulary(S.default_model(), 1.0)


def pieces_of(path):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return {m.id_to_piece(i): (i, m.get_score(i)) for i in range(m.vocab_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))}, m.vocab_size()


def all_segmentations(text, v):
    """Every path of the whole lattice, straight from the vocabulary file, with its log probability."""
    pieces, n = pieces_of(S.default_model())
    s = (" " + text).replace(" ", S.MARK)

    @lru_cache(None)
    def rec(at):
        if at == len(s):
            return [((), 0.0)]
        out = []
        for end in range(at + 1, len(s) + 1):
            if s[at:end] in pieces:
                i, score = pieces[s[at:end]]
                w = -math.log((-score if score > -1e8 else n) + 2.7)
                out += [((i, *rest), w + x) for rest, x in rec(end)]
        if s[at] not in pieces:
            raw = s[at].encode()
            out += [((*(v.byte_id[b] for b in raw), *rest), -math.log(n + 2.7) * len(raw) + x) for rest, x in rec(at + 1)]
        return out

    found = rec(0)
    total = math.log(sum(math.exp(w) for _, w in found))
    return {p: w - total for p, w in found}


def test_lattice_and_distribution(v):
    text, k, n = "thand ab", 4, 1500
    exact = all_segmentations(text, v)
    got = S.sample([text] * n, list(range(n)), v, S.Units(), k, 5)
    first, among = Counter(), Counter()
    for found in got:
        ids = [tuple(x[0].tolist()) for x in found]
        assert len(set(ids)) == k
        assert [x[2] for x in found] == sorted((x[2] for x in found), reverse=True)
        for i, x in zip(ids, found, strict=True):
            assert x[1] == pytest.approx(exact[i], abs=1e-5)
        first[ids[0]] += 1
        among.update(ids)
    rng = np.random.default_rng(0)
    logs, names = np.array(list(exact.values())), list(exact)
    brute = Counter(names[i] for _ in range(n) for i in np.argsort(-(logs + rng.gumbel(size=len(logs))))[:k])
    for p in sorted(exact, key=exact.get, reverse=True)[:8]:
        q = math.exp(exact[p])
        assert abs(first[p] - n * q) < 5 * math.sqrt(n * q * (1 - q) + 1)
        q = brute[p] / n
        assert abs(among[p] - brute[p]) < 7 * math.sqrt(n * q * (1 - q) + 1)


def test_inclusion_scores_are_unbiased(v):
    """The sum over samples of p / inclusion estimates the total probability, which is 1."""
    n = 1500
    got = S.sample(["thand ab"] * n, list(range(n)), v, S.Units(), 3, 9)
    sums = [sum(math.exp(x[1] - x[3]) for x in found) for found in got]
    assert np.mean(sums) == pytest.approx(1, abs=5 * np.std(sums) / math.sqrt(n) + 0.01)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab é▁\n\t🙂中,.%"), max_size=40), min_size=1, max_size=4))
def test_distinct_and_exact_round_trip(texts):
    v = S.vocabulary(S.default_model(), 1.0)
    for text, found in zip(texts, S.sample(texts, list(range(len(texts))), v, S.Units(), 4, 0), strict=True):
        ids = [tuple(x[0].tolist()) for x in found]
        assert len(set(ids)) == len(ids) >= 1
        assert all(v.decode(i) == text and v.decodes_to(np.array(i, np.int64), text) for i in ids)
        assert not any(v.decodes_to(np.array(i, np.int64), text + "a") for i in ids)
        assert all(x[3] <= 1e-12 for x in found)


def test_all_of_few_come_out(v):
    for text in ("", "a", "中", "é", "▁"):
        exact = all_segmentations(text, v) if text and text != "▁" else None
        found = S.sample([text], [1], v, S.Units(), 50, 3)[0]
        if exact is not None:
            assert {tuple(x[0].tolist()) for x in found} == set(exact)
        assert all(x[3] == 0.0 for x in found)


def test_samples_depend_on_key_and_text_alone(v):
    texts = ["some words here", "more of them", "some words here", "x" * 500, "tail " * 400]
    keys = [1, 2, 3, 4, 5]
    together = S.sample(texts, keys, v, S.Units(), 3, 7)
    store = S.Units()
    for t, k, want in reversed(list(zip(texts, keys, together, strict=True))):
        alone = S.sample([t], [k], v, store, 3, 7)[0]
        for a, b in zip(alone, want, strict=True):
            assert list(a[0]) == list(b[0])
            assert a[1:] == pytest.approx(b[1:])
    assert [x[2] for x in together[0]] != [x[2] for x in together[2]]
    other = S.sample(texts, keys, v, S.Units(), 3, 8)
    assert [x[2] for x in other[0]] != [x[2] for x in together[0]]


def test_long_texts_deviate_late_when_the_start_is_certain(v):
    """A text that has one way at first and many at its end: the tail has to be opened."""
    text = "中 " * 200 + "thand thand"
    exact = all_segmentations("thand thand", v)
    best = sorted(exact.values(), reverse=True)[:2]
    found = S.sample([text] * 200, list(range(200)), v, S.Units(), 2, 1)
    assert all(len({tuple(x[0]) for x in f}) == 2 for f in found)
    share = np.mean([abs(f[0][1] - max(x[1] for g in found for x in g)) < 1e-4 for f in found])
    assert share > 0.1
    assert len(best) == 2


def test_frames_digests_and_decoding(spark):
    path = S.default_model()
    rows = [(1, "Hello  world\n é"), (2, None), (3, ""), (1, "Hello  world\n é"), (4, "w " * 3000), (None, "no key")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, sample int")
    got = S.sample_segmentations(docs, "doc_id", "text", path, k=2)
    back = S.decode_pieces(got, "pieces", path).collect()
    texts = {i: t or "" for i, t in rows}
    assert all(r.text == texts[None if r.doc_id is None or r.doc_id != r.doc_id else r.doc_id] for r in back)
    assert Counter(r.doc_id for r in back)[1] == 4
    digests = S.sample_segmentations(docs, "doc_id", "text", path, k=2, digest=True).collect()
    assert all(r.decodes for r in digests)
    assert S.sample_segmentations(docs.where("false"), "doc_id", "text", path).count() == 0
    assert list(itertools.islice((r.n_pieces for r in digests if r.doc_id == 2), 1)) == [0]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\0▁é", max_size=12))
def test_units_spell_the_text(text):
    units = S.units_of(text)
    assert "".join(map(S._spelled, units)) == " " + text
    # Equal names are equal units: a unit is found again by its name alone.
    assert all(u == "\n" or "\n" not in u for u in units)


def test_keys_with_the_names_of_results_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a text", 5), (1, "a text", 5), (2, None, 5)], "sample long, pieces string, log_prob int")
    got = S.sample_segmentations(docs, "sample", "pieces", S.default_model(), k=2)
    assert got.columns[:2] == ["sample", "sample_"]
    assert sorted((r["sample"], r.sample_) for r in got.collect()) == [(1, 0), (1, 0), (1, 1), (1, 1), (2, 0)]
    assert S.sample_segmentations(docs.where("false"), "sample", "pieces", S.default_model()).count() == 0
