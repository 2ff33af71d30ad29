import itertools
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from maskwright.llm import simhash as S
from maskwright.llm.components import connected_components


def brute_fingerprint(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", folded)
    found = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    bits = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in found) * 2 > len(found) for b in range(64)]
    return sum(1 << b for b, on in enumerate(bits) if on)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aAÉé \t\x0b\x1f\xa0b.", max_size=60))
def test_fingerprint(text):
    assert S.fingerprint(text) == brute_fingerprint(text)


def test_fingerprint_of_nothing():
    assert S.fingerprint(None) == S.fingerprint("") == S.fingerprint(" \n") == 0


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4), st.integers(3, 9))
def test_budgets_keep_every_close_pair(fp, flips, m):
    """The principle itself: within tau, some chain begins with equal segments and stays in budget."""
    lengths, allowed = S.segment_lengths(m), S.budgets(m, 2)
    other = fp
    for b in flips:
        other ^= 1 << b
    diff = f"{fp ^ other:064b}"
    cuts = [0, *itertools.accumulate(lengths)]
    counts = [diff[a:b].count("1") for a, b in itertools.pairwise(cuts)]
    passes = any(all(sum((counts + counts)[i : i + n]) <= allowed[n - 1] for n in range(1, m + 1)) for i in range(m))
    assert passes == (len(flips) <= 2)


def brute_components(values):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(values, 2):
        if (a ^ b).bit_count() <= 2:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    groups = {}
    for v in values:
        groups.setdefault(find(v), set()).add(v)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("hot", [1, 4, 64])
def test_links_join_what_brute_force_joins(spark, hot):
    random.seed(hot)
    base = [random.getrandbits(64) for _ in range(12)]
    values = set(base) | {0, (1 << 64) - 1}
    for b in base:
        for _ in range(12):
            v = b
            for _ in range(random.randint(1, 5)):
                v ^= 1 << random.randrange(64)
            values.add(v)
    values = sorted(values)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    links = S.link_within(spark.createDataFrame([(v,) for v in signed], "fp long"), hot=hot)
    for r in links.collect():
        assert ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2
    roots = {r.node: r.root for r in connected_components(links).collect()}
    groups = {}
    for u, s in zip(values, signed, strict=True):
        groups.setdefault(roots.get(s, s), set()).add(u)
    assert sorted(map(sorted, groups.values())) == brute_components(values)


def test_components(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)]
    links = spark.createDataFrame([*path, *star, (200, 201), (201, 200), (300, 300), (200, 201)], "a long, b long")
    got = {r.node: r.root for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert connected_components(links.where("false")).count() == 0


def test_near_duplicates_with_nulls_copies_and_clashing_columns(spark):
    long = " ".join(f"word{i}" for i in range(400))
    rows = [(5, None), (3, ""), (9, " \n"), (1, long), (2, long.upper()), (2, long), (7, long.replace("word7 ", "wordx ")), (8, "alone here"), (4, "x " * 9000)]
    docs = spark.createDataFrame([(i, t, 0, "c") for i, t in rows], "doc_id long, text string, fp int, component string")
    got = S.near_duplicates(docs, "doc_id", "text").collect()
    assert len(got) == len(rows)
    component = {r.doc_id: r.component for r in got}
    assert component[5] == component[3] == component[9] == 3
    assert component[1] == component[2] == 1
    assert component[8] == 8
    values = {r.fp & (2**64 - 1) for r in got}
    assert len(set(component.values())) == len(brute_components(sorted(values)))
    assert S.near_duplicates(docs.where("false"), "doc_id", "text").count() == 0


@pytest.mark.parametrize("hot", [3, 64])
def test_similar_groups(spark, hot):
    random.seed(1)
    words = [f"w{i}" for i in range(3000)]
    texts, kind = [], []
    for g in range(12):
        own = random.choices(words, k=300)
        for _ in range(8):
            copy = list(own)
            for _ in range(2):
                copy[random.randrange(300)] = "new" + str(random.random())
            texts.append(" ".join(copy))
            kind.append(g)
    for g in range(100, 140):
        texts.append(" ".join(random.choices(words, k=random.randint(1, 400))))
        kind.append(g)
    rows = list(enumerate(texts)) + [(500, None), (501, ""), (502, texts[0]), (0, texts[0])]
    got = {r[0]: r[1] for r in S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", hot=hot).collect()}
    for i, g in enumerate(kind):
        assert got[i] == kind.index(g)
    assert got[500] == got[501] == 500
    assert got[502] == 0


def test_wide_fingerprints_tell_similarity():
    random.seed(3)
    own = [f"w{i}" for i in range(500)]
    for changes, most in ((0, 0), (3, 30)):
        copy = list(own)
        for i in range(changes):
            copy[100 * i + 50] = "other"
        a, b = S.wide_fingerprint(" ".join(own))[1], S.wide_fingerprint(" ".join(copy))[1]
        assert sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True)) <= most
    far = S.wide_fingerprint(" ".join(random.sample(own, 500)))[1]
    assert sum((x ^ y).bit_count() for x, y in zip(a, far, strict=True)) > S.bits_for(0.8)


def isolated_pairs(similarities, each, seed):
    """Pairs of texts that nothing else is near to, and the exact similarity of their sets of shingles."""
    random.seed(seed)
    out = []
    for aim in similarities:
        while len(out) < each * (1 + similarities.index(aim)):
            own = [f"v{random.randrange(10**9)}" for _ in range(random.randint(60, 400))]
            other = list(own)
            while True:
                sets = [set(S.shingles([w.encode() for w in t], 5)) for t in (own, other)]
                exact = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
                if exact < aim + 0.03:
                    break
                other[random.randrange(len(own))] = f"u{random.randrange(10**9)}"
            out.append((" ".join(own), " ".join(other), exact))
    return out


@pytest.mark.parametrize("hot", [1, 12])
def test_every_isolated_pair_at_the_similarity_is_found(spark, hot):
    pairs = isolated_pairs([0.8, 0.82, 0.85, 0.9], 60, 4)
    rows = [(2 * i + s, p[s]) for i, p in enumerate(pairs) for s in (0, 1)]
    got = {r[0]: r[1] for r in S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", hot=hot).collect()}
    assert sum(e >= 0.8 for *_, e in pairs) > 200
    for i, (*_, exact) in enumerate(pairs):
        assert got[2 * i] == 2 * i
        assert (got[2 * i + 1] == 2 * i) == (exact >= 0.8)


def test_pairs_under_the_similarity_stay_apart(spark):
    pairs = isolated_pairs([0.6, 0.7, 0.74], 60, 5)
    assert all(e < 0.8 for *_, e in pairs)
    rows = [(2 * i + s, p[s]) for i, p in enumerate(pairs) for s in (0, 1)]
    assert all(a == b for a, b in S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect())


@pytest.mark.parametrize("hot", [1, 64])
def test_groups_do_not_depend_on_how_full_buckets_are(spark, hot):
    random.seed(6)
    texts = []
    for _ in range(4):
        own = [f"v{random.randrange(10**9)}" for _ in range(200)]
        for _ in range(30):
            copy = list(own)
            for _ in range(random.randint(0, 7)):
                copy[random.randrange(200)] = f"u{random.randrange(10**9)}"
            texts.append(" ".join(copy))
    sets = [set(S.shingles(S.words_of(t), 5)) for t in texts]
    root = list(range(len(texts)))
    for a, b in itertools.combinations(root[:], 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    got = S.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", hot=hot).collect()
    assert {r[0]: r[1] for r in got} == dict(enumerate(root))
    assert len(set(root)) > 4


def test_keys_with_the_names_of_results(spark):
    docs = spark.createDataFrame([(7, "one two three four five six"), (5, "one two three four five six"), (None, None)], "component long, fp string")
    got = S.near_duplicates(docs, "component", "fp")
    assert got.columns == ["component", "fp", "component_"]
    assert {(r.component, r.component_) for r in got.collect()} == {(7, 5), (5, 5), (None, None)}
    assert S.similar_groups(docs.where("component > 0"), "component", "fp").columns == ["component", "component_"]
    assert S.fingerprints(docs.withColumnRenamed("component", "FP_").withColumnRenamed("fp", "t").withColumnRenamed("FP_", "fp"), "fp", "t").columns == ["fp", "fp_"]


def test_ring_pairs_join_what_brute_force_joins(spark):
    """The pipeline's first candidates: fingerprints within two bits, by the ring, and classes of one fingerprint."""
    random.seed(8)
    rows = []
    for _ in range(15):
        v = random.getrandbits(64)
        for _ in range(6):
            rows.append((len(rows), v))
            v ^= sum(1 << b for b in random.sample(range(64), random.choice([0, 1, 2, 4])))
    signed = [(i, v - (1 << 64) if v >> 63 else v) for i, v in rows]
    for share in (1, 1000):
        roots = {r.node: r.root for r in connected_components(S.ring_pairs(spark.createDataFrame(signed, "id long, fp long"), share)).collect()}
        groups = {}
        for i, v in rows:
            groups.setdefault(roots.get(i, i), set()).add(v)
        assert sorted(map(sorted, groups.values())) == brute_components(sorted({v for _, v in rows}))


def test_what_first_candidates_join_is_not_tried_in_every_band(spark, monkeypatch):
    random.seed(9)
    own = [f"v{random.randrange(10**9)}" for _ in range(200)]
    texts = []
    for i in range(150):
        copy = list(own)
        copy[random.randrange(200)] = f"u{i}"
        texts.append(" ".join(copy))
    tried, similar = [], S._similar
    monkeypatch.setattr(S, "_similar", lambda pairs, *a: tried.append(pairs.count()) or similar(pairs, *a))
    got = S.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text").collect()
    assert {r[1] for r in got} == {0}
    assert sum(tried) < 12 * len(texts)


def test_a_family_just_under_the_similarity_is_not_tried_in_pairs(spark, monkeypatch):
    random.seed(10)
    own = [f"v{random.randrange(10**9)}" for _ in range(200)]
    texts = [" ".join(own)]
    for _ in range(149):
        copy = list(own)
        for at in random.sample(range(5, 195, 10), random.randint(5, 8)):
            copy[at] = f"u{random.randrange(10**9)}"
        texts.append(" ".join(copy))
    sets = [set(S.shingles(S.words_of(t), 5)) for t in texts]
    assert all(len(a & b) < 0.8 * len(a | b) for a, b in itertools.combinations(sets, 2))
    tried, similar = [], S._similar
    monkeypatch.setattr(S, "_similar", lambda pairs, *a: tried.append(pairs.count()) or similar(pairs, *a))
    got = S.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text").collect()
    assert all(a == b for a, b in got)
    assert tried[-1] < len(texts)
