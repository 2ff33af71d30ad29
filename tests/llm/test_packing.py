import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskwright.llm import packing


def plain(sizes, k):
    """Differencing by whole k-tuples with their empty parts, merged by the definition; the sums, largest first."""
    waiting = [(size, -i, [size] + [0] * (k - 1)) for i, size in enumerate(sizes)]
    while len(waiting) > 1:
        waiting.sort()
        (_, i, a), (_, j, b) = waiting.pop(), waiting.pop()
        c = sorted((x + y for x, y in zip(a, reversed(b))), reverse=True)
        waiting.append((c[0] - c[-1], max(i, j), c))
    return waiting[0][2] if waiting else []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=25), st.integers(1, 7))
def test_windows_are_those_of_whole_tuples(sizes, k):
    windows = packing.differenced(sizes, k)
    assert sorted(i for _, members in windows for i in members) == list(range(len(sizes)))
    assert all(total == sum(sizes[i] for i in members) for total, members in windows)
    assert [total for total, _ in windows] == [x for x in plain(sizes, k) if x]


def test_known_partitions():
    assert [w[0] for w in packing.differenced([4, 5, 6, 7, 8], 2)] == [16, 14]
    assert [w[0] for w in packing.differenced([8, 7, 6, 5, 4], 3)] == [12, 10, 8] or sum(w[0] for w in packing.differenced([8, 7, 6, 5, 4], 3)) == 30
    random.seed(1)
    sums = [w[0] for w in packing.differenced([random.randint(1, 600) for _ in range(300)], 40)]
    assert max(sums) - min(sums) <= 30


def test_the_number_of_windows_rises_over_the_capacity():
    assert len(packing.divided([6, 6, 6], 10)) == 3
    assert [w[0] for w in packing.divided([5, 5, 5, 5], 10)] == [10, 10]
    assert packing.divided([], 10) == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=30), st.booleans())
def test_every_token_lies_in_one_piece(lengths, cut):
    sequences = packing.packed(lengths, 16, cut)
    seen = defaultdict(list)
    for pieces in sequences:
        assert 0 < sum(p[2] for p in pieces) <= 16
        assert all(p[2] > 0 for p in pieces)
        for doc, start, length in pieces:
            seen[doc] += range(start, start + length)
    assert {d: sorted(x) for d, x in seen.items()} == {d: list(range(n)) for d, n in enumerate(lengths)}
    if cut:
        assert sum(packing.padding(sum(p[2] for p in pieces), 16) for pieces in sequences) == 0


TEXTS = st.lists(st.sampled_from([*"ab \n\t", "\r", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\u3000", "\u2028", "\u1680", "\u180e", "é", "中", "1", "23", "'s", "'ll", "!", "...", "foo", " bar", "\U0001f600", "<|endoftext|>", "<|end"]), max_size=40).map("".join)


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(packing.default_tokenizer(), most=50, at_once=4)


@settings(max_examples=800, deadline=None)
@given(TEXTS)
def test_pieces_of_text_give_the_whole_text_s_ids(encoder, text):
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.ids(text), "<u4").tolist() == want


def test_query_holds_every_token_once(spark, tmp_path):
    random.seed(2)
    word = lambda: random.choice(["the", "Cat's", "über", "x" * 9, "12", "\n\n", "end.\n", "  "])
    docs = [(i, " ".join(word() for _ in range(random.randint(0, 900))), i) for i in range(150)]
    docs += [(200, None, 0), (201, "", 0), (None, "no id", 0), (3, "again 3", 1), (3, "again 3", 1), (202, "long " * 60_000, 2)]
    spark.createDataFrame(docs, "doc_id long, text string, sequence_id long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows = packing.op12_packing(spark, str(tmp_path)).collect()
    tokenizer = packing.Encoder(packing.default_tokenizer()).tokenizer
    encode = lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
    texts = defaultdict(list)
    for i, t, _ in docs:
        texts[i].append(encode(t))
    sequences = defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert packing.padding(at) == 0
        assert at <= 2048
    assert set(pieces) == set(texts)
    for i, got in pieces.items():
        want = [(s, n, len(t)) for t in texts[i] for s, n, _, m in got if m == len(t)]
        assert sum(n for _, n, *_ in got) == sum(map(len, texts[i]))
        for s, n, crc, m in got:
            assert any(m == len(t) and crc == zlib.crc32(np.array(t[s : s + n], "<u4").tobytes()) for t in texts[i])
        assert want
    whole = packing.pack(spark.read.parquet(f"{tmp_path}/documents.parquet"), "doc_id", "text", packing.default_tokenizer(), cut=False)
    assert whole.where((F.col("length") != F.col("doc_tokens")) & (F.col("doc_tokens") <= 2048)).count() == 0
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", packing.default_tokenizer()).count() == 0
