import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import toxicity as X

BAD = ["idiot", "moron", "scum", "trash"]


def corpus(n, seed):
    random.seed(seed)
    words = [f"w{random.randrange(10**6)}" for _ in range(3000)]
    out = []
    for i in range(n):
        text = random.choices(words, k=random.randint(20, 200))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                text[random.randrange(len(text))] = random.choice(BAD)
        out.append((i, " ".join(text), int(toxic)))
    return out


def test_gradients_equal_differences():
    """Backpropagation against finite differences, in every parameter."""
    random.seed(0)
    texts = ["a b c bad " + "x " * 5, "d e f", "bad g h", "i j"] * 3
    labels = [1, 0, 1, 0] * 3
    model = X.train(texts, labels, steps=8)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    docs = [X.words_of(t) for t in texts]
    names = {}
    numbers = np.array([names.setdefault(w, len(names)) for d in docs for w in d])
    every = X._Words(list(names), model.words)
    sizes = np.array([len(d) for d in docs])
    ids, mask = X._windows(numbers, np.cumsum(sizes) - sizes, sizes)
    y, scale = np.array(labels, np.float64), np.linspace(0.5, 2, len(texts))

    def loss():
        projected = every.inputs(model.p, np.arange(len(every.own)))[0].astype(np.float64) @ model.p["wx"] + model.p["bx"]
        z = model.logits(projected, ids, mask).astype(np.float64)
        return float((scale * (np.logaddexp(0, z) - y * z)).mean())

    g = X._gradients(model, every, ids, mask, y, scale)
    checked = 0
    for name, p in model.p.items():
        flat, grad = p.reshape(-1), np.asarray(g[name]).reshape(-1)
        for i in np.argsort(-abs(grad))[:4]:
            if name == "word" and i % X.WORD_SIZE == 0:
                continue  # a word's first number is fixed
            old, step = flat[i], 1e-2
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            if abs(grad[i]) > 1e-3:
                assert (up - down) / (2 * step) == pytest.approx(grad[i], rel=0.1, abs=2e-4), name
                checked += 1
    assert checked > 10


def test_held_out_accuracy_and_windows():
    train, held = corpus(600, 1), corpus(300, 2)
    model = X.train([t for _, t, _ in train], [y for _, _, y in train])
    scores = model.score([t for _, t, _ in held])
    found = scores >= X.THRESHOLD
    truth = np.array([y for *_, y in held], bool)
    assert (found == truth).mean() > 0.97
    # One bad passage anywhere in a long text is found: all windows are scored.
    quiet = " ".join(f"v{i}" for i in range(4000))
    for at in (0, 9000, len(quiet)):
        assert model.score([quiet[:at] + " idiot moron scum " + quiet[at:]])[0] > 0.5
    assert model.score([quiet])[0] < 0.3
    assert ((scores >= 0) & (scores <= 1)).all()


def test_scores_depend_on_the_text_alone():
    train = corpus(100, 3)
    model = X.train([t for _, t, _ in train], [y for _, _, y in train], steps=20)
    texts = [t for _, t, _ in train] + [None, "", "idiot"]
    a = model.score(texts)
    model.forget()
    b = np.array([model.score([t])[0] for t in reversed(texts)])[::-1]
    assert np.allclose(a, b, atol=1e-5)
    assert a[-2] == a[-3]


@pytest.mark.parametrize("labels", [[], [0, 0], [1, 1]])
def test_without_both_labels(labels):
    model = X.train(["a", "b"][: len(labels)], labels)
    assert list(model.score(["x", None])) == [float(np.mean(labels)) if labels else 0.0] * 2


def test_windows_cover_every_word_and_overlap():
    for n in (0, 1, 47, 48, 49, 80, 81, 1000):
        starts = X.window_starts(n)
        assert set(range(n)) == {i for s in starts for i in range(s, min(n, s + X.WINDOW))}
        assert all(b - a == X.STRIDE < X.WINDOW for a, b in zip(starts, starts[1:], strict=False))


def test_trigrams_stay_in_their_word():
    a, begins = X.trigrams([b"idiot", b"a"])
    assert len(a) == 6
    assert list(begins) == [0, 5]
    b, _ = X.trigrams([b"a", b"idiot"])
    assert list(a[:5]) == list(b[1:])


def test_query_columns_nulls_and_repeats(spark, tmp_path):
    rows = corpus(200, 4)
    docs = [(i, t, "en") for i, t, _ in rows] + [(None, "idiot scum", "en"), (900, None, "x"), (901, "", "x"), (0, rows[0][1], "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, None), (None, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = X.op2_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.predicted == int(r.score >= 0.3)
    by = {r.doc_id: r.score for r in got}
    assert by[900] == by[901]
    truth = {i: y for i, _, y in rows}
    assert np.mean([int(by[i] >= 0.3) == y for i, y in truth.items()]) > 0.95
    assert X.score_texts(spark.createDataFrame([], "doc_id long, text string"), X.train([], [])).count() == 0


def plain_score(model, text):
    """The network word by word, straight from its equations."""
    words = X.words_of(text)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    best = -np.inf
    for start in X.window_starts(len(words)):
        inputs = []
        for w in words[start : start + X.WINDOW]:
            grams, _ = X.trigrams([w])
            own = model.p["word"][model.words.get(w, 0)]
            inputs.append(np.concatenate([own, np.mean([model.p["char"][g] for g in grams], axis=0)]))
        states = np.zeros((len(inputs), 2 * X.UNITS))
        for d in (0, 1):
            h = np.zeros(X.UNITS)
            for t in range(len(inputs))[:: 1 - 2 * d]:
                x = (inputs[t] @ model.p["wx"] + model.p["bx"])[d * 3 * X.UNITS : (d + 1) * 3 * X.UNITS].reshape(3, -1)
                r = (h @ model.p["uh"][d]).reshape(3, -1)
                z, reset = sigmoid(x[0] + r[0]), sigmoid(x[1] + r[1])
                h = (1 - z) * np.tanh(x[2] + reset * r[2]) + z * h
                states[t, d * X.UNITS : (d + 1) * X.UNITS] = h
        weight = np.exp([np.tanh(s @ model.p["wa"]) @ model.p["va"] for s in states])
        pooled = (states * (weight / weight.sum())[:, None]).sum(axis=0)
        best = max(best, pooled @ model.p["wo"] + model.p["bo"][0])
    return sigmoid(best) if words else 0.0


def test_scores_equal_the_plain_network():
    train = corpus(60, 6)
    model = X.train([t for _, t, _ in train], [y for _, _, y in train], steps=12)
    texts = [t for _, t, _ in train[:12]] + ["idiot", "Idiot, scum!", "", None, "w " * 500, "é ü 你好"]
    assert np.allclose(model.score(texts), [plain_score(model, t) for t in texts], atol=1e-4)


def test_passages_stand_whole_in_a_window():
    for n in (60, 100, 333):
        starts = X.window_starts(n)
        for at in range(n - 24):
            assert any(s <= at and at + 24 <= min(n, s + X.WINDOW) for s in starts)


def test_clashing_columns_and_bounded_texts(spark):
    train = corpus(60, 7)
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t, _ in train] * 2, "doc_id long, text string, score int, _t string")
    labels = spark.createDataFrame([(i, y) for i, _, y in train], "doc_id long, toxic int")
    got = X.score_texts(docs, X.train([], []))
    assert got.columns.count("score") == 1
    assert got.first().score == 0.0
    assert {r._t for r in got.collect()} == {"x"}
    # No text is under the bound, so there is nothing to learn from.
    assert X.fit(docs, labels, max_bytes=1).constant == 0.0


@pytest.mark.parametrize("n", [*range(1, 9), 12, 20])
@pytest.mark.filterwarnings("error")
def test_scores_are_numbers_with_few_labels(n):
    random.seed(n)
    text = lambda: " ".join(random.choices(["one", "two", "three", "blue", "sky", "house"], k=random.randint(5, 90)))
    model = X.train([text() + " idiot scum" * (i % 2) for i in range(n)], [i % 2 for i in range(n)])
    scores = model.score([text() for _ in range(40)] + ["", None, "never seen words"])
    assert np.isfinite(scores).all()
    assert ((scores >= 0) & (scores <= 1)).all()


def test_few_labels_leave_ordinary_documents_alone(spark):
    random.seed(1)
    words = [f"w{i}" for i in range(500)]
    docs = [(i, " ".join(random.choices(words, k=60)) + (" idiot scum trash" if i < 3 else "")) for i in range(56)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for labelled in ([0, 10, 11, 12], [0, 1, 2, 10, 11, 12]):
        labels = spark.createDataFrame([(i, int(i < 3)) for i in labelled], "doc_id long, toxic int")
        scored = X.score_texts(frame, X.fit(frame, labels, held_out=None)).collect()
        assert all(r.score is not None for r in scored)
        assert sum(r.score >= X.THRESHOLD for r in scored if r.doc_id >= 3) <= 5


def test_a_text_over_the_budget_costs_only_itself(spark):
    random.seed(2)
    words = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(random.choices(words, k=12)) + (" idiot scum" if i % 3 == 0 else "")) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    first = frame.orderBy(F.xxhash64("doc_id")).first().doc_id
    long = frame.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("much "), 2000)).otherwise(F.col("text")))
    model = X.fit(long, labels, held_out=None, max_bytes=9000)
    assert model.constant is None
    assert model.score(["w1 w2 idiot scum w3"])[0] > model.score(["w1 w2 w3 w4"])[0]
