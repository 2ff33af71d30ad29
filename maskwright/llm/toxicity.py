"""Toxicity: a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

A word's input is its own vector (frequent words of the training sample) beside
the mean of its character trigrams' vectors (hashed, so unseen spellings have one
too); both are learnt, from random values. A text is cut into windows of words,
each of which overlaps the next by half, every one is scored, and the largest
score is the text's. Only the text is read: ids, languages, sources and labels
are no inputs.

Training takes a bounded sample of labelled rows: at most `max_docs` of each
label, the first by a hash of their id, and at most half of `max_bytes` of text of each. A
labelled text says only that some window is toxic, so training begins with
random windows of each text and then takes the one that the network finds most
toxic, chosen anew every few steps. In every fourth step no word has a vector of
its own, so that characters alone must tell, as they must for unknown words.

Nulls and empty texts are texts without words: with nothing in them that could be
toxic their score is 0. Texts of any length are scored whole. Labels of null are no labels; a
document with several labels counts with each. Without any label of one kind
there is nothing to learn and every score is the share of label 1 (0 without
labels); a handful of labels teach little, but scores are numbers all the same. Repeated rows are scored each. Empty tables give empty results. Input
columns pass through; one with the name of the score gives way to it.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty, written

WINDOW, STRIDE = 48, 24
UNITS, ATTENTION, WORD_SIZE, CHAR_SIZE, CHAR_BUCKETS = 8, 8, 8, 10, 8192
#: In training: how often windows are chosen anew (more often where there are few), what a label 1 falls short of 1 (labels are noisy), how fast vectors
#: that nothing needs shrink (over the number of texts: few are easily learnt by heart), in how
#: many texts a word with a vector of its own stands, the share of label 0 that shows its most toxic window, the rate of learning, the share of words
#: that a step treats as unknown, and over which last share of the steps parameters are averaged.
ROUNDS, DOUBT, DECAY, LEAST_DOCS, HARD, RATE, UNKNOWN, LATE = (12, 40), 0.1, 1200, 6, 0.8, 0.02, 0.1, 0.6
#: With few texts that would shrink vectors by more than they hold.
MOST_DECAY = 24.0
THRESHOLD = 0.3

#: ASCII letters and digits and all of UTF-8's longer sequences stay; the rest separates words.
_SPLIT = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_SPLIT).split() if text else []


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of each word, with its ends marked, end to end, and where each word's begin."""
    joined = np.frombuffer(b"".join([b"\x01" + w + b"\x02" for w in words]), np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    begins = np.cumsum(sizes + 2) - sizes - 2
    hashed = (joined[:-2] * np.uint32(0x9E3779B1) ^ joined[1:-1] * np.uint32(0x85EBCA77) ^ joined[2:] * np.uint32(0xC2B2AE3D)) if len(joined) > 2 else np.zeros(0, np.uint32)
    hashed ^= hashed >> np.uint32(15)
    # A word of n bytes has n trigrams; those that reach over two words are left out.
    keep = np.ones(len(hashed), bool)
    over = begins[1:] - 2
    keep[np.concatenate([over, over + 1])] = False
    return (hashed[keep] % CHAR_BUCKETS).astype(np.int64), np.cumsum(sizes) - sizes


def window_starts(n: int) -> np.ndarray:
    """Where the windows over n words begin: every STRIDE words, until one reaches the end."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE) if n > WINDOW else np.zeros(1, np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Model:
    """Parameters by name, and the words that have vectors of their own (number 0 is any other word)."""

    p: dict[str, np.ndarray]
    words: dict[bytes, int]
    constant: float | None = None
    key: str = ""
    _cache: dict[bytes, int] = field(default_factory=dict, repr=False)
    _table: np.ndarray | None = field(default=None, repr=False)

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """The input vector of each word."""
        own = self.p["word"][[self.words.get(w, 0) for w in words]]
        grams, begins = trigrams(words)
        counts = np.diff(np.append(begins, len(grams)))
        sums = np.add.reduceat(self.p["char"][grams], begins, axis=0)
        return np.concatenate([own, sums / counts[:, None]], axis=1).astype(np.float32)

    def project(self, words: list[bytes]) -> np.ndarray:
        """What both directions' gates get from each word."""
        return self.inputs(words) @ self.p["wx"] + self.p["bx"]

    def numbers(self, words: list[bytes], most: int = 80_000) -> np.ndarray:
        """Rows of the table of projected words. The table grows with new words and starts anew when it is full."""
        cache = self._cache
        if len(cache) > most:
            self.forget()
        known = len(cache)
        out = np.fromiter([cache.setdefault(w, len(cache)) for w in words], np.int64, len(words))
        if len(cache) > known:
            new = self.project(list(cache)[known:] if known else list(cache))
            if self._table is None:
                self._table = np.zeros((0, new.shape[1]), np.float32)
            if len(cache) > len(self._table):
                grown = np.zeros((max(len(cache), 2 * len(self._table)), new.shape[1]), np.float32)
                grown[:known] = self._table[:known]
                self._table = grown
            self._table[known : len(cache)] = new
        return out

    def forget(self) -> None:
        self._cache.clear()
        self._table = None

    def logits(self, projected: np.ndarray, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The score of each window, before the sigmoid. ids, mask: (windows, WINDOW)."""
        n, steps = ids.shape
        out = np.empty((2, steps, n, UNITS), np.float32)
        whole = mask.all(axis=0)
        for d in (0, 1):
            table_, u = projected[:, d * 3 * UNITS : (d + 1) * 3 * UNITS], self.p["uh"][d]
            h = np.zeros((n, UNITS), np.float32)
            for t in range(steps)[:: 1 - 2 * d]:
                x, r = table_[ids[:, t]], h @ u
                gate = _sigmoid(x[:, : 2 * UNITS] + r[:, : 2 * UNITS])
                new = np.tanh(x[:, 2 * UNITS :] + gate[:, UNITS:] * r[:, 2 * UNITS :])
                new += gate[:, :UNITS] * (h - new)
                h = new if whole[t] else np.where(mask[:, t, None], new, h)
                out[d, t] = h
        both = np.concatenate([out[0], out[1]], axis=2)
        scores = np.tanh(both @ self.p["wa"]) @ self.p["va"]
        weights = np.exp(scores - scores.max(axis=0)) * mask.T
        weights /= np.maximum(weights.sum(axis=0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", weights, both)
        return pooled @ self.p["wo"] + self.p["bo"][0]

    def score(self, texts: list[str | None], windows_at_once: int = 1024) -> np.ndarray:
        """The largest window score of each text, 0 to 1."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        best, has_words = np.full(len(texts), -np.inf), np.ones(len(texts), bool)
        at, owners, starts, sizes, flat = 0, [], [], [], []

        def flush() -> None:
            if not owners:
                return
            # A batch without words still has windows, all of them empty.
            numbers = self.numbers([w for ws in flat for w in ws] or [b"\0"])
            ids, mask = _windows(numbers, np.concatenate(starts), np.concatenate(sizes))
            got = np.concatenate([self.logits(self._table, ids[s : s + windows_at_once], mask[s : s + windows_at_once]) for s in range(0, len(ids), windows_at_once)])
            np.maximum.at(best, np.concatenate(owners), got)

        for i, text in enumerate(texts):
            words = words_of(text)
            has_words[i] = bool(words)
            own = window_starts(len(words))
            owners.append(np.full(len(own), i))
            starts.append(own + at)
            sizes.append(np.minimum(len(words) - own, WINDOW))
            flat.append(words)
            at += len(words)
            if at > 60_000:
                flush()
                at, owners, starts, sizes, flat = 0, [], [], [], []
        flush()
        return np.where(has_words, 1 / (1 + np.exp(-best)), 0.0)


def _windows(numbers: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.arange(WINDOW)
    mask = step < sizes[:, None]
    return numbers[np.minimum(starts[:, None] + step, len(numbers) - 1)], mask


# --- training --------------------------------------------------------------


def train(texts: list[str | None], toxic: list[int], weights: tuple[float, float] = (1.0, 1.0), seed: int = 7, steps: int = 240, batch: int = 256) -> Model:
    """A model of the labelled texts. weights: what an example of label 0 and of label 1 counts, to make up for a sample's shares."""
    y = np.array(toxic, np.float32)
    if len(set(toxic)) < 2:
        return Model({}, {}, constant=float(y.mean()) if len(y) else 0.0, key="constant")
    random = np.random.default_rng(seed)
    docs = [words_of(t) for t in texts]
    seen = Counter(w for d in docs for w in set(d))
    vocabulary = {w: i + 1 for i, w in enumerate(sorted(w for w, n in seen.items() if n >= LEAST_DOCS))}
    n_toxic, n = int(y.sum()), len(y)
    gates = 3 * UNITS
    size = WORD_SIZE + CHAR_SIZE
    draw = lambda *shape, scale: (random.standard_normal(shape) * scale).astype(np.float32)
    word = draw(len(vocabulary) + 1, WORD_SIZE, scale=0.1)
    word[0] = 0
    model = Model(
        {
            "word": word, "char": draw(CHAR_BUCKETS, CHAR_SIZE, scale=0.1), "wx": draw(size, 2 * gates, scale=size**-0.5), "bx": np.zeros(2 * gates, np.float32),
            "uh": draw(2, UNITS, gates, scale=UNITS**-0.5), "wa": draw(2 * UNITS, ATTENTION, scale=0.3), "va": draw(ATTENTION, scale=0.5), "wo": draw(2 * UNITS, scale=0.3), "bo": np.zeros(1, np.float32),
        },
        vocabulary,
    )
    names: dict[bytes, int] = {}
    numbers = np.fromiter([names.setdefault(w, len(names)) for d in docs for w in d], np.int64)
    if not len(numbers):
        return Model({}, {}, constant=float(y.mean()), key="constant")
    every = _Words(list(names), vocabulary)
    sizes = np.array([len(d) for d in docs])
    own = [window_starts(s) for s in sizes]
    n_own = np.array([len(o) for o in own])
    first = np.cumsum(n_own) - n_own
    owner = np.repeat(np.arange(n), n_own)
    ids, mask = _windows(numbers, np.concatenate(own) + (np.cumsum(sizes) - sizes)[owner], np.minimum(sizes[owner] - np.concatenate(own), WINDOW))
    chosen: np.ndarray | None = None
    adam = _Adam(model.p, min(max(1.0, DECAY / n), MOST_DECAY))
    rounds = min(max(200_000 // len(ids), ROUNDS[0]), ROUNDS[1])
    mean: dict[str, np.ndarray] = {}
    cost = np.where(y == 1, weights[1], weights[0]).astype(np.float32)
    target = np.where(y == 1, 1 - DOUBT, 0).astype(np.float32)
    truth = np.array([weights[0] * (n - n_toxic), weights[1] * n_toxic])
    for step in range(steps):
        if step and step % max(1, steps // rounds) == 0:
            projected = every.project(model.p)
            got = np.concatenate([model.logits(projected, ids[s : s + 1024], mask[s : s + 1024]) for s in range(0, len(ids), 1024)])
            chosen = _best(got, owner, n)
        if n <= batch:
            pick = np.arange(n)
        else:  # half of each label, with the cost of the other examples that each stands for
            pick = np.concatenate([random.choice(np.nonzero(y == label)[0], batch // 2) for label in (0, 1)])
        share = np.array([np.mean(y[pick] == label) for label in (0, 1)])
        scale = (truth / truth.sum() / share)[y[pick].astype(int)].astype(np.float32) if n > batch else cost[pick] / cost[pick].mean()
        # Some windows of label 0 are any of the text's: all of them have that label.
        at = first[pick] + (random.random(len(pick)) * n_own[pick]).astype(np.int64)
        if chosen is not None:
            at = np.where((y[pick] == 1) | (random.random(len(pick)) < HARD), chosen[pick], at)
        kept = mask[at]
        kept = kept & ((random.random(kept.shape) > 0.2) | (kept.sum(axis=1) < 4)[:, None])
        # Any part of a text of label 0 has label 0: some are cut short, as texts and last windows can be.
        short = (y[pick] == 0) & (random.random(len(pick)) < 0.3)
        kept[short] &= np.arange(WINDOW) < random.integers(1, WINDOW, short.sum())[:, None]
        part = ids[at]
        # So has one of its words again and again, as in worthless pages.
        same = (y[pick] == 0) & (random.random(len(pick)) < 0.1)
        part[same] = part[same, random.integers(0, WINDOW, same.sum())][:, None]
        rate = RATE * (0.5 + 0.5 * np.cos(np.pi * step / steps)) + 0.001
        adam.step(_gradients(model, every, part, kept, target[pick], scale, np.where(random.random(len(every.own)) < (1 if step % 4 == 3 else UNKNOWN), 0, every.own)), rate)
        # The mean of the last steps' parameters is steadier than the last ones.
        if (late := step - (1 - LATE) * steps) >= 0:
            if not mean:
                mean.update({k: np.zeros(v.shape, np.float64) for k, v in model.p.items()})
            for k, v in model.p.items():
                mean[k] += (v - mean[k]) / (int(late) + 1)
    model.p = {k: v.astype(np.float32) for k, v in mean.items()}
    if not all(np.isfinite(v).all() for v in model.p.values()):  # nothing was learnt that could score a text
        return Model({}, {}, constant=float(y.mean()), key="constant")
    digest = hashlib.sha256(b"".join(v.tobytes() for v in model.p.values()))
    model.key = digest.hexdigest()
    return model


def _best(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((values, owner))
    return order[np.searchsorted(owner[order], np.arange(n), "right") - 1]


class _Words:
    """The distinct words of a training set, with what their vectors are made of."""

    def __init__(self, words: list[bytes], vocabulary: dict[bytes, int]):
        self.own = np.array([vocabulary.get(w, 0) for w in words])
        self.grams, self.begins = trigrams(words)
        self.counts = np.diff(np.append(self.begins, len(self.grams)))

    def inputs(self, p: dict[str, np.ndarray], some: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        counts = self.counts[some]
        where = np.repeat(self.begins[some] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        grams = self.grams[where]
        owner = np.repeat(np.arange(len(some)), counts)
        sums = np.add.reduceat(p["char"][grams], np.cumsum(counts) - counts, axis=0)
        return np.concatenate([p["word"][(self.own if own is None else own)[some]], sums / counts[:, None]], axis=1).astype(np.float32), grams, owner

    def project(self, p: dict[str, np.ndarray]) -> np.ndarray:
        return self.inputs(p, np.arange(len(self.own)))[0] @ p["wx"] + p["bx"]


def _gradients(model: Model, every: _Words, ids: np.ndarray, mask: np.ndarray, y: np.ndarray, scale: np.ndarray, own: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Of the mean weighted log loss, by backpropagation through time. own: the number of each word's vector, if not its own."""
    own = every.own if own is None else own
    p = model.p
    n, steps = ids.shape
    some, local = np.unique(ids, return_inverse=True)
    local = local.reshape(ids.shape)
    x, grams, gram_owner = every.inputs(p, some, own)
    projected = x @ p["wx"] + p["bx"]
    g3 = 3 * UNITS
    states = np.zeros((2, steps, n, UNITS), np.float32)
    kept: list[list] = [[None] * steps, [None] * steps]
    for d in (0, 1):
        h = np.zeros((n, UNITS), np.float32)
        for t in range(steps)[:: 1 - 2 * d]:
            xt, r = projected[local[:, t], d * g3 : (d + 1) * g3], h @ p["uh"][d]
            gate = _sigmoid(xt[:, : 2 * UNITS] + r[:, : 2 * UNITS])
            z, reset = gate[:, :UNITS], gate[:, UNITS:]
            new = np.tanh(xt[:, 2 * UNITS :] + reset * r[:, 2 * UNITS :])
            m = mask[:, t, None].astype(np.float32)
            kept[d][t] = (h, z, reset, new, r[:, 2 * UNITS :], m)
            h = m * ((1 - z) * new + z * h) + (1 - m) * h
            states[d, t] = h
    both = np.concatenate([states[0], states[1]], axis=2)
    a = np.tanh(both @ p["wa"])
    s = a @ p["va"]
    w = np.exp(s - s.max(axis=0)) * mask.T
    w /= np.maximum(w.sum(axis=0), 1e-9)
    pooled = np.einsum("tn,tnh->nh", w, both)
    logit = pooled @ p["wo"] + p["bo"][0]
    score = _sigmoid(logit)
    d_logit = (score - y) * scale / n
    g = {"wo": pooled.T @ d_logit, "bo": np.array([d_logit.sum()], np.float32)}
    d_pooled = d_logit[:, None] * p["wo"]
    d_both = w[:, :, None] * d_pooled
    d_w = np.einsum("nh,tnh->tn", d_pooled, both)
    d_s = w * (d_w - (w * d_w).sum(axis=0))
    g["va"] = np.einsum("tn,tna->a", d_s, a)
    d_a = d_s[:, :, None] * p["va"] * (1 - a * a)
    g["wa"] = np.einsum("tnh,tna->ha", both, d_a)
    d_both = d_both + d_a @ p["wa"].T
    g["uh"] = np.zeros_like(p["uh"])
    d_projected = np.zeros_like(projected)
    for d in (0, 1):
        dh = np.zeros((n, UNITS), np.float32)
        for t in range(steps)[:: 2 * d - 1]:
            h, z, reset, new, rn, m = kept[d][t]
            dh = dh + d_both[t, :, d * UNITS : (d + 1) * UNITS]
            dm = dh * m
            d_new = dm * (1 - z) * (1 - new * new)
            d_z = dm * (h - new) * z * (1 - z)
            d_reset = d_new * rn * reset * (1 - reset)
            d_gate = np.concatenate([d_z, d_reset, d_new], axis=1)
            d_r = np.concatenate([d_z, d_reset, d_new * reset], axis=1)
            g["uh"][d] += h.T @ d_r
            np.add.at(d_projected[:, d * g3 : (d + 1) * g3], local[:, t], d_gate)
            dh = dh * (1 - m) + dm * z + d_r @ p["uh"][d].T
    g["wx"], g["bx"] = x.T @ d_projected, d_projected.sum(axis=0)
    d_x = d_projected @ p["wx"].T
    g["word"] = np.zeros_like(p["word"])
    np.add.at(g["word"], own[some], d_x[:, :WORD_SIZE])
    g["word"][0] = 0
    g["char"] = np.zeros_like(p["char"])
    np.add.at(g["char"], grams, (d_x[:, WORD_SIZE:] / every.counts[some][:, None])[gram_owner])
    return g


class _Adam:
    def __init__(self, p: dict[str, np.ndarray], decay: float):
        self.p, self.t, self.decay = p, 0, decay
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        shrink = min(1.0, 1.0 / max(norm, 1e-9))
        for k, x in g.items():
            x = x * shrink
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.01 * (x * x - self.v[k])
            if k in ("word", "char"):
                self.p[k] *= max(0.0, 1 - self.decay * rate)
            self.p[k] -= (rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-7)).astype(np.float32)


# --- operators -------------------------------------------------------------


def remainder(key: str, by: int) -> Column:
    return F.crc32(F.encode(F.col(key).cast("string"), "utf-8")) % by


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", held_out: tuple[int, int] | None = (4, 2), max_docs: int = 1500, max_bytes: int = 24 << 20) -> Model:
    """A model of the labelled documents, but for those whose crc32(key) mod held_out[0] is held_out[1].

    The sample is at most max_docs of each label, the first by a hash of the key,
    and of each label's at most half of max_bytes of text: a text that no longer
    fits is left out, those after it that do are not. Its size is the only thing that the corpus does not decide. Of several
    texts of one id it takes the least.
    """
    known = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).where("_k is not null and _y in (0, 1)")
    if held_out:
        known = known.where(remainder("_k", held_out[0]) != held_out[1])
    counts = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    sample = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_k"), "_k").limit(max_docs) for y in (0, 1)]
    picked = sample[0].union(sample[1]).collect()
    if not picked:
        return Model({}, {}, constant=0.0, key="constant")
    ids = docs.sparkSession.createDataFrame([(r["_k"], r["_y"]) for r in picked], known.schema)
    texts_ = docs.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t")).join(F.broadcast(ids), "_k").groupBy("_k", "_y").agg(F.min("_t").alias("_t"))
    # At most 2 * max_docs rows, one for each id and label; their lengths decide which texts come to the driver.
    held = written(texts_, "labelled-texts")
    sizes = held.select("_k", "_y", F.coalesce(F.octet_length("_t"), F.lit(0)).alias("_n"), F.xxhash64("_k").alias("_o")).collect()
    room, fits = {0: max_bytes // 2, 1: max_bytes // 2}, []
    for r in sorted(sizes, key=lambda r: (r["_o"], r["_k"], r["_y"])):
        if r["_n"] <= room[r["_y"]]:
            room[r["_y"]] -= r["_n"]
            fits.append((r["_k"], r["_y"]))
    if not fits:
        return Model({}, {}, constant=0.0, key="constant")
    rows = held.join(F.broadcast(docs.sparkSession.createDataFrame(fits, known.schema)), ["_k", "_y"]).select("_k", "_y", "_t", F.xxhash64("_k").alias("_o"))
    got = sorted(rows.collect(), key=lambda r: (r["_o"], r["_k"], r["_y"]))
    texts, labels_ = [r["_t"] for r in got], [r["_y"] for r in got]
    here = Counter(labels_)
    return train(texts, labels_, tuple(counts.get(y, 0) / max(1, here[y]) for y in (0, 1)))


def score_texts(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """The documents with the score of their whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for batch in batches:
            yield pd.Series(model.score(list(batch)).astype(float))
        model.forget()  # a worker that goes on to other work should not keep the table

    return docs.withColumn(into, scores(F.col(text)))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score, learnt from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    scored = score_texts(docs.withColumn("text", text_or_empty("text")), model)
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
