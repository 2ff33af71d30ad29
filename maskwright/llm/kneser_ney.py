"""Interpolated modified Kneser-Ney n-grams, counted in Spark and kept as sorted arrays.

A text is the sequence of its words and one end; a start stands before it as
context. Words are first counted by 64-bit hashes and numbered, frequent ones
first. Counting then goes down the orders: the n-grams of all texts are summed;
every distinct n-gram counts once for its suffix, and so on to single words.
Places before a text's start are filled with a word that is none: such n-grams
are not counted, they bring the shorter ones that begin a text, which nothing
precedes, down to their order with their own count.

N-grams travel as packed arrays of numbers, one for a bucket and a task, already
summed, sorted and compressed there. A bucket is found from the n-gram's words up
to the first that is not very frequent, so that a context's sums are complete in
one bucket; only contexts of nothing but very frequent words are dealt by the
whole n-gram, and their sums are added in a second step. A word is very frequent if
it stands once in 8 * `hot_share` bytes of text, so there are at most so many such
words, and an eighth as often as a bucket has words.

Each bucket ends as a tree in a file of the shared folder: the first words in order,
for each the second words, and so on; counts in one byte, larger ones apart. A
context's sums follow from the counts under it and are kept only where those are
many. Scoring tasks map these files into memory and search them; nothing of
the model but the files' directory and the discounts goes through the driver.

Nulls count as empty texts, which are one end. Texts of any length are one
sequence. Repeated rows count as often as they stand there. A table without
training texts gives the uniform model over no words. Ids of null learn. Empty
tables give empty results. Input columns pass through; one with the name of a
result gives way to it.
"""

from __future__ import annotations

import os
import pickle
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_columns, mounted, shared_path, table, text_or_empty

END, START = (np.uint64(xxhash.xxh64_intdigest(name, 42)) for name in (b" end", b" start"))  # no word has a space
#: Numbers: the word that is none, the start, the first of the words.
NO_WORD, START_ID, FIRST_ID = 0, 1, 2
#: A context's sums are kept if it has more n-grams.
FEW = 8
#: So many words or more that are looked for in one range are searched together.
MANY = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BLOBS = "kind string, level int, bucket long, words binary, counts binary"
_COLUMNS = ["kind", "level", "bucket", "words", "counts"]


def _stirred(h: np.ndarray | np.uint64, c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = (h ^ (h >> np.uint64(29))) * _ODD + c.astype(np.uint64)
        return (out ^ (out >> np.uint64(32))) * _MIX


def gram_hash(columns: Iterable[np.ndarray]) -> np.ndarray:
    """One hash for the words of each row, in order."""
    out: np.ndarray | np.uint64 = np.uint64(0)
    for c in columns:
        out = _stirred(out, c)
    return out


def _words(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' words as places among the different ones, how many each text has, and the different ones' hashes."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array([t or "" for t in texts], pa.large_string())))
    coded = split.flatten().dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in names), np.uint64, len(names))
    codes = coded.indices.to_numpy()
    # White space at a text's ends leaves an empty word there.
    real = codes != pc.index(coded.dictionary, pa.scalar("", pa.large_string())).as_py()
    return codes[real], np.diff(np.append(0, np.cumsum(real))[split.offsets.to_numpy()]), hashes


def sequences(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' words, with start and end, in one array, as places in the last one; each position's place in its text (0: start); the different words' hashes, after those of start and end."""
    codes, sizes, hashes = _words(texts)
    pa.default_memory_pool().release_unused()
    sizes = sizes + 2
    begin = np.cumsum(sizes) - sizes
    flat, body = np.ones(sizes.sum(), np.int32), np.ones(sizes.sum(), bool)
    flat[begin] = 0
    body[begin] = body[begin + sizes - 1] = False
    flat[body] = codes + 2
    return flat, np.arange(len(flat)) - np.repeat(begin, sizes), np.append([START, END], hashes)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _keys(columns: list[np.ndarray]) -> np.ndarray | None:
    """A number for each row, in the order of the rows; none where 64 bits are too few even for the places of the columns' values among their own."""
    columns = list(columns)
    bits = [int(c.max(initial=0)).bit_length() for c in columns]
    for i, c in enumerate(columns):
        if sum(bits) <= 64:
            break
        codes, values = pd.factorize(c)
        rank = np.empty(len(values), np.uint32)
        rank[np.argsort(values)] = np.arange(len(values))
        columns[i], bits[i] = rank[codes], len(values).bit_length()
    if sum(bits) > 64:
        return None
    packed = columns[0].astype(np.uint64)
    for c, n in zip(columns[1:], bits[1:], strict=True):
        packed <<= np.uint64(n)
        packed |= c.astype(np.uint64)
    return packed


def ordered(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows by their columns, and in it where each of the different rows begins."""
    keys = _keys(columns)
    if keys is None:
        order = np.lexsort(columns[::-1])
        return order, np.flatnonzero(_starts(*(c[order] for c in columns)))
    order = np.argsort(keys)
    return order, np.flatnonzero(_starts(keys[order]))


def summed(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows as one with the sum of their counts, in order."""
    order, first = ordered(columns)
    rows = order[first]
    return [c[rows] for c in columns], np.add.reduceat(counts[order], first) if len(first) else counts


def tallied(columns: list[np.ndarray], n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows of numbers below n, equal ones as one with how many they are, in order."""
    bits = np.uint64(n.bit_length())
    if len(columns) * int(bits) > 64:
        return summed(columns, np.ones(len(columns[0]), np.int64))
    keys = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        keys <<= bits
        keys |= c.astype(np.uint64)
    keys.sort()
    first = np.flatnonzero(_starts(keys))
    counts, keys, mask = np.diff(np.append(first, len(keys))), keys[first], (np.uint64(1) << bits) - np.uint64(1)
    return [keys >> (bits * np.uint64(i)) & mask for i in range(len(columns) - 1, -1, -1)], counts


def _pack(counts: np.ndarray) -> bytes:
    small = counts.max(initial=0) < 256
    return (b"\1" if small else b"\4") + pa.compress(counts.astype(np.uint8 if small else np.uint64).tobytes(), "zstd", asbytes=True)


def _unpack(packed: bytes, n: int) -> np.ndarray:
    kind = np.uint8 if packed[:1] == b"\1" else np.uint64
    return np.frombuffer(pa.decompress(packed[1:], n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind).astype(np.int64)


def _pack_words(columns: list[np.ndarray]) -> bytes:
    """Rows in order: each word as its distance from the one before where the words to its left are the same, byte by byte."""
    if columns[0].dtype == np.uint64:
        return columns[0].tobytes()
    parts, new = [], np.arange(len(columns[0])) == 0
    for c in columns:
        parts.append(np.where(new, c, c - np.roll(c, 1)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())
        new = new | _starts(c)
    return np.int64(len(columns[0])).tobytes() + pa.compress(b"".join(parts), "zstd", asbytes=True)


def _unpack_words(packed: bytes, n: int) -> list[np.ndarray]:
    """n: of columns; 0: one of hashes."""
    if not n:
        return [np.frombuffer(packed, np.uint64)]
    size = int.from_bytes(packed[:8], "little")
    flat = np.frombuffer(pa.decompress(packed[8:], 4 * n * size, "zstd", asbytes=True), np.uint8).reshape(n, 4, size)
    columns, new = [], np.arange(size) == 0
    for part in flat:
        steps = np.ascontiguousarray(part.T).view("<u4").ravel().astype(np.int64)
        total, first = np.cumsum(steps), np.flatnonzero(new)
        columns.append((total - np.repeat(total[first] - steps[first], np.diff(np.append(first, size)))).astype(np.uint32))
        new = new | _starts(columns[-1])
    return columns


@dataclass(frozen=True)
class Deal:
    """Which bucket an n-gram goes to. buckets is a power of two; numbers under hot are of very frequent words."""

    buckets: int
    hot: int = FIRST_ID

    def of_hash(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.buckets.bit_length() + 1)).astype(np.int64) if self.buckets > 1 else np.zeros(len(h), np.int64)

    def of(self, columns: list[np.ndarray]) -> np.ndarray:
        if columns[0].dtype == np.uint64:
            return self.of_hash(columns[0])
        h, more = _stirred(np.uint64(0), columns[0]), np.flatnonzero(columns[0] < self.hot)
        for c in columns[1:]:
            own = c[more]
            h[more] = _stirred(h[more], own)
            more = more[own < self.hot]
        return self.of_hash(h)

    def all_hot(self, columns: list[np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([c < self.hot for c in columns])


def _blobs(level: int, columns: list[np.ndarray], counts: np.ndarray, deal: Deal) -> pd.DataFrame:
    """Different rows, in order, as packed arrays, one for each bucket."""
    bucket = deal.of(columns)
    order = np.argsort(bucket.astype(np.min_scalar_type(deal.buckets)), kind="stable")
    bucket, counts, columns = bucket[order], counts[order], [c[order] for c in columns]
    rows = [("grams", level, b, _pack_words([c[a:e] for c in columns]), _pack(counts[a:e])) for b, a, e in _runs(bucket)]
    return pd.DataFrame(rows, columns=_COLUMNS)


def _joined(words: list[bytes], counts: list[bytes], n: int) -> tuple[list[np.ndarray], np.ndarray]:
    parts = [_unpack_words(w, n) for w in words]
    return [np.concatenate(c) for c in zip(*parts, strict=True)], np.concatenate([_unpack(c, len(p[0])) for c, p in zip(counts, parts, strict=True)])


def _gathered(docs: DataFrame, text: str, order: int, deal: Deal, at_once: int, known: Broadcast | None = None) -> DataFrame:
    """Packed n-grams of the texts, summed over at_once tokens at a time; without known words, the hashes of words and ends (level 0)."""

    def grams(texts: list[str | None], reader: Reader | None) -> pd.DataFrame:
        flat, place, words = sequences(texts)
        ends = np.flatnonzero(place > 0)
        if reader is None:
            counts = np.bincount(flat[ends], minlength=len(words))
            return _blobs(0, *summed([words[counts > 0]], counts[counts > 0]), deal)
        values, rank = np.unique(np.append(np.uint32(NO_WORD), reader.numbered(words)[0]), return_inverse=True)
        own = rank[1:].astype(np.uint32)[flat]
        columns = [np.where(place[ends] >= back, own[np.maximum(ends - back, 0)], rank[0]) for back in range(order - 1, -1, -1)]
        columns, counts = tallied(columns, len(values))
        return _blobs(order, [values[c] for c in columns], counts, deal)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _reader(known.value) if known else None
        waiting, size = [], 0
        for batch in batches:
            for t in batch[text]:
                waiting.append(t)
                size += len(t or "") // 5 + 2
                if size > at_once:
                    yield grams(waiting, reader)
                    waiting, size = [], 0
        if waiting:
            yield grams(waiting, reader)

    return docs.select(text).mapInPandas(rows, BLOBS)


# --- files -----------------------------------------------------------------


def _count_arrays(counts: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Counts in a byte each; of those too large the places, lower and upper halves. And how many those are."""
    large = np.flatnonzero(counts > 254)
    small = np.minimum(counts, 255).astype(np.uint8)
    small = np.append(small, np.zeros(-len(small) % 4, np.uint8)).view(np.uint32)
    return [small, large.astype(np.uint32), *_halves(counts[large])], len(large)


def _halves(x: np.ndarray) -> list[np.ndarray]:
    return [(x & 0xFFFFFFFF).astype(np.uint32), (x >> 32).astype(np.uint32)]


def _word_arrays(words: np.ndarray, counts: np.ndarray) -> tuple[list[np.ndarray], list[int], list[int]]:
    """Arrays and their places: hashes, number within the class, counts. And the sizes of the classes, which double in counts."""
    kind = np.frexp(counts.astype(float))[1]
    order = np.argsort(kind, kind="stable")
    sizes = np.bincount(kind, minlength=64)
    rank = np.empty(len(kind), np.uint32)
    rank[order] = np.arange(len(kind)) - (np.cumsum(sizes) - sizes)[kind[order]]
    tail, large = _count_arrays(counts)
    n = len(words)
    return [words.view(np.uint32), rank, *tail], [0, n, 2 * n, 3 * n, 3 * n + len(tail[0]), large], sizes.tolist()


def _tree_arrays(columns: list[np.ndarray], counts: np.ndarray, hot: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """Arrays and their places: keys of each depth and where their children begin, counts, sums of contexts with many n-grams (hot ones have theirs elsewhere)."""
    arrays, places, at = [], [], 0

    def put(x: np.ndarray) -> None:
        nonlocal at
        arrays.append(x)
        places.append(at)
        at += len(x)

    new = np.zeros(len(counts), bool)
    nodes = []
    for c in columns:
        new = new | _starts(c)
        nodes.append(np.flatnonzero(new))
    for i, c in enumerate(columns):
        put(c[nodes[i]].astype(np.uint32))
        if i + 1 < len(columns):
            put(np.append(np.searchsorted(nodes[i + 1], nodes[i]), len(nodes[i + 1])).astype(np.uint32))
    tail, large = _count_arrays(counts)
    put(tail[0])
    put(np.concatenate(tail[1:]))
    kept = np.zeros(0, np.int64)
    sums = np.zeros((4, 0), np.int64)
    if len(columns) > 1 and len(counts):
        first = nodes[-2]
        sums = np.stack([np.add.reduceat(x.astype(np.int64), first) for x in (counts, counts == 1, counts == 2, counts > 2)])
        kept = np.flatnonzero(((np.diff(np.append(first, len(counts))) > FEW) | (np.maximum.reduceat(counts, first) > 254)) & ~hot[first])
        sums = sums[:, kept]
    put(np.concatenate([kept.astype(np.uint32), *_halves(sums[0]), *(x.astype(np.uint32) for x in sums[1:])]))
    return arrays, [*places, large, len(kept), len(nodes[0])]


@contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffled rows that are written within need not be kept after."""
    before = spark.conf.get(_SHUFFLES)
    spark.conf.set(_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_SHUFFLES, before)


def _merged(blobs: DataFrame, level: int, deal: Deal, folder: str) -> DataFrame:
    """Sums each bucket and writes its arrays. Rows out: the next level's packed n-grams, sums of hot contexts, and what the driver keeps of each bucket."""
    place = mounted(folder)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = f"level{level}-{uuid.uuid4().hex}"
        os.makedirs(place, exist_ok=True)
        at = 0
        with open(os.path.join(place, name), "wb") as file:
            for bucket, group in _groups(batches):
                columns, counts = summed(*_joined(*group, level))
                extra, known = [], {"file": name, "at": at}
                if not level:
                    arrays, known["places"], known["classes"] = _word_arrays(columns[0], counts)
                else:
                    whole = columns[0] != NO_WORD
                    if level > 1:
                        extra.append(_blobs(level - 1, *summed(columns[1:], np.where(whole, 1, counts)), deal))
                    columns, counts = [c[whole] for c in columns], counts[whole]
                    hot = deal.all_hot(columns[:-1]) if level > 1 else np.zeros(len(counts), bool)
                    arrays, known["places"] = _tree_arrays(columns, counts, hot)
                    if hot.any():
                        keys, sums = _context_sums(gram_hash([c[hot] for c in columns[:-1]]), counts[hot])
                        rows = [("hot", level, int(b), keys[s].tobytes(), np.stack([x[s] for x in sums]).tobytes()) for b, s in _by_bucket(deal.of_hash(keys))]
                        extra.append(pd.DataFrame(rows, columns=_COLUMNS))
                data = b"".join(x.tobytes() for x in arrays)
                data += bytes(-len(data) % 8)
                file.write(data)
                known |= {"of": [int((counts == i).sum()) for i in (1, 2, 3, 4)], "more": int((counts > 2).sum()), "total": int(counts.sum()), "distinct": len(counts)}
                at += len(data)
                yield pd.DataFrame([("bucket", level, bucket, pickle.dumps(known), b"")], columns=_COLUMNS)
                yield from extra
            file.flush()
            os.fsync(file.fileno())

    spark = blobs.sparkSession
    own = blobs.where(f"kind = 'grams' and level = {level}").select("bucket", "words", "counts")
    # Packed rows are few bytes, but much work: as many tasks as there are partitions.
    dealt = own.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket").sortWithinPartitions("bucket")
    with _shuffles_end(spark):
        dealt.mapInPandas(rows, BLOBS).write.parquet(f"{folder}/grams{level}")
    return spark.read.schema(BLOBS).parquet(f"{folder}/grams{level}")


def _removed(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, tuple[list[bytes], list[bytes]]]]:
    """The rows of each bucket, from batches sorted by bucket."""
    bucket, words, counts = None, [], []
    for batch in batches:
        for b, w, c in zip(batch["bucket"], batch["words"], batch["counts"], strict=True):
            if b != bucket:
                if words:
                    yield bucket, (words, counts)
                bucket, words, counts = b, [], []
            words.append(w)
            counts.append(c)
    if words:
        yield bucket, (words, counts)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for b in np.unique(bucket):
        yield b, bucket == b


def _context_sums(contexts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each context's sum of counts, and how many n-grams it has that count 1, 2, and more."""
    order = np.argsort(contexts, kind="stable")
    contexts, counts = contexts[order], counts[order]
    first = np.flatnonzero(_starts(contexts))
    return contexts[first], [np.add.reduceat(x.astype(np.uint64), first) for x in (counts, counts == 1, counts == 2, counts > 2)]


# --- the model -------------------------------------------------------------


@dataclass(frozen=True)
class Level:
    """A level's files and where each bucket's arrays stand in them, its totals and its discounts."""

    files: list[str]
    file: np.ndarray
    places: np.ndarray
    total: int
    distinct: int
    of: tuple[int, int, int, int]
    more: int
    #: Of words: the first number of each bucket's classes, and how many words each class has.
    first: np.ndarray | None = None
    classes: np.ndarray | None = None

    @property
    def discounts(self) -> np.ndarray:
        """By count (0, 1, 2, 3 and more), from the counts of counts; where those are too few, half of each count."""
        n1, n2, n3, n4 = self.of
        if not (n1 and n2):
            return np.array([0.0, 0.5, 1.0, 1.5])
        y = n1 / (n1 + 2 * n2)
        d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        return np.array([0.0, *(min(max(x, 0.0), float(k)) if x == x else 0.0 for k, x in enumerate(d, 1))])


@dataclass(frozen=True)
class NGrams:
    """What a worker needs to find the model's files and use them. levels[0] has the words' own counts, levels[k] the n-grams of k words."""

    order: int
    folder: str
    deal: Deal
    levels: tuple[Level, ...]
    hot: dict[int, dict[int, dict]]
    key: str

    @property
    def tokens(self) -> int:
        return self.levels[0].total

    @property
    def types(self) -> int:
        return self.levels[0].distinct


def count_ngrams(docs: DataFrame, text: str = "text", order: int = 2, bucket_bytes: int = 8 << 20, hot_share: int = 4096, at_once: int = 2_000_000) -> NGrams:
    """The model of all texts of docs. bucket_bytes: of text for each bucket, which bounds what one bucket takes in memory."""
    spark = docs.sparkSession
    folder = shared_path(spark, "ngrams")
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    deal = Deal(1 << max(2, int(size // bucket_bytes).bit_length()))
    words = _level(_merged(_gathered(docs, text, 0, deal, at_once), 0, deal, folder), 0, deal)
    _removed(spark, f"{folder}/grams0")
    if words.distinct + FIRST_ID + 1 >= 1 << 32:
        raise ValueError(f"{words.distinct} distinct words: their numbers don't fit 32 bits")
    frequent = max(bucket_bytes // 64, size // (8 * hot_share)) + 1
    # Words of class i are counted 2 ** (i - 1) times at least.
    deal = replace(deal, hot=FIRST_ID + int(words.classes[(frequent - 1).bit_length() + 1 :].sum()))
    model = NGrams(order, mounted(folder), deal, (words,), {}, uuid.uuid4().hex)
    rest = _gathered(docs, text, order, deal, at_once, spark.sparkContext.broadcast(model))
    levels, hot = [words], {}
    for level in range(order, 0, -1):
        rest = _merged(rest, level, deal, folder)
        levels.insert(1, _level(rest, level, deal))
        if level > 1:
            hot[level] = _hot_contexts(rest, level, folder)
        if level < order:
            _removed(spark, f"{folder}/grams{level + 1}")
    _removed(spark, f"{folder}/grams1")
    return replace(model, levels=tuple(levels), hot=hot, key=uuid.uuid4().hex)


def _level(merged: DataFrame, level: int, deal: Deal) -> Level:
    rows = merged.where(f"kind = 'bucket' and level = {level}").select("bucket", "words").collect()
    known = {r["bucket"]: pickle.loads(r["words"]) for r in sorted(rows, key=lambda r: r["bucket"])}
    add = lambda k: sum(b[k] for b in known.values())
    of = tuple(sum(b["of"][i] for b in known.values()) for i in range(4))
    files = sorted({b["file"] for b in known.values()})
    at = {name: i for i, name in enumerate(files)}
    file = np.full(deal.buckets, -1, np.int64)
    # Places are of 32-bit values in the file; the last ones (three of a tree, one of words) and the words' second are sizes.
    places = np.zeros((deal.buckets, 6 if not level else 2 * level + 5), np.int64)
    sizes = [1, 5] if not level else [-3, -2, -1]
    for b, k in known.items():
        file[b] = at[k["file"]]
        places[b] = k["places"]
        moved = np.ones(places.shape[1], bool)
        moved[sizes] = False
        places[b, moved] += k["at"] // 4
    out = Level(files, file, places, add("total"), add("distinct"), of, add("more"))
    if level:
        return out
    by = np.zeros((deal.buckets, 64), np.int64)
    for b, k in known.items():
        by[b] = k["classes"]
    # Frequent classes first, in each the buckets in order.
    line = by[:, ::-1].T.ravel()
    first = (np.cumsum(line) - line + FIRST_ID).reshape(64, -1).T[:, ::-1]
    return replace(out, first=np.ascontiguousarray(first), classes=by.sum(axis=0))


def _hot_contexts(merged: DataFrame, level: int, folder: str) -> dict[int, dict]:
    """Adds up the sums of hot contexts and writes them, sorted by their hash."""
    place = mounted(folder)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = f"hot{level}-{uuid.uuid4().hex}"
        os.makedirs(place, exist_ok=True)
        at = 0
        with open(os.path.join(place, name), "wb") as file:
            for bucket, (keys, sums) in _groups(batches):
                k = np.concatenate([np.frombuffer(x, np.uint64) for x in keys])
                s = np.concatenate([np.frombuffer(x, np.uint64).reshape(4, -1) for x in sums], axis=1)
                order = np.argsort(k, kind="stable")
                k, s = k[order], s[:, order]
                first = np.flatnonzero(_starts(k))
                data = k[first].tobytes() + np.add.reduceat(s, first, axis=1).tobytes()
                file.write(data)
                yield pd.DataFrame([("bucket", level, bucket, pickle.dumps({"file": name, "at": at // 8, "n": len(first)}), b"")], columns=_COLUMNS)
                at += len(data)
            file.flush()
            os.fsync(file.fileno())

    own = merged.where(f"kind = 'hot' and level = {level}").select("bucket", "words", "counts")
    found = own.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(rows, BLOBS).collect()
    return {r["bucket"]: pickle.loads(r["words"]) for r in found}


class Reader:
    """The model's arrays, mapped into memory."""

    def __init__(self, model: NGrams):
        self.model = model
        self.files: dict[str, np.ndarray] = {}
        self.discounts = [level.discounts for level in model.levels]
        #: Of each level, each of the places for all buckets.
        self.places = [np.ascontiguousarray(level.places.T) for level in model.levels]
        #: Of each level, the buckets' order by files. Small numbers are sorted faster.
        self.lines = [np.argsort(np.argsort(level.file, kind="stable")).astype(np.min_scalar_type(len(level.file))) for level in model.levels]

    def _file(self, name: str, kind: type = np.uint32) -> np.ndarray:
        if name not in self.files:
            self.files[name] = np.memmap(os.path.join(self.model.folder, name), np.uint8, "r")
        return np.asarray(self.files[name]).view(kind)

    def _counts(self, file: str, at: np.ndarray, start: np.ndarray, large: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The counts at these places; start: of the counts, large, n: places and number of the large ones."""
        out = self._file(file, np.uint8)[4 * start + at].astype(np.int64)
        some = np.flatnonzero(out == 255)
        if len(some):
            whole, n = self._file(file), n[some]
            found, _ = _find(whole, large[some], large[some] + n, at[some])
            out[some] = _whole(whole, found + n, found + 2 * n)
        return out

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of sorted hashes; the number after the last one for unknown words."""
        level = self.model.levels[0]
        ids, counts = np.full(len(hashes), FIRST_ID + level.distinct, np.int64), np.zeros(len(hashes), np.int64)
        bucket = self.model.deal.of_hash(hashes)
        for f, own in _by_bucket(level.file[bucket]):
            if f < 0:
                continue
            own = np.flatnonzero(own)
            whole, b = self._file(level.files[f]), bucket[own]
            keys, n, rank, small, large, m = self.places[0][:, b]
            found, hit = _find(self._file(level.files[f], np.uint64), keys // 2, keys // 2 + n, hashes[own])
            at = (found - keys // 2)[hit]
            c = self._counts(level.files[f], at, small[hit], large[hit], m[hit])
            counts[own[hit]] = c
            ids[own[hit]] = level.first[b[hit], np.frexp(c.astype(float))[1]] + whole[rank[hit] + at]
        return ids, counts

    def numbered(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each of these hashes, the first of which is the start, and its count in training."""
        order = np.argsort(words)
        ids, counts = np.zeros(len(words), np.uint32), np.zeros(len(words), np.int64)
        ids[order], counts[order] = self.words(words[order])
        ids[0] = START_ID
        return ids, counts

    def search(self, k: int, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of different n-grams in order: each one's count, and its context's sum of counts and what discounts take from it: (2, n)."""
        level, deal = self.model.levels[k], self.model.deal
        bucket = deal.of(columns)
        order = np.argsort(self.lines[k][bucket], kind="stable")
        columns, bucket = [c[order] for c in columns], bucket[order]
        counts, sums = np.zeros(len(order), np.int64), np.zeros((2, len(order)))
        for f, a, e in _runs(level.file[bucket]):
            if f >= 0:
                counts[order[a:e]], sums[:, order[a:e]] = self._descend(k, level.files[f], [c[a:e] for c in columns], bucket[a:e])
        hot = np.flatnonzero(deal.all_hot(columns[:-1])) if k > 1 else []
        if len(hot):
            keys, back = np.unique(gram_hash([c[hot] for c in columns[:-1]]), return_inverse=True)
            sums[:, order[hot]] = self._taken(k, self._hot_sums(self.model.hot[k], keys))[:, back]
        return counts, sums

    def _taken(self, k: int, sums: np.ndarray) -> np.ndarray:
        """A sum of counts and what is discounted, from the sum and the n-grams that count 1, 2 and more."""
        return np.stack([sums[0], self.discounts[k][1:] @ sums[1:]])

    def _descend(self, k: int, file: str, columns: list[np.ndarray], bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of different n-grams sorted by bucket and words: what several have in common is searched once."""
        whole, places = self._file(file), self.places[k]
        new = _starts(bucket, columns[0])
        first, group = np.flatnonzero(new), np.cumsum(new) - 1
        own = bucket[first]
        lo = places[0][own]
        hi = lo + places[-1][own]
        sums = np.zeros((2, len(bucket)))
        for depth in range(k):
            found, hit = _find(whole, lo, hi, columns[depth][first])
            at = np.where(hit, found - places[2 * depth][own], 0)
            if depth == k - 1:
                break
            begin = places[2 * depth + 1][own] + at
            lo, hi = (np.where(hit, whole[begin + i].astype(np.int64), 0) for i in (0, 1))
            parent = group
            if depth == k - 2:
                sums = self._taken(k, self._sums(file, places, own, at, lo, hi))[:, group]
                first = slice(None)
            else:
                new = new | _starts(columns[depth + 1])
                first = np.flatnonzero(new)
                parent, group = group[first], np.cumsum(new) - 1
            own = own[parent]
            lo, hi = lo[parent] + places[2 * depth + 2][own], hi[parent] + places[2 * depth + 2][own]
        counts = np.zeros(len(own), np.int64)
        own = own[hit]
        counts[hit] = self._counts(file, at[hit], places[2 * k - 1][own], places[2 * k][own], places[-3][own])
        return counts, sums

    def _sums(self, file: str, places: np.ndarray, bucket: np.ndarray, context: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The sums of contexts whose n-grams are from lo to hi."""
        whole, small = self._file(file), self._file(file, np.uint8)
        out = np.zeros((4, len(lo)), np.int64)
        many = hi - lo > FEW
        own = np.flatnonzero(~many & (hi > lo))
        at, left = 4 * places[-6][bucket[own]] + lo[own], (hi - lo)[own]
        while len(own):
            c = small[at]
            out[0, own] += c
            out[np.minimum(c, 3), own] += 1
            many[own[c == 255]] = True
            more = left > 1
            own, at, left = own[more], at[more] + 1, left[more] - 1
        some = np.flatnonzero(many)
        if len(some):
            start, n = places[-4][bucket[some]], places[-2][bucket[some]]
            found, hit = _find(whole, start, start + n, context[some])
            some, found, n = some[hit], found[hit], n[hit]
            out[0, some] = _whole(whole, found + n, found + 2 * n)
            for i in (1, 2, 3):
                out[i, some] = whole[found + (2 + i) * n]
        return out

    def _hot_sums(self, known: dict[int, dict], keys: np.ndarray) -> np.ndarray:
        out = np.zeros((4, len(keys)), np.int64)
        for b, a, e in _runs(self.model.deal.of_hash(keys)):
            if b in known:
                n, whole = known[b]["n"], self._file(known[b]["file"], np.uint64)[known[b]["at"] :]
                at = np.minimum(np.searchsorted(whole[:n], keys[a:e]), n - 1)
                hit = whole[at] == keys[a:e]
                out[:, a:e][:, hit] = whole[n : 5 * n].reshape(4, n)[:, at[hit]]
        return out

    def probabilities(self, flat: np.ndarray, place: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The probability of every word but the starts after the words before it, and the count of each word in training."""
        model = self.model
        ends = np.flatnonzero(place > 0)
        ids, known = self.numbered(words)
        # The texts' own words by their places among them: few bits for each.
        values, rank = np.unique(ids, return_inverse=True)
        own = rank.astype(np.uint32)[flat]
        p = self._lowest(self.search(1, [values])[0])[own[ends]]
        unknown = np.searchsorted(values, FIRST_ID + model.types)
        for k in range(2, model.order + 1):
            deep = np.flatnonzero(place[ends] >= k - 1)
            columns = [own[ends[deep] - k + 1 + i] for i in range(k)]
            seen = np.logical_and.reduce([c < unknown for c in columns[:-1]])
            if not seen.all():
                deep, columns = deep[seen], [c[seen] for c in columns]
            if not len(deep):
                continue
            # Equal n-grams have one probability.
            order, first = ordered(columns)
            deep, once = deep[order], order[first]
            counts, sums = self.search(k, [values[c[once]] for c in columns])
            total, low = np.maximum(sums[0], 1), p[deep[first]]
            d = self.discounts[k]
            direct = np.maximum(counts - d[np.minimum(counts, 3)], 0)
            p[deep] = np.repeat(np.where(sums[0] > 0, (direct + sums[1] * low) / total, low), np.diff(np.append(first, len(deep))))
        return p, known[flat[ends]]

    def _lowest(self, counts: np.ndarray) -> np.ndarray:
        """Of single words: how many words they follow, discounted; the rest is shared by all words and one unknown."""
        level, d = self.model.levels[1], self.discounts[1]
        if not level.total:
            return np.full(len(counts), 1.0 / (self.model.types + 1))
        left = (d[1] * level.of[0] + d[2] * level.of[1] + d[3] * level.more) / level.total
        return np.maximum(counts - d[np.minimum(counts, 3)], 0) / level.total + left / (self.model.types + 1)


def _runs(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    cuts = np.flatnonzero(_starts(bucket))
    for a, e in zip(cuts, np.append(cuts[1:], len(bucket)), strict=True):
        yield int(bucket[a]), int(a), int(e)


def _whole(array: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    return array[lower].astype(np.int64) | (array[upper].astype(np.int64) << 32)


def _find(array: np.ndarray, lo: np.ndarray, hi: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of q stands between its lo and hi, where the array is sorted, and whether it does. Neighbours of one range are searched together."""
    q, at, last = q.astype(array.dtype), lo.copy(), len(array) - 1
    first = np.flatnonzero(_starts(lo, hi))
    sizes = np.diff(np.append(first, len(lo)))
    many = sizes >= MANY
    for a, n in zip(first[many].tolist(), sizes[many].tolist(), strict=True):
        at[a : a + n] += np.searchsorted(array[lo[a] : hi[a]], q[a : a + n])
    own = np.flatnonzero((hi > lo) & np.repeat(~many, sizes))
    now, left, own_q = lo[own], (hi - lo)[own], q[own]
    while len(own):
        # Half of what is left is passed over where its last value is too small.
        half = (left + 1) >> 1
        less = array[now + (half - 1)] < own_q
        now += half * less
        left = np.where(less, left - half, np.maximum(half - 1, 0))
        more = left > 0
        if 4 * np.count_nonzero(more) < 3 * len(own):
            at[own] = now
            own, now, left, own_q = own[more], now[more], left[more], own_q[more]
    return at, (at < hi) & (array[np.minimum(at, last)] == q)


_readers: dict[str, Reader] = {}


def _reader(model: NGrams) -> Reader:
    if model.key not in _readers:
        _readers.clear()
        _readers[model.key] = Reader(model)
    return _readers[model.key]


def score_texts(docs: DataFrame, model: NGrams, text: str = "text", at_once: int = 1_200_000) -> DataFrame:
    """The rows of docs, text left out, with n_tokens, n_known, base_score and score (log10 of the text's probability) and perplexity."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = [T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known")] + [T.StructField(n, T.DoubleType()) for n in ("base_score", "score", "perplexity")]
    kept = [f for f in docs.schema.fields if f.name != text and f.name.lower() not in {n.name for n in new}]
    names = [f.name for f in kept]

    def of(reader: Reader, texts: list[str | None]) -> np.ndarray:
        flat, place, words = sequences(texts)
        p, known = reader.probabilities(flat, place, words)
        n, types = reader.model.tokens, reader.model.types
        cuts = np.flatnonzero(place == 0)
        cuts = cuts - np.arange(len(cuts))
        logs = np.stack([np.ones(len(p)), known > 0, np.log10((known + 1) / (n + types + 1)), np.log10(p)])
        return np.add.reduceat(logs, cuts, axis=1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        reader = _reader(shared.value)
        for batch in batches:
            parts, waiting, size = [], [], 0
            for t in batch[text].to_pylist():
                waiting.append(t)
                size += len(t or "") // 5 + 2
                if size > at_once:
                    parts.append(of(reader, waiting))
                    waiting, size = [], 0
            if waiting:
                parts.append(of(reader, waiting))
            got = np.concatenate(parts, axis=1) if parts else np.zeros((4, 0))
            yield {**{n: batch[n] for n in names}, "n_tokens": got[0].astype(np.int64), "n_known": got[1].astype(np.int64), "base_score": got[2], "score": got[3], "perplexity": 10 ** (-got[3] / np.maximum(got[0], 1))}

    return map_columns(docs.select(*names, text), rows, T.StructType([*kept, *new]))


def held_out(key: str, by: int = 7, at: int = 2) -> Column:
    return F.coalesce(F.crc32(F.encode(F.col(key).cast("string"), "utf-8")) % by == at, F.lit(False))


#: The registered query's: contexts of two words.
QUERY_ORDER = 3


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score under the model of those that are not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", text_or_empty("text").alias("text"))
    model = count_ngrams(docs.where(~held_out("doc_id")), order=QUERY_ORDER)
    scored = score_texts(docs, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
