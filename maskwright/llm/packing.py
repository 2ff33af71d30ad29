"""Packing of tokenised documents into sequences of one length, by Karmarkar-Karp differencing.

Each task takes its documents as they come, in groups of some GROUP_WINDOWS windows
of tokens. Documents over the capacity are cut into full windows and a rest. The
rests of a group are divided by multiway differencing: the two partial partitions
with the largest imbalance are merged so that the largest part of one meets the
smallest of the other, until one partition is left, whose windows are nearly equal.
If a window is over the capacity there, the number of windows rises by one and the
group is divided anew.

Near-equal windows leave some room each. Where documents may be cut, the emptiest
windows are taken apart again and fill the room of the others, which are then full;
what is left of a group goes into sequences whose lengths are powers of two, as
those need no padding. Most documents stay whole.

One pass over the texts, no shuffle; a task holds one batch of texts, one group and a bounded
store of words already tokenised. Sequence numbers are unique, as they begin with
the task's number; they depend on how the table is divided into tasks.

A null text is an empty one: its document has the end token only. Texts of any
length are tokenised whole; text is cut where the tokenizer itself always cuts.
Repeated rows and ids are documents of their own, null ids stay null. Ties go by place in the group. An
empty table gives no pieces. Only the key is carried, other columns are not, whatever their names.
"""

from __future__ import annotations

import heapq
import os
import re
from array import array
from collections.abc import Iterator, Sequence
from itertools import islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_columns, table

CAPACITY, END = 2048, 1
#: Of one group: windows of tokens, and documents.
GROUP_WINDOWS, GROUP_DOCS = 64, 4096

#: (document, start, length)
Piece = tuple[int, int, int]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# --- tokens ----------------------------------------------------------------

#: White space as the tokenizer's own pattern has it. Pieces of a text begin where that pattern begins a match: at the last of some white space before a word.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(rf"[{_SPACE}]?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: The tokenizer's own pattern: fixed values.
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: The characters by which byte-level vocabularies show bytes: printable ones as they are, the others from 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SHOWN = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class _Known(dict):
    """The ids of short pieces of text. What isn't there is made, of the older half of what was known if it can be."""

    def __init__(self, model, longest: int, older: dict[str, bytes]):
        self.model, self.longest, self.older = model, longest, older

    def __missing__(self, chunk: str) -> bytes:
        found = self.older.get(chunk) or self._made(chunk)
        if len(chunk) <= self.longest:
            self[chunk] = found
        return found

    def _made(self, chunk: str) -> bytes:
        # Letters alone, after a space or not, are one word; else words are told by the tokenizer's own pattern.
        if not (chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()) and (chunk.isascii() or max(chunk) < "\u02b0")):
            words = _WORD.findall(chunk)
            if len(words) > 1:
                return b"".join(map(self.__getitem__, words))
        return array("I", [t.id for t in self.model.tokenize(chunk.encode().decode("latin-1").translate(_SHOWN))]).tobytes()


class Encoder:
    """Token ids as little-endian 32-bit numbers, by a byte-level tokenizer with that pattern. What short pieces of text give is kept, as words come again and again: the pieces seen lately, in two halves, the older of which goes when the newer is full."""

    def __init__(self, path: str, most: int = 2_400_000, longest: int = 48, at_once: int = 1 << 16):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        marks = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = re.compile(f"({'|'.join(marks)})") if marks else None
        self.model = self.tokenizer.model
        self.most, self.longest, self.at_once = most, longest, at_once
        self.known = _Known(self.model, longest, {})

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if self.marks and len(parts := self.marks.split(text)) > 1:  # the tokenizer takes its own marks out first
            return b"".join(self._encode(p) if i % 2 else self._plain(p) for i, p in enumerate(parts))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if len(self.known) > self.most // 2:
            self.known = _Known(self.model, self.longest, dict(self.known))
        if len(text) < 8 * self.at_once:
            return b"".join(map(self.known.__getitem__, _CHUNK.findall(text)))
        found, out = (m.group() for m in _CHUNK.finditer(text)), []
        while some := list(islice(found, self.at_once)):
            out.append(b"".join(map(self.known.__getitem__, some)))
        return b"".join(out)


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """A worker's own, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# --- differencing ----------------------------------------------------------


def _merged(a: list, b: list, k: int) -> list:
    """Two partial partitions, each largest part first and without its empty parts, as one: the largest of one meets the smallest of the other."""
    if len(a) + len(b) <= k:
        out = a + b
    else:
        meet = zip(a[k - len(b) :], reversed(b[k - len(a) :]), strict=True)
        out = a[: k - len(b)] + b[: k - len(a)] + [(x + y, xs + ys) for (x, xs), (y, ys) in meet]
    out.sort(key=itemgetter(0), reverse=True)
    return out


def differenced(sizes: Sequence[int], k: int) -> list[tuple[int, list[int]]]:
    """k or fewer windows (sum, places of sizes) of nearly equal sums, largest first; windows without anything are left out."""
    heap = [(-size, i, [(size, [i])]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, first, a = heapq.heappop(heap)
        _, second, b = heapq.heappop(heap)
        parts = _merged(a, b, k)
        heapq.heappush(heap, (-(parts[0][0] - (parts[-1][0] if len(parts) == k else 0)), min(first, second), parts))
    return heap[0][2] if heap else []


def divided(sizes: Sequence[int], capacity: int) -> list[tuple[int, list[int]]]:
    """As few windows as differencing gets under the capacity: their number rises whenever one is over it. No size is over it itself."""
    k = -(-sum(sizes) // capacity)
    while (windows := differenced(sizes, max(1, k))) and windows[0][0] > capacity:
        k += 1
    return windows


def packed(lengths: Sequence[int], capacity: int = CAPACITY, cut: bool = True) -> list[list[Piece]]:
    """The sequences of documents with these numbers of tokens, each a list of pieces in order."""
    sequences = [[(doc, start, capacity)] for doc, n in enumerate(lengths) for start in range(0, n - capacity + 1, capacity)]
    rests = [(doc, n - n % capacity, n % capacity) for doc, n in enumerate(lengths) if n % capacity]
    windows = [(total, [rests[i] for i in members]) for total, members in divided([r[2] for r in rests], capacity)]
    if not cut:
        return sequences + [pieces for _, pieces in windows]
    full, left = divmod(sum(total for total, _ in windows), capacity)
    loose = [p for _, pieces in windows[full:] for p in pieces][::-1]

    def filled(pieces: list[Piece], room: int) -> list[Piece]:
        while room:
            doc, start, length = loose.pop()
            if length > room:
                loose.append((doc, start + room, length - room))
                length = room
            pieces.append((doc, start, length))
            room -= length
        return pieces

    sequences += [filled(pieces, capacity - total) for total, pieces in windows[:full]]
    return sequences + [filled([], 1 << bit) for bit in range(left.bit_length() - 1, -1, -1) if left >> bit & 1]


def padding(length: int, capacity: int = CAPACITY) -> int:
    """What a sequence lacks: nothing at a power of two."""
    return 0 if length & (length - 1) == 0 else capacity - length


# --- on frames -------------------------------------------------------------


def pack(docs: DataFrame, key: str, text: str, tokenizer: str, capacity: int = CAPACITY, end: int = END, cut: bool = True) -> DataFrame:
    """(key, start, length, ids, doc_tokens, sequence_id, offset) of every piece. ids: the piece's token ids, 4 bytes each, lowest first. The tokenizer's file must be where the workers are."""
    kind = docs.schema[key].dataType.simpleString()
    last = np.array([end], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder = _encoder(tokenizer)
        number = TaskContext.get().partitionId() << 40
        keys, tokens, n = [], [], 0

        def group() -> dict:
            nonlocal number, n
            sequences = packed([len(t) // 4 for t in tokens], capacity, cut)
            rows = [(doc, start, length, number + i) for i, pieces in enumerate(sequences) for doc, start, length in pieces]
            out = {
                "key": pa.array([keys[r[0]] for r in rows], key_type), "start": [r[1] for r in rows], "length": [r[2] for r in rows], "ids": [tokens[r[0]][4 * r[1] : 4 * (r[1] + r[2])] for r in rows],
                "doc_tokens": [len(tokens[r[0]]) // 4 for r in rows], "sequence_id": [r[3] for r in rows], "offset": [at for pieces in sequences for at in _offsets(pieces)],
            }
            number += len(sequences)
            keys.clear()
            tokens.clear()
            n = 0
            return out

        for b in batches:
            key_type = b.column(0).type
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys.append(k)
                tokens.append(encoder.ids(t or "") + last)
                n += len(tokens[-1]) // 4
                if n >= GROUP_WINDOWS * capacity or len(keys) >= GROUP_DOCS:
                    yield group()
        if keys:
            yield group()

    plain = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    found = map_columns(plain, pieces, f"key {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return found.withColumnRenamed("key", key)


def _offsets(pieces: list[Piece]) -> list[int]:
    return [0, *np.cumsum([p[2] for p in pieces])[:-1].tolist()]


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in sequences of at most 2048, a row for each piece."""
    packed_ = pack(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", default_tokenizer())
    return packed_.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
