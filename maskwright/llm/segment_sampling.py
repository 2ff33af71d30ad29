"""SentencePiece sampling without replacement: Gumbel top-k over the lattice, and decoding.

A text's lattice has an edge for every vocabulary piece that stands at a place.
No piece of the vocabulary has a space mark after another character, nor a line
feed, so the lattice is a chain of small ones (units), which are built once for
each distinct unit. A path is a segmentation; its probability is the product of
its pieces' weights over that of all paths. Characters without a piece are
bytes, so every text has a path and decodes to itself.

The k segmentations are those with the largest Gumbel-perturbed log
probabilities, found by A* search from above: a region of the tree of prefixes
has as its bound the largest perturbed value in it, drawn from the region's
exact mass. The region with the largest bound is opened by drawing one path in
it, which gets the bound as its value; what is left of it falls apart into the
regions that leave the path at each step, whose bounds are drawn below. Regions
far down a path stand together as one until their bound is the largest. So the
segmentations come out distinct, in order, and as Gumbel top-k has them; the
bound after the last is the threshold of the inclusion scores.

Draws come from a hash of the seed, the row's key and the place of the draw, so
a row has the same samples in every run and partition. Rows with the same key
and text have the same samples.

The vocabulary has merge ranks and no probabilities; a piece of rank r weighs
(r + 2.7)^-theta.

Nulls count as empty texts. An empty text has one segmentation, with no pieces.
Where a text has fewer than k segmentations all come out, with inclusion 1.
Texts of any length are sampled whole. Repeated rows give their samples each,
empty tables none. Only the key and the text are read; where the key has the name
of an output column, the output's gets an underscore.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, map_columns, table, text_or_empty

MARK = "▁"
UNIT = re.compile(r" +(?:[^ \n\0][^ \n]*)?|[^ \n]+|\n")
AHEAD = 32
GRID = 1 << 30
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def default_model() -> str:
    """Where the public vocabulary file is."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _hash(*parts: np.ndarray | int) -> np.ndarray:
    """Mixed 64-bit values of the parts, which broadcast."""
    with np.errstate(over="ignore"):
        out = np.uint64(0x243F6A8885A308D3)
        for p in parts:
            out = (out ^ np.asarray(p).astype(np.uint64)) * _A
            out = out ^ (out >> np.uint64(32))
        out = (out ^ (out >> np.uint64(30))) * _B
        out = (out ^ (out >> np.uint64(27))) * _C
        return out ^ (out >> np.uint64(31))


def _uniform(*parts: np.ndarray | int) -> np.ndarray:
    """Numbers over 0 and under 1."""
    return ((_hash(*parts) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


class Vocabulary:
    """A SentencePiece file's pieces: their hashes, weights and bytes."""

    def __init__(self, path: str, theta: float = 1.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.bytes: list[bytes] = []
        self.byte_id = [0] * 256
        pieces: list[tuple[str, int, float]] = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes.append(b"")
            else:
                if MARK in piece.lstrip(MARK) or "\n" in piece:
                    raise ValueError(f"piece {i} runs over units")
                self.bytes.append(piece.replace(MARK, " ").encode())
                rank = -model.get_score(i)
                pieces.append((piece, i, -theta * np.log((rank if rank < 1e8 else n) + 2.7)))
        self.byte_weight = -theta * np.log(n + 2.7)
        self.longest = max(len(p) for p, _, _ in pieces)
        # All beginnings of pieces, so that a search for longer ones stops where no piece goes on.
        known: dict[str, tuple[int, float]] = {p[:n]: (-1, 0.0) for p, _, _ in pieces for n in range(1, len(p) + 1)}
        known.update((p, (i, w)) for p, i, w in pieces)
        hashes = np.array([self._of(p) for p in known], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array([i for i, _ in known.values()], np.int32)[order]
        self.weight = np.zeros(n)
        for _, i, w in pieces:
            self.weight[i] = w
        self.byte_ids = np.array(self.byte_id, np.int32)
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.lengths = np.array([len(b) for b in self.bytes], np.int32)
        self.starts = np.cumsum(self.lengths, dtype=np.int32) - self.lengths
        self.weight[self.byte_ids] = self.byte_weight
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces share a hash")
        # Where the hashes with the same first 20 bits begin; a search looks at the few from there.
        self.slot = np.searchsorted(self.hashes, np.arange((1 << 20) + 1, dtype=np.uint64) << np.uint64(44)).astype(np.int32)
        self.slot_size = int(np.diff(self.slot).max())
        self.hashes = np.concatenate([self.hashes, np.full(self.slot_size, self.hashes[-1] ^ np.uint64(1))])

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are known, and where those stand."""
        at = self.slot[(h >> np.uint64(44)).astype(np.int64)]
        hit = self.hashes[at] == h
        for more in range(1, self.slot_size):
            other = np.flatnonzero(~hit)
            found = other[self.hashes[at[other] + more] == h[other]]
            at[found] += more
            hit[found] = True
        return hit, at[hit]

    @staticmethod
    def _of(piece: str) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for c in piece:
            h = Vocabulary.grow(h, np.array([ord(c)], np.uint64))
        return h[0]

    @staticmethod
    def grow(h: np.ndarray, code: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (h + code + np.uint64(1)) * _A
            return h ^ (h >> np.uint64(29))

    def decodes_to(self, ids: np.ndarray, text: str | bytes) -> bool:
        """Whether decode gives the text (or its UTF-8), by arrays."""
        if isinstance(text, str):
            text = text.encode("utf-8", "surrogatepass")
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths, dtype=np.int32)
        if (ends[-1] if len(ends) else 1) != len(text) + 1:
            return False
        at = np.repeat(self.starts[ids] - ends + lengths, lengths)
        at += np.arange(len(at), dtype=np.int32)
        return self.flat[at][1:].tobytes() == text

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of an encoding; its first byte is the space that encoding puts before every text."""
        known = self.bytes
        return b"".join(map(known.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))[1:].decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def vocabulary(path: str, theta: float) -> Vocabulary:
    return Vocabulary(path, theta)


class _Numbers(dict):
    """Numbers words as they come; those that are new since the last look stand in fresh."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.fresh.append(word)
        return number


#: Stands before a unit without a space. No piece has it, so a text's own is cut off from the space before it.
BARE = "\0"


def units_of(text: str) -> list[str]:
    """The units of a text with a space before it: line feeds, and runs between them and single spaces, which stand without their space."""
    if "  " in text or text[:1] == " " or BARE in text:
        return [u[1:] if u[0] == " " else u if u == "\n" else BARE + u for u in UNIT.findall(" " + text)]
    if "\n" in text:
        text = text.replace("\n", f" \n {BARE}").replace(f" {BARE} ", " ").removesuffix(f" {BARE}")
    return text.split(" ")


def _spelled(unit: str) -> str:
    return unit if unit == "\n" else unit[1:] if unit[:1] == BARE else " " + unit


class Units:
    """Lattices of distinct units, end to end.

    An edge has its place, the place that it leads to (-1 at its unit's end), a
    piece, its probability at its place and a bound for draws. A place has its
    first edge and what all its edges but the first have together.
    """

    EDGES = (("place", np.int32), ("next", np.int32), ("piece", np.int32), ("chance", np.float32), ("below", np.int32))
    PLACES = (("edge_from", np.int32), ("others", np.float32))
    UNITS = (("root", np.int32),)

    def __init__(self) -> None:
        self.of = _Numbers()
        self.edges = self.places = self.units = 0
        for name, kind in (*self.EDGES, *self.PLACES, *self.UNITS):
            setattr(self, name, np.zeros(1024, kind))

    def _append(self, kinds: tuple, at: int, **new: np.ndarray) -> int:
        end = at + len(new[kinds[0][0]])
        for name, kind in kinds:
            old = getattr(self, name)
            if end >= len(old):
                grown = np.zeros(max(end + 1, len(old) * 5 // 4), kind)
                grown[:at] = old[:at]
                setattr(self, name, grown)
            getattr(self, name)[at:end] = new[name]
        return end

    def numbers(self, words: list[str], v: Vocabulary) -> np.ndarray:
        """The number of each unit; the lattices of new ones are built."""
        out = np.fromiter(map(self.of.__getitem__, words), np.int64, len(words))
        if self.of.fresh:
            self.add([_spelled(w) for w in self.of.fresh], v)
            self.of.fresh.clear()
        return out

    def add(self, units: list[str], v: Vocabulary) -> None:
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        starts = np.cumsum(sizes) - sizes
        n = len(codes)
        left = np.repeat(starts + sizes, sizes) - np.arange(n)
        # A space is the mark; a mark in the text is no piece's and goes by bytes.
        seen = np.where(codes == 32, ord(MARK), np.where(codes == ord(MARK), 0, codes)).astype(np.uint64)
        # A row for each place, a column for each length: the piece, or none.
        none = np.iinfo(np.int32).min
        pieces = np.full((n, v.longest), none, np.int32)
        h, open_ = np.zeros(n, np.uint64), np.arange(n)
        for k in range(1, v.longest + 1):
            on = left[open_] >= k
            open_, h = open_[on], h[on]
            if not len(open_):
                break
            h = v.grow(h, seen[open_ + k - 1])
            hit, found = v.find(h)
            open_, h = open_[hit], h[hit]
            whole = v.ids[found]
            pieces[open_, k - 1] = np.where(whole >= 0, whole, none)
        # Characters without a piece: their byte, or (several bytes, spelled out at the end) a negative number.
        rest = np.flatnonzero(pieces[:, 0] == none)
        pieces[rest, 0] = np.where(codes[rest] < 128, v.byte_ids[np.minimum(codes[rest], 255)], -1 - codes[rest])
        flat = np.flatnonzero(pieces.ravel() != none)
        at_, length_ = np.divmod(flat, v.longest)
        piece_ = pieces.ravel()[flat]
        length_ += 1
        by_bytes = np.flatnonzero(piece_ < 0)
        weight_ = v.weight[np.maximum(piece_, 0)]
        c = -1 - piece_[by_bytes]
        weight_[by_bytes] = v.byte_weight * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))
        counts = np.bincount(at_, minlength=n)
        edge_from = np.concatenate([[0], np.cumsum(counts)])
        ends = length_ == left[at_]
        mass, of_edge = self._mass(left, counts, edge_from, at_ + length_, ends, weight_)
        chance = np.exp(weight_ + of_edge - np.repeat(mass, counts))
        chance[np.repeat(counts == 1, counts)] = 1.0
        # The likeliest edge of a place first: most draws end there. It changes places with the first.
        top = np.flatnonzero(chance == np.repeat(np.maximum.reduceat(chance, edge_from[:-1]), counts))
        top = top[np.concatenate([[True], at_[top[1:]] != at_[top[:-1]]])]
        leads = np.where(ends, -1 - self.places, at_ + length_)
        for x in (leads, piece_, chance):
            x[top], x[edge_from[:-1]] = x[edge_from[:-1]], x[top]
        # The chances up to and with each edge's at its place, in whole 2^-30: draws are exact however places are numbered.
        below = chance.copy()
        others = np.zeros(n)
        for r in range(1, counts.max(initial=1)):
            more = np.flatnonzero(counts > r)
            of_rank = edge_from[more] + r
            # Their own sum: one less the likeliest would lose what is very unlikely.
            others[more] += chance[of_rank]
            below[of_rank] += below[of_rank - 1]
        below = np.minimum(np.floor(below * GRID), GRID - 1).astype(np.int32)
        below[edge_from[1:] - 1] = GRID
        before, place = self.edges, self.places
        self.units = self._append(self.UNITS, self.units, root=place + starts)
        self.edges = self._append(self.EDGES, before, place=place + at_, next=place + leads, piece=piece_, chance=chance, below=below)
        self.places = self._append(self.PLACES, place, edge_from=before + edge_from[:-1], others=others)
        self.edge_from[self.places] = self.edges

    @staticmethod
    def _mass(left: np.ndarray, counts: np.ndarray, edge_from: np.ndarray, to: np.ndarray, ends: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log mass of all ways from each place to its unit's end, from the ends backwards; and of those behind each edge."""
        n = len(left)
        order = np.argsort(left.astype(np.int16) if left.max(initial=0) < 1 << 15 else left, kind="stable")
        rank = np.empty(n + 1, np.int64)
        rank[order], rank[n] = np.arange(n), n
        to = rank[np.where(ends, n, to)]
        c = counts[order]
        first = np.concatenate([[0], np.cumsum(c)])
        edges = np.repeat(edge_from[order] - first[:-1], c) + np.arange(first[-1])
        weight, to_ = weight[edges], to[edges]
        # By rank; the last, which no place has, is where units end.
        mass = np.zeros(n + 1)
        cuts = np.searchsorted(left[order], np.arange(1, left.max(initial=0) + 2)).tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            s, e = first[a], first[b]
            w = weight[s:e] + mass[to_[s:e]]
            begins = first[a:b] - s
            top = np.maximum.reduceat(w, begins)
            w -= np.repeat(top, c[a:b])
            mass[a:b] = top + np.log(np.add.reduceat(np.exp(w, out=w), begins))
        return mass[rank[:-1]], mass[to]

    def log_rest(self, edges: np.ndarray) -> np.ndarray:
        """What is left at each edge's place without it."""
        place = self.place[edges]
        rest = np.where(self.edge_from[place] == edges, self.others[place].astype(np.float64), 1 - self.chance[edges].astype(np.float64))
        with np.errstate(divide="ignore"):
            return np.log(np.minimum(rest, 1.0))

    def log_chance(self, edges: np.ndarray) -> np.ndarray:
        return np.log(self.chance[edges], dtype=np.float64)

    def draw(self, place: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A path from each place to its unit's end: all edges, in order, and how many each has."""
        n = len(place)
        counts = np.zeros(n, np.int64)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        active = np.arange(n)
        with np.errstate(over="ignore"):
            while len(active):
                u = (_finish(seeds + _D * np.uint64(len(steps))) >> np.uint64(34)).astype(np.int32)
                edge = self.edge_from[place]
                over = np.flatnonzero(u >= self.below[edge])
                while len(over):
                    edge[over] += 1
                    over = over[u[over] >= self.below[edge[over]]]
                counts[active] += 1
                steps.append((active, edge))
                place = self.next[edge]
                on = np.flatnonzero(place >= 0)
                active, place, seeds = active[on], place[on], seeds[on]
        first = np.cumsum(counts) - counts
        out = np.empty(counts.sum(), np.int32)
        for i, (entry, edge) in enumerate(steps):
            out[first[entry] + i] = edge
        return out, counts


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


@dataclass
class Path:
    """Edges and the unit of each; the bounds of the regions that leave it at its steps from `since` on, and of all later ones together."""

    edges: np.ndarray
    units: np.ndarray
    value: float
    since: int
    log_p: float
    bounds: list[float]
    tail: float
    taken: dict[int, list[int]] = field(default_factory=dict)


_WORD = (1 << 64) - 1


def _draw_one(seed: int, *parts: int) -> float:
    """A number over 0 and under 1, as _uniform makes them, for single draws."""
    x = seed
    for p in parts:
        x = (x ^ (p & _WORD)) * 0x9E3779B97F4A7C15 & _WORD
        x ^= x >> 32
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _WORD
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _WORD
    return ((x ^ x >> 31) >> 12) * 2.0**-52 + 2.0**-53


def _gumbel_below(mass: float, ceiling: float, u: float) -> float:
    """The largest perturbed value in a region of this log mass, given that it is under the ceiling."""
    if mass == -math.inf:
        return -math.inf
    e = math.log(-math.log(u)) - mass
    top = max(-ceiling, e)
    return -(top + math.log1p(math.exp(-abs(-ceiling - e))))


class Search:
    """The A* search of one text."""

    def __init__(self, local: Units, seed: int):
        self.local, self.seed, self.paths = local, seed, []

    def best(self) -> tuple[float, int, int]:
        """The largest bound, its path and step; step -1 is the tail."""
        out = (-math.inf, -1, -1)
        for number, p in enumerate(self.paths):
            if p.bounds:
                most = max(p.bounds)
                if most > out[0]:
                    out = (most, number, p.since + p.bounds.index(most))
            if p.tail > out[0]:
                out = (p.tail, number, -1)
        return out

    def open_tail(self, number: int) -> None:
        """Gives every region in a path's tail its own bound; the largest stays what it was."""
        p = self.paths[number]
        until = p.since + len(p.bounds)
        logs = self.local.log_chance(p.edges)
        mass = (np.cumsum(logs) - logs)[until:] + self.local.log_rest(p.edges[until:])
        share = np.cumsum(np.exp(mass - mass.max()))
        chosen = int(np.searchsorted(share, share[-1] * _draw_one(self.seed, 3, number), side="right"))
        with np.errstate(invalid="ignore"):
            e = np.log(-np.log(_uniform(np.uint64(self.seed), 6, number, np.arange(len(mass)))))
            bounds = np.where(np.isneginf(mass), -np.inf, -np.logaddexp(-p.tail, e - mass)).tolist()
        bounds[min(chosen, len(bounds) - 1)] = p.tail
        p.bounds += bounds
        p.tail = -math.inf

    def leave(self, number: int, step: int, value: float) -> int:
        """Draws the edge by which a path leaves another at a step, and what bound is left there."""
        p, local = self.paths[number], self.local
        taken = p.taken.setdefault(step, [int(p.edges[step])])
        place = int(local.place[p.edges[step]])
        chances = {e: float(local.chance[e]) for e in range(int(local.edge_from[place]), int(local.edge_from[place + 1])) if e not in taken}
        left = sum(chances.values()) * _draw_one(self.seed, 4, number, step, len(taken))
        for edge, chance in chances.items():
            left -= chance
            if left < 0:
                break
        taken.append(edge)
        rest = sum(c for e, c in chances.items() if e != edge)
        before = float(local.log_chance(p.edges[:step]).sum())
        mass = before + math.log(rest) if rest > 0 else -math.inf
        p.bounds[step - p.since] = _gumbel_below(mass, value, _draw_one(self.seed, 5, number, step, len(taken)))
        return edge


def _add_paths(searches: list[Search], new: list[tuple[np.ndarray, np.ndarray, float, int]], local: Units, number: int) -> None:
    """Adds a path (edges, units, value, since) to each search, with the bounds of the regions that leave it, for all at once."""
    sizes = np.array([len(e) for e, _, _, _ in new])
    flat = np.concatenate([e for e, _, _, _ in new])
    begins = np.cumsum(sizes) - sizes
    since = np.array([s for _, _, _, s in new])
    values = np.array([v for _, _, v, _ in new])
    logs = local.log_chance(flat)
    total = np.add.reduceat(logs, begins)
    before = np.array([float(local.log_chance(e[:s]).sum()) if s else 0.0 for e, _, _, s in new])
    step = np.arange(AHEAD)
    inside = since[:, None] + step < sizes[:, None]
    at = np.minimum(begins[:, None] + since[:, None] + step, len(flat) - 1)
    reached = before[:, None] + np.cumsum(np.where(inside, logs[at], 0.0), axis=1)
    mass = np.concatenate([before[:, None], reached[:, :-1]], axis=1) + local.log_rest(flat[at])
    seeds = np.array([s.seed for s in searches], np.uint64)
    with np.errstate(invalid="ignore", divide="ignore"):
        e = np.log(-np.log(_uniform(seeds[:, None], 2, number, step)))
        bounds = np.where(np.isneginf(mass), -np.inf, -np.logaddexp(-values[:, None], e - mass))
        until = np.minimum(since + AHEAD, sizes)
        reached = reached[:, -1]
        deep = total - reached
        mass = np.where((until < sizes) & (deep < 0), reached + np.log(-np.expm1(np.minimum(deep, 0))), -np.inf)
        e = np.log(-np.log(_uniform(seeds, 2, number, AHEAD)))
        tails = np.where(np.isneginf(mass), -np.inf, -np.logaddexp(-values, e - mass))
    counts = inside.sum(axis=1).tolist()
    for s, (edges, units, value, first), n, row, tail, log_p in zip(searches, new, counts, bounds.tolist(), tails.tolist(), total.tolist(), strict=True):
        s.paths.append(Path(edges, units, value, first, log_p, row[:n], tail))


def sample(texts: list[str | None], keys: list, v: Vocabulary, store: Units, k: int, seed: int, most_edges: int = 3_000_000) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its segmentations, from the largest perturbed value: pieces, log probability, perturbed value, log of the inclusion probability."""
    cut = [units_of(t) if t else [] for t in texts]
    if store.edges > most_edges:
        store.__init__()
    sizes = np.array([len(c) for c in cut], np.int64)
    numbers = store.numbers(list(chain.from_iterable(cut)), v)
    roots = store.root[numbers]
    begins = np.cumsum(sizes) - sizes
    seeds = [_seed(key, seed) for key in keys]
    searches = [Search(store, s) for s in seeds]
    firsts = [-math.log(-math.log(_draw_one(s, 1))) for s in seeds]
    seeds = np.array(seeds, np.uint64)
    # What each text draws next: from which unit (and which place in it), after which edges, under which value.
    wanted = [(d, 0, None, None, firsts[d], 0) for d in np.flatnonzero(sizes).tolist()]
    for number in range(k):
        if not wanted:
            break
        docs, since = np.array([w[0] for w in wanted]), np.array([w[1] for w in wanted])
        n = sizes[docs] - since
        ends = np.cumsum(n)
        unit = np.repeat(since - (ends - n), n) + np.arange(ends[-1])
        doc = np.repeat(docs, n)
        place = roots[begins[doc] + unit]
        inner = [i for i, w in enumerate(wanted) if w[2] is not None]
        place[(ends - n)[inner]] = [wanted[i][2] for i in inner]
        with np.errstate(over="ignore"):
            edges, counts = store.draw(place, _finish(seeds[doc] + _A * (unit + 1).astype(np.uint64) + _C * np.uint64(number + 1)))
        units = np.repeat(unit, counts)
        cuts = np.append(0, np.cumsum(counts))[np.append(0, ends)].tolist()
        added = []
        for (_, _, _, stem, value, step), a, b in zip(wanted, cuts, cuts[1:], strict=False):
            if stem is None:
                added.append((edges[a:b], units[a:b], value, step))
            else:
                added.append((np.concatenate([stem[0], edges[a:b]]), np.concatenate([stem[1], units[a:b]]), value, step))
        _add_paths([searches[w[0]] for w in wanted], added, store, number)
        if number < k - 1:
            wanted = [w for w in (_next(searches[d], d, int(sizes[d])) for d in docs.tolist()) if w]
    return [_results(s, v) if s.paths else [(np.zeros(0, np.int64), 0.0, first, 0.0)] for s, first in zip(searches, firsts, strict=True)]


def _next(s: Search, doc: int, n_units: int) -> tuple | None:
    """Opens the region with the largest bound: what is to be drawn there, or nothing if no region is left."""
    local = s.local
    while True:
        value, path, step = s.best()
        if value == -math.inf:
            return None
        if step >= 0:
            break
        s.open_tail(path)
    edge = s.leave(path, step, value)
    p = s.paths[path]
    unit = int(p.units[step])
    stem = np.append(p.edges[:step], edge), p.units[: step + 1]
    if local.next[edge] >= 0:
        return doc, unit, int(local.next[edge]), stem, value, step + 1
    return doc, unit + 1, None, stem, value, step + 1


def _results(s: Search, v: Vocabulary) -> list[tuple[np.ndarray, float, float, float]]:
    threshold = s.best()[0]
    out = []
    for p in s.paths:
        x = p.log_p - threshold
        inclusion = 0.0 if threshold == -math.inf else x if x < -30 else math.log(-math.expm1(-math.exp(min(x, 700.0))))
        out.append((_ids(s.local.piece[p.edges], v), p.log_p, p.value, inclusion))
    return out


def _ids(pieces: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Piece numbers, characters without a piece as their bytes."""
    if not len(pieces) or pieces.min() >= 0:
        return pieces
    by_bytes = np.flatnonzero(pieces < 0)
    spelled = [[v.byte_id[b] for b in chr(-1 - c).encode("utf-8", "surrogatepass")] for c in pieces[by_bytes].tolist()]
    lengths = np.ones(len(pieces), np.int64)
    lengths[by_bytes] = [len(x) for x in spelled]
    out = np.repeat(pieces, lengths)
    out[out < 0] = [i for x in spelled for i in x]
    return out


def _seed(key: object, seed: int) -> int:
    return xxhash.xxh64_intdigest(repr(key).encode("utf-8", "surrogatepass"), seed)


# --- operators -------------------------------------------------------------

SAMPLES = T.StructType([T.StructField("sample", T.IntegerType()), T.StructField("log_prob", T.DoubleType()), T.StructField("perturbed", T.DoubleType()), T.StructField("log_inclusion", T.DoubleType()), T.StructField("n_pieces", T.LongType())])
_stores: dict[tuple[str, float], Units] = {}


def sample_segmentations(docs: DataFrame, key: str, text: str, model: str, k: int = 3, seed: int = 0, theta: float = 1.0, digest: bool = False, units_at_once: int = 30_000) -> DataFrame:
    """(key, sample, log_prob, perturbed, log_inclusion, n_pieces, pieces) for every text and each of its segmentations.

    model: the vocabulary file's path, which every worker has. With digest,
    pieces_sha256 (of the pieces as little-endian 32-bit numbers) and decodes
    (whether the pieces decode to the text) stand for the pieces.
    """
    last = [T.StructField("pieces_sha256", T.StringType()), T.StructField("decodes", T.BooleanType())] if digest else [T.StructField("pieces", T.ArrayType(T.IntegerType()))]
    names = [free_name(f.name, [key]) for f in (*SAMPLES.fields, *last)]
    schema = T.StructType([docs.schema[key], *(T.StructField(n, f.dataType) for n, f in zip(names, (*SAMPLES.fields, *last), strict=True))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        v = vocabulary(model, theta)
        store = _stores.setdefault((model, theta), Units())
        for batch in batches:
            ids, texts = batch[0].to_pylist(), batch[1].to_pylist()
            at = 0
            while at < len(ids):
                end, size = at, 0
                while end < len(ids) and (end == at or size < units_at_once):
                    size += len(texts[end] or "") // 6 + 1
                    end += 1
                of, out = [], []
                for number, t, found in zip(range(at, end), texts[at:end], sample(texts[at:end], ids[at:end], v, store, k, seed), strict=True):
                    own = (t or "").encode("utf-8", "surrogatepass") if digest else b""
                    for i, (pieces, log_p, value, inclusion) in enumerate(found):
                        shown = (hashlib.sha256(pieces.astype("<i4").tobytes()).hexdigest(), v.decodes_to(pieces, own)) if digest else (pieces.astype(np.int32),)
                        of.append(number)
                        out.append((i, log_p, value, inclusion, len(pieces), *shown))
                yield {key: batch[0].take(pa.array(of)), **dict(zip(names, map(list, zip(*out, strict=True)), strict=True))}
                at = end
        store.__init__()  # a worker that goes on to other work should not keep it

    return map_columns(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), rows, schema)


def decode_pieces(encoded: DataFrame, pieces: str, model: str, into: str = "text") -> DataFrame:
    """The rows with the text that their pieces decode to; null pieces give a null text."""

    @F.pandas_udf("string")
    def decoded(column: pd.Series) -> pd.Series:
        v = vocabulary(model, 1.0)
        return column.map(lambda ids: None if ids is None else v.decode(ids))

    return encoded.withColumn(into, decoded(F.col(pieces)))


def op4_segment_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three distinct sampled segmentations of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", text_or_empty("text").alias("text"))
    return sample_segmentations(docs, "doc_id", "text", default_model(), k=3, digest=True)
