"""SimHash near-duplicates with pigeonring filtering.

The bits of a fingerprint stand in segments on a ring. If two fingerprints
differ in at most `tau` bits over `m` segments, some segment starts a chain of
which every first l segments differ in at most l*tau/m bits together. So
fingerprints are indexed by the chains that this forces to be equal, each chain
is grown along the ring while its differences stay in budget, and only pairs
that pass go to the full Hamming check.

Nulls count as empty texts. An empty text has fingerprint zero and is linked
like any other. Texts with fewer words than a shingle are one shingle. Repeated
rows and copies share a fingerprint and are linked through it, without pairs.
Empty tables give empty results. Texts of any length are read whole. Only the key
and the text are read; where the key has the name of an output column, the output's
gets an underscore.

Buckets of the index that hold over `hot` fingerprints don't make pairs:
`link_within` links their members through the values at one bit's distance,
which is exact for tau 2 and linear in the members.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, map_columns, mounted, shared_path, table, text_or_empty, written
from .components import connected_components

SEED = 42
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_PLACE = (np.arange(8) * 256).astype(np.int64)


def words_of(text: str | None) -> list[bytes]:
    """Runs of bytes other than space and 0x09-0x0D, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(words: list[bytes], size: int) -> list[bytes]:
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the 64-bit hashes have, as an unsigned number; zero for none."""
    n = len(hashes)
    if n == 0:
        return 0
    octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    seen = np.bincount((octets + _PLACE).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(seen.ravel() * 2 > n).tobytes(), "big")


def fingerprint(text: str | None, size: int = 3) -> int:
    """SimHash over XXH64 (seed 42) of the word shingles, repeats included."""
    digest = xxhash.xxh64_intdigest
    found = shingles(words_of(text), size)
    return majority(np.fromiter([digest(s, SEED) for s in found], np.uint64, len(found)))


def fingerprints(docs: DataFrame, key: str, text: str, size: int = 3) -> DataFrame:
    """(key, fp): fp is the fingerprint as a signed long."""
    fp = free_name("fp", [key])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found = np.array([fingerprint(t, size) for t in batch["text"].to_pylist()], np.uint64)
            yield {key: batch["key"], fp: found.view(np.int64)}

    return map_columns(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), rows, f"`{key}` {docs.schema[key].dataType.simpleString()}, {fp} long")


# --- the ring --------------------------------------------------------------


def segment_lengths(m: int, bits: int = 64) -> list[int]:
    return [bits // m + (i < bits % m) for i in range(m)]


def budgets(m: int, tau: int) -> list[int]:
    """How many bits the first 1, 2, ... m segments of a chain may differ in."""
    return [length * tau // m for length in range(1, m + 1)]


def ring_keys(fp: Column, m: int, tau: int) -> Column:
    """An array of (chain, part, ring) per fingerprint: the ring turned to begin at each segment, and its first bits, which the budgets force to be equal."""
    lengths = segment_lengths(m)
    equal = sum(b == 0 for b in budgets(m, tau))
    if not equal:
        raise ValueError(f"{m} segments for {tau} bits force no segment to be equal")
    out = []
    for i in range(m):
        before, own = sum(lengths[:i]), sum((lengths + lengths)[i : i + equal])
        ring = F.shiftleft(fp, before).bitwiseOR(F.shiftrightunsigned(fp, 64 - before)) if before else fp
        out.append(F.struct(F.lit(i).alias("chain"), F.shiftrightunsigned(ring, 64 - own).alias("part"), ring.alias("ring")))
    return F.array(*out)


def chain_passes(difference: Column, chain: Column, m: int, tau: int) -> Column:
    """Whether the differences, turned to begin at the chain's segment, stay within the budget of every length."""
    lengths, allowed = segment_lengths(m), budgets(m, tau)
    passes = F.bit_count(difference) <= allowed[-1]
    for i in range(m):
        own = F.lit(True)
        for n in range(1, m):
            if allowed[n - 1] < min(allowed[n], sum((lengths + lengths)[i : i + n])) or n == m - 1:
                own = own & (F.bit_count(F.shiftrightunsigned(difference, 64 - sum((lengths + lengths)[i : i + n]))) <= allowed[n - 1])
        passes = passes & ((chain != i) | own)
    return passes


def link_within(fps: DataFrame, m: int = 5, tau: int = 2, hot: int = 64) -> DataFrame:
    """(a, b) links that join every two fingerprints of fps (distinct, column fp) at tau or fewer bits, directly or through others that close.

    Buckets of up to `hot` members are joined on themselves; larger ones, where
    pairs would grow with the square, go through `link_by_midpoints`.
    """
    indexed = fps.select("fp", F.explode(ring_keys(F.col("fp"), m, tau)).alias("k")).select("fp", "k.chain", "k.part", "k.ring")
    crowded = written(indexed.groupBy("chain", "part").count().where(F.col("count") > hot).select("chain", "part"), "crowded")
    few = indexed.join(crowded, ["chain", "part"], "left_anti")
    left = few.select("chain", "part", F.col("ring").alias("ring_a"), F.col("fp").alias("a"))
    right = few.select("chain", "part", F.col("ring").alias("ring_b"), F.col("fp").alias("b"))
    passing = chain_passes(F.col("ring_a").bitwiseXOR(F.col("ring_b")), F.col("chain"), m, tau)
    pairs = left.join(right, ["chain", "part"]).where((F.col("a") < F.col("b")) & passing).select("a", "b")
    if crowded.isEmpty():
        return pairs.distinct()
    if tau != 2:
        raise ValueError("crowded buckets can be linked for tau 2 only")
    many = indexed.join(crowded, ["chain", "part"], "left_semi").select("fp").distinct()
    return pairs.union(link_by_midpoints(many)).distinct()


def link_by_midpoints(fps: DataFrame) -> DataFrame:
    """Links among distinct fingerprints at 2 or fewer bits: two of them are that close exactly if one value is at most one bit from both.

    Every fingerprint stands under 65 values, and no value has more than 65
    fingerprints, so groups are small however close the fingerprints lie.
    """
    near = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long")) for i in range(64)))
    groups = fps.select("fp", F.explode(near).alias("middle")).groupBy("middle").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    return groups.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b")


def near_duplicates(docs: DataFrame, key: str, text: str, size: int = 3, m: int = 5, tau: int = 2, share: int = 1000) -> DataFrame:
    """(key, fp, component): component is the smallest key that links reach from the document.

    A fingerprint that over one in `share` documents has is crowded. There are
    fewer than `share` of these, so they go to every task; the documents of the
    others meet their fingerprint's row in a join, where no key is common.
    """
    marked = written(fingerprints(docs, key, text, size).toDF("key", "fp"), "fingerprints")
    firsts = written(marked.groupBy("fp").agg(F.min("key").alias("first"), F.count("*").alias("n")), "firsts")
    roots = connected_components(link_within(firsts.select("fp"), m, tau)).withColumnRenamed("node", "fp")
    linked = firsts.join(roots, "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("component"))
    of_linked = linked.join(least, "root").select("fp", "component")
    of_all = written(firsts.join(of_linked, "fp", "left").select("fp", "n", F.coalesce("component", "first").alias("component")), "of-fingerprints")
    crowded = F.col("n") > (firsts.agg(F.sum("n")).first()[0] or 0) // share
    common = F.broadcast(of_all.where(crowded).select("fp", "component"))
    rest = marked.join(common.select("fp"), "fp", "left_anti").join(of_all.where(~crowded).select("fp", "component"), "fp")
    every = marked.join(common, "fp").select("key", "fp", "component").union(rest.select("key", "fp", "component"))
    return every.toDF(key, free_name("fp", [key]), free_name("component", [key]))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest doc_id of its component."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", text_or_empty("text").alias("text"))
    found = near_duplicates(docs, "doc_id", "text")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


# --- shingle sets for a threshold of similarity ----------------------

WIDE_WORDS = 4
# Odd multipliers that mix the hashes of a shingle's words, and that draw the four hashes of a shingle from one.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
_DRAW = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


def _mixed(words: list[bytes], size: int) -> np.ndarray:
    """A hash of each shingle, in text order; a text of fewer words is one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(w, SEED) for w in words], np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    with np.errstate(over="ignore"):
        mixed = np.zeros(n, np.uint64)
        for i in range(min(size, len(words))):
            mixed = (mixed ^ (mixed >> np.uint64(31))) * _MIX[0] + hashes[i : i + n] * _MIX[1 + i % 6]
        return mixed ^ (mixed >> np.uint64(32))


def wide_fingerprint(text: str | None, size: int = 5) -> tuple[int, list[int]]:
    """The number of shingles and 256 bits as four unsigned numbers; zeros for a text without words."""
    mixed = _mixed(words_of(text), size)
    return len(mixed), _wide(mixed)


def _wide(mixed: np.ndarray) -> list[int]:
    out = []
    with np.errstate(over="ignore"):
        for c in _DRAW:
            drawn = mixed * c
            drawn ^= drawn >> np.uint64(29)
            drawn *= _MIX[0]
            drawn ^= drawn >> np.uint64(32)
            out.append(majority(drawn))
    return out


def bits_for(similarity: float, bits: int = 64 * WIDE_WORDS, slack: float = 0.75) -> int:
    """The differing bits of two texts of one length whose shingle sets have this Jaccard similarity: what is expected and slack standard deviations more, so that most pairs just at the similarity are in."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(share * bits + slack * np.sqrt(share * (1 - share) * bits))


#: Bands of minima: two sets at similarity s share a band's key with chance s**BAND_ROWS, so a pair at 0.8 is missed by all with 6 in 100,000.
BANDS, BAND_ROWS = 32, 6
#: Of these bands all pairs are tried, of the others those that are in two components then.
FIRST_BANDS = 4
_MINIMA = np.random.default_rng(20).integers(1 << 63, size=BANDS * BAND_ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def similar_groups(docs: DataFrame, key: str, text: str, size: int = 5, similarity: float = 0.8, hot: int = 4, share: int = 1000) -> DataFrame:
    """(key, component) for every row, whose key must not be null: the smallest key of the group that links of at least the similarity join.

    A link is two texts whose sets of shingle hashes have at least this Jaccard
    similarity, counted from the sets themselves. Texts with equal sets are one
    class from the start; a null text is an empty one, and all texts without
    words are one class. The sets lie in files of the shared folder. Other
    columns are not read.

    Candidates come from pigeonring on SimHash fingerprints of the sets first
    (`ring_pairs`), with the first bands' below. Fingerprints of texts at 0.8 differ
    in a twelfth to a sixth of their bits, so the ring can't force any segment of a
    useful length to be equal for these; what it has not joined are classes that
    share the key of a band of minima. Where up to
    `hot` classes share a key, all pairs are tried. Where more do, each is tried
    against the next in an order of sizes and hashes, another one in every band,
    which joins the bulk of a large group. Pairs that the ring and the first bands
    have joined are not tried again. Each is tried against the centre of its crowded buckets then (`_centred`), and if a bucket's classes are not one component yet, those outside
    its largest are tried against all others of the bucket that are not in their
    own, as far as they share a hash among their rarest, which sets of the similarity must.
    """
    folder = mounted(shared_path(docs.sparkSession, "sets"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        name, at = uuid.uuid4().hex, 0
        os.makedirs(folder, exist_ok=True)
        with open(os.path.join(folder, name), "wb") as file:
            for batch in _slices(batches):
                sets = [shingle_set(t, size) for t in batch["text"].to_pylist()]
                out = []
                for found in sets:
                    data = found.tobytes()
                    out.append((len(found), *np.frombuffer(xxhash.xxh3_128_digest(data), ">i8").tolist(), at, majority(found)))
                    file.write(data)
                    at += len(data)
                yield {"id": batch["id"], "file": [name] * len(out), "bands": list(band_keys(sets)), "fp": np.array([x[4] for x in out], np.uint64).view(np.int64), **dict(zip(("n", "s0", "s1", "at"), list(zip(*out, strict=True))[:4] if out else [()] * 4, strict=True))}

    kind = docs.schema[key].dataType.simpleString()
    own = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    marked = written(map_columns(own, rows, f"id {kind}, file string, n long, s0 long, s1 long, bands array<long>, at long, fp long"), "sets-of")
    same = ["n", "s0", "s1"]
    classes = written(marked.groupBy(*same).agg(F.min(F.struct("id", "file", "at", "bands", "fp")).alias("m"), F.count("*").alias("rows")).select(*same, "rows", "m.*"), "classes")
    places = classes.select("id", "n", "file", "at")
    everything = classes.where("n > 0").select("id", "n", F.posexplode("bands").alias("band", "k"))
    counts = everything.groupBy("k").count().where(F.col("count") > 1)
    index = written(everything.join(counts, "k"), "index")

    first = _neighbours(index.where(F.col("band") < FIRST_BANDS).withColumn("root", F.col("id")), hot, similarity)
    ring = ring_pairs(classes.where("n > 0").select("id", "fp"), share)
    links = written(_similar(ring.union(first).distinct(), places, folder, similarity), "similar")
    roots = written(connected_components(links), "roots")
    # Two classes of one component need not be tried again.
    later = index.where(F.col("band") >= FIRST_BANDS).join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    more = written(_similar(_neighbours(later, hot, similarity), places, folder, similarity), "similar")
    if not more.isEmpty():
        links = links.union(more)
        roots = written(connected_components(links), "roots")
    crowded_buckets = index.where(F.col("count") > hot)
    more = written(_similar(_centred(crowded_buckets, roots, places, folder, similarity), places, folder, similarity), "similar")
    if not more.isEmpty():
        links = links.union(more)
        roots = written(connected_components(links), "roots")
    left = _left_over(crowded_buckets, roots, places, folder, similarity)
    more = written(_similar(left, places, folder, similarity), "similar")
    if not more.isEmpty():
        roots = written(connected_components(links.union(more)), "roots")
    of_class = written(classes.join(roots.withColumnRenamed("node", "id"), "id", "left").select(*same, "rows", F.coalesce("root", "id").alias("component")), "of-classes")
    # Fewer than `share` classes have over one in `share` rows each: they go to every task, and the others' copies meet their class in a join without common keys.
    crowded = F.col("rows") > (of_class.agg(F.sum("rows")).first()[0] or 0) // share
    common = F.broadcast(of_class.where(crowded).drop("rows"))
    keyed = marked.select("id", *same)
    rest = keyed.join(common, same, "left_anti").join(of_class.where(~crowded).drop("rows"), same)
    every = keyed.join(common, same).select("id", "component").union(rest.select("id", "component"))
    return every.toDF(key, free_name("component", [key]))


def ring_pairs(classes: DataFrame, share: int = 1000, m: int = 5, tau: int = 2) -> DataFrame:
    """(a, b) of classes (id, fp) whose fingerprints pigeonring finds within tau bits: each class with the first of its fingerprint, and the first ones of every two linked fingerprints."""
    prints = written(classes.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("rows")), "prints")
    # As with copies: fingerprints of over one in `share` classes go to every task, the others meet in a join without common keys.
    crowded = F.col("rows") > (prints.agg(F.sum("rows")).first()[0] or 0) // share
    common = F.broadcast(prints.where(crowded).select("fp", "first"))
    rest = classes.join(common.select("fp"), "fp", "left_anti").join(prints.where(~crowded & (F.col("rows") > 1)).select("fp", "first"), "fp")
    equal = classes.join(common, "fp").select("first", "id").union(rest.select("first", "id"))
    side = lambda x: prints.select(F.col("fp").alias(x), F.col("first").alias(f"first_{x}"))
    close = link_within(prints.select("fp"), m, tau).join(side("a"), "a").join(side("b"), "b").select("first_a", "first_b")
    both = equal.union(close).toDF("x", "y").where("x <> y")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in smaller parts, so that the sets of few rows are in memory together."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """The distinct hashes of the text's shingles, sorted."""
    return np.unique(_mixed(words_of(text), size))


def band_keys(sets: list[np.ndarray], at_once: int = 1 << 15) -> np.ndarray:
    """The keys of each set's bands: (sets, BANDS). Those of empty sets mean nothing."""
    out = np.zeros((len(sets), BANDS), np.uint64)
    some = [i for i, x in enumerate(sets) if len(x)]
    at = 0
    with np.errstate(over="ignore"):
        while at < len(some):
            end, size = at, 0
            while end < len(some) and (end == at or size < at_once):
                size += len(sets[some[end]])
                end += 1
            part = [sets[i] for i in some[at:end]]
            flat = np.concatenate(part)
            begins = np.cumsum([0, *map(len, part[:-1])])
            for b in range(BANDS):
                k = np.full(len(part), b + 1, np.uint64)
                for c in _MINIMA[b * BAND_ROWS : (b + 1) * BAND_ROWS]:
                    k = (k ^ (k >> np.uint64(31))) * _MIX[0] + np.minimum.reduceat(flat * c, begins) * _MIX[1]
                out[some[at:end], b] = k ^ (k >> np.uint64(32))
            at = end
    return out.view(np.int64)


def _set_reader(folder: str) -> Callable[[str, int, int], np.ndarray]:
    """Reads sets by file, offset and number; files stay open."""
    files: dict[str, int] = {}

    def read(name: str, at: int, n: int) -> np.ndarray:
        if name not in files:
            files[name] = os.open(os.path.join(folder, name), os.O_RDONLY)
        return np.frombuffer(os.pread(files[name], 8 * n, at), np.uint64)

    return read


def _sizes_fit(similarity: float, a: str = "n_a", b: str = "n_b") -> Column:
    """Whether sets of these sizes can have the similarity."""
    return F.least(a, b) >= similarity * F.greatest(a, b) - 1e-6


def _neighbours(index: DataFrame, hot: int, similarity: float, part_size: int = 256) -> DataFrame:
    """(a, b) of two roots: all pairs of buckets of up to hot classes, and each member of a larger one with the next, within parts of the bucket that one task holds easily."""
    part = F.pmod(F.xxhash64("id", "k"), F.ceil(F.col("count") / part_size))
    # Another order in every bucket, sizes roughly first: sets of very different sizes are not similar.
    w = Window.partitionBy("k", "part").orderBy(F.floor(F.log2("n") * 4), F.xxhash64("k", "id"), "id")
    members = index.select("k", "id", "n", "root", (F.col("count") <= hot).alias("few"), F.when(F.col("count") > part_size, part).otherwise(0).alias("part"))
    nexts = F.array(*(F.struct(F.when(F.lit(i == 1) | F.col("few"), F.lead("id", i).over(w)).alias("b"), F.lead("n", i).over(w).alias("n_b"), F.lead("root", i).over(w).alias("root_b")) for i in range(1, max(2, hot))))
    near = members.select(F.col("id").alias("a"), F.col("n").alias("n_a"), "root", nexts.alias("nexts")).select("a", "n_a", "root", F.inline("nexts"))
    near = near.where(F.col("b").isNotNull() & (F.col("a") != F.col("b")) & (F.col("root") != F.col("root_b")) & _sizes_fit(similarity))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _similar(pairs: DataFrame, places: DataFrame, folder: str, similarity: float) -> DataFrame:
    """The pairs whose sets have the similarity."""
    columns = ("file", "at", "n")
    sides = [places.select(F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns)) for x in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        read = _set_reader(folder)
        for batch in _slices(batches):
            values = (batch[f"{c}_{x}"].to_pylist() for x in "ab" for c in columns)
            fits = []
            for fa, pa_, na, fb, pb, nb in zip(*values, strict=True):
                together = np.concatenate([read(fa, pa_, na), read(fb, pb, nb)])
                together.sort()
                shared = np.count_nonzero(together[1:] == together[:-1])
                fits.append(shared * (1 + similarity) >= similarity * (na + nb) - 1e-6)
            keep = pa.array(fits, pa.bool_())
            yield {x: batch[x].filter(keep) for x in "ab"}

    kind = pairs.schema["a"].dataType.simpleString()
    return map_columns(both, rows, f"a {kind}, b {kind}")


def _divided(crowded: DataFrame, roots: DataFrame) -> DataFrame:
    """(k, id, n, root, largest) of the crowded buckets that are not one component; largest is the root of a bucket's largest one."""
    members = crowded.select("k", "id", "n").join(roots.withColumnRenamed("node", "id"), "id", "left").select("k", "id", "n", F.coalesce("root", "id").alias("root"))
    by_root = members.groupBy("k", "root").count()
    largest = by_root.groupBy("k").agg(F.max_by("root", F.struct("count", "root")).alias("largest"), F.count("*").alias("roots")).where("roots > 1").select("k", "largest")
    return written(members.join(largest, "k"), "mixed")


def _sets(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Small batches of places with their sets."""
    read = _set_reader(folder)
    for batch in _slices(batches):
        yield batch, [read(*x) for x in zip(*(batch[c].to_pylist() for c in ("file", "at", "n")), strict=True)]


#: Slots in which the hashes of crowded buckets are counted.
SLOT_BITS = 20


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _frequencies(placed: DataFrame, folder: str) -> Broadcast:
    """How frequent hashes are in the sets, by slots: of one size, whatever the number of texts. It only decides on orders, never on links."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen = np.zeros(1 << SLOT_BITS, np.int64)
        for _, found in _sets(batches, folder):
            seen += np.bincount(_slots(np.concatenate(found)), minlength=len(seen)) if found else 0
        slots = np.flatnonzero(seen)
        yield {"slot": slots.astype(np.int32), "seen": seen[slots]}

    counts = map_columns(placed.select("file", "at", "n"), counted, "slot int, seen long").groupBy("slot").agg(F.sum("seen").alias("seen")).toArrow()
    seen = np.zeros(1 << SLOT_BITS, np.int64)
    seen[counts["slot"].to_numpy()] = counts["seen"].to_numpy()
    return placed.sparkSession.sparkContext.broadcast(seen)


def _centred(crowded: DataFrame, roots: DataFrame, places: DataFrame, folder: str, similarity: float) -> DataFrame:
    """(a, b): the members of crowded buckets that are not one component with the bucket's centre, whose hashes are the most frequent on average: what others are copies of has least of its own."""
    mixed = _divided(crowded, roots)
    placed = written(mixed.select("id").distinct().join(places, "id"), "placed")
    shared = _frequencies(placed, folder)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch, found in _sets(batches, folder):
            yield {"id": batch["id"], "score": [float(np.log2(shared.value[_slots(x)]).mean()) for x in found]}

    scores = map_columns(placed, scored, f"id {mixed.schema['id'].dataType.simpleString()}, score double")
    best = mixed.join(scores, "id").groupBy("k").agg(F.max(F.struct("score", "id", "n", "root")).alias("c")).select("k", F.col("c.id").alias("centre"), F.col("c.n").alias("n_b"), F.col("c.root").alias("root_b"))
    met = mixed.withColumnRenamed("n", "n_a").join(best, "k").where((F.col("root") != F.col("root_b")) & _sizes_fit(similarity))
    return met.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()


def _left_over(crowded: DataFrame, roots: DataFrame, places: DataFrame, folder: str, similarity: float) -> DataFrame:
    """(a, b): members of crowded buckets that are not one component, of two components, one of them outside its bucket's largest, that share a hash among their rarest.

    Sets of the similarity share so many hashes that one must be among the rarest of both,
    in any order that is the same for all; rare ones first, a passage that many texts have makes no pairs.
    """
    apart = _divided(crowded, roots).groupBy("id", "root").agg(F.max(F.col("root") != F.col("largest")).alias("outside"))
    placed = written(apart.join(places, "id"), "placed")
    shared, kind = _frequencies(placed, folder), placed.schema["id"].dataType.simpleString()

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch, found in _sets(batches, folder):
            firsts = [x[np.lexsort((x, shared.value[_slots(x)]))[: len(x) - int(np.ceil(similarity * len(x) - 1e-6)) + 1]] for x in found]
            rows = np.repeat(np.arange(len(firsts)), [len(x) for x in firsts])
            pos = np.concatenate([np.arange(len(x)) for x in firsts]) if firsts else []
            yield {**{c: batch[c].take(pa.array(rows)) for c in ("id", "n", "root", "outside")}, "pos": pos, "h": np.concatenate(firsts).view(np.int64) if firsts else []}

    prefixes = written(map_columns(placed, rarest, f"id {kind}, n long, root {kind}, outside boolean, pos long, h long"), "rarest")
    sided = lambda df, x: df.select("h", *(F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "root", "pos")))
    # Of two sets with so many hashes in common, the first common one has no more before it in either than that leaves out.
    common = F.ceil(similarity / (1 + similarity) * (F.col("n_a") + F.col("n_b")) - 1e-6)
    early = (F.col("pos_a") + common <= F.col("n_a")) & (F.col("pos_b") + common <= F.col("n_b"))
    met = sided(prefixes.where("outside"), "a").join(sided(prefixes, "b"), "h").where((F.col("root_a") != F.col("root_b")) & _sizes_fit(similarity) & early)
    return met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()
