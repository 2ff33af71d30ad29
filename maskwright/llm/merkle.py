"""Merkle manifest of a dataset: a root, a subroot for each source, and every row's authentication path.

A leaf is the SHA-256 of a row. Per group (a source) the leaves stand in order and
every FAN consecutive nodes become their hash, level by level, until one is left;
the groups' roots, in order, become one root by the same rule. Digests are hashed
as hexadecimal text.

Leaves are ranked within their group (`common.ranked`) and fall into aligned blocks
of FAN ** HEIGHT. Each block is one small group of rows. Its root comes from a
treehash stack; block roots are nodes of the next tier, so tiers shrink by 4096
until one node a group is left. Authentication paths are then made downwards: the
upper tiers' paths, a few rows, are the part that all of a block's leaves share,
and a traversal of the block advances its own part leaf by leaf. It holds one run
of FAN siblings a level and, a level, the stack of the run that comes next, which
takes in one leaf a step: memory grows with the logarithm of the block.

A null is `-` in a leaf; order is ascending, nulls first; rows with equal ids stand in the order
of their digests, repeated rows are leaves of their own. Texts of any length are hashed whole by Spark's own functions. An empty table has no
rows, and the hash of nothing for a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, crc32_sql, ranked, table, written

FAN, HEIGHT = 16, 3
BLOCK = FAN**HEIGHT

#: The siblings of a node, level by level: its place in its run, and the run.
Path = list[tuple[int, list[bytes]]]
PATH = "array<struct<at:int,run:array<binary>>>"
ARROW_PATH = pa.list_(pa.struct([("at", pa.int32()), ("run", pa.list_(pa.binary()))]))


def parent(run: Sequence[bytes]) -> bytes:
    return hashlib.sha256(b"".join(run)).hexdigest().encode()


class Treehash:
    """Nodes of a height, from the leaves below them, which come one at a time. At most FAN nodes wait on each level."""

    def __init__(self, height: int):
        self.waiting: list[list[bytes]] = [[] for _ in range(height)]
        self.nodes: list[bytes] = []

    def add(self, node: bytes) -> None:
        for run in self.waiting:
            run.append(node)
            if len(run) < FAN:
                return
            node = parent(run)
            run.clear()
        self.nodes.append(node)

    def closed(self) -> list[bytes]:
        """All nodes, after the last leaf: a level's last run may be short."""
        node = None
        for run in self.waiting:
            if node is not None:
                run.append(node)
            node = parent(run) if run else None
            run.clear()
        if node is not None:
            self.nodes.append(node)
        return self.nodes


def built(leaves: Sequence[bytes], height: int) -> list[bytes]:
    tree = Treehash(height)
    for x in leaves:
        tree.add(x)
    return tree.closed()


def height_of(n: int, block: int) -> int:
    """How far a block of n nodes is raised. A first block that isn't full is all there is of its group and ends at one node; all others go up HEIGHT levels."""
    if block or n >= BLOCK:
        return HEIGHT
    height = 0
    while FAN**height < n:
        height += 1
    return height


def traversed(leaves: Sequence[bytes], height: int) -> Iterator[Path]:
    """The path of every leaf in turn, up to the root of these leaves."""
    spans = [FAN ** (h + 1) for h in range(height)]
    runs = [built(leaves[:span], h) for h, span in enumerate(spans)]
    coming = [Treehash(h) for h in range(height)]
    for i in range(len(leaves)):
        yield [(i * FAN // span % FAN, run) for span, run in zip(spans, runs, strict=True)]
        for h, span in enumerate(spans):
            if i + span < len(leaves):
                coming[h].add(leaves[i + span])
            if (i + 1) % span == 0:
                runs[h], coming[h] = coming[h].closed(), Treehash(h)


def folded(leaf: bytes, path: Path) -> bytes:
    """The root that a leaf and its siblings give."""
    for at, run in path:
        leaf = parent([*run[:at], leaf, *run[at + 1 :]])
    return leaf


def proof(path: Path) -> bytes:
    """The hash of all siblings, from the lowest level up, left to right."""
    return parent([x for at, run in path for x in (*run[:at], *run[at + 1 :])])


# --- on frames -------------------------------------------------------------


def _hex(column: pa.ChunkedArray) -> list[bytes | None]:
    return [None if x is None else x.hex().encode() for x in column.to_pylist()]


def _block_root(key: tuple, nodes: pa.Table) -> pa.Table:
    nodes = nodes.sort_by("pos")
    block = key[1].as_py()
    (root,) = built(_hex(nodes["digest"]), height_of(len(nodes), block))
    return pa.table({"grp": pa.array([key[0].as_py()], pa.string()), "pos": pa.array([block], pa.int64()), "digest": pa.array([bytes.fromhex(root.decode())], pa.binary())})


def _by_block(nodes: DataFrame):
    return nodes.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long")).groupBy("grp", "block")


def _tiers(nodes: DataFrame) -> list[DataFrame]:
    """Nodes (grp, pos, digest), their blocks' roots, and so on up to one node a group."""
    tiers = [nodes]
    while len(tiers) == 1 or not tiers[-1].where("pos > 0").isEmpty():
        tiers.append(written(_by_block(tiers[-1].select("grp", "pos", "digest")).applyInArrow(_block_root, "grp string, pos long, digest binary"), f"merkle-tier-{len(tiers)}"))
    return tiers


def _block_paths(nodes: pa.Table, above: pa.Table) -> Iterator[tuple[int, Path]]:
    """(row of nodes, path) of a block's nodes, which are in order of pos: the block's own part, then what all share."""
    if not len(nodes):
        return
    upper = [(x["at"], [d.hex().encode() for d in x["run"]]) for x in above["path"][0].as_py()]
    block = nodes["pos"][0].as_py() // BLOCK
    for i, path in enumerate(traversed(_hex(nodes["digest"]), height_of(len(nodes), block))):
        yield i, path + upper


def _rows_of(path: Path) -> list[dict]:
    return [{"at": at, "run": [bytes.fromhex(x.decode()) for x in run]} for at, run in path]


def _descended(tiers: list[DataFrame], above: DataFrame, lowest: int) -> DataFrame:
    """(grp, pos, path) of the nodes of tier `lowest`. above: the same of the last tier's."""

    def paths(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("pos")
        found = [_rows_of(p) for _, p in _block_paths(nodes, above)]
        return pa.table({"grp": nodes["grp"], "pos": nodes["pos"], "path": pa.array(found, ARROW_PATH)})

    for tier in reversed(tiers[lowest:-1]):
        held = above.withColumnRenamed("pos", "block").groupBy("grp", "block")
        above = written(_by_block(tier.select("grp", "pos", "digest")).cogroup(held).applyInArrow(paths, f"grp string, pos long, path {PATH}"), "merkle-paths")
    return above


@dataclass(frozen=True)
class Tree:
    """What a dataset's leaves give: their tiers, the groups' tiers above them, and the root."""

    tiers: list[DataFrame]
    groups: list[DataFrame]
    root: str

    def manifest(self) -> DataFrame:
        """(grp, n_leaves, subroot): what one keeps beside the root."""
        counts = self.tiers[0].groupBy("grp").agg(F.count("*").alias("n_leaves"))
        return counts.join(self.tiers[-1].select("grp", F.lower(F.hex("digest")).alias("subroot")), "grp")

    def _shared(self) -> DataFrame:
        """(grp, pos, path) of the blocks of leaves."""
        spark = self.tiers[0].sparkSession
        top = spark.createDataFrame([("", 0, [])], f"grp string, pos long, path {PATH}")
        names = self.groups[0].select("pos", "name")
        subroots = _descended(self.groups, top, 0).join(names, "pos").select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("pos"), "path")
        return _descended(self.tiers, subroots, 1)

    def proofs(self, paths: bool = False) -> DataFrame:
        """The leaves (key, grp, leaf, subroot, root) with the hash of their siblings, and the root that their claimed digest, or the leaf itself where that is null, gives with them. paths: with the whole path."""
        leaves = self.tiers[0]
        kind = leaves.schema["key"].dataType.simpleString()

        def done(nodes: pa.Table, above: pa.Table) -> pa.Table:
            nodes = nodes.sort_by("pos")
            digests, claimed = _hex(nodes["digest"]), _hex(nodes["claimed"])
            proofs, roots, whole = [], [], []
            for i, path in _block_paths(nodes, above):
                proofs.append(proof(path).decode())
                roots.append(folded(claimed[i] or digests[i], path).decode())
                if paths:
                    whole.append(_rows_of(path))
            columns = {"key": nodes["key"], "grp": nodes["grp"], "leaf": [x.decode() for x in digests], "proof_sha256": proofs, "folded_root": roots}
            return pa.table(columns | ({"path": pa.array(whole, ARROW_PATH)} if paths else {}))

        schema = f"key {kind}, grp string, leaf string, proof_sha256 string, folded_root string" + f", path {PATH}" * paths
        blocks = self._shared().withColumnRenamed("pos", "block").groupBy("grp", "block")
        found = _by_block(leaves).cogroup(blocks).applyInArrow(done, schema)
        subroots = self.tiers[-1].select("grp", F.lower(F.hex("digest")).alias("subroot"))
        return found.join(subroots, "grp").withColumn("root", F.lit(self.root))


def encoded(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """The digest of a row's values, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(encoded, values)).cast("binary"), 256))


def merkle_tree(rows: DataFrame, key: Column, group: Column, digest: Column, claimed: Column | None = None) -> Tree:
    """The tree of rows: within each group by the key and then the digest, groups by their text, bytewise, null first. claimed: another digest to be held against the root, or null. Other columns are not carried, whatever their names."""
    # Group names are unlike null and in the order of their bytes.
    named = F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group.cast("string")))
    other = F.lit(None).cast("binary") if claimed is None else claimed
    leaves = rows.select(key.alias("key"), named.alias("grp"), digest.alias("digest"), other.alias("claimed"))
    tiers = _tiers(ranked(leaves, "grp", ["key", "digest"], "merkle-leaves").withColumnRenamed("rank", "pos"))
    subroots = tiers[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest")
    groups = _tiers(ranked(subroots, "grp", ["name"], "merkle-groups").withColumnRenamed("rank", "pos"))
    top = groups[-1].collect()  # one row, or none
    return Tree(tiers, groups, top[0]["digest"].hex() if top else hashlib.sha256().hexdigest())


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, subroot, root and proof, and the root that a copy of it gives in which some texts are lower-cased."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 5 == 0
    lower = leaf(*fields, F.translate("text", UPPER, UPPER.lower()))
    proofs = merkle_tree(docs, F.col("doc_id"), F.col("source"), leaf(*fields, F.col("text")), F.when(tampered, lower)).proofs()
    return proofs.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_ENCODED = " || ".join(f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c} end" for c in ("doc_id", "source", "lang", "n_chars"))
_LEVELS_SQL = """{name}(g, level, pos, d, n) as (
  select g, 0::bigint, row_number() over (partition by g order by {order}) - 1, d, count(*) over (partition by g) from {leaves}
  union all
  select g, level + 1, pos // 16, sha256(string_agg(d, '' order by pos)), ((max(n) + 15) // 16)::bigint from {name} where n > 1 group by g, level, pos // 16
)"""

OP11_SQL = f"""
with recursive rows_ as (select doc_id, source g, sha256({_ENCODED} || case when text is null then '-' else strlen(text) || ':' || text end) d,
  case when doc_id is not null and {crc32_sql('doc_id::varchar')} % 5 = 0 then sha256({_ENCODED} || case when text is null then '-' else strlen(text) || ':' || translate(text, '{UPPER}', '{UPPER.lower()}') end) end claimed from documents),
{_LEVELS_SQL.format(name="own", order="doc_id nulls first, d", leaves="rows_")},
subroots as (select 0 g, g source, d from own where n = 1),
{_LEVELS_SQL.format(name="tops", order="source nulls first", leaves="subroots")},
placed as (select *, row_number() over (partition by g order by doc_id nulls first, d) - 1 pos from rows_),
heads as (select source, d subroot, row_number() over (order by source nulls first) - 1 place from subroots),
runs as (select g, level, pos // 16 run, list(d order by pos) ds, 0 part from own where n > 1 group by all),
top_runs as (select level, pos // 16 run, list(d order by pos) ds from tops where n > 1 group by all),
steps as (
  select doc_id, p.d, p.pos pos0, 0 part, r.level, (p.pos // (16 ** r.level)::bigint) % 16 + 1 a, r.ds from placed p join runs r on r.g is not distinct from p.g and r.run = p.pos // (16 ** (r.level + 1))::bigint
  union all
  select doc_id, p.d, p.pos, 1, r.level, (h.place // (16 ** r.level)::bigint) % 16 + 1, r.ds from placed p join heads h on h.source is not distinct from p.g join top_runs r on r.run = h.place // (16 ** (r.level + 1))::bigint),
paths as (select doc_id, d, pos0, list({{'x': '', 'a': a, 'r': ds}} order by part, level) path from steps group by all),
root as (select max(d) root from tops where n = 1)
select p.doc_id, p.d leaf, h.subroot, root, sha256(array_to_string(list_transform(coalesce(path, []), lambda s: array_to_string(s.r[: s.a - 1], '') || array_to_string(s.r[s.a + 1 :], '')), '')) proof_sha256,
  list_reduce(coalesce(path, []), lambda s, y: {{'x': sha256(array_to_string(y.r[: y.a - 1], '') || s.x || array_to_string(y.r[y.a + 1 :], '')), 'a': y.a, 'r': y.r}}, {{'x': coalesce(claimed, p.d), 'a': 0::bigint, 'r': ['']}}).x folded_root,
  folded_root = root verified
from placed p join heads h on h.source is not distinct from p.g left join paths q on q.doc_id is not distinct from p.doc_id and q.d = p.d and q.pos0 = p.pos, root
"""
