"""Repair of conversations by composition of weighted finite-state machines.

A conversation's turns are an input acceptor; an edit transducer keeps a turn,
gives it another role, deletes it or inserts an empty one, each at a cost; the
grammar of roles, `(s?(ua)+)?` over their initials, is an acceptor. Their
composition is built lazily: states (turn, grammar state, inserts made there) come
up as the search reaches them, in topological order, and weights are (cost, labels)
under lexicographic order, so the shortest path is the cheapest repair and of equal
ones that with the least string of edits' initials. Two paths of one cost over the same turns
never begin one with the other, as a longer one has further inserts; so that order
also holds for paths put together from parts.

A conversation is a group of rows while it has fewer than SEGMENT turns. Longer ones
are ranked (`common.ranked`) and cut into segments, each of which gives the shortest
paths between all pairs of grammar states; these are put together in order, a row a
segment, and only then the segments' turns are repaired, each where its rows are.
What is sequential by definition, the hash over a whole repaired conversation, is
a stream of segments, one in memory at a time. Turns seen earlier are found in such
conversations by sums of equal turns, not by holding them.

Null roles and texts are one space. Turns stand in order, null ones first, equal
ones by role and text. A null key is a conversation of its own. Conversations without turns
repair to nothing, texts of any length are read whole. An empty table gives no rows. Columns that aren't named are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_sql, ranked, table, written

SEGMENT = 512
#: The grammar acceptor: from state to state by a role's initial. 0: nothing yet, 1: after s, 2: after u, 3: after a.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
RECAST, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
WHITE = " \t\n\x0b\x0c\r"

#: The cost and the labels of a path.
Weight = tuple[int, str]


@dataclass(frozen=True)
class Turn:
    turn: int | None
    role: str
    text: str
    #: Its role and text were seen earlier.
    again: bool = False

    @property
    def fault(self) -> str | None:
        """The first that holds: blank, duplicate or truncated."""
        bare = self.text.rstrip(WHITE)
        return "blank" if not bare else "duplicate" if self.again else "truncated" if bare[-1] not in ".!?" else None


def edits(turn: Turn, fault: str | None) -> Iterator[tuple[str, str | None, int]]:
    """The transducer's arcs that read a turn: (label, initial written or None, cost). Written initials of None mean that nothing is."""
    yield "D", None, DELETE
    if fault not in ("blank", "duplicate"):
        more = UNFINISHED if fault == "truncated" else 0
        yield "K", turn.role[:1], more
        for initial in ROLES:
            yield "R", initial, RECAST + more


def _relaxed(weights: dict[int, Weight], state: int, weight: Weight) -> None:
    if state not in weights or weight < weights[state]:
        weights[state] = weight


def with_inserts(weights: dict[int, Weight]) -> dict[int, Weight]:
    """What states cost after inserts before the next turn. Two take a path to every state that any number does; more would come back to one at a higher cost."""
    layer = dict(weights)
    for _ in range(2):
        after: dict[int, Weight] = {}
        for state, (cost, labels) in layer.items():
            for initial, to in GRAMMAR[state].items():
                if initial in ROLES:
                    _relaxed(after, to, (cost + INSERT, labels + "I"))
        for state, weight in after.items():
            _relaxed(weights := dict(weights), state, weight)
        layer = after
    return weights


def shortest(turns: Iterable[Turn], start: int) -> dict[int, Weight]:
    """The lightest path over all turns from a grammar state to every other; inserts after the last turn are not made."""
    weights: dict[int, Weight] = {start: (0, "")}
    for turn in turns:
        after: dict[int, Weight] = {}
        arcs = list(edits(turn, turn.fault))
        for state, (cost, labels) in with_inserts(weights).items():
            for label, initial, price in arcs:
                to = state if initial is None else GRAMMAR[state].get(initial)
                if to is not None:
                    _relaxed(after, to, (cost + price, labels + label))
        weights = after
    return weights


def ended(weights: dict[int, Weight]) -> Weight:
    return min(w for state, w in with_inserts(weights).items() if state in FINAL)


def lines(turns: Iterable[Turn], labels: str, state: int) -> list[str]:
    """`role:text` of the turns after edits, from a grammar state."""
    out, turns = [], iter(turns)
    for label in labels:
        turn = None if label == "I" else next(turns)
        if label == "D":
            continue
        initial = turn.role[:1] if label == "K" else "a" if state == 2 else "u"
        out.append(f"{turn.role if label == 'K' else ROLES[initial]}:{turn.text if turn else ''}")
        state = GRAMMAR[state][initial]
    return out


@dataclass
class Found:
    """What stretches of a conversation have, added up in order."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    distinct: int = 0
    least: int | None = None
    most: int | None = None
    first: str | None = None
    last: str | None = None

    def add(self, other: Found) -> Found:
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        if self.last is not None and other.first is not None and self.last + other.first not in LEGAL:
            self.illegal += 1
        # Turns are in order, so only the last of one and the first of the other can be one.
        self.distinct += other.distinct - (self.most is not None and self.most == other.least)
        self.least = other.least if self.least is None else self.least
        self.most = self.most if other.most is None else other.most
        self.first = other.first if self.first is None else self.first
        self.last = self.last if other.last is None else other.last
        return self

    @classmethod
    def of(cls, turns: list[Turn]) -> Found:
        out = cls()
        for t in turns:
            fault = t.fault
            out.add(cls(fault == "blank", fault == "duplicate", fault == "truncated", 0, t.turn is not None, t.turn, t.turn, t.role[:1], t.role[:1]))
        return out

    @property
    def gaps(self) -> int:
        return 0 if self.least is None else self.most - self.least + 1 - self.distinct


def repair(turns: list[Turn]) -> tuple[Found, Weight, list[str]]:
    """A whole conversation: its faults, the cheapest repair, and what that leaves. Turns in order; those seen earlier are found here."""
    seen: set[tuple[str, str]] = set()
    marked = [Turn(t.turn, t.role, t.text, (t.role, t.text) in seen or seen.add((t.role, t.text)) is not None) for t in turns]
    cost, audit = ended(shortest(marked, 0))
    return Found.of(marked), (cost, audit), lines(marked, audit, 0)


# --- on frames -------------------------------------------------------------

COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _turns(rows: pa.Table) -> list[Turn]:
    rows = rows.sort_by("rank")
    return [Turn(*x) for x in zip(*(rows[c].to_pylist() for c in ("turn", "role", "text", "again")), strict=True) if x[1] is not None]


def _counted(found: Found, weight: Weight) -> dict[str, list]:
    return {"gaps": [found.gaps], "blank": [found.blank], "duplicate": [found.duplicate], "truncated": [found.truncated], "illegal": [found.illegal], "cost": [weight[0]], "audit": [weight[1]]}


def _whole(key: tuple, rows: pa.Table) -> pa.Table:
    found, weight, left = repair(_turns(rows))
    return pa.table({"key": rows["key"][:1], **_counted(found, weight), "repaired": ["\n".join(left)]})


PATHS = "array<struct<from:int,to:int,cost:long,labels:string>>"
ARROW_PATHS = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("cost", pa.int64()), ("labels", pa.string())]))
FOUND = "blank long, duplicate long, truncated long, illegal long, distinct long, least long, most long, first string, last string"


def _segment(key: tuple, rows: pa.Table) -> pa.Table:
    """One segment's faults and its lightest paths between grammar states."""
    turns = _turns(rows)
    paths = [{"from": a, "to": b, "cost": w[0], "labels": w[1]} for a in GRAMMAR for b, w in shortest(turns, a).items()]
    found = vars(Found.of(turns))
    kinds = {"first": pa.string(), "last": pa.string()}
    return pa.table({"grp": key[:1], "segment": key[1:], "key": rows["key"][:1], **{n: pa.array([v], kinds.get(n, pa.int64())) for n, v in found.items()}, "paths": pa.array([paths], ARROW_PATHS)})


@dataclass
class _Joined:
    """The segments of one conversation so far: the lightest path to every state, and by which states it came."""

    key: object
    found: Found = field(default_factory=Found)
    weights: dict[int, Weight] = field(default_factory=lambda: {0: (0, "")})
    came: list[dict[int, int]] = field(default_factory=list)

    def add(self, row: dict) -> None:
        self.found.add(Found(**{n: row[n] for n in vars(self.found)}))
        after: dict[int, Weight] = {}
        came: dict[int, int] = {}
        for p in row["paths"]:
            if p["from"] in self.weights:
                cost, labels = self.weights[p["from"]]
                weight = (cost + p["cost"], labels + p["labels"])
                if p["to"] not in after or weight < after[p["to"]]:
                    after[p["to"]], came[p["to"]] = weight, p["from"]
        self.weights = after
        self.came.append(came)

    def end(self, grp: str) -> dict:
        """The conversation's row. choices: the states between which each segment's path runs; tail: inserts after the last turn."""
        cost, audit = ended(self.weights)
        state = min(s for s in self.weights if ended({s: self.weights[s]}) == (cost, audit)) if self.weights else 0
        tail, choices, at = len(audit) - len(self.weights[state][1]), [], state
        for came in reversed(self.came):
            choices.append({"from": came[at], "to": at})
            at = came[at]
        counts = {n: v[0] for n, v in _counted(self.found, (cost, audit)).items()}
        return {"grp": grp, "key": self.key, **counts, "choices": choices[::-1], "state": state, "tail": tail}


def _joined(segments: DataFrame, kind: str) -> DataFrame:
    """A row for each conversation from its segments, which come in order. A task holds one conversation's paths to four states."""
    schema = f"grp string, key {kind}, {COUNTS}, choices array<struct<from:int,to:int>>, state int, tail int"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, under_way = None, None
        out_schema = None
        for b in batches:
            out_schema = pa.schema([("grp", pa.string()), ("key", b.schema.field("key").type), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("choices", pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))), ("state", pa.int32()), ("tail", pa.int32())])
            for row in b.to_pylist():
                if row["grp"] != grp:
                    if under_way:
                        yield pa.RecordBatch.from_pylist([under_way.end(grp)], out_schema)
                    grp, under_way = row["grp"], _Joined(row["key"])
                under_way.add(row)
        if under_way:
            yield pa.RecordBatch.from_pylist([under_way.end(grp)], out_schema)

    return segments.repartition("grp").sortWithinPartitions("grp", "segment").mapInArrow(rows, schema)


def _hashed(texts: DataFrame) -> DataFrame:
    """(grp, repaired_sha256) of segments' lines (grp, segment, lines; null for none), in order, a segment at a time."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, digest, any_ = None, None, False
        for b in batches:
            for row in b.to_pylist():
                if row["grp"] != grp:
                    if digest:
                        yield pa.RecordBatch.from_pydict({"grp": [grp], "repaired_sha256": [digest.hexdigest()]})
                    grp, digest, any_ = row["grp"], hashlib.sha256(), False
                if row["lines"] is not None:
                    digest.update(("\n" * any_ + row["lines"]).encode())
                    any_ = True
        if digest:
            yield pa.RecordBatch.from_pydict({"grp": [grp], "repaired_sha256": [digest.hexdigest()]})

    return texts.repartition("grp").sortWithinPartitions("grp", "segment").mapInArrow(rows, "grp string, repaired_sha256 string")


def _long(rows: DataFrame, kind: str) -> DataFrame:
    """Conversations of SEGMENT turns or more."""
    same = ["grp", "role", "hash"]
    hashed = rows.withColumn("hash", F.sha2("text", 256))
    several = written(hashed.where("role is not null").groupBy(*same).agg(F.min("rank").alias("first_rank"), F.count("*").alias("n")).where("n > 1").drop("n"), "turns-seen")
    marked = hashed.drop("again").join(several, same, "left").withColumn("again", F.coalesce(F.col("rank") > F.col("first_rank"), F.lit(False))).drop("hash", "first_rank")
    marked = written(marked.withColumn("segment", F.floor(F.col("rank") / SEGMENT).cast("long")), "turns-marked")
    segments = written(marked.groupBy("grp", "segment").applyInArrow(_segment, f"grp string, segment long, key {kind}, {FOUND}, paths {PATHS}"), "segments")
    done = written(_joined(segments, kind), "joined-segments")
    ends = done.select("grp", F.posexplode("choices").alias("segment", "c"), (F.size("choices") - 1).alias("last"), "state", "tail")
    chosen = ends.select("grp", F.col("segment").cast("long").alias("segment"), F.col("c.from").alias("from"), F.col("c.to").alias("to"), F.when(F.col("segment") == F.col("last"), F.col("tail")).otherwise(0).alias("tail"))
    labels = segments.select("grp", "segment", F.explode("paths").alias("p")).select("grp", "segment", "p.from", "p.to", "p.labels").join(chosen, ["grp", "segment", "from", "to"])

    def repaired(turns: pa.Table, path: pa.Table) -> pa.Table:
        p = path.to_pylist()[0]
        kept = lines(_turns(turns), p["labels"] + "I" * p["tail"], p["from"])
        return pa.table({"grp": [p["grp"]], "segment": [p["segment"]], "lines": pa.array(["\n".join(kept) if kept else None], pa.string())})

    texts = marked.groupBy("grp", "segment").cogroup(labels.groupBy("grp", "segment")).applyInArrow(repaired, "grp string, segment long, lines string")
    return done.join(_hashed(texts), "grp").select("key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair_conversations(turns: DataFrame, key: Column, turn: Column, role: Column, text: Column) -> DataFrame:
    """A row for each conversation: key, its faults, cost and audit (the edits' initials) of the cheapest repair, and the SHA-256 of what it leaves (`role:text` lines). A row whose role is null is no turn, but its conversation is there."""
    rows = turns.select(key.alias("key"), F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("")).alias("grp"), turn.cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.lit(False).alias("again"))
    kind = rows.schema["key"].dataType.simpleString()
    placed = ranked(rows, "grp", ["turn", "role", "text"], "turns")
    large = written(placed.where(F.col("rank") == SEGMENT - 1).select("grp"), "long-conversations")
    if large.isEmpty():
        short, long_ = placed, None
    else:
        short, long_ = placed.join(large, "grp", "left_anti"), placed.join(large, "grp", "left_semi")
    done = short.groupBy("grp").applyInArrow(_whole, f"key {kind}, {COUNTS}, repaired string").withColumn("repaired_sha256", F.sha2("repaired", 256)).drop("repaired")
    return done if long_ is None else done.unionByName(_long(long_, kind))


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations of which some turns are dropped (role null), emptied, cut of their ends, repeated or given to the user, by a hash of their place."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat_ws(":", said("conv_id"), said("turn")), "utf-8")) % 20
    role = F.when(kind == 4, "user").when(kind != 0, said("role"))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage: its faults and its cheapest repair."""
    turns = damaged(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    done = repair_conversations(turns, *(F.col(c) for c in ("conv_id", "turn", "role", "text")))
    return done.withColumnRenamed("key", "conv_id")


def _then(state: str, cost: str, label: str, line: str = "") -> str:
    """SQL for a state's path (cost, audit, lines) after one more edit."""
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{label}', 'y': {state}.y{line and f' || chr(10) || {line}'}}}"


def _let(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _inserted(states: str) -> str:
    new = lambda i, role: _then(f"q[{i}]", "5", "I", f"'{role}:'")
    return _let(states, "q", f"[q[1], q[2], list_min([q[3], {new(1, 'user')}, {new(2, 'user')}, {new(4, 'user')}]), list_min([q[4], {new(3, 'assistant')}])]")


#: What no repair costs.
_NEVER = 10**9


def _read(states: str) -> str:
    """SQL for the four states after the turn r."""
    gone = lambda i: _then(f"w[{i}]", "2", "D")
    kept = lambda i, initial: _then(f"w[{i}]", f"(case when r.x or r.c <> '{initial}' then {_NEVER} else r.t end)", "K", "r.r || ':' || r.y")
    recast = lambda i, role: _then(f"w[{i}]", f"(case when r.x then {_NEVER} else 1 + r.t end)", "R", f"'{role}:' || r.y")
    to_user = ", ".join(f"{kept(i, 'u')}, {recast(i, 'user')}" for i in (1, 2, 4))
    return _let(states, "w", f"[{gone(1)}, list_min([{gone(2)}, {kept(1, 's')}]), list_min([{gone(3)}, {to_user}]), list_min([{gone(4)}, {kept(3, 'a')}, {recast(3, 'assistant')}])]")


_START = "[{'c': 0::bigint, 'a': '', 'y': ''}, " + ", ".join([f"{{'c': {_NEVER}::bigint, 'a': '', 'y': ''}}"] * 3) + "]"
_ROW = "{{'s': {s}, 'c': {c}, 'x': {x}, 't': {t}, 'r': {r}, 'y': {y}}}"

OP13_SQL = f"""
with hashed as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc32_sql("(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))")} % 20 k from conversations),
turns as (select conv_id, turn, case when k = 4 then 'user' else role end as role, case k when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text from hashed, (values (0), (1)) c(copy) where k <> 0 and (copy = 0 or k = 3)),
placed as (select *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) bare, row_number() over (partition by conv_id order by turn nulls first, role, text) i from turns),
judged as (select *, left(role, 1) c, lag(left(role, 1)) over (partition by conv_id order by i) before,
  case when bare = '' then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate' when right(bare, 1) not in ('.', '!', '?') then 'truncated' else '' end fault from placed),
summed as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint gaps, count(*) filter (fault = 'blank') blank, count(*) filter (fault = 'duplicate') duplicate, count(*) filter (fault = 'truncated') truncated,
  count(*) filter (before || c not in ('su', 'ua', 'au')) illegal,
  list({_ROW.format(s=_START, c="c", x="fault in ('blank', 'duplicate')", t="(case when fault = 'truncated' then 5 else 0 end)::bigint", r="role", y="text")} order by i) rs from judged group by conv_id),
walked as (select *, list_reduce(rs, lambda w0, r: {_ROW.format(s=_read(_inserted(_inserted("w0.s"))), c="''", x="false", t="0::bigint", r="''", y="''")}, {_ROW.format(s=_START, c="''", x="false", t="0::bigint", r="''", y="''")}).s ends from summed),
best as (select *, {_let(_inserted(_inserted("ends")), "e", "list_min([e[1], e[4]])")} b from walked)
select conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal, coalesce(b.c, 0) as cost, coalesce(b.a, '') audit, sha256(coalesce(substr(b.y, 2), '')) repaired_sha256
from (select distinct conv_id from conversations) o left join (select * rename (conv_id as own) from best) b_ on b_.own is not distinct from o.conv_id
"""
