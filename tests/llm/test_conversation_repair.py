import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskwright.llm import conversation_repair as R

GOOD = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"


def all_repairs(turns, most_inserts):
    """Every string of edits with at most so many inserts: (cost, labels, lines), by trying them all. turns: (role, text)."""
    seen, kinds = set(), []
    for role, text in turns:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        kinds.append("x" if not bare or (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    for places in itertools.product(range(most_inserts + 1), repeat=len(turns) + 1):
        if sum(places) > most_inserts:
            continue
        options = []
        for i, n in enumerate(places):
            options += [[("I", 5, "user", ""), ("I", 5, "assistant", "")]] * n
            if i < len(turns):
                (role, text), more = turns[i], 5 if kinds[i] == "t" else 0
                kept = [] if kinds[i] == "x" else [("K", more, role, text), ("R", 1 + more, "user", text), ("R", 1 + more, "assistant", text)]
                options.append([("D", 2, None, None), *kept])
        for chosen in itertools.product(*options):
            roles = [r for _, _, r, _ in chosen if r is not None]
            if GOOD.fullmatch("".join(r[:1] for r in roles)) and all(roles):
                yield sum(c[1] for c in chosen), "".join(c[0] for c in chosen), [f"{r}:{t}" for _, _, r, t in chosen if r is not None]


TURN = st.tuples(st.sampled_from(["user", "assistant", "system", "tool", " "]), st.sampled_from(["a.", "b!", "cut", "", " \t", "c? "]))


@settings(max_examples=150, deadline=None)
@given(st.lists(TURN, max_size=4))
def test_repair_is_the_best_of_all(turns):
    _, weight, left = R.repair([R.Turn(i, *t) for i, t in enumerate(turns)])
    want = min(all_repairs(turns, 2))
    assert (*weight, left) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(TURN, min_size=1, max_size=14), st.data())
def test_segments_put_together_are_the_whole(turns, data):
    seen = set()
    marked = [R.Turn(i // 2, r, t, (r, t) in seen or seen.add((r, t)) is not None) for i, (r, t) in enumerate(turns)]
    cuts = sorted({0, len(marked), *data.draw(st.lists(st.integers(0, len(marked)), max_size=4))})
    joined = R._Joined(1)
    parts = [marked[a:b] for a, b in itertools.pairwise(cuts)]
    for part in parts:
        paths = [{"from": a, "to": b, "cost": w[0], "labels": w[1]} for a in R.GRAMMAR for b, w in R.shortest(part, a).items()]
        joined.add(vars(R.Found.of(part)) | {"paths": paths})
    got = joined.end("")
    found, (cost, audit), left = R.repair([R.Turn(i // 2, r, t) for i, (r, t) in enumerate(turns)])
    assert (got["cost"], got["audit"]) == (cost, audit)
    assert joined.found == found
    out = []
    for i, (part, choice) in enumerate(zip(parts, got["choices"], strict=True)):
        labels = R.shortest(part, choice["from"])[choice["to"]][1]
        out += R.lines(part, labels + "I" * (got["tail"] if i == len(parts) - 1 else 0), choice["from"])
    assert out == left


def plain(rows):
    """{conv_id: row} by the definition, with whole conversations in memory; repairs by R.repair, which is held against all repairs above."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c] = by[c]
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by[c] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for c, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        known = {t for t, *_ in turns if t is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        seen, counts = set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in turns:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        _, (cost, audit), left = R.repair([R.Turn(*t) for t in turns])
        out[c] = (c, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def conversations():
    random.seed(4)
    text = lambda: random.choice(["Fine.", "Why?", "And so", "", " ", "No!\n", "é.", f"word {random.random()}."])
    rows = [(c, t, random.choice(["user", "assistant", "system"]) if random.random() < 0.2 else ("user", "assistant")[t % 2], text()) for c in range(150) for t in range(random.randint(1, 9))]
    rows += [(c, t, r, x) for c in (None, 500) for t, r, x in ((None, "user", "a."), (None, None, None), (3, "assistant", "b."), (9, "user", "x" * 200_000), (3, "assistant", "b."))]
    # 501 and 502 are long, one with turns that come again and again and one of single turns; dropped rows alone make a conversation without turns.
    rows += [(501, t // 3, ("user", "assistant")[t % 2], text()) for t in range(1700)]
    rows += [(502, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(R.SEGMENT)]
    gone = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    return [*rows, (gone, 0, "user", "gone.")], gone


def test_query_is_the_definition(spark, tmp_path):
    rows, gone = conversations()
    spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", rank int, key string").repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r) for r in R.op13_conversation_repair(spark, str(tmp_path)).collect()}
    want = plain(rows)
    assert set(got) == set(want)
    assert [c for c in want if got[c] != want[c]] == []
    assert got[gone] == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert want[501][2] > 100
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet' where conv_id is null or conv_id <> 501")
    sql = {r[0]: tuple(r) for r in con.sql(R.OP13_SQL).fetchall()}
    assert [c for c in want if c != 501 and sql[c] != want[c]] == []


def test_an_empty_table_has_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert R.repair_conversations(empty, *(F.col(c) for c in empty.columns)).count() == 0


@pytest.mark.parametrize(("turns", "want"), [([], (0, "")), ([("user", "a.")], (2, "D")), ([("assistant", "a.")], (2, "D")), ([("user", "a."), ("user", "b.")], (1, "KR")), ([("system", "s."), ("assistant", "a."), ("user", "b.")], (2, "KRR"))])
def test_small_repairs(turns, want):
    assert R.repair([R.Turn(i, *t) for i, t in enumerate(turns)])[1] == want
