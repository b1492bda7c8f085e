from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversations as c

ROWS = "conv_id long, turn long, role string, text string, part string, fault string, tie string"


def plain(turns, ends=c.ENDS, entry=0):
    """Cheapest and least edit string by full recursion over (row, state)."""
    best = {(len(turns), s): (ends[s], c.finish(s) if ends is c.ENDS else "") for s in range(4)}
    for at in range(len(turns) - 1, -1, -1):
        for _ in range(4):  # insertions lead from state to state of a layer
            for s in range(4):
                t, more = turns[at], 5 * turns[at].cut
                options = [(2 + best[at + 1, s][0], "D" + best[at + 1, s][1])]
                u = c._next(s)[1]
                if (at, u) in best:
                    options.append((5 + best[at, u][0], "I" + best[at, u][1]))
                if not t.gone:
                    options.append((1 + more + best[at + 1, u][0], "R" + best[at + 1, u][1]))
                    if t.initial in c.TURNS[s]:
                        k = c.TURNS[s][t.initial]
                        options.append((more + best[at + 1, k][0], "K" + best[at + 1, k][1]))
                best[at, s] = min(options)
    return best[0, entry]


def turn(rng):
    return c.Turn(rng.choice("suau "), rng.random() < 0.2, rng.random() < 0.2)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 17, 60])
def test_auction_equals_recursion(n):
    rng = random.Random(n)
    for _ in range(60):
        turns = [turn(rng) for _ in range(n)]
        lattice = c.Lattice(turns)
        audit, state = lattice.trace(0)
        assert (lattice.settle(0, 0), audit + c.finish(state)) == plain(turns)


def test_costs_between_states():
    rng = random.Random(5)
    for _ in range(40):
        turns = [turn(rng) for _ in range(rng.choice([1, 2, 5, 9]))]
        far = 10**6
        got = c.Lattice(turns).costs_to()
        for s, e in itertools.product(range(4), range(4)):
            want = plain(turns, tuple(0 if x == e else far for x in range(4)), s)[0]
            assert got[s][e] == (want if want < far else None)


def _data():
    rng = random.Random(2)
    out = []
    for conv in [*range(30), None]:
        for t in range(rng.choice([1, 3, 8, 20])):
            role = rng.choice(["user", "assistant", "system", "tool", "", None])
            out.append((conv, rng.choice([t, t, t, None]), role, rng.choice(["a.", "b", "  ", "", None, "same!", f"x{t}?", "x.\n \t"]), "x", "x", "x"))
    return out


def _result(df):
    return sorted(((r.conv_id is not None, r.conv_id or 0, *[r[k] for k in c.RESULT[1:8]], [tuple(x) for x in r.repaired]) for r in df.collect()), key=str)


def _expected(rows):
    out = []
    for conv in {r[0] for r in rows}:
        mine = [(t, r or " " if r is None else r, " " if x is None else x) for i, t, r, x, *_ in rows if i == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, turns, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in mine:
            solid = text.rstrip(" \t\n\v\f\r")
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            turns.append(c.Turn(role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        known = [t for t, _, _ in mine if t is not None]
        initials = [r[:1] or " " for _, r, _ in mine]
        cost, audit = plain(turns)
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a + b not in c.LEGAL for a, b in itertools.pairwise(initials))
        repaired = [(x["role"], x["text"]) for x in c.edited([(r, x) for _, r, x in mine], audit, 0)]
        out.append((conv is not None, conv or 0, gaps, *counts.values(), illegal, cost, audit, repaired))
    return sorted(out, key=str)


@pytest.mark.parametrize("per_range", [100_000, 40, 7])
def test_repair_in_one_range_and_in_many(spark, per_range):
    rows = _data()
    df = spark.createDataFrame(rows, ROWS)
    assert _result(c.repair(df, rows_per_range=per_range)) == _expected(rows)


def test_one_conversation_over_many_ranges(spark):
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"q{t}?", f"r{t}"]), "x", "x", "x") for t in range(300)]
    assert _result(c.repair(spark.createDataFrame(rows, ROWS), rows_per_range=20)) == _expected(rows)


def test_damage_and_empty_tables(spark):
    rows = [(i, t, "assistant", "Well. Yes!", "x", "x", "x") for i in range(40) for t in (0, 1, None)]
    df = spark.createDataFrame(rows, ROWS)
    kinds = {(r.conv_id, r.turn): r.k for r in df.select("conv_id", "turn", F.expr("crc32(cast(concat(conv_id, ':', coalesce(cast(turn as string), ' ')) as binary)) % 20").alias("k")).collect()}
    got = {}
    for r in c.damaged(df).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text))
    usual = [("assistant", "Well. Yes!")]
    want = {0: None, 1: [("assistant", "")], 2: [("assistant", "Well Yes")], 3: usual * 2, 4: [("user", "Well. Yes!")]}
    assert all(got.get(k) == want.get(v, usual) for k, v in kinds.items()) and {0, 1, 2, 3, 4} <= set(kinds.values())
    assert c.repair(df.where("false"), df.where("false")).count() == 0
    bare = c.repair(df.where("conv_id = 1"), df).where("conv_id = 2").collect()
    assert [(r.gaps, r.cost, r.audit, r.repaired) for r in bare] == [(0, 0, "", [])]
