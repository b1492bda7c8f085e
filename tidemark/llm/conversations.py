"""Conversation structure repair: cheapest edits by an auction on node prices, traced in letter order over tight arcs."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.llm.common import cut, null_safe

#: rows of conversations that one task holds
ROWS_PER_RANGE = 50_000
#: layers of the lattice whose prices are raised together
SEGMENT = 16
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: state → {role initial: next state}; 0 nothing yet, 1 behind the system turn, 2 an answer is due, 3 a question is due (0 and 3 may end)
TURNS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ROLES = {"u": "user", "a": "assistant"}
#: cost to the end from each state behind the last row: a missing answer, or a question and an answer
ENDS = (0, 2 * INSERT, INSERT, 0)
LEGAL = ("su", "ua", "au")


def _next(state: int) -> tuple[str, int]:
    """The role that an inserted or rerolled turn takes in this state, and the state behind it."""
    initial = "a" if state == 2 else "u"
    return initial, TURNS[state][initial]


class Turn(NamedTuple):
    initial: str
    gone: bool  # blank or duplicate: must be deleted
    cut: bool  # ends early: costs more if it stays


class Lattice:
    """Nodes (rows done, state) and edits as arcs, with a price per node that never exceeds its distance to the end.

    A path grows from an origin: where the price of its last node is below the cheapest arc plus the price behind it, the price
    is raised to that and the node leaves the path; else the path takes the cheapest arc. Once it arrives, the origin's price
    is its distance, and every arc of a cheapest path is tight (price = cost + price behind it).
    """

    def __init__(self, turns: list[Turn], ends: tuple[int, ...] = ENDS):
        self.turns, self.last = turns, len(turns)
        self.prices = [[0, 0, 0, 0] for _ in turns] + [list(ends)]
        self.settled = [[False] * 4 for _ in turns] + [[True] * 4]
        for first in range((self.last - 1) // SEGMENT * SEGMENT, -1, -SEGMENT):
            least = min(self.prices[min(first + SEGMENT, self.last)])  # a start that no distance is below
            for layer in range(first, min(first + SEGMENT, self.last)):
                self.prices[layer] = [least] * 4
            for state in range(4) if first else (0,):
                self.settle(first, state)

    def arcs(self, layer: int, state: int) -> list[tuple[str, int, int, int]]:
        """(letter, cost, rows done, state) in letter order."""
        turn, more = self.turns[layer], TRUNCATED if self.turns[layer].cut else 0
        out = [("D", DELETE, layer + 1, state), ("I", INSERT, layer, _next(state)[1])]
        if not turn.gone:
            kept = TURNS[state].get(turn.initial)
            if kept is not None:
                out.append(("K", more, layer + 1, kept))
            out.append(("R", REROLE + more, layer + 1, _next(state)[1]))
        return out

    def settle(self, layer: int, state: int) -> int:
        """The distance from a node to the end: the auction with this node as its origin."""
        path = [(layer, state)]
        while not self.settled[layer][state]:
            at, s = path[-1]
            if self.settled[at][s]:
                for done, t in path:  # arrived: all of the path is tight, so exact
                    self.settled[done][t] = True
                break
            cost, to = min((c + self.prices[i][t], (i, t)) for _, c, i, t in self.arcs(at, s))
            if self.prices[at][s] < cost:
                self.prices[at][s] = cost
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        return self.prices[layer][state]

    def trace(self, state: int) -> tuple[str, int]:
        """The least of the cheapest edit strings from a state before the first row, and the state behind the last row."""
        layer, letters = 0, []
        while layer < self.last:
            here = self.settle(layer, state)
            for letter, cost, i, t in self.arcs(layer, state):
                if here == cost + self.prices[i][t] and here == cost + self.settle(i, t):
                    letters.append(letter)
                    layer, state = i, t
                    break
        return "".join(letters), state

    def costs_to(self) -> list[list[int | None]]:
        """Cost from each state before the first row to each state behind the last one, without the edits behind it."""
        out: list[list[int | None]] = [[None] * 4 for _ in range(4)]
        out[0][0] = out[1][1] = DELETE * self.last
        system = [TRUNCATED * t.cut for t in self.turns if t.initial == "s" and not t.gone]
        if system:
            out[0][1] = DELETE * (self.last - 1) + min(system)
        for end in (2, 3):  # every state reaches these two by insertions; elsewhere a price beyond any cost
            far = 100 + (DELETE + 2 * INSERT) * (self.last + 1)
            one = Lattice(self.turns, tuple(0 if s == end else far for s in range(4)))
            for s in range(4):
                out[s][end] = one.settle(0, s) if one.settle(0, s) < far else None
        return out


def finish(state: int) -> str:
    """Insertions behind the last row."""
    return "I" * (ENDS[state] // INSERT)


def edited(rows: list[tuple[str, str]], audit: str, state: int) -> list[dict]:
    """Apply an edit string to (role, text) rows, from a state on."""
    out, at = [], 0
    for letter in audit:
        initial, after = _next(state)
        if letter == "I":
            out.append({"role": ROLES[initial], "text": ""})
            state = after
            continue
        role, text = rows[at]
        at += 1
        if letter == "K":
            out.append({"role": role, "text": text})
            state = TURNS[state][role[:1]]
        elif letter == "R":
            out.append({"role": ROLES[initial], "text": text})
            state = after
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a faulty export leaves them, by crc32 of ``conv_id:turn`` modulo 20 (null: one blank):
    0 drops the row, 1 empties its text, 2 removes its stops, 3 repeats it, 4 makes it a user turn."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.pmod(F.crc32(F.concat_ws(":", *named).cast("binary")), F.lit(20))
    role, text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text")]
    rows = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"),
    )
    return rows.where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "copy")


PART = "conv_id {id}, part int, rows long, blank long, duplicate long, truncated long, illegal long, low long, high long, turns long, first_turn long, last_turn long, opens string, closes string"
EDITS = "entry int, leaves int, price long, audit string, repaired array<struct<role: string, text: string>>"
COSTS = "costs array<array<long>>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Runs of rows of one conversation in one range, in their order."""
    held: dict = {}
    for batch in batches:
        for row in batch.to_pylist():
            key = (row["conv_id"], row["part"])
            if held and held["key"] != key:
                yield held
                held = {}
            if not held:
                held = {"key": key, "rows": [], "ends": row["ends"]}
            held["rows"].append(row)
    if held:
        yield held


def _summary(block: dict) -> dict:
    rows = block["rows"]
    initials = [r["role"][:1] or " " for r in rows]
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    return {
        "conv_id": block["key"][0],
        "part": block["key"][1],
        "rows": len(rows),
        "blank": sum(r["fault"] == "blank" for r in rows),
        "duplicate": sum(r["fault"] == "duplicate" for r in rows),
        "truncated": sum(r["fault"] == "truncated" for r in rows),
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)),
        "low": min(turns, default=None),
        "high": max(turns, default=None),
        "turns": len(set(turns)),
        "first_turn": turns[0] if turns else None,
        "last_turn": turns[-1] if turns else None,
        "opens": initials[0],
        "closes": initials[-1],
    }


def _lattice(block: dict) -> Lattice:
    turns = [Turn(r["role"][:1], r["fault"] in ("blank", "duplicate"), r["fault"] == "truncated") for r in block["rows"]]
    return Lattice(turns, tuple(block["ends"] or ENDS))


def _arrow(schema: pa.Schema, work):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        held = 0
        for block in _blocks(batches):
            for row in work(block):
                out.append(row)
                held += row["rows"]
            if held > 4096:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _price(block: dict) -> Iterator[dict]:
    yield _summary(block) | {"costs": _lattice(block).costs_to()}


def _edit(block: dict) -> Iterator[dict]:
    """One row for a whole conversation; one per state it may be entered in for a part of a conversation."""
    summary, lattice = _summary(block), _lattice(block)
    rows = [(r["role"], r["text"]) for r in block["rows"]]
    for entry in range(4) if block["ends"] else (0,):
        price = lattice.settle(0, entry)
        audit, state = lattice.trace(entry)
        if block["ends"]:
            price -= block["ends"][state]
        else:
            audit += finish(state)
        yield summary | {"entry": entry, "leaves": state, "price": price, "audit": audit, "repaired": edited(rows, audit, entry)}


def _prices_behind(parts: Column) -> Column:
    """Distance to the end from each state behind each part: [end, behind the last but one, ..., before the first]."""
    step = lambda prices, part: F.concat(
        prices,
        F.array(F.transform(part["costs"], lambda row: F.array_min(F.zip_with(row, F.element_at(prices, -1), lambda a, b: a + b)))),
    )
    start = F.array(F.array(*[F.lit(e).cast("long") for e in ENDS]))
    return F.aggregate(F.reverse(parts), start, step)


def _states_before(parts: Column) -> Column:
    """State before each part, and behind the last: folds the parts' maps of states."""
    return F.aggregate(parts, F.array(F.lit(0)), lambda states, part: F.concat(states, F.array(F.element_at(part["leaves"], F.element_at(states, -1) + 1))))


def repair(rows: DataFrame, ids: DataFrame | None = None, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Faults of every conversation and its cheapest repair to ``system? (user assistant)+``, or to nothing.

    ``rows``: conv_id, turn, role, text; other columns are ignored. ``ids``: a table whose conv_ids all come back, also those without
    rows (zeros, an empty audit, no repaired rows). Rows are ordered by turn (null first), then role and text. Returns conv_id, gaps,
    blank, duplicate, truncated, illegal, cost, audit and ``repaired``, an array of (role, text).
    A row keeps its place (K, 0), takes the role user or assistant (R, 1) or goes (D, 2); blank rows and rows whose role and
    text came before must go; an empty user or assistant turn may be put in anywhere (I, 5); a row that stays without a stop at its end
    costs 5 more. Of the cheapest edit strings the least counts.

    Rows are range-partitioned by conversation and order, so a conversation of any length lies in several bounded ranges. The auction
    runs inside a range. A conversation over several ranges has its parts' costs between states folded backward (which gives every
    part the prices behind it) and the traced parts' states forward; the edits of its parts are then joined in one row.

    Null conv_ids are one conversation; null role and text count as one blank, so a null text is blank; null turns take no part in
    ``gaps``. Equal rows are duplicates. An empty table gives no rows.
    """
    id_type = rows.schema["conv_id"].dataType.simpleString()
    base = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    base = base.withColumns({"same": F.xxhash64("role", "text", F.length("role")), "also": F.xxhash64("text", F.lit(7), "role")})
    base = cut(base.withColumn("tie", F.monotonically_increasing_id()))
    place = F.struct(F.coalesce(F.col("turn"), F.lit(-(1 << 63))).alias("turn"), F.col("tie").alias("tie"))
    seen = base.groupBy("conv_id", "same", "also").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    parts = max(1, -(-base.count() // rows_per_range))
    solid = F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", "")
    fault = (
        F.when(F.length(solid) == 0, "blank")
        .when(place != F.col("first"), "duplicate")
        .when(~F.substring(solid, -1, 1).isin(".", "!", "?"), "truncated")
    )
    marked = null_safe(base, seen, ["conv_id", "same", "also"]).withColumn("fault", fault).drop("first", "same", "also")
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", "tie"]
    ranged = cut(marked.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    spans = ranged.groupBy("conv_id").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    crossing = F.broadcast(cut(spans.where("low < high").select("conv_id", F.lit(True).alias("crosses")), light=True))  # fewer than there are ranges

    def dealt(df: DataFrame, work, ddl: str) -> DataFrame:
        schema = f"{PART.format(id=id_type)}, {ddl}"
        return df.repartition(parts, "part").sortWithinPartitions("part", *order).mapInArrow(_arrow(to_arrow_schema(StructType.fromDDL(schema)), work), schema)

    long_rows = null_safe(ranged, crossing, ["conv_id"], "inner").drop("crosses")
    costs = dealt(long_rows.withColumn("ends", F.lit(None).cast("array<long>")), _price, COSTS)
    by_part = costs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "costs"))).alias("parts"))  # an entry per range
    behind = by_part.withColumn("prices", F.reverse(_prices_behind(F.col("parts")))).select("conv_id", F.posexplode("parts").alias("nth", "p"), "prices")
    behind = cut(behind.select("conv_id", F.col("p.part").alias("part"), F.col("prices")[F.col("nth") + 1].alias("ends")), light=True)
    found = cut(dealt(null_safe(ranged, F.broadcast(behind), ["conv_id", "part"]), _edit, EDITS))
    found = null_safe(found, crossing, ["conv_id"])
    leaves = F.transform(F.sort_array(F.collect_list(F.struct("entry", "leaves"))), lambda x: x["leaves"])
    chain = found.where("crosses").groupBy("conv_id", "part").agg(leaves.alias("leaves"))
    chain = chain.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "leaves"))).alias("parts")).withColumn("states", _states_before(F.col("parts")))
    chain = chain.select("conv_id", F.posexplode("parts").alias("nth", "p"), "states")
    chain = cut(chain.select("conv_id", F.col("p.part").alias("part"), F.col("states")[F.col("nth")].alias("entry")), light=True)
    whole = found.where("crosses IS NULL").withColumn("gaps", F.col("high") - F.col("low") + 1 - F.col("turns")).withColumnRenamed("price", "cost")
    whole = whole.select(*RESULT).unionByName(_joined(null_safe(found.where("crosses"), F.broadcast(chain), ["conv_id", "part", "entry"], "inner")))
    whole = whole.withColumn("gaps", F.coalesce("gaps", F.lit(0).cast("long")))
    if ids is None:
        return whole
    ids = ids.select("conv_id").distinct()
    bare = null_safe(ids, whole.select("conv_id"), ["conv_id"], "left_anti")
    zero = [F.lit(0).cast("long").alias(c) for c in RESULT[1:7]]
    return whole.unionByName(bare.select("conv_id", *zero, F.lit("").alias("audit"), F.array().cast(TURN_ROWS).alias("repaired")))


RESULT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"]
TURN_ROWS = "array<struct<role: string, text: string>>"


def _joined(parts: DataFrame) -> DataFrame:
    """One row per conversation from its parts, each of them entered in the state that the one before leaves."""
    inside = ["part", *[c for c in parts.columns if c not in ("conv_id", "part", "entry", "crosses")]]
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*inside))).alias("p"))
    seams = F.arrays_zip(F.slice("p", 1, F.size("p") - 1).alias("a"), F.slice("p", 2, F.size("p")).alias("b"))
    total = lambda name: F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x[name])
    at = lambda test: F.size(F.filter(seams, test))
    illegal = total("illegal") + at(lambda x: ~F.concat(x["a"]["closes"], x["b"]["opens"]).isin(*LEGAL))
    distinct = total("turns") - at(lambda x: x["a"]["last_turn"] == x["b"]["first_turn"])
    state = F.element_at("p", -1)["leaves"]
    by_state = lambda values: F.element_at(F.array(*values), state + 1)
    turn = lambda role: F.struct(F.lit(role).alias("role"), F.lit("").alias("text"))
    tails = [F.array().cast(TURN_ROWS), F.array(turn("user"), turn("assistant")), F.array(turn("assistant")), F.array().cast(TURN_ROWS)]
    low, high = F.array_min(F.transform("p", lambda x: x["low"])), F.array_max(F.transform("p", lambda x: x["high"]))
    return whole.select(
        "conv_id",
        (high - low + 1 - distinct).alias("gaps"),
        *[total(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        illegal.alias("illegal"),
        (total("price") + by_state([F.lit(e) for e in ENDS])).cast("long").alias("cost"),
        F.concat(F.array_join(F.transform("p", lambda x: x["audit"]), ""), by_state([F.lit(finish(s)) for s in range(4)])).alias("audit"),
        F.concat(F.flatten(F.transform("p", lambda x: x["repaired"])), by_state(tails)).alias("repaired"),
    )
