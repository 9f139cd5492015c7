"""Repairs the structure of conversations at the least cost, by Four-Russians block tables.

A row is a symbol: its role's initial (s, u, a, or o for any other; a capital if the text is cut off), b if blank, d if seen before.
What it takes to end well from each of four states is a vector of costs. Less its least entry it is one of a few vectors, so what
every block of BLOCK symbols makes of every vector is computed once; a conversation is worked on from its end, block by block by lookup.
The edits are then read from the start: each block is opened backward from the vector at its end, and of the edits that cost least the first letter is taken.

Rows in order are cut into stretches of STRETCH. A conversation that lies in one is repaired there. One that crosses stretches
is composed of theirs, which are min-plus matrices and later maps of states, over a tree of a logarithm's levels, so that a
conversation may hold any share of the rows.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.running import positions
from ..stored import written

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS, GONE = "suaoSUAO", 8
DELETE, INSERT, REROLE, CUT = 4, 3, 3, 3
#: States: nothing yet, after s, after u, after a. What keeping an initial, and what a row made or turned to user or assistant, leads to.
STATES = range(4)
KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}
TURN = (2, 2, 3, 2)
NEVER = 1 << 20
BLOCK, STRETCH, BRANCHES = 4, 1024, 1024

Vector = tuple[int, ...]


def _with_inserts(costs: list[int]) -> Vector:
    """Rows may be put in first; three or more at a place lead to nothing new."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[TURN[q]]) for q, c in enumerate(costs)]
    return tuple(min(c, NEVER) for c in costs)


END = _with_inserts([0, NEVER, NEVER, 0])
UNITS = [tuple(0 if q == j else NEVER for q in STATES) for j in STATES]


def choices(symbol: int, q: int) -> list[tuple[str, int, int]]:
    """Edits of a row, but inserts before it: letter, cost and next state, by letter."""
    out = [("D", DELETE, q)]
    if symbol != GONE:
        cut = CUT * (symbol >= 4)
        if q in (kept := KEEP[SYMBOLS[symbol % 4]]):
            out.append(("K", cut, kept[q]))
        out.append(("R", REROLE + cut, TURN[q]))
    return out


def before(after: Vector, symbol: int) -> Vector:
    """Costs in front of a row from those behind it."""
    return _with_inserts([min(cost + after[to] for _, cost, to in choices(symbol, q)) for q in STATES])


def normal(costs: Vector) -> tuple[Vector, int]:
    least = min(costs)
    return tuple(c if c >= NEVER else c - least for c in costs), least


class Tables:
    """All vectors that rows lead to from the end or from a single state, and what symbols and blocks make of them."""

    def __init__(self) -> None:
        self.vectors = [normal(v)[0] for v in (END, *UNITS)]
        self.ids = {v: k for k, v in enumerate(self.vectors)}
        one, plus = [], []
        for v in self.vectors:  # grows meanwhile
            made = [normal(before(v, s)) for s in range(GONE + 1)]
            for u, _ in made:
                if u not in self.ids:
                    self.ids[u] = len(self.vectors)
                    self.vectors.append(u)
            one.append([self.ids[u] for u, _ in made])
            plus.append([least for _, least in made])
        self.one, self.plus = np.array(one), np.array(plus)
        blocks = np.array(list(itertools.product(range(GONE + 1), repeat=BLOCK)))
        now = np.repeat(np.arange(len(self.vectors))[:, None], len(blocks), 1)
        total = np.zeros_like(now)
        for symbol in blocks.T[::-1]:
            total += self.plus[now, symbol]
            now = self.one[now, symbol]
        self.block, self.block_plus = now.tolist(), total.tolist()
        self.one, self.plus = self.one.tolist(), self.plus.tolist()
        self.opened: dict[tuple, tuple[str, int]] = {}

    def id(self, costs: list[int]) -> int:
        return self.ids[normal(tuple(costs))[0]]

    def back(self, head: list[int], codes: list[int], vector: int) -> tuple[int, int, list[int]]:
        """The vector in front of the head's symbols and the blocks, what was taken off it, and the vector behind each block."""
        total, ends = 0, []
        for code in reversed(codes):
            ends.append(vector)
            total += self.block_plus[vector][code]
            vector = self.block[vector][code]
        ends.reverse()
        for symbol in reversed(head):
            total += self.plus[vector][symbol]
            vector = self.one[vector][symbol]
        return vector, total, ends

    def open(self, symbols: tuple[int, ...], vector: int, q: int) -> tuple[str, int]:
        """The least of the cheapest edits of a block in state q, with ``vector`` behind it, and the state there."""
        key = (symbols, vector, q)
        if key not in self.opened:
            behind = [self.vectors[vector]]
            for symbol in reversed(symbols):
                behind.append(before(behind[-1], symbol))
            letters = []
            for k, symbol in enumerate(symbols):
                here, after, row = behind[len(symbols) - k], behind[len(symbols) - k - 1], False
                while not row:
                    options = [(letter, cost + after[to], to, True) for letter, cost, to in choices(symbol, q)] + [("I", INSERT + here[TURN[q]], TURN[q], False)]
                    letter, _, q, row = min(x for x in options if x[1] == here[q])
                    letters.append(letter)
            self.opened[key] = "".join(letters), q
        return self.opened[key]

    def trace(self, head: list[int], codes: list[int], symbols: list[int], vector: int, q: int) -> tuple[str, int]:
        ends = self.back(head, codes, vector)[2]
        at, out = len(head), []
        first = vector if not codes else self.block[ends[0]][codes[0]]
        for part, behind in [(head, first), *((symbols[at + BLOCK * k : at + BLOCK * (k + 1)], end) for k, end in enumerate(ends))]:
            letters, q = self.open(tuple(part), behind, q)
            out.append(letters)
        return "".join(out), q


@functools.cache
def tables() -> Tables:
    return Tables()


CODES = {c: k for k, c in enumerate(SYMBOLS)} | {"b": GONE, "d": GONE}


def cut(letters: str) -> tuple[list[int], list[int], list[int]]:
    """Symbols, those in front of the first whole block, and the numbers of the blocks."""
    symbols = [CODES[c] for c in letters]
    head = len(symbols) % BLOCK
    numbers = [functools.reduce(lambda n, s: n * (GONE + 1) + s, symbols[k : k + BLOCK], 0) for k in range(head, len(symbols), BLOCK)]
    return symbols, symbols[:head], numbers


def matrix(letters: str) -> list[int]:
    """Costs from each state in front of the rows to each behind them, by rows."""
    t, (_, head, codes) = tables(), cut(letters)
    columns = []
    for unit in UNITS:
        v, plus, _ = t.back(head, codes, t.ids[unit])
        columns.append([min(c + plus, NEVER) if c < NEVER else NEVER for c in t.vectors[v]])
    return [columns[j][q] for q in STATES for j in STATES]


def times(m: list[int], v: list[int]) -> list[int]:
    return [min(NEVER, *(m[4 * q + j] + v[j] for j in STATES)) for q in STATES]


def product(a: list[int], b: list[int]) -> list[int]:
    columns = [times(a, [b[4 * q + j] for q in STATES]) for j in STATES]
    return [columns[j][q] for q in STATES for j in STATES]


def edits(letters: str, right: list[int], q: int) -> tuple[str, int]:
    """The edits of a stretch with costs ``right`` behind it, and the state there."""
    t, (symbols, head, codes) = tables(), cut(letters)
    return t.trace(head, codes, symbols, t.id(right), q)


def cost(audit: str, letters: str) -> int:
    rows = iter(letters)
    return sum(INSERT if e == "I" else DELETE if (c := next(rows)) and e == "D" else REROLE * (e == "R") + CUT * c.isupper() for e in audit)


def through(nodes: DataFrame, start: list[int], join: Callable, walk: Callable, backward: bool) -> DataFrame:
    """conv, node and ``given`` for nodes (conv, node, value): what ``start`` has become when it comes to the node, going through the conversation's others before (backward: after) it.

    Groups of at most BRANCHES nodes are joined, level by level, until each conversation has one; going down, each group hands its own the value in turn.
    """
    spark_type = "conv " + nodes.schema["conv"].dataType.simpleString()

    def up(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        value = functools.reduce(join, ([*map(int, v)] for v in group["value"]))
        return pd.DataFrame({"conv": group["conv"].iloc[:1].values, "node": group["up"].iloc[:1].values, "value": [value]})

    def down(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node", ascending=not backward)
        given, out = [*map(int, group["given"].iloc[0])], []
        for value in group["value"]:
            out.append(given)
            given = walk([*map(int, value)], given)
        return pd.DataFrame({"conv": group["conv"], "node": group["node"], "given": out})

    above = F.floor(F.col("node") / BRANCHES).alias("up")
    levels = [nodes]
    while (levels[-1].groupBy("conv").count().agg(F.max("count")).first()[0] or 1) > 1:
        grouped = levels[-1].select("*", above).groupBy("conv", "up")
        levels.append(written(grouped.applyInPandas(up, f"{spark_type}, node long, value array<long>"), "joined"))
    given = levels[-1].select("conv", "node", F.array(*map(F.lit, start)).cast("array<long>").alias("given"))
    for level in reversed(levels[:-1]):
        top = given.select(F.col("conv").alias("c"), F.col("node").alias("up"), "given")
        kids = level.select("*", above).alias("k").join(top.alias("t"), F.expr("k.conv <=> t.c AND k.up = t.up")).select("conv", "node", "k.up", "value", "given")
        given = kids.groupBy("conv", "up").applyInPandas(down, f"{spark_type}, node long, given array<long>")
    return given


def damaged(conversations: DataFrame) -> DataFrame:
    """conv, turn, role and text after one row in 20 each was dropped, emptied, robbed of its stops, repeated, or given to the user. Null roles and texts become one space."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), one("role").alias("role"), one("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def _symbol(blank: Column, seen: Column) -> Column:
    trimmed = F.rtrim("text", F.lit(SPACE))
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    return F.when(blank, "b").when(seen, "d").when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), initial).otherwise(F.upper(initial))


def ordered(rows: DataFrame) -> DataFrame:
    """The rows (conv, turn, role, text) with their place in the order of conversations and turns, nulls first; rows of one turn go by the first characters of role and text, then by a hash of them."""
    # bounds are sampled, so whole texts stay out of them
    ties = {"_role": F.substring("role", 1, 32), "_text": F.substring("text", 1, 64), "_hash": F.xxhash64("role", "text"), "_row": F.monotonically_increasing_id()}
    return positions(rows.withColumns(ties), ["conv", "turn", *ties], "at").drop(*ties)


def stretches(rows: DataFrame) -> DataFrame:
    """conv, node, at (of the first row), letters and crosses (it may go on in another stretch) of rows with places."""
    lean = rows.select("conv", "at", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("hash"), (F.rtrim("text", F.lit(SPACE)) == "").alias("blank"), _symbol(F.lit(False), F.lit(False)).alias("symbol"))
    first = lean.groupBy("conv", "hash").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    marked = lean.join(first, "at", "left").select("conv", "at", F.when(F.col("blank"), "b").when(F.col("first").isNull(), "d").otherwise(F.col("symbol")).alias("symbol"))
    parts = marked.groupBy("conv", F.floor(F.col("at") / STRETCH).alias("node")).agg(F.array_sort(F.collect_list(F.struct("at", "symbol"))).alias("rows"))
    start, end = F.element_at("rows", 1)["at"], F.element_at("rows", -1)["at"]
    return parts.select("conv", "node", start.alias("at"), F.array_join(F.transform("rows", lambda r: r["symbol"]), "").alias("letters"), ((start % STRETCH == 0) | ((end + 1) % STRETCH == 0)).alias("crosses"))


def traces(parts: DataFrame) -> DataFrame:
    """conv, node, at, letters, state and audit: the edits of each stretch and the state in front of it."""
    kind = parts.schema["conv"].dataType.simpleString()

    def valued(of: Callable, given: str) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                values = [of(letters, g) for letters, g in zip(b.column("letters").to_pylist(), b.column(given).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("node"), pa.array(values, pa.list_(pa.int64()))], ["conv", "node", "value"])

        return run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            audits = []
            for letters, right, state, last in zip(*(b.column(c).to_pylist() for c in ("letters", "given", "state", "last")), strict=True):
                audit, q = edits(letters, right, state)
                audits.append(audit + "I" * (0, 2, 1, 0)[q] * last)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv", "node", "at", "letters", "state")), pa.array(audits)], ["conv", "node", "at", "letters", "state", "audit"])

    end = F.array(*map(F.lit, END)).cast("array<long>")
    inner = parts.where("NOT crosses").select("conv", "node", "at", "letters", end.alias("given"), F.lit(0).alias("state"), F.lit(True).alias("last"))
    edge = written(parts.where("crosses").withColumn("none", F.lit(0)), "edges")
    as_nodes = f"conv {kind}, node long, value array<long>"
    nodes = written(edge.mapInArrow(valued(lambda letters, _: matrix(letters), "none"), as_nodes), "matrices")
    same = lambda a, b: F.expr(f"{a}.conv <=> {b}.conv AND {a}.node = {b}.node")
    right = written(edge.alias("e").join(through(nodes, list(END), product, times, True).alias("g"), same("e", "g")).select("e.*", "given"), "rights")
    maps = written(right.mapInArrow(valued(lambda letters, given: [edits(letters, given, q)[1] for q in STATES], "given"), as_nodes), "maps")
    states = through(maps, [0], lambda a, b: [b[x] for x in a], lambda m, q: [m[q[0]]], False).select("conv", "node", F.col("given")[0].cast("int").alias("state"))
    most = edge.groupBy("conv").agg(F.max("node").alias("node"), F.lit(True).alias("last"))
    outer = right.alias("r").join(states.alias("s"), same("r", "s")).join(most.alias("m"), same("r", "m"), "left").select("r.conv", "r.node", "at", "letters", "given", "state", F.coalesce("last", F.lit(False)).alias("last"))
    return inner.unionByName(outer).mapInArrow(run, f"conv {kind}, node long, at long, letters string, state int, audit string")


FED = ["conv", "at", "kind", "turn", "role", "text", "letters", "state", "audit"]


def _fed(rows: DataFrame, edited: DataFrame) -> DataFrame:
    """Rows with their stretch's edits in front of the first, so that no text is joined."""
    lines = rows.select("conv", "at", F.lit(1).alias("kind"), "turn", "role", "text", *(F.lit(None).cast(t).alias(c) for c, t in (("letters", "string"), ("state", "int"), ("audit", "string"))))
    return lines.unionByName(edited.select("conv", "at", F.lit(0).alias("kind"), *(F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"))), "letters", "state", "audit"))


class Reader:
    """Goes through a stretch's edits, row by row."""

    def __init__(self, audit: str, state: int):
        self.edits, self.left, self.state = iter(audit), sum(e != "I" for e in audit), state

    def lines(self, role: str, text: str) -> list[tuple[str, str]]:
        """What becomes of the next row: rows put in before it, itself unless deleted, and after the last row those put in behind it."""
        out: list[tuple[str, str]] = []
        for e in self.edits:
            if e == "K":
                self.state = KEEP[role[:1]][self.state]
                out.append((role, text))
            elif e in "IR":
                self.state = TURN[self.state]
                out.append(("user" if self.state == 2 else "assistant", text if e == "R" else ""))
            self.left -= e != "I"
            if e != "I" and self.left:
                break
        return out


class Report:
    """The counts and the hash of one conversation."""

    def __init__(self, conv):
        self.conv, self.turns, self.first, self.last = conv, 0, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.audit: list[str] = []
        self.initial, self.hash, self.lines = None, hashlib.sha256(), 0

    def stretch(self, letters: str, audit: str) -> None:
        self.blank += letters.count("b")
        self.duplicate += letters.count("d")
        self.truncated += sum(map(str.isupper, letters))
        self.cost += cost(audit, letters)
        self.audit.append(audit)

    def row(self, turn: int | None, role: str, lines: list[tuple[str, str]]) -> None:
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        for made, text in lines:
            self.hash.update(("\n" if self.lines else "").encode() + f"{made}:{text}".encode())
            self.lines += 1

    def result(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def report(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conv_id of ``conversations``, of the rows (conv, turn, role, text)
    that are left of it, by default its damaged ones.

    Null conv_ids are one conversation, null turns come first, rows of one turn and repeated rows go side by side. A conversation without rows has zeros, an
    empty audit and the empty text's hash. Other columns are left out; an empty table gives no rows. The hash of a conversation has to be taken in order, so its
    rows go through one task, as a stream: memory holds a batch of rows and the audit.
    """
    rows = ordered(damaged(conversations) if rows is None else rows)
    kind = rows.schema["conv"].dataType.simpleString()
    fed = _fed(rows, traces(stretches(rows)))
    ids = conversations.select(F.col("conv_id").alias("conv")).distinct().select("conv", F.lit(-1).cast("long").alias("at"), F.lit(0).alias("kind"), *(F.lit(None).cast(fed.schema[c].dataType).alias(c) for c in FED[3:]))
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader, done = None, None, []

        def give() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], conv_type), *(pa.array(c, pa.int64()) for c in columns[1:7]), *(pa.array(c, pa.string()) for c in columns[7:])], ["conv_id", *names, "audit", "repaired_sha256"])

        for b in batches:
            conv_type = b.schema.field("conv").type
            for conv, at, row, turn, role, text, letters, state, audit in zip(*(b.column(c).to_pylist() for c in FED), strict=True):
                if at < 0:  # the conversation's first row
                    if now is not None:
                        done.append(now.result())
                    now = Report(conv)
                elif not row:
                    reader = Reader(audit, state)
                    now.stretch(letters, audit)
                else:
                    now.row(turn, role, reader.lines(role, text))
            if done:
                yield give()
        if now is not None:
            done.append(now.result())
            yield give()

    sorted_ = fed.unionByName(ids).select(*FED).repartition("conv").sortWithinPartitions("conv", "at", "kind")
    return sorted_.mapInArrow(run, f"conv_id {kind}, {', '.join(f'{n} long' for n in names)}, audit string, repaired_sha256 string")


def repaired(rows: DataFrame) -> DataFrame:
    """conv, at, part, role and text: the repaired rows of rows (conv, turn, role, text), in the order of ``at`` and ``part``. Stretches are written side by side, whatever conversation they are of."""
    rows = ordered(rows)
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for b in batches:
            out = []
            for conv, at, row, _, role, text, _, state, audit in zip(*(b.column(c).to_pylist() for c in FED), strict=True):
                if not row:
                    reader = Reader(audit, state)
                else:
                    out += [(conv, at, k, *line) for k, line in enumerate(reader.lines(role, text))]
            if out:
                kinds = [b.schema.field("conv").type, pa.int64(), pa.int32(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["conv", "at", "part", "role", "text"])

    fed = _fed(rows, traces(stretches(rows))).select(*FED).repartition("conv", F.floor(F.col("at") / STRETCH)).sortWithinPartitions("conv", "at", "kind")
    return fed.mapInArrow(run, f"conv {kind}, at long, part int, role string, text string")
