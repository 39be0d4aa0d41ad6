"""Repair of conversation structure by generalised LR parsing.

The grammar of roles is an optional system turn and pairs of user and assistant turns::

    document -> (nothing) | s turns | turns
    turns    -> turns pair | pair
    pair     -> u a

LR tables are made from it.  A graph-structured stack is driven over the turns of a
conversation: at every turn each stack top may keep, rerole or delete it or insert a turn,
at a cost, and equal tops are merged by the minimum of (cost, audit), audit being the edits
so far.  What a vertex stands on is shared by all stacks above it.  Two prefixes of equal
cost with one top are never prefixes of each other (an edit more costs more), so the
smaller audit stays smaller whatever follows, and merging loses nothing.

Conversations are sorted over range partitions, so one of any length spreads: turns are
parsed in chunks, a chunk that does not begin its conversation from every possible stack,
and the chunks of a conversation are joined in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

GRAMMAR = [("document", ()), ("document", ("s", "turns")), ("document", ("turns",)), ("turns", ("turns", "pair")), ("turns", ("pair",)), ("pair", ("u", "a"))]
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: turns parsed as one piece; a piece that may start on any stack costs as many parses as there are stacks
CHUNK = 512
#: faults of a turn
NONE, BLANK, DUPLICATE, TRUNCATED_TURN = 0, 1, 2, 3

Value = tuple[int, str]
END = "$"


class Tables:
    """SLR(1) tables of a grammar and the vertices of its graph-structured stack.

    A vertex is an LR state on another vertex.  Vertices are made once, so stacks that
    agree below some height share it, and an equal top is the same vertex.
    """

    def __init__(self, grammar: list[tuple[str, tuple[str, ...]]]):
        self.rules = [("start", (grammar[0][0],)), *grammar]
        self.left = {left for left, _ in self.rules}
        self._follow = self._follow_sets()
        self.states: list[frozenset] = [self._closure({(0, 0)})]
        self.moves: dict[tuple[int, str], int] = {}
        for k, state in enumerate(self.states):  # grows
            for symbol in sorted({self.rules[r][1][d] for r, d in state if d < len(self.rules[r][1])}):
                target = self._closure({(r, d + 1) for r, d in state if self.rules[r][1][d : d + 1] == (symbol,)})
                if target not in self.states:
                    self.states.append(target)
                self.moves[k, symbol] = self.states.index(target)
        self.vertices: list[tuple[int, int]] = [(0, -1)]
        self._number = {(0, -1): 0}
        self._next: dict[tuple[int, str], int | None] = {}
        self.terminals = sorted({x for _, right in self.rules for x in right} - self.left)
        for v, _ in enumerate(self.vertices):  # all vertices that turns can lead to; grows
            for symbol in self.terminals:
                self.advance(v, symbol)

    def _closure(self, items: set) -> frozenset:
        items = set(items)
        while more := {(n, 0) for r, d in items for n, (left, _) in enumerate(self.rules) if self.rules[r][1][d : d + 1] == (left,)} - items:
            items |= more
        return frozenset(items)

    def _first(self, symbols: tuple[str, ...], seen: frozenset = frozenset()) -> set[str]:
        """Terminals that can begin the symbols; the empty string if they can be empty."""
        out: set[str] = set()
        for x in symbols:
            if x not in self.left:
                return out | {x}
            of_x = set().union(*(self._first(right, seen | {x}) for left, right in self.rules if left == x)) if x not in seen else set()
            out |= of_x - {""}
            if "" not in of_x:
                return out
        return out | {""}

    def _follow_sets(self) -> dict[str, set[str]]:
        follow = {x: set() for x in self.left}
        follow["start"].add(END)
        grew = True
        while grew:
            grew = False
            for left, right in self.rules:
                for i, x in enumerate(right):
                    if x in self.left:
                        begins = self._first(right[i + 1 :])
                        more = (begins - {""}) | (follow[left] if "" in begins else set())
                        grew |= not more <= follow[x]
                        follow[x] |= more
        return follow

    def _reduction(self, state: int, lookahead: str) -> int | None:
        found = [r for r, d in self.states[state] if r and d == len(self.rules[r][1]) and lookahead in self._follow[self.rules[r][0]]]
        return min(found, default=None)

    def _vertex(self, state: int, below: int) -> int:
        key = (state, below)
        if key not in self._number:
            self._number[key] = len(self.vertices)
            self.vertices.append(key)
        return self._number[key]

    def _reduced(self, vertex: int, lookahead: str) -> int:
        while (rule := self._reduction(self.vertices[vertex][0], lookahead)) is not None:
            left, right = self.rules[rule]
            for _ in right:
                vertex = self.vertices[vertex][1]
            vertex = self._vertex(self.moves[self.vertices[vertex][0], left], vertex)
        return vertex

    def advance(self, vertex: int, symbol: str) -> int | None:
        """The vertex after a turn: reductions that the turn allows, then its shift."""
        key = (vertex, symbol)
        if key not in self._next:
            top = self._reduced(vertex, symbol)
            state = self.moves.get((self.vertices[top][0], symbol))
            self._next[key] = None if state is None else self._vertex(state, top)
        return self._next[key]

    def accepts(self, vertex: int) -> bool:
        return self.vertices[self._reduced(vertex, END)] == (self.moves[0, "document"], 0)


LR = Tables(GRAMMAR)
_SYMBOLS = tuple(ROLES)


def _better(tops: dict[int, Value], vertex: int | None, cost: int, audit: str) -> bool:
    """Put a value on a top; of equal tops the minimum of (cost, audit) stays."""
    if vertex is None or (vertex in tops and tops[vertex] <= (cost, audit)):
        return False
    tops[vertex] = (cost, audit)
    return True


def inserted(tops: dict[int, Value]) -> dict[int, Value]:
    """Tops after any inserts."""
    open_ = list(tops)
    while open_:
        v = open_.pop()
        cost, audit = tops[v]
        for symbol in _SYMBOLS:
            to = LR.advance(v, symbol)
            if _better(tops, to, cost + INSERT, audit + "I"):
                open_.append(to)
    return tops


def step(tops: dict[int, Value], initial: str, fault: int) -> dict[int, Value]:
    """Tops after one more turn."""
    out: dict[int, Value] = {}
    more = TRUNCATED if fault == TRUNCATED_TURN else 0
    for v, (cost, audit) in tops.items():
        _better(out, v, cost + DELETE, audit + "D")
        if fault in (BLANK, DUPLICATE):
            continue
        if initial in LR.terminals:
            _better(out, LR.advance(v, initial), cost + KEEP + more, audit + "K")
        for symbol in _SYMBOLS:
            if symbol != initial:
                _better(out, LR.advance(v, symbol), cost + REROLE + more, audit + "R")
    return inserted(out)


def parse(turns: list[tuple[str, int]], start: int) -> dict[int, Value]:
    """Every stack top after turns of (role initial, fault) from a start vertex, with its (cost, audit)."""
    tops = inserted({start: (0, "")})
    for initial, fault in turns:
        tops = step(tops, initial, fault)
    return tops


def joined(tops: dict[int, Value], piece: dict[int, dict[int, Value]]) -> dict[int, Value]:
    """Tops behind a piece of turns that was parsed from every vertex."""
    out: dict[int, Value] = {}
    for v, (cost, audit) in tops.items():
        for to, (c, a) in piece.get(v, {}).items():
            if to not in out or out[to][0] >= cost + c:
                _better(out, to, cost + c, audit + a)
    return out


def best(tops: dict[int, Value]) -> Value:
    return min((x for v, x in tops.items() if LR.accepts(v)), default=(0, ""))


def replayed(audit: Iterator[str], turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation: an edit that changes a role has one that the grammar allows."""
    vertex = 0

    def allowed(role_now: str | None) -> tuple[int, str]:
        return next((to, name) for symbol, name in ROLES.items() if symbol != role_now and (to := LR.advance(vertex, symbol)) is not None)

    for edit in audit:
        if edit == "I":
            vertex, role = allowed(None)
            yield role, ""
            continue
        role, text = next(turns)
        if edit == "K":
            vertex = LR.advance(vertex, role[:1])
            yield role, text
        elif edit == "R":
            vertex, role = allowed(role[:1])
            yield role, text


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with the damage that the digest of conversation and turn chooses, before repeats are written out.

    ``conv_id, turn, role0, text0`` as given (null role and text: one space), ``role, text``
    after damage, ``times`` the row stands there (0 dropped, 2 repeated).  A null conversation
    or turn counts as one space in the digest.
    """
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(number("conv_id"), F.lit(":"), number("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role0"), F.coalesce("text", F.lit(" ")).alias("text0"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text0", "[.!?]", "")).otherwise(F.col("text0"))
    times = F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", "role0", "text0", F.when(F.col("code") == 4, "user").otherwise(F.col("role0")).alias("role"), text.alias("text"), times.alias("times"))


#: order of the rows of a conversation; equal turns by role and text as given, copies side by side
ORDER = ["turn", "role0", "digest0"]


def with_faults(rows: DataFrame) -> DataFrame:
    """Narrow rows of the conversations after damage: ``conv_id, turn, role0, digest0, copy, initial, fault``.

    A conversation that lost all its rows keeps one with null ``copy``.  Equal rows are
    counted before they are shuffled.  The first of equal (role, text) is found by an
    aggregate and joined back, so a text that a conversation repeats without end is no
    group in one task.
    """
    ends = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    kind = F.when(F.regexp_like("text", F.lit(r"\A[\x20\x09-\x0D]*\z")), BLANK).when(~ends.isin(".", "!", "?"), TRUNCATED_TURN).otherwise(NONE)
    flat = rows.select(
        "conv_id", "turn", "role0", F.sha2("text0", 256).alias("digest0"), "role", F.sha2("text", 256).alias("digest"), F.substring("role", 1, 1).alias("initial"),
        kind.alias("kind"), "times",
    )
    counted = flat.groupBy(*[c for c in flat.columns if c != "times"]).agg(F.sum("times").alias("times"))
    lost = counted.groupBy("conv_id").agg(F.sum("times").alias("n")).filter("n = 0").select("conv_id")
    there = counted.filter("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("times") - 1).cast("int"))))
    place = F.struct(*ORDER, "copy")  # nulls come first in Spark's order
    said = ["conv_id", "role", "digest"]
    first = there.groupBy(*said).agg(F.min(place).alias("first"))
    met = there.alias("t").join(first.alias("f"), F.col("t.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("t.role") == F.col("f.role")) & (F.col("t.digest") == F.col("f.digest")), "left")
    at = F.struct(*[F.col(f"t.{c}") for c in [*ORDER, "copy"]])
    fault = F.when(F.col("t.kind") == BLANK, BLANK).when(~at.eqNullSafe(F.col("f.first")), DUPLICATE).otherwise(F.col("t.kind"))
    out = met.select(*[f"t.{c}" for c in ["conv_id", *ORDER, "copy", "initial"]], fault.alias("fault"))
    return out.unionByName(lost, allowMissingColumns=True)


_PIECES = "conv_id {id}, part int, piece int, n long, first_turn {turn}, last_turn {turn}, turns long, first_initial string, last_initial string, blank long, duplicate long, truncated long, illegal long, tops array<struct<start:int,top:int,cost:long,audit:string>>"
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns], strict=True)


def _piece_rows(rows: Iterator[tuple], part: int) -> Iterator[tuple]:
    """Sorted narrow rows -> one row for each piece of a conversation in this partition."""
    held: list[tuple] = []
    now, number, known = None, 0, False

    def close() -> tuple:
        turns = [r[4:6] for r in held if r[3] is not None]
        starts = [0] if known and number == 0 else range(len(LR.vertices))
        tops = [(s, v, cost, audit) for s in starts for v, (cost, audit) in parse(turns, s).items()]
        faults = [f for _, f in turns]
        when = [r[1] for r in held if r[1] is not None and r[3] is not None]
        initials = [i for i, _ in turns]
        illegal = sum(p not in _LEGAL for p in zip(initials, initials[1:], strict=False))
        return (
            now[0], part, number, len(turns), when[0] if when else None, when[-1] if when else None, sum(a != b for a, b in zip(when, when[1:], strict=False)) + bool(when),
            initials[0] if initials else None, initials[-1] if initials else None, faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED_TURN), illegal,
            [dict(zip(("start", "top", "cost", "audit"), t, strict=True)) for t in tops],
        )

    for conv, turn, *rest in rows:
        if now is not None and (now[0] != conv or len(held) == CHUNK):
            yield close()
            known, number, held = (True, 0, []) if now[0] != conv else (known, number + 1, [])
        now = (conv,)
        held.append((conv, turn, rest[0], rest[2], rest[3], rest[4]))
    if held:
        yield close()


def _joined_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Pieces in order -> one row for each conversation."""
    sums: list = []
    now, tops = None, {}

    def result() -> tuple:
        n, low, high, distinct, _, blank, duplicate, truncated, illegal = sums
        cost, audit = best(tops)
        return now[0], 0 if low is None else int(high) - int(low) + 1 - distinct, blank, duplicate, truncated, illegal, cost, audit

    for conv, _, _, n, first_turn, last_turn, distinct, first, last, blank, duplicate, truncated, illegal, found in rows:
        if now is None or now[0] != conv:
            if now is not None:
                yield result()
            now, tops, sums = (conv,), {0: (0, "")}, [0, None, None, 0, None, 0, 0, 0, 0]
        piece: dict[int, dict[int, Value]] = {}
        for t in found:
            piece.setdefault(t["start"], {})[t["top"]] = (t["cost"], t["audit"])
        tops = joined(tops, piece)
        same = first_turn is not None and sums[2] == first_turn
        border = sums[4] is not None and first is not None and (sums[4], first) not in _LEGAL
        sums = [
            sums[0] + n, first_turn if sums[1] is None else sums[1], sums[2] if last_turn is None else last_turn, sums[3] + distinct - same, sums[4] if last is None else last,
            sums[5] + blank, sums[6] + duplicate, sums[7] + truncated, sums[8] + illegal + border,
        ]
    if now is not None:
        yield result()


def audits(narrow: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of rows as ``with_faults`` makes them."""
    spark, kind = narrow.sparkSession, {c: narrow.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    ddl = _PIECES.format(id=kind["conv_id"], turn=kind["turn"])
    pieces_schema = _arrow(spark, ddl)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_piece_rows(_rows(batches), TaskContext.get().partitionId()), pieces_schema, 2000)

    out = f"conv_id {kind['conv_id']}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    out_schema = _arrow(spark, out)

    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_joined_rows(_rows(batches)), out_schema, 2000)

    order = ["conv_id", *ORDER, "copy"]
    sorted_rows = narrow.select(*order, "initial", "fault").repartitionByRange(*order).sortWithinPartitions(*order)
    found = sorted_rows.mapInArrow(pieces, ddl)
    return found.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece").mapInArrow(conversations, out)


def _digest_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Sorted (conversation, ..., times, role, text), the audit first -> digest of every repaired conversation.

    Texts are hashed as they pass, none is kept.
    """
    held: list = []

    def turns(audit_conv) -> Iterator[tuple[str, str]]:
        for row in rows:
            if row[0] != audit_conv or row[1] == 0:
                held.append(row)
                return
            for _ in range(row[2]):
                yield row[3], row[4]

    row = next(rows, None)
    while row is not None:
        conv, audit = row[0], row[4]
        source, sha, n = turns(conv), hashlib.sha256(), 0
        for role, text in replayed(iter(audit), source):
            sha.update(f"{chr(10) if n else ''}{role}:{text}".encode())
            n += 1
        for _ in source:  # rows behind the last edit: none
            pass
        yield conv, n, sha.hexdigest()
        row = held.pop() if held else next(rows, None)


def repair(conversations: DataFrame) -> DataFrame:
    """Every conversation after damage with its faults and cheapest repair.

    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_turns, repaired_sha256``.

    Rows follow their turn, null turns first; rows of one turn follow role and text as
    given, and rows equal in all of these are one repeated row.  Null roles and texts are one
    space.  A role whose first code point is not ``s``, ``u`` or ``a`` (an empty one too)
    can't be kept.  A null conversation is one conversation.  One that lost all rows has
    zeros, an empty audit and the digest of nothing; an empty table gives no rows.  Other
    columns are not read, whatever their names.

    One conversation of any size is parsed by many tasks.  The digest of its repaired text is
    one SHA-256 over all of it, so one task reads it from first to last, holding no text.
    """
    rows = damaged(conversations)
    found = stored(audits(with_faults(rows)), "audits")
    kind = {c: conversations.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    texts = rows.filter("times > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role0", F.sha2("text0", 256).alias("digest0"), "times", "role", "text")
    nothing = lambda t: F.lit(None).cast(t)
    scripts = found.select("conv_id", F.lit(0).alias("kind"), nothing(kind["turn"]).alias("turn"), nothing("string").alias("role0"), nothing("string").alias("digest0"), F.lit(1).alias("times"), nothing("string").alias("role"), F.col("audit").alias("text"))
    ddl = f"conv_id {kind['conv_id']}, repaired_turns long, repaired_sha256 string"
    schema = _arrow(conversations.sparkSession, ddl)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_digest_rows(_rows(batches)), schema, 2000)

    both = scripts.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER)
    hashed = both.select("conv_id", "kind", "times", "role", "text").mapInArrow(digests, ddl)
    return found.alias("a").join(hashed.alias("h"), F.col("a.conv_id").eqNullSafe(F.col("h.conv_id"))).select("a.*", "h.repaired_turns", "h.repaired_sha256")
