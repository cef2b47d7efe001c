"""Conversation structure repair by a forward Viterbi pass over four grammar states.

A well-formed conversation's role initials are (s?(ua)+)?: nothing yet, after s, after u, after a. Each turn is kept (0),
reroled to user or assistant (2) or deleted (3), and turns without text are inserted (2); a kept or reroled truncated turn
costs 1 more, and blank and duplicate turns must go. The pass carries, for each state, the least cost and of these the
ASCII-least audit, the string of the edits' initials. A turn's layer is closed by at most three inserts in a row: more
return to a state at a higher cost. An audit is held as its last letters and a link to what it was before. Of one layer no
audit begins another (both end with an edit of the same turn), so audits compare by the order of what they were before,
and then by their last letters: a turn takes constant time, however long the conversation.

A run of turns acts on the states as a 4 x 4 table of (cost, audit), so conversations are split as Spark deals them:

1. Turns are range-partitioned and sorted by (conversation, turn, role, text). A task repairs each conversation that lies
   inside its partition, holding that conversation's turns.
2. The first and last conversation of a partition may go on in others, as a very long one does. Their turns (at most two
   conversations a partition, whose ids are broadcast) are read again. Equal turns become one row with a number; the
   first of equal role and text is told by map-side minima; each partition gives a run's table; a conversation's tables
   are chained, one for each partition it touches.
3. The repaired turns are streamed past the audit in order. SHA-256 is sequential, so one task streams all turns of a
   conversation, in constant memory but for the audit (a byte a turn, which the result holds anyway).

Turns of one number are ordered by role, then text; null numbers come first. Null roles and texts count as one space. A
null conversation id is a conversation. Rows flagged as gone only name their conversation: one without other rows gets
zeros, an empty audit and the hash of the empty string. Other columns are ignored; an empty table gives empty results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial
from itertools import product

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineagelake.llm.common import written

#: The contract's costs and grammar: fixed values.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
LEGAL = ("su", "ua", "au")
START, SYSTEM, USER, ASSISTANT = range(4)
#: From state, by role initial, to state.
MOVES = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLES = {"u": "user", "a": "assistant"}
#: Leading characters of a text that place it among turns of one conversation, number and role.
HEAD = 64

NOT_SPACE = re.compile(r"[^\x20\x09-\x0D]")
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
COUNTS = COLUMNS[1:7]


def _after_inserts(state: int) -> list[tuple[int, str]]:
    """The states that up to three inserts lead to, with their letters."""
    found, letters = [(state, "")], ""
    for _ in range(3):
        state, letters = (ASSISTANT if state == USER else USER), letters + "I"
        found.append((state, letters))
    return found


def _table(initial: str, fault: str) -> list[list[tuple[int, int, str]]]:
    """For each state after a turn: (state before, cost, letters), the best for each state before."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    extra = TRUNCATED if fault == "truncated" else 0
    for before in range(4):
        for state, letters in _after_inserts(before):
            edits = [(state, DELETE, "D")]
            if fault not in ("blank", "duplicate"):
                edits += [(MOVES[state, x], REROLE + extra, "R") for x in "ua" if (state, x) in MOVES]
                edits += [(MOVES[state, initial], extra, "K")] if (state, initial) in MOVES else []
            for after, cost, letter in edits:
                found = (cost + INSERT * len(letters), letters + letter)
                best[before, after] = min(found, best.get((before, after), found))
    return [[(b, *best[b, a]) for b in range(4) if (b, a) in best] for a in range(4)]


TABLES = {(i, f): _table(i, f) for i, f in product(("s", "u", "a", ""), ("", "blank", "duplicate", "truncated"))}


def start(state: int = START) -> list:
    """The layer before any turn: for each state None, or (cost, rank among the layer's audits, audit)."""
    return [(0, 0, None) if s == state else None for s in range(4)]


def advance(layer: list, table: list) -> list:
    """The layer after a turn, or after a run of turns that acts as this table."""
    found = []
    for after in range(4):
        ways = [(layer[b][0] + cost, layer[b][1], letters, b) for b, cost, letters in table[after] if layer[b]]
        found.append(min(ways) if ways else None)
    order = sorted((w[1:3] for w in found if w))
    return [w and (w[0], order.index(w[1:3]), (layer[w[3]][2], w[2])) for w in found]


def audit_of(node: tuple | None) -> str:
    parts = []
    while node:
        node, letters = node
        parts.append(letters)
    return "".join(reversed(parts))


def finish(layer: list) -> tuple[int, str]:
    """Cost and audit, closed by inserts so that the grammar accepts."""
    ways = [(layer[s][0] + INSERT * len(end), layer[s][1], end, s) for s, end in ((START, ""), (SYSTEM, "II"), (USER, "I"), (ASSISTANT, "")) if layer[s]]
    cost, _, end, s = min(ways)
    return cost, audit_of(layer[s][2]) + end


def fault_of(text: str, seen: bool) -> str:
    """The first of blank, duplicate and truncated that holds, or an empty string."""
    if not NOT_SPACE.search(text):
        return "blank"
    return "duplicate" if seen else "truncated" if text.rstrip(" \t\n\v\f\r")[-1] not in ".!?" else ""


class Turns:
    """A run of turns in order: counts, the layers from each given state, and what a later run needs to know."""

    def __init__(self, states: tuple[int, ...] = (START,)):
        self.layers = [start(s) for s in states]
        self.faults = dict.fromkeys(("", "blank", "duplicate", "truncated"), 0)
        self.illegal, self.distinct, self.rows = 0, 0, 0
        self.low = self.high = self.first = self.last = None

    def add(self, turn: int | None, role: str, fault: str) -> None:
        initial = role[:1]
        self.faults[fault] += 1
        self.illegal += self.rows > 0 and self.last + initial not in LEGAL
        if turn is not None:
            self.distinct += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.first, self.last = initial if self.first is None else self.first, initial
        self.rows += 1
        table = TABLES[initial if initial in ("s", "u", "a") else "", fault]
        self.layers = [advance(x, table) for x in self.layers]

    def counts(self) -> tuple[int, ...]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return gaps, self.faults["blank"], self.faults["duplicate"], self.faults["truncated"], self.illegal


class Repairer:
    """Applies an audit to the turns in order; yields the repaired (role, text, edit)."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _made(self) -> str:
        return "a" if self.state == USER else "u"

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            initial = self._made()
            self.state, self.at = MOVES[self.state, initial], self.at + 1
            yield ROLES[initial], "", "I"

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserts()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "R":
            role = ROLES[self._made()]
        if edit != "D":
            self.state = MOVES[self.state, role[0]]
            yield role, text, edit


class Digest:
    """SHA-256 of role:text lines joined by newlines."""

    def __init__(self):
        self.hash, self.empty = hashlib.sha256(), True

    def add(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.empty = False


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000, chars: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, held_chars = [], 0

    def made() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for row in rows:
        held.append(row)
        held_chars += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= size or held_chars >= chars:
            yield made()
            held, held_chars = [], 0
    if held:
        yield made()


#: kind 0: a conversation; 1: one that its partition may not hold whole; 2: a repaired turn.
FOUND = "kind int, conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, pos long, role string, text string, edit string"
_LONG, _STR = pa.int64(), pa.string()
FOUND_ARROW = pa.schema([("kind", pa.int32()), ("conv_id", _LONG), *[(c, _LONG) for c in COUNTS], ("audit", _STR), ("repaired_sha256", _STR), ("pos", _LONG), ("role", _STR), ("text", _STR), ("edit", _STR)])
EMPTY_HASH = hashlib.sha256(b"").hexdigest()


def _turn_row(conv: int | None, pos: int, turn: tuple[str, str, str]) -> tuple:
    return (2, conv, *[None] * 8, pos, *turn)


def _repaired(conv: int | None, rows: list[tuple], turns: bool) -> Iterator[tuple]:
    run, seen = Turns(), set()
    for turn, role, text in rows:
        run.add(turn, role, fault_of(text, (role, text) in seen))
        seen.add((role, text))
    cost, audit = finish(run.layers[0])
    digest, repairer, pos = Digest(), Repairer(audit), 0
    for made in (x for source in (*(repairer.turn(r, t) for _, r, t in rows), repairer.inserts()) for x in source):
        digest.add(*made[:2])
        if turns:
            yield _turn_row(conv, pos, made)
        pos += 1
    yield (0, conv, *run.counts(), cost, audit, digest.hash.hexdigest(), *[None] * 4)


def _inside(batches: Iterator[pa.RecordBatch], turns: bool) -> Iterator[pa.RecordBatch]:
    """Repairs the conversations between the first and the last of a partition, and names these two."""

    def walk() -> Iterator[tuple]:
        edge, key, held = True, None, None
        for conv, turn, role, text, gone in _rows(batches):
            if held is None or conv != key:
                if held is not None:
                    yield from [(1, key, *[None] * 12)] if edge else _repaired(key, held, turns)
                    edge = False
                key, held = conv, []
            if not gone and not edge:
                held.append((turn, role, text))
        if held is not None:
            yield (1, key, *[None] * 12)

    return _batched(walk(), FOUND_ARROW)


RUN = "conv_id long, part int, low long, high long, distinct long, first string, last string, blank long, duplicate long, truncated long, illegal long, costs array<long>, audits array<string>"
RUN_ARROW = pa.schema([("conv_id", _LONG), ("part", pa.int32()), ("low", _LONG), ("high", _LONG), ("distinct", _LONG), ("first", _STR), ("last", _STR), *[(c, _LONG) for c in COUNTS[1:5]], ("costs", pa.list_(_LONG)), ("audits", pa.list_(_STR))])


def _run_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each conversation of a partition, how the run of its turns here acts on the states."""
    part = TaskContext.get().partitionId()

    def told(conv: int | None, run: Turns) -> tuple:
        cells = [x for layer in run.layers for x in layer]
        _, *faults, illegal = run.counts()
        costs, audits = [x and x[0] for x in cells], [x and audit_of(x[2]) for x in cells]
        return (conv, part, run.low, run.high, run.distinct, run.first, run.last, *faults, illegal, costs, audits)

    def walk() -> Iterator[tuple]:
        key, run = None, None
        for conv, turn, role, text, copies, first in _rows(batches):
            if run is None or conv != key:
                if run is not None:
                    yield told(key, run)
                key, run = conv, Turns(tuple(range(4)))
            for i in range(copies):
                run.add(turn, role, fault_of(text, not first or i > 0))
        if run is not None:
            yield told(key, run)

    return _batched(walk(), RUN_ARROW)


def _chained(table: pa.Table) -> pa.Table:
    """One conversation's runs, a row for each partition it touches, in order."""
    runs = sorted(table.to_pylist(), key=lambda r: r["part"])
    layer, last, gaps, low, high, sums = start(), None, 0, None, None, [0] * 4
    for r in runs:
        cells = [[(b, r["costs"][4 * b + a], r["audits"][4 * b + a]) for b in range(4) if r["costs"][4 * b + a] is not None] for a in range(4)]
        layer = advance(layer, cells)
        sums = [x + r[c] for x, c in zip(sums, COUNTS[1:5])]
        sums[3] += last is not None and last + r["first"] not in LEGAL
        last = r["last"]
        if r["low"] is not None:
            gaps += r["distinct"] - (r["low"] == high)
            low, high = r["low"] if low is None else low, r["high"]
    cost, audit = finish(layer)
    row = (0, runs[0]["conv_id"], 0 if low is None else high - low + 1 - gaps, *sums, cost, audit, *[None] * 5)
    return pa.Table.from_batches(list(_batched(iter([row]), FOUND_ARROW)))


def _streamed(batches: Iterator[pa.RecordBatch], turns: bool) -> Iterator[pa.RecordBatch]:
    """Each conversation's audit comes first, then its turns in order."""

    def walk() -> Iterator[tuple]:
        key, repairer, digest, pos = None, None, None, 0

        def out(made: Iterator[tuple[str, str, str]]) -> Iterator[tuple]:
            nonlocal pos
            for x in made:
                digest.add(*x[:2])
                if turns:
                    yield _turn_row(key, pos, x)
                pos += 1

        def ended() -> Iterator[tuple]:
            if repairer is not None:
                yield from out(repairer.inserts())
                yield (0, key, *[None] * 7, digest.hash.hexdigest(), *[None] * 4)

        for conv, head, _, role, text, copies in _rows(batches):
            if head == 0:
                yield from ended()
                key, repairer, digest, pos = conv, Repairer(text), Digest(), 0
            else:
                for _ in range(copies):
                    yield from out(repairer.turn(role, text))
        yield from ended()

    return _batched(walk(), FOUND_ARROW)


def _split(rows: DataFrame, edges: DataFrame, turns: bool) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) of the conversations named in edges, whatever number of partitions they take."""
    rows = rows.join(F.broadcast(edges), rows.conv_id.eqNullSafe(edges.edge), "left_semi")
    equal = rows.filter("not gone").groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    firsts = equal.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text").alias("t")).agg(F.min(F.struct("turn")).alias("least"))
    marked = equal.join(firsts, equal.conv_id.eqNullSafe(firsts.c) & (equal.role == firsts.r) & (equal.text == firsts.t))
    marked = written(marked.select("conv_id", "turn", "role", "text", "copies", F.col("turn").eqNullSafe(F.col("least.turn")).alias("first")))
    runs = _in_order(marked).mapInArrow(_run_tables, RUN)
    told = written(runs.groupBy("conv_id").applyInArrow(_chained, FOUND))
    stream = told.select("conv_id", F.lit(0).alias("head"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(1).cast("long").alias("copies"))
    stream = stream.unionByName(marked.select("conv_id", F.lit(1).alias("head"), "turn", "role", "text", "copies"))
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "head", "turn", "role", "text")
    found = written(stream.mapInArrow(partial(_streamed, turns=turns), FOUND))
    hashes = found.filter("kind = 0").select(F.col("conv_id").alias("c"), F.col("repaired_sha256").alias("hash"))
    out = edges.join(told.drop("kind"), edges.edge.eqNullSafe(told.conv_id), "left")
    out = out.join(hashes, out.edge.eqNullSafe(hashes.c), "left")
    out = out.select(F.col("edge").alias("conv_id"), *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("hash", F.lit(EMPTY_HASH)).alias("repaired_sha256"))
    return out, found.filter("kind = 2")


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, HEAD)).sortWithinPartitions("conv_id", "turn", "role", "text")


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None, turns: bool = True) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): a row of counts, cost, audit and hash each, and the repaired turns (conv_id, pos, role, text, edit).

    gone: a boolean column; such rows name their conversation and count for nothing else. turns=False leaves that table empty.
    """
    flag = F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), flag.alias("gone"))
    found = written(_in_order(rows).mapInArrow(partial(_inside, turns=turns), FOUND))
    edges = written(found.filter("kind = 1").select(F.col("conv_id").alias("edge")).distinct())
    split, split_turns = _split(rows, edges, turns)
    all_turns = found.filter("kind = 2").unionByName(split_turns).select("conv_id", "pos", "role", "text", "edit")
    return found.filter("kind = 0").select(*COLUMNS).unionByName(split), all_turns
