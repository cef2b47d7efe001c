"""Conversation repair against exhaustive search, split conversations against whole ones, and odd tables."""

import hashlib
import heapq
import random
import re
from collections import defaultdict

import pytest

from lineagelake.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string, gone boolean"
GRAMMAR = re.compile(r"(s?(ua)+)?")
PREFIX = re.compile(r"s?(ua)*u?")


def brute(rows):
    """Cheapest edits by Dijkstra over (turns taken, audit, roles): no states, only the grammar as a pattern."""
    rows = sorted(((t is not None, t or 0), " " if r is None else r, " " if x is None else x) for t, r, x in rows)
    faults, seen, blank = [], set(), "\t\n\v\f\r "
    for _, r, x in rows:
        body = x.strip(blank)
        faults.append("blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((r, x))
    heap, best = [(0, "", 0, "", ())], None
    while best is None:
        cost, audit, i, roles, made = heapq.heappop(heap)
        if i == len(rows) and GRAMMAR.fullmatch(roles):
            best = (cost, audit, made)
            break
        ways = [(2, "I", i, x, ({"u": "user", "a": "assistant"}[x], "")) for x in "ua"] if not audit.endswith("III") else []
        if i < len(rows):
            _, r, x = rows[i]
            ways.append((3, "D", i + 1, "", None))
            if faults[i] not in ("blank", "duplicate"):
                late = faults[i] == "truncated"
                ways.append((late, "K", i + 1, r[:1] or "-", (r, x)))
                ways += [(2 + late, "R", i + 1, y, ({"u": "user", "a": "assistant"}[y], x)) for y in "ua"]
        for c, letter, j, y, turn in ways:
            if PREFIX.fullmatch(roles + y):
                heapq.heappush(heap, (cost + c, audit + letter, j, roles + y, made + ((turn,) if turn else ())))
    initials = [r[:1] for _, r, _ in rows]
    numbers = {t[1] for t, _, _ in rows if t[0]}
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in best[2]).encode()).hexdigest()
    return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, best[0], best[1], sha), list(best[2])


def at_once(rows):
    """The operator's own pass over a whole conversation."""
    space = lambda v: " " if v is None else v
    rows = sorted(((t, space(r), space(x)) for t, r, x in rows), key=lambda r: (r[0] is not None, r))
    *turns, told = cv._repaired(1, rows, True)
    return tuple(told[2:10]), [x[11:13] for x in turns]


def compare(spark, rows):
    groups = defaultdict(list)
    for c, t, r, x, gone in rows:
        groups[c] += [] if gone else [(t, r, x)]
    conversations, turns = cv.repair(spark.createDataFrame(rows, SCHEMA), gone="gone")
    got = {r.conv_id: tuple(r)[1:] for r in conversations.collect()}
    made = defaultdict(list)
    for r in sorted(turns.collect(), key=lambda r: r.pos):
        made[r.conv_id].append((r.role, r.text))
    assert set(got) == set(groups)
    for c, own in groups.items():
        want, want_turns = brute(own) if len(own) < 12 else at_once(own)
        assert (c, got[c]) == (c, want)
        assert made[c] == want_turns


def random_rows(rng, n_conversations):
    rows = []
    for c in range(n_conversations):
        for t in range(rng.randrange(0, 8)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Hi.", "Hi.", "Why?", "so then", "", " \t", None, "é!", " ", "end. "])
            rows.append((c, rng.choice([t, t, t, 2 * t, None]), role, text, rng.random() < 0.1))
    return rows


def test_repairs_are_the_cheapest(spark):
    compare(spark, random_rows(random.Random(1), 120))


def test_conversations_dealt_over_partitions(spark):
    """A conversation that takes most partitions, neighbours cut by partition bounds, copies at and across turns."""
    rng = random.Random(2)
    rows = random_rows(rng, 12)
    long = [(5, t // 2, rng.choice(["user", "assistant", "system", None]), rng.choice(["a.", "b", "", f"{t}."]), False) for t in range(60)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        compare(spark, rows + long + long[:9])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_long_conversation_takes_linear_time(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"{t}.", False) for t in range(60_000)]
    rows[30_000] = (1, 30_000, "user", "", False)
    r = cv.repair(spark.createDataFrame(rows, SCHEMA), gone="gone", turns=False)[0].first()
    assert (r.blank, r.cost) == (1, 5) and len(r.audit) == 60_001 and r.audit.count("K") == 59_999 and r.audit[30_000:30_002] == "DI"


def test_odd_conversations(spark):
    rows = [(None, None, None, None, False), (None, 1, "user", "x?", False), (7, 1, "user", "gone", True), (8, 3, "user", "a" * 200_000 + ".", False), (8, 3, "user", "a" * 200_000 + ".", False), (9, 5, "user", "a.", None)]
    compare(spark, rows)
    empty = spark.createDataFrame([], SCHEMA)
    conversations, turns = cv.repair(empty, gone="gone")
    assert conversations.count() == 0 and turns.count() == 0 and conversations.columns == cv.COLUMNS
    clash = spark.createDataFrame([(1, 0, "user", "a.", 1, 1, "x")], "conv_id long, turn long, role string, text string, edge int, kind int, copies string")
    assert cv.repair(clash)[0].first().audit == "KI"
    other = clash.selectExpr("conv_id as c", "turn as t", "role as r", "text as x")
    assert cv.repair(other, "c", "t", "r", "x")[0].first().audit == "KI"


@pytest.mark.parametrize("initial", ["s", "u", "a", ""])
def test_tables_keep_no_path_that_another_beats(initial):
    for fault in ("", "blank", "duplicate", "truncated"):
        for ways in cv.TABLES[initial, fault]:
            assert len({b for b, _, _ in ways}) == len(ways)
            assert fault not in ("blank", "duplicate") or all(letters.endswith("D") for _, _, letters in ways)


def test_query_matches_brute_force_on_the_table(spark):
    import zlib

    import __spark_entry__ as entry

    groups = defaultdict(list)
    for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect():
        kind = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", r.text) if kind == 2 else r.text
        groups[r.conv_id] += [] if kind == 0 else [(r.turn, "user" if kind == 4 else r.role, text)] * (2 if kind == 3 else 1)
    got = {r.conv_id: tuple(r)[1:] for r in entry.queries()["op11_conversation_repair"](spark, "/root/testdata/sf0.001").select(*cv.COLUMNS).collect()}
    assert got == {c: brute(own)[0] for c, own in groups.items()}
