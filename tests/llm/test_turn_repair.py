"""Repairs against exhaustive search and plain Python over whole tables, long conversations, and odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from helpers import rows

from tidemark.llm import turn_repair as T
from tidemark.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def cheapest(given):
    """Exhaustive: edits of every row, up to three insertions in every gap."""
    best = None
    inserted = ["", "u", "a", "ua", "au", "uau", "aua"]

    def options(initial, fault):
        yield 3, "D", ""
        if fault not in (T.BLANK, T.DUPLICATE):
            more = fault == T.CUT
            yield more, "K", initial or "?"
            yield from ((2 + more, "R", x) for x in "ua")

    for gaps in itertools.product(inserted, repeat=len(given) + 1):
        if sum(map(len, gaps)) > 4:
            continue
        for picks in itertools.product(*(list(options(*r)) for r in given)):
            roles = gaps[0] + "".join(p[2] + g for p, g in zip(picks, gaps[1:]))
            if GRAMMAR.fullmatch(roles):
                audit = "I" * len(gaps[0]) + "".join(p[1] + "I" * len(g) for p, g in zip(picks, gaps[1:]))
                best = min(x for x in (best, (sum(p[0] for p in picks) + 2 * sum(map(len, gaps)), audit)) if x)
    return best


def test_lightest_repairs_by_exhaustive_search():
    draw = random.Random(5)
    for _ in range(60):
        given = [(draw.choice("suax"), draw.randrange(4)) for _ in range(draw.randrange(4))]
        assert T.repair(given) == cheapest(given), given


def table_repair(given):
    """The same optimum by a table over (row, state), insertions relaxed until nothing changes."""
    now = {T.START: (0, "")}

    def insertions(cells):
        while True:
            new = dict(cells)
            for s, (c, a) in cells.items():
                new[T.MADE[s]] = min(new.get(T.MADE[s], (1 << 60, "")), (c + 2, a + "I"))
            if new == cells:
                return cells
            cells = new

    for initial, fault in given:
        now, nxt = insertions(now), {}
        for s, (c, a) in now.items():
            steps = [(s, 3, "D")]
            if fault not in (T.BLANK, T.DUPLICATE):
                more = int(fault == T.CUT)
                steps.append((T.MADE[s], 2 + more, "R"))
                if initial in T.KEPT[s]:
                    steps.append((initial, more, "K"))
            for t, w, letter in steps:
                nxt[t] = min(nxt.get(t, (1 << 60, "")), (c + w, a + letter))
        now = nxt
    now = insertions(now)
    return min(now[s] for s in T.ACCEPTED if s in now)


def plain(conversations):
    """The contract in plain Python: conv_id -> result."""
    convs = {}
    for conv, turn, role, text in conversations:
        out = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        damage = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if damage == 0:
            continue
        text = "" if damage == 1 else re.sub("[.!?]", "", text) if damage == 2 else text
        out += [(turn, "user" if damage == 4 else role, text)] * (2 if damage == 3 else 1)
    results = {}
    for conv, listed in convs.items():
        listed.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, given = set(), []
        for _, role, text in listed:
            bare = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = T.BLANK if not bare else T.DUPLICATE if (role, text) in seen else T.CUT if bare[-1] not in ".!?" else T.FINE
            seen.add((role, text))
            given.append((role[:1], fault))
        turns = [t for t, _, _ in listed if t is not None]
        cost, audit = table_repair(given)
        lines, state, at = [], T.START, 0
        for letter in audit:
            role, text = ("", "") if letter == "I" else listed[at][1:]
            at += letter != "I"
            if letter != "D":
                state = role[:1] if letter == "K" else T.MADE[state]
                lines.append(f"{role if letter == 'K' else T.NAMES[state]}:{text}")
        faults = [f for _, f in given]
        results[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count(T.BLANK), faults.count(T.DUPLICATE),
                         faults.count(T.CUT), sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(given, given[1:])), cost, audit,
                         hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return results


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def check(spark, given):
    df = given if hasattr(given, "columns") else spark.createDataFrame(given, SCHEMA)
    got = T.repaired(df).collect()
    want = plain([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])
    assert len(got) == len(want)
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got} == want


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_whole_table(spark, sf):
    check(spark, table(spark, f"/root/testdata/sf{sf}", "conversations"))


def test_random_rows(spark):
    draw = random.Random(11)
    pick = draw.choice
    given = [(pick([None, *range(12)]), pick([None, *range(9)]), pick(["user", "assistant", "system", "tool", "", None, "user"]),
              pick([None, "", " \t", "Yes.", "No", "Why? ", "é!\n", "a.b"])) for _ in range(400)]
    check(spark, given)


def test_a_long_conversation_over_many_segments(spark, monkeypatch):
    draw = random.Random(2)
    given = [(1, i, draw.choice(["user", "assistant", "system"]), draw.choice(["Yes.", f"n{i}.", f"m{i}", ""])) for i in range(5000)]
    given += [(k, i, "user" if i % 2 == 0 else "assistant", f"x{i}.") for k in (0, 2) for i in range(4)]
    check(spark, spark.createDataFrame(given, SCHEMA).repartition(16))


def test_segments_join_to_the_whole():
    draw = random.Random(9)
    for _ in range(20):
        given = [(draw.choice("suax"), draw.randrange(4)) for _ in range(draw.randrange(30))]
        after, at = {T.START: (0, "")}, 0
        while at < len(given):
            size = draw.randrange(1, 6)
            after = T.joined(after, T.segment_weights(given[at:at + size]))
            at += size
        assert T.goal(after) == T.repair(given) == table_repair(given)


def test_many_equal_rows(spark):
    check(spark, [(7, 3, "user", "Same.")] * 3000 + [(7, 5, "assistant", "Well.")])


def test_everything_dropped(spark):
    dropped = next(t for t in range(1000) if zlib.crc32(f"4:{t}".encode()) % 20 == 0)
    got = T.repaired(spark.createDataFrame([(4, dropped, "user", "Hi.")], SCHEMA)).first()
    assert tuple(got[c] for c in COLUMNS) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_odd_tables(spark):
    assert T.repaired(spark.createDataFrame([], SCHEMA)).count() == 0
    some = spark.createDataFrame([(1, 0, "user", "Hi. " * 300_000), (1, 1, "assistant", "Ho."), (None, None, None, None)], SCHEMA)
    check(spark, some)
    more = some.selectExpr("*", "1 AS times", "2 AS kind", "3 AS digest", "4 AS gaps", "5 AS audit", "6 AS damage", "7 AS part")
    assert rows(T.repaired(more)) == rows(T.repaired(some))
    named = some.selectExpr("cast(conv_id as string) conv_id", "turn", "role", "text")
    assert T.repaired(named).count() == 2
