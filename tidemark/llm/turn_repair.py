"""Conversation structure repair by Knuth's lightest derivations (operator 13).

A repair reads the rows of a conversation in order and keeps, reroles or deletes each, or inserts rows between them, so
that the roles left read ``(s?(ua)+)?``. It is a derivation in a weighted hypergraph: an item ``(i, state)`` says that
the first i rows are dealt with and the roles so far leave the grammar in ``state``; another kind of item is an edit of a
row. A deduction joins a prefix item and an edit item to the next prefix item; its weight is a pair (cost, audit): costs
add up, audits are joined. Both grow, so the function is superior and ``lightest`` may take items off an agenda in the
order of their weights, each final when it is taken. Edit items have an empty audit, so that no weight is below those
it was made from; two audits of one item never differ by an end alone, as that would be insertions, which cost.

Long conversations. Rows are sorted over all tasks by (conversation, turn, role, digest of the text) and cut into
segments of at most ``SEGMENT`` rows. The weights of a segment are derived from every state it can be entered in; the
segments of a conversation are then items themselves, joined one after the other by the same procedure. So a
conversation with a third of all rows is derived by many tasks. The one thing a single task does for it is to hash its
repaired rows, as SHA-256 has an order: it streams them from a sort and holds no more than a batch and the audit.

Rows that are equal in all four are one row with a number of times before anything is sorted; which row is the first of
its role and text is found by sums per (conversation, role, digest), partially aggregated, without a window.

Defined cases: a null role or text is one space, a null conversation or turn is one space in the damage's key; null is a
conversation of its own; null turns come first; rows of one turn are in the order of role and of the SHA-256 of the
text; repeated rows are duplicates of the first; a role's initial is its first code point (none for an empty one); a
conversation without rows after damage has zeros, an empty audit and the hash of nothing; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import parts, ship, written

SEGMENT = 1024
SPACES = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = "start", "s", "u", "a"
STATES = (START, SYSTEM, USER, ASSISTANT)
ACCEPTED = (START, ASSISTANT)
# state -> what may stand there next: initials of rows; the one a row can be changed to or inserted as.
KEPT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MADE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
# faults of a row
FINE, BLANK, DUPLICATE, CUT = range(4)


def lightest(deductions: list[tuple], goals) -> dict:
    """item -> (cost, audit) of its lightest derivation, for all items taken before every goal that can be had was.

    A deduction is (head, tail, cost, letters): from the items of ``tail`` follows ``head``, whose weight is the sum of
    the costs and the audits of the tail joined in order, then ``letters``. Axioms have an empty tail.
    """
    uses: dict = {}
    left = []
    agenda = []
    for k, (head, tail, cost, letters) in enumerate(deductions):
        left.append(len(tail))
        for item in tail:
            uses.setdefault(item, []).append(k)
        if not tail:
            agenda.append((cost, letters, head))
    heapq.heapify(agenda)
    final: dict = {}
    wanted = set(goals)
    while agenda and wanted:
        cost, audit, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = (cost, audit)
        wanted.discard(item)
        for k in uses.get(item, ()):
            left[k] -= 1
            if left[k]:
                continue
            head, tail, more, letters = deductions[k]
            if head not in final:
                total, joined = more, ""
                for t in tail:
                    total += final[t][0]
                    joined += final[t][1]
                heapq.heappush(agenda, (total, joined + letters, head))
    return final


def row_deductions(rows: list[tuple[str, int]]) -> list[tuple]:
    """Deductions of the items (i, state) of ``rows`` (initial, fault), without a first item."""
    out = []
    for i in range(len(rows) + 1):
        for state in STATES:
            out.append(((i, MADE[state]), ((i, state),), INSERT, "I"))
    for i, (initial, fault) in enumerate(rows):
        out.append(((i, "delete"), (), DELETE, ""))
        for state in STATES:
            out.append(((i + 1, state), ((i, state), (i, "delete")), 0, "D"))
        if fault in (BLANK, DUPLICATE):
            continue
        extra = TRUNCATED if fault == CUT else 0
        out += [((i, "keep"), (), extra, ""), ((i, "rerole"), (), REROLE + extra, "")]
        for state in STATES:
            if initial in KEPT[state]:
                out.append(((i + 1, initial), ((i, state), (i, "keep")), 0, "K"))
            out.append(((i + 1, MADE[state]), ((i, state), (i, "rerole")), 0, "R"))
    return out


def segment_weights(rows: list[tuple[str, int]], entries=STATES) -> list[tuple]:
    """(entry, exit, cost, audit) of the lightest way through ``rows`` for each pair of states that has one."""
    common, n = row_deductions(rows), len(rows)
    out = []
    for entry in entries:
        final = lightest([*common, ((0, entry), (), 0, "")], [(n, s) for s in STATES])
        out += [(entry, s, *final[n, s]) for s in STATES if (n, s) in final]
    return out


def joined(before: dict, segment: list[tuple]) -> dict:
    """state -> (cost, audit) after one more segment, from those before it."""
    deductions = [((0, s), (), *weight) for s, weight in before.items()]
    for entry, exit_, cost, audit in segment:
        deductions.append(((0, entry, exit_), (), cost, ""))
        deductions.append(((1, exit_), ((0, entry), (0, entry, exit_)), 0, audit))
    final = lightest(deductions, [(1, s) for s in STATES])
    return {s: final[1, s] for s in STATES if (1, s) in final}


def goal(after: dict) -> tuple[int, str]:
    """The lightest derivation of a whole conversation from the states at its end."""
    deductions = [((s,), (), *weight) for s, weight in after.items()]
    deductions += [("goal", ((s,),), 0, "") for s in ACCEPTED]
    return lightest(deductions, ["goal"])["goal"]


def repair(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """Cost and audit of the lightest repair of one conversation of (initial, fault) rows."""
    after = {START: (0, "")}
    for i in range(0, len(rows), SEGMENT):
        after = joined(after, segment_weights(rows[i:i + SEGMENT], [*after]))
    return goal(after)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` with the contract's damage; a row to be dropped has ``times`` 0, a repeated one 2."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"),
                                F.coalesce("text", space).alias("text"), (F.crc32(key) % 20).alias("damage"))
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.when(F.col("damage") == 0, 0).when(F.col("damage") == 3, 2).otherwise(1).cast("long").alias("times"))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _coded(rows: DataFrame) -> DataFrame:
    """One row per different row of a conversation: how often, is it the first of its role and text, blank, cut."""
    bare = F.btrim("text", F.lit(SPACES))
    keys = ["conv_id", "turn", "role", "digest"]
    narrow = rows.where("times > 0").select(
        "conv_id", "turn", "role", _digest(F.col("text")).alias("digest"), "times", (bare == "").alias("blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    each = narrow.groupBy(*keys).agg(F.sum("times").alias("times"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    each = written(each, "turns")
    firsts = each.groupBy("conv_id", "role", "digest").agg(F.bool_or(F.col("turn").isNull()).alias("none"), F.min("turn").alias("turn")) \
        .select("conv_id", F.when(~F.col("none"), F.col("turn")).alias("turn"), "role", "digest", F.lit(0).cast("long").alias("times"),
                F.lit(None).cast("boolean").alias("blank"), F.lit(None).cast("boolean").alias("cut"), F.lit(True).alias("fresh"))
    both = each.withColumn("fresh", F.lit(False)).unionByName(firsts)
    return both.groupBy(*keys).agg(F.sum("times").alias("times"), F.max("blank").alias("blank"), F.max("cut").alias("cut"), F.max("fresh").alias("fresh"))


_LINE = {"part": pa.int32(), "seg": pa.int32(), "first": pa.string(), "last": pa.string(), "illegal": pa.int64(), "blank": pa.int64(),
         "duplicate": pa.int64(), "truncated": pa.int64(),
         "weights": pa.list_(pa.struct([("entry", pa.string()), ("exit", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))}
_LINE_SQL = "part int, seg int, first string, last string, illegal long, blank long, duplicate long, truncated long, " \
            "weights array<struct<entry:string,exit:string,cost:long,audit:string>>"
_FOUND = ("blank", "duplicate", "truncated", "illegal", "cost", "audit")
_FOUND_SQL = "blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_LEGAL = ("su", "ua", "au")
_NOTHING = object()


def _table(rows: list[tuple], conv_type, fields: dict) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * (len(fields) + 1)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (conv_type, *fields.values()))], ["conv_id", *fields])


def _illegal(initials) -> int:
    return sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:]))


def _segments(batches):
    """Sorted rows to lines of segments. The first conversation of a task may have begun in another one."""
    part = TaskContext.get().partitionId()
    conv, seg, sure, rows = _NOTHING, 0, False, []

    def line():
        faults = [f for _, f in rows]
        weights = segment_weights(rows, (START,) if sure and seg == 0 else STATES)
        initials = [i for i, _ in rows]
        return (conv, part, seg, initials[0], initials[-1], _illegal(initials), faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT),
                [dict(zip(("entry", "exit", "cost", "audit"), w)) for w in weights])

    out, conv_type = [], None
    for batch in batches:
        conv_type = batch.schema.field("conv_id").type
        for key, role, times, blank, cut, fresh in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "times", "blank", "cut", "fresh"))):
            if conv is _NOTHING or key != conv:
                if rows:
                    out.append(line())
                sure, conv, seg, rows = conv is not _NOTHING, key, 0, []
            for k in range(times):
                if len(rows) == SEGMENT:
                    out.append(line())
                    seg, rows = seg + 1, []
                rows.append((role[:1], BLANK if blank else DUPLICATE if not fresh or k else CUT if cut else FINE))
                if len(out) == 256:
                    yield _table(out, conv_type, _LINE)
                    out = []
    if rows:
        out.append(line())
    if out:
        yield _table(out, conv_type, _LINE)


def _conversations(batches):
    """Lines of segments in order to one row per conversation."""
    conv, after, sums, last = _NOTHING, {}, [], None

    def done():
        return conv, *sums, *goal(after)

    fields = dict(zip(_FOUND, (*[pa.int64()] * 5, pa.string())))
    for batch in parts(batches, 64):
        conv_type, out = batch.schema.field("conv_id").type, []
        for r in batch.to_pylist():
            if conv is _NOTHING or r["conv_id"] != conv:
                if conv is not _NOTHING:
                    out.append(done())
                conv, after, sums, last = r["conv_id"], {START: (0, "")}, [0] * 4, None
            after = joined(after, [tuple(w.values()) for w in r["weights"]])
            crossing = last is not None and last + r["first"] not in _LEGAL
            sums = [s + n for s, n in zip(sums, (r["blank"], r["duplicate"], r["truncated"], r["illegal"] + crossing))]
            last = r["last"]
        if out:
            yield _table(out, conv_type, fields)
    if conv is not _NOTHING:
        yield _table([done()], conv_type, fields)


def repaired_rows(rows, audit: str):
    """(role, text) of the repair that ``audit`` names, for an iterator of (role, text)."""
    state = START
    for letter in audit:
        if letter == "I":
            state = MADE[state]
            yield NAMES[state], ""
            continue
        role, text = next(rows)
        if letter == "K":
            state = role[:1]
            yield role, text
        elif letter == "R":
            state = MADE[state]
            yield NAMES[state], text


_RESULT = "gaps long, " + _FOUND_SQL + ", repaired_sha256 string"


def _hashed(batches):
    """Per conversation a line with its audit, then its rows in order, to the line with the hash of the repaired rows."""
    fields = {"gaps": pa.int64(), **dict(zip(_FOUND, (*[pa.int64()] * 5, pa.string()))), "repaired_sha256": pa.string()}
    conv_type = None

    def rows():
        nonlocal conv_type
        for batch in parts(batches):
            conv_type = batch.schema.field("conv_id").type
            yield from batch.to_pylist()

    stream = rows()
    line = next(stream, None)
    while line is not None:
        head, line = line, None

        def texts():
            nonlocal line
            for row in stream:
                if row["kind"] == 0:
                    line = row
                    return
                for _ in range(row["times"]):
                    yield row["role"], row["text"]

        own, sha, joint = texts(), hashlib.sha256(), b""
        for role, text in repaired_rows(own, head["audit"]):
            sha.update(joint + role.encode() + b":" + text.encode())
            joint = b"\n"
        for _ in own:  # up to the next conversation
            pass
        yield _table([(head["conv_id"], *(head[f] for f in ("gaps", *_FOUND)), sha.hexdigest())], conv_type, fields)


def repaired(conversations: DataFrame) -> DataFrame:
    """One row for every conversation: what was wrong with it after the damage, its lightest repair and the repair's hash."""
    ship(conversations.sparkSession)
    rows = damaged(conversations)
    conv = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}"
    keys = ("conv_id", "turn", "role", "digest")
    ordered = _coded(rows).repartitionByRange(*keys).sortWithinPartitions(*keys)
    lines = written(ordered.mapInArrow(_segments, f"{conv}, {_LINE_SQL}"), "segments")
    found = lines.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg").mapInArrow(_conversations, f"{conv}, {_FOUND_SQL}")

    turn = F.when(F.col("times") > 0, F.col("turn"))
    span = F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn)
    every = rows.groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"))
    heads = every.unionByName(found, allowMissingColumns=True).groupBy("conv_id").agg(
        F.max("gaps").alias("gaps"), *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in _FOUND[:-1]], F.coalesce(F.max("audit"), F.lit("")).alias("audit"))
    texts = rows.where("times > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", _digest(F.col("text")).alias("digest"), "text", "times")
    both = heads.withColumn("kind", F.lit(0)).unionByName(texts, allowMissingColumns=True)
    stream = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    return stream.mapInArrow(_hashed, f"{conv}, {_RESULT}")
