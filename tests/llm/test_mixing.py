import hashlib
import re

import pytest
from helpers import crowded, docs, rows

from tidemark.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(table):
    """Targets by resharing until none is above, then the draws, in plain Python."""
    size = [len(WORD.findall(t or "")) for _, t, _ in table]
    sources = sorted({s for _, _, s in table if s is not None}) + ([None] if any(s is None for _, _, s in table) else [])
    total = {s: sum(n for n, r in zip(size, table) if r[2] == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target, open_ = dict.fromkeys(sources, 0.0), [s for s in sources if total[s]]
    left = 1.5 * sum(total.values())
    while open_ and left > 1e-9:
        share = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in list(open_):
            target[s] += share * weight[s]
            if target[s] >= 2 * total[s]:
                left += target[s] - 2 * total[s]
                target[s] = float(2 * total[s])
                open_.remove(s)
    out = []
    for (i, _, s), n in zip(table, size):
        rate = min(2.0, target[s] / total[s]) if total[s] else 0.0
        u = int(hashlib.md5(f"mix:{'null' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        out.append((i, n, total[s], target[s], n * (int(rate) + (u < rate - int(rate)))))
    return out


TABLE = [(i, " ".join(["w"] * (i % 7 + 1)), "abcde"[i % 5]) for i in range(60)] + [
    (100, None, "a"), (101, "", "b"), (102, "\x0b \x1c x y\n", None), (None, "a b", "c"), (None, "a b", "c"), (7, "r r r", "z"), (7, "r r r", "z"),
    (103, "long " * 30000, "b"), (104, None, "empty")]


def test_matches_resharing_by_hand(spark):
    got = sorted(mixing.taken(docs(spark, TABLE)).collect(), key=lambda r: repr(r[:3]))
    want = sorted(expected(TABLE), key=lambda r: repr(r[:3]))
    assert [(r.doc_id, r.size, r.source_size, r.taken) for r in got] == [w[:3] + w[4:] for w in want]
    assert [r.target for r in got] == pytest.approx([w[3] for w in want])


def test_copies_extra_columns_and_repeats(spark):
    df = crowded(docs(spark, TABLE))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    taken = {}
    for r in mixing.taken(docs(spark, TABLE)).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.copies
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in taken.items() if v}
    assert rows(mixed) == rows(mixing.mix(df))


def test_a_source_with_most_rows_nears_its_target(spark):
    table = [(i, "a b c " * (i % 5 + 1), "hot" if i % 3 else f"s{i % 4}") for i in range(6000)]
    by = {}
    for r, (_, _, s) in zip(sorted(mixing.taken(docs(spark, table)).collect()), table):
        by.setdefault(s, [r.target, 0])[1] += r.taken
    assert all(abs(t - n) <= 0.06 * t for t, n in by.values())


def test_empty_table(spark):
    assert mixing.taken(docs(spark, [])).count() == 0 and mixing.mix(docs(spark, [])).count() == 0
