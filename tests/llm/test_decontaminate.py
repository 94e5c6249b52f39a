import random

from helpers import crowded, docs, rows
from hypothesis import given
from hypothesis import strategies as st

from tidemark.llm import decontaminate as d

ITEMS = "item_id long, text string"


def edits(item, text):
    """Least edits of ``item`` against any stretch of ``text``, row by row."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def plain(table, items):
    return sorted((i, k, e) for i, t in table for k, x in items if (w := d.words(x or "")) and (e := edits(w, d.words(t or ""))) <= d.budget(len(w), d.RATE))


@given(st.lists(st.integers(1, 4), min_size=1, max_size=70), st.lists(st.integers(0, 4), max_size=30))
def test_bit_parallel_distance(item, text):
    masks = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    found = d.myers(masks, len(item), text, len(item))
    assert (found[0] if found else len(item)) == edits(item, text)


def test_pieces_cover_the_item():
    for size in range(1, 200):
        cut = d.pieces(size, d.RATE)
        assert len(cut) == d.budget(size, d.RATE) + 1 and sum(n for _, n in cut) == size and min(n for _, n in cut) >= 1


def case():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(25)] + [(90, None), (91, ""), (92, "!?"), (7, "w1 w2 w3"), (7, "w1 w2 w3"), (None, "w5 w6 w7 w8")]
    table = [(0, None), (1, ""), (2, "w1, W2. w3")]
    for i in range(120):
        out = [rng.choice(words) for _ in range(rng.randrange(0, 80))]
        for _ in range(rng.randrange(3)):
            hidden = (rng.choice(items[:25])[1]).split()
            for _ in range(rng.randrange(0, 2 + len(hidden) // 4)):
                at, how = rng.randrange(len(hidden)), rng.randrange(3)
                hidden[at:at + 1] = [[], ["zz"], [hidden[at], "zz"]][how]
                if not hidden:
                    break
            cut = rng.randrange(len(out) + 1)
            out[cut:cut] = hidden
        table.append((10 + i, " ".join(out)))
    return table, items


def test_against_plain_distances(spark):
    table, items = case()
    got = d.matches(docs(spark, table), spark.createDataFrame(items, ITEMS))
    assert sorted(((r.doc_id, r.item_id, r.distance) for r in got.collect()), key=repr) == sorted(plain(table, items), key=repr)
    small = d.matches(docs(spark, table), spark.createDataFrame(items, ITEMS), block_words=40)
    assert rows(small) == rows(got)


def test_filter_keeps_the_rest(spark):
    table, items = case()
    table += [(1000, "x" * 500_000), (None, "clean"), (None, "w1 w2 w3")]
    df = crowded(docs(spark, table))
    kept = d.decontaminated(df, spark.createDataFrame(items, ITEMS))
    bad = {t for i, t in table if any(x[0] == i for x in plain([(i, t)], items))}
    assert kept.columns == df.columns
    assert rows(kept, "doc_id", "text") == sorted(((i, t) for i, t in table if t not in bad), key=repr)


def test_empty_tables(spark):
    some, none = docs(spark, [(1, "w1 w2")]), spark.createDataFrame([], ITEMS)
    assert d.matches(some, none).count() == 0 and d.decontaminated(some, none).count() == 1
    assert d.matches(docs(spark, []), spark.createDataFrame([(1, "w1")], ITEMS)).count() == 0
