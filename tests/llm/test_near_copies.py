import random
from collections import Counter

import numpy as np
import pytest
from helpers import crowded, docs, rows
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import common, near_copies, simhash

SF = "/root/testdata/sf0.001"


def shingle_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_firsts(table):
    """The first row of each component of pairs at 0.8, by comparing all rows."""
    sets, root = [shingle_set(t) for _, t in table], list(range(len(table)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if a == sets[j] or 5 * shared >= 4 * (len(a) + len(sets[j]) - shared) > 0:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return sorted(i for i in range(len(table)) if find(i) == i)


def edited(rng, words, whole, times):
    near = list(whole)
    for _ in range(times):
        near[rng.randrange(len(near))] = rng.choice(words)
    return " ".join(near)


def test_groups_are_those_of_all_pairs(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    texts = [None, "", "one", "ONE", "one two", "a b c d e", "a b c d f"]
    for _ in range(25):
        whole = [rng.choice(words) for _ in range(rng.randrange(6, 500))]
        texts += [edited(rng, words, whole, n) for n in (0, 1, 2, len(whole) // 60, len(whole) // 45, len(whole) // 40, len(whole) // 30)]
    line = [rng.choice(words) for _ in range(30)]
    texts += [" ".join(line + [rng.choice(words) for _ in range(rng.randrange(2, 30))]) for _ in range(150)]  # share a line, are no copies
    table = list(enumerate(texts))
    kept = near_copies.deduplicated(docs(spark, table))
    assert sorted(r.doc_id for r in kept.collect()) == plain_firsts(table)


def test_keeps_one_row_and_all_columns(spark):
    table = [(5, "a b c d"), (2, "a b c d"), (2, "a b c d"), (None, "a b c d"), (None, None), (None, None), (8, "other words stand here"), (9, "")]
    df = crowded(docs(spark, table))
    kept = near_copies.deduplicated(df)
    assert kept.columns == df.columns
    assert rows(kept, "doc_id", "text") == sorted([(2, "a b c d"), (8, "other words stand here"), (9, "")], key=repr)
    assert near_copies.deduplicated(docs(spark, [])).count() == 0


def test_pipeline_removes_near_copies_of_distant_fingerprints(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(900)]
    table = []
    for i in range(20):
        whole = [rng.choice(words) for _ in range(200)]
        table += [(2 * i, " ".join(whole)), (2 * i + 1, edited(rng, words, whole, 3))]
    assert simhash.deduplicated(docs(spark, table)).count() > 20  # three bits do not find them all
    left = corpus_pipeline.near_dedup(spark, docs(spark, table), SF)
    assert sorted(r.doc_id for r in left.collect()) == list(range(0, 40, 2))


def test_unlike_texts_of_near_fingerprints_stay(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "_of_prints", lambda classes: classes.alias("x").join(classes.alias("y"), F.expr("x.bits < y.bits")).selectExpr(
        "x.bits AS a", "x.n", "y.bits AS b", "y.n AS m"))
    table = [(i, " ".join(f"d{i}w{k}" for k in range(30))) for i in range(12)]
    assert near_copies.deduplicated(docs(spark, table)).count() == 12


def by_prefixes(table):
    """How many texts stay, by an exact prefix filter in plain Python."""
    sets = sorted({frozenset(shingle_set(t)) for _, t in table}, key=len)
    counts = Counter(g for s in sets for g in s)
    index, root = {}, list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, s in enumerate(sets):
        prefix = sorted(s, key=lambda g: (counts[g], g))[:len(s) - -(-4 * len(s) // 5) + 1]
        for j in {j for g in prefix for j in index.get(g, ())}:
            shared = len(s & sets[j])
            if 9 * shared >= 4 * (len(s) + len(sets[j])):
                root[find(k)] = find(j)
        for g in prefix:
            index.setdefault(g, []).append(k)
    return len({find(k) for k in range(len(sets))})


def emitted(spark, table, monkeypatch):
    """Texts kept, and the pairs that were compared."""
    compared, verified = [], near_copies._verified

    def counted(pairs, grams):
        compared.append(pairs.count())
        return verified(pairs, grams)

    monkeypatch.setattr(near_copies, "_verified", counted)
    return near_copies.deduplicated(docs(spark, table)).count(), sum(compared)


def test_one_bucket_of_many_unlike_texts(spark, monkeypatch):
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(160)]
    table = [(i, " ".join(passage + [f"t{i}w{k}" for k in range(40)])) for i in range(5000)]  # 0.66 alike
    table += [(5000 + i, " ".join(passage + [f"t{i}w{k}" for k in range(38)] + [f"x{i}"])) for i in range(100)]
    rng.shuffle(table)
    kept, compared = emitted(spark, table, monkeypatch)
    assert kept == by_prefixes(table) == 5000
    assert compared < 40 * len(table)


def test_edits_of_a_text_that_is_not_there(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(4000)]
    whole = [rng.choice(words) for _ in range(150)]
    table = [(i, edited(rng, words, whole, rng.choice([2, 3, 3, 4, 5, 7]))) for i in range(300)]
    assert emitted(spark, table, monkeypatch)[0] == by_prefixes(table)


def test_recall_on_a_table(spark):
    table = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert near_copies.deduplicated(docs(spark, table)).count() == by_prefixes(table)


def test_fingerprint_of_a_set():
    rng = np.random.default_rng(1)
    for size in (1, 2, 3, 500, 5000):
        found = rng.integers(0, 1 << 63, size, np.uint64)
        want = sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in found) > size)
        assert near_copies.print_of(found) % (1 << 64) == want
    assert near_copies.print_of(np.empty(0, np.uint64)) == 0


def test_scratch_tables_of_others_stay(spark):
    before = common.written(spark.range(3), "mine")
    with common.scope(spark):
        inner = common.written(spark.range(5), "inner")
        assert inner.count() == 5
    assert before.count() == 3
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|PATH_NOT_FOUND"):
        inner.count()
