import math
import pickle

import numpy as np
import pytest
from helpers import crowded

from tidemark.llm import mtree

VECTORS = "vec_id long, embedding array<float>, label int"


def plain(table, k=20):
    usable = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in table
              if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in usable:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in usable if j != i)[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    return sorted(out)


def table(n, spread=1.0, seed=0, size=8):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(5, size))
    return [(i, [float(x) for x in centers[i % 5] + spread * rng.normal(size=size)]) for i in range(n)]


def got(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    return sorted(map(tuple, mtree.top_k(crowded(df), **how).collect()))


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_exact_with_small_pages_and_trees(spark, spread):
    rows = table(700, spread)
    assert got(spark, rows, tree=100, page=8) == plain(rows)


def test_hot_vector_ties_and_odd_rows(spark):
    rows = table(200) + [(1000 + i, [0.5] * 8) for i in range(150)] + [
        (None, [1.0] * 8), (20, None), (40, []), (60, [1.0, None] + [0.0] * 6), (80, [math.nan] * 8), (100, [math.inf] * 8),
        (2000, [0.5, 0.5]), (2020, [0.0] * 8), (0, [9.0] * 8), (0, [9.0] * 8)]
    assert got(spark, rows, tree=40, page=8) == plain(rows)


def test_one_row_repeated_is_dealt_to_many_trees(spark):
    rows = table(100) + [(777, [1.0] * 8)] * 300
    assert got(spark, rows, tree=30, page=8) == plain(rows)
    vectors = mtree.prepared(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)).select("vec_id", "vector")
    sizes = [len(pickle.loads(r.data).ids) for r in mtree.forest(vectors, 8, 1e5, tree=30, page=8).collect()]
    assert sum(sizes) == 400 and max(sizes) <= 60


def test_few_and_none(spark):
    rows = table(6)
    assert got(spark, rows) == plain(rows) and len(got(spark, rows)) == 5
    assert got(spark, [(1, [1.0])]) == [] and got(spark, []) == [] and got(spark, [(20, [1.0, 2.0])]) == []


def test_bounds_save_computations():
    rng = np.random.default_rng(2)
    x = np.floor(64 * (np.repeat(rng.normal(size=(40, 8)) * 4, 50, axis=0) + 0.05 * rng.normal(size=(2000, 8))))
    most = float((x * x).sum(1).max())
    tree = mtree.Tree(np.arange(2000), x, most, 32)
    for page in tree.pages:
        if page[0] == "inner":
            for routing, radius, child in zip(page[1], page[2], page[4]):
                below, rows = [child], []
                while below:
                    p = tree.pages[below.pop()]
                    rows += p[1].tolist() if p[0] == "leaf" else below.extend(p[4]) or []
                inside = mtree._extended(x[rows], most)
                assert np.sqrt(((inside - routing) ** 2).sum(1)).max() <= radius + 1e-6
    seen = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            seen.append(len(self))
            return np.asarray(self) @ other

    tree._x = tree.x.astype(np.float64).view(Counted)
    tree.search(-1, x[0], (np.zeros(0), np.zeros(0, np.int64)), 20)
    assert sum(seen) < 1000


def test_vectors_too_long_for_exact_doubles(spark):
    rng = np.random.default_rng(5)
    rows = table(120, 1.0, size=2) + [(2, [2.0e6, 1.0]), (201, [2.0e6, 1.5]), (202, [2.0e6, 1.25]), (220, [1.5e6, -7.0]), (240, [-2.0e6, 3.0])]
    rows += [(300 + i, [float(v) for v in rng.normal(scale=1e6, size=2)]) for i in range(60)]
    assert got(spark, rows, tree=30, page=8) == plain(rows)


def test_scores_beyond_a_long_are_ranked_exactly(spark):
    rows = [(20, [1e12, 1.0])] + [(i, [1e12 - 70_000.0 * i, 0.0]) for i in range(1, 9)]
    found = got(spark, rows, k=5)
    assert [r[2] for r in found] == [1, 2, 3, 4, 5] and {r[3] for r in found} == {(1 << 63) - 1}
