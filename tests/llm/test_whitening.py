"""The polynomial against its definition, roots and vectors against numpy, whole tables by brute force, odd tables."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from helpers import rows

from tidemark.llm import charpoly as C
from tidemark.llm import whitening as W
from tidemark.llm.common import table

SCHEMA = "vec_id long, embedding array<double>, label int"


def determinant(m):
    """By cofactors, in whole numbers."""
    if not m:
        return 1
    return sum((-1) ** j * v * determinant([r[:j] + r[j + 1:] for r in m[1:]]) for j, v in enumerate(m[0]) if v)


def whole_polynomial(m):
    return C.combined([(p, C.residue(m, p)) for p in C.primes(C.coefficient_bits(m) + 1)])


def test_polynomial_by_its_values():
    draw = random.Random(1)
    for n in range(1, 6):
        for most in (1, 3, 10 ** 12):
            m = [[draw.randint(-most, most) * (draw.random() < 0.7) for _ in range(n)] for _ in range(n)]
            found = whole_polynomial(m)
            assert found[-1] == 1 and found[-2] == -sum(m[i][i] for i in range(n))
            for t in (-2, 0, 1, 7):
                at = [[(t if i == j else 0) - v for j, v in enumerate(row)] for i, row in enumerate(m)]
                assert sum(c * t ** k for k, c in enumerate(found)) == determinant(at)


def test_primes():
    found = C.primes(200)
    assert all(p % q for p in found for q in range(3, math.isqrt(p) + 1, 2)) and math.prod(found).bit_length() > 200


def scattered(draw, n, d, rank):
    base = draw.integers(-5, 6, (n, rank)) @ draw.integers(-5, 6, (rank, d))
    return (base.T @ base).tolist()


def test_roots_and_vectors():
    draw = np.random.default_rng(4)
    for d, rank in ((1, 1), (3, 2), (6, 6), (9, 4)):
        m = scattered(draw, 30, d, rank)
        found = C.largest_roots(whole_polynomial(m), d, 100)
        values = [c / 2 ** 100 for c, many in found for _ in range(many)]
        want = np.linalg.eigvalsh(np.array(m, float))[::-1]
        assert values == pytest.approx(want.tolist(), abs=1e-9 * want[0])
        assert sum(many for c, many in found if c < 0) == d - np.linalg.matrix_rank(np.array(m, float))
        for cell, many in found:
            if cell >= 0:
                vectors = np.array([[x / 2 ** 100 for x in v] for v in C.null_space(m, cell, many, 100)])
                assert np.abs(vectors @ vectors.T - np.eye(many)).max() < 1e-14
                assert np.abs(np.array(m, float) @ vectors.T - vectors.T * (cell / 2 ** 100)).max() < 1e-9 * want[0]


def test_roots_of_several():
    assert C.largest_roots([0, 0, 9, -6, 1], 4, 20) == [((3 << 20) - 1, 2), (-1, 2)]  # t^2 (t - 3)^2
    same = [[7, 0, 0], [0, 7, 0], [0, 0, 2]]
    (cell, many), second = C.largest_roots(whole_polynomial(same), 3, 64)
    assert many == 2 and second[1] == 1
    vectors = np.array([[x / 2 ** 64 for x in v] for v in C.null_space(same, cell, 2, 64)])
    assert np.abs(vectors[:, 2]).max() < 1e-15 and np.abs(vectors @ vectors.T - np.eye(2)).max() < 1e-15


def brute(given):
    """vec_id list, n, deviations, covariance of x, x - mean: plain numpy and whole numbers."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in given]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums)] for v in x])
    return n, deviation, centred.T @ centred / n, centred


def check(spark, df, given):
    n, deviation, covariance, centred = brute(given)
    values, vectors = np.linalg.eigh(covariance)
    found = {}
    for r in W.whitened(df).collect():
        assert r.n == n and r.identity_error < 1e-9
        found.setdefault((r.vec_id, r.deviation), {})[r.component] = (r.whitened, r.explained)
    count = min(8, len(covariance))
    for (key, _), d, row in zip(given, deviation, centred):
        got = found[key, d]
        assert sorted(got) == list(range(1, count + 1))
        for k in range(count):
            e, v = values[-1 - k], vectors[:, -1 - k]
            assert got[k + 1][1] == pytest.approx(e / np.trace(covariance), rel=1e-9)
            assert abs(got[k + 1][0]) == pytest.approx(abs(row @ v) / math.sqrt(e), rel=1e-6, abs=1e-7)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_whole_table(spark, sf):
    df = table(spark, f"/root/testdata/sf{sf}", "embeddings")
    check(spark, df, [(r.vec_id, r.embedding) for r in df.collect()])


def test_odd_rows(spark):
    draw = random.Random(3)
    good = [(i, [draw.uniform(-1, 1) * (k + 1) for k in range(3)]) for i in range(40)] + [(None, [0.1, 0.2, 0.3]), (7, [0.5, 0.5, 0.5])]
    bad = [(90, None), (91, [1.0, None, 2.0]), (92, [float("nan"), 1.0, 1.0]), (93, [1.0, float("inf"), 1.0]), (94, [1.0, 2.0]), (95, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in good + bad], SCHEMA).repartition(5)
    check(spark, df, good)
    assert rows(W.whitened(df.selectExpr("*", "1 AS n", "2 AS component", "3 AS w", "4 AS k")).select("vec_id", "component", "deviation")) == \
        rows(W.whitened(df).select("vec_id", "component", "deviation"))


def test_entries_beyond_whole_doubles_and_longs(spark):
    given = [(i, [(-1) ** i * 2.0 ** 70 * (1 + i), float(i % 3), 1e300 * (i % 2)]) for i in range(12)]
    got = W.whitened(spark.createDataFrame([(i, v, 0) for i, v in given], SCHEMA)).collect()
    assert {r.component for r in got} == {1, 2, 3} and all(r.deviation is None and r.identity_error < 1e-4 for r in got)


def test_low_rank_equal_vectors_and_empty_tables(spark):
    line = [(i, [float(i), 2.0 * i, -1.0 * i], 0) for i in range(10)]
    got = W.whitened(spark.createDataFrame(line, SCHEMA)).collect()
    assert {r.component for r in got} == {1} and all(r.explained == pytest.approx(1) for r in got) and len(got) == 10
    assert W.whitened(spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(5)], SCHEMA)).count() == 0
    assert W.whitened(spark.createDataFrame([], SCHEMA)).count() == 0
    assert W.whitened(spark.createDataFrame([(1, [], 0)], SCHEMA)).count() == 0


def test_equal_eigenvalues(spark):
    corners = [(i, [(1.0 if i & 1 else -1.0), (1.0 if i & 2 else -1.0), (1.0 if i & 4 else -1.0)], 0) for i in range(8)]
    got = W.whitened(spark.createDataFrame(corners, SCHEMA)).collect()
    assert len(got) == 24 and all(r.explained == pytest.approx(1 / 3) and r.identity_error < 1e-12 for r in got)
