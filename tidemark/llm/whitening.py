"""Embedding whitening from an exact characteristic polynomial (operator 12).

Vectors become whole numbers. Every task sums their products in whole numbers of any size and sends one row for each
pair of dimensions, in limbs that Spark adds up; so the scatter n * sum(x x') - s s' is exact, and so is its
characteristic polynomial: tasks take its residues modulo primes by Hessenberg reduction, Chinese remaindering puts them
together (``charpoly``). Its largest roots are isolated to ``places`` by exact counts, inverse iteration on
the null space of each gives the components, and the vectors are projected on those in tasks.

What passes the driver has the size of the dimension squared, whatever the number of rows: the scatter, the residues,
the components. The work there grows with the fourth power of the dimension, that of the residues is spread over tasks.

Defined cases: vectors that are null or hold a null or non-finite entry take no part; where lengths differ, the commonest
counts (the longer of two that are as common) and vectors of another length take no part; a null id is returned as
it is, rows with the same id are rows of their own; a component's eigenvalue is above zero, so fewer components than
``COMPONENTS`` come from vectors of lower rank, and none, without rows, from equal vectors or an empty table; of equal
eigenvalues any orthogonal components are given; a deviation that is no long is null; other columns are not read.
"""

from __future__ import annotations

from fractions import Fraction
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import charpoly
from tidemark.llm.common import ship, written

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
BITS = 128
_LIMB = 40
_FIT = 1 << 62
_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part."""
    finite = "forall(embedding, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('infinity'))"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")) \
        .where(F.col("embedding").isNotNull()).where(finite)
    lengths = rows.groupBy(F.size("embedding").alias("length")).agg(F.count("*").alias("n"))
    common = lengths.agg(F.max_by("length", F.struct("n", "length"))).first()[0]
    return rows.where(F.size("embedding") == F.lit(common or 0))


def _whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) as int64, or as Python's whole numbers where one does not fit."""
    scaled = np.floor(values * SCALE)
    if np.abs(scaled).max(initial=0) < _FIT:
        return scaled.astype(np.int64)
    exact = [int(c) * SCALE if abs(c) >= 1 << 53 else int(np.floor(c * SCALE)) for c in values.ravel().tolist()]
    return np.array(exact, object).reshape(values.shape)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    listed = batch.column("embedding")
    return listed.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _moments(batches):
    """Sums over a task's vectors: (i, j, limb, value) for products, j -1 for sums, both -1 for the number of rows."""
    n, sums, products = 0, None, None
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            x = _whole(_matrix(batch.slice(at, 1024)))
            if not x.shape[1]:
                continue
            most = int(np.abs(x).max())
            if most * most * len(x) >= _FIT:
                x = x.astype(object)
            # sums of at most 1024 rows fit; those of a task are whole numbers of any size
            part, square = x.sum(0), x.T @ x
            n += len(x)
            sums = part.astype(object) if sums is None else sums + part.astype(object)
            products = square.astype(object) if products is None else products + square.astype(object)
    if n:
        d = len(sums)
        values = [(-1, -1, n), *((i, -1, sums[i]) for i in range(d)), *((i, j, products[i, j]) for i in range(d) for j in range(i, d))]
        out = []
        for i, j, v in values:
            limb, v = 0, int(v)
            while True:
                high = v >> _LIMB
                last = high in (0, -1)
                out.append((i, j, limb, v if last else v & ((1 << _LIMB) - 1)))
                if last:
                    break
                limb, v = limb + 1, high
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
                                         ["i", "j", "limb", "value"])


def scatter(rows: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums, and n * sum(x x') - s s' of floor(SCALE * c), in whole numbers; a shift of all does not change the last."""
    added = rows.mapInArrow(_moments, "i int, j int, limb int, value long").groupBy("i", "j", "limb").agg(F.sum("value").alias("value"))
    whole: dict = {}
    for i, j, limb, value in added.collect():  # as many as pairs of dimensions
        whole[i, j] = whole.get((i, j), 0) + (value << (_LIMB * limb))
    n, d = whole.get((-1, -1), 0), sum(j == -1 and i >= 0 for i, j in whole)
    sums = [whole[i, -1] for i in range(d)]
    return n, sums, [[n * whole[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(d)] for i in range(d)]


def characteristic_polynomial(spark, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(t - matrix), constant term first; each task takes some of the primes."""
    chosen = charpoly.primes(charpoly.coefficient_bits(matrix) + 1)
    shared = spark.sparkContext.broadcast(matrix)  # of the dimension squared

    def run(batches):
        for batch in batches:
            found = [charpoly.residue(shared.value, p) for p in batch.column("p").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("p"), pa.array(found, pa.list_(pa.int64()))], ["p", "found"])

    tasks = max(1, min(len(chosen) // 4, 4 * spark.sparkContext.defaultParallelism))
    dealt = spark.createDataFrame([(p, k % tasks) for k, p in enumerate(chosen)], "p long, task int").repartition(tasks, "task").select("p")
    return charpoly.combined([tuple(r) for r in dealt.mapInArrow(run, "p long, found array<bigint>").collect()])


def places(matrix: list[list[int]]) -> int:
    """Binary places for roots and vectors: BITS more than the largest spread has before its point."""
    return BITS + sum(matrix[i][i] for i in range(len(matrix))).bit_length() // 2


def components(spark, matrix: list[list[int]], count: int, bits: int) -> list[tuple[Fraction, list[int]]]:
    """(eigenvalue of ``matrix``, unit vector times 2^bits) by falling eigenvalue, those above zero."""
    if not any(any(row) for row in matrix):
        return []
    out: list = []
    for root, many in charpoly.largest_roots(characteristic_polynomial(spark, matrix), count, bits):
        if root >= 0:  # the cell of zero begins below it
            value = Fraction(2 * root + 1, 2 << bits)  # its middle
            out += [(value, v) for v in charpoly.null_space(matrix, root, many, bits)]
    return out[:count]


def _extended(v: list[int], bits: int) -> np.ndarray:
    """v / 2^bits with the 64 bits of an extended double."""
    high = [float(Fraction(x, 1 << bits)) for x in v]
    low = [float(Fraction(x, 1 << bits) - Fraction(h)) for x, h in zip(v, high)]
    return np.array(high, np.longdouble) + np.array(low, np.longdouble)


def _deviation(variance: Fraction) -> np.longdouble:
    """The square root, also of what is beyond a double."""
    return np.longdouble(float(Fraction(isqrt((variance.numerator << 256) // variance.denominator), 1 << 128)))


def projected(rows: DataFrame, n: int, sums: list[int], axes: list[tuple[Fraction, list[int]]], bits: int) -> DataFrame:
    """vec_id, deviation and the whitened coordinates ``w`` of every row.

    Rows that fit 64 bits are projected in extended doubles, others in whole numbers.
    """
    turned = np.array([_extended(v, bits) for _, v in axes]).T
    exact = np.array([v for _, v in axes], object).T
    widths = np.array([_deviation(e / (n * n)) for e, _ in axes])
    shared = rows.sparkSession.sparkContext.broadcast((sums, turned, exact, widths))

    def run(batches):
        sums, turned, exact, widths = shared.value
        centre, most_sum = np.array(sums, object), max(map(abs, sums))
        small = centre.astype(np.int64) if most_sum < _FIT else None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _whole(_matrix(part))
                reach = n * int(np.abs(x).max()) + most_sum
                moved = x * n - small if reach < _FIT else x.astype(object) * n - centre
                squares = moved if reach * reach * len(sums) < _FIT else moved.astype(object)
                deviation = [v if v < 1 << 63 else None for v in (squares * squares).sum(1).tolist()]
                if moved.dtype == object:
                    along = np.array([[float(Fraction(c, n << bits)) for c in row] for row in moved @ exact])
                else:
                    along = moved.astype(np.longdouble) / n @ turned
                w = (along / widths).astype(np.float64)
                offsets = np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(w.ravel()))],
                    ["vec_id", "deviation", "w"])

    return rows.mapInArrow(run, "vec_id long, deviation long, w array<double>")


def identity_error(spread: DataFrame, count: int) -> float:
    """The largest absolute entry of the covariance of ``w`` minus the identity."""
    pairs = [(i, j) for i in range(count) for j in range(i, count)]
    found = spread.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs))


def whitened(embeddings: DataFrame, count: int = COMPONENTS) -> DataFrame:
    """One row for every vector that takes part and component."""
    spark = embeddings.sparkSession
    ship(spark)
    rows = usable(embeddings)
    n, sums, matrix = scatter(rows)
    bits = places(matrix)
    axes = components(spark, matrix, count, bits) if n else []
    if not axes:
        return spark.createDataFrame([], _SCHEMA)
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    explained = F.array(*[F.lit(float(e / trace)) for e, _ in axes])
    spread = written(projected(rows, n, sums, axes, bits), "whitened")
    error = identity_error(spread, len(axes))
    return spread.select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened")).select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("k") + 1).alias("explained"), F.lit(error).alias("identity_error"))
