"""Exact top-k inner products with a forest of M-trees and best-first search (operator 1).

Metric. With every vector x extended by sqrt(M^2 - |x|^2), M the largest length, and a query q by zero,
|q' - x'|^2 = |q|^2 + M^2 - 2 <q, x>: the highest inner products are the smallest distances of a metric.

Trees. Vectors go to the nearest of some sampled pivots; those of a pivot with many are dealt in turn,
so each tree has about ``TREE`` vectors however they are spread or repeated, and is one row. A tree is
built of pages: entries of inner pages have a routing vector, a covering radius, the distance to
the parent's routing vector and a child; entries of leaf pages have a vector and that distance.

Search. Queries are dealt into blocks, every block is sent all trees, one at a time. A query visits the
pages of a tree in order of their lower bound, and skips entries whose stored parent distance already
shows that they are too far (triangle inequality); what it has found bounds the next trees. Scores are
exact: components are whole numbers, and the doubles that sum them are below 2^53; where a squared length reaches
that, doubles only bound the search and scores are summed in whole numbers of any size.

The sample of pivots (at most ``PIVOTS`` rows) only decides which tree a vector is in; every vector is
in one, and every query is compared with every tree until its bound excludes it.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part, nor do
rows without an id and vectors (of doubles) whose squared length is beyond a double; shorter vectors count as filled up with zeros; a score beyond a long is ranked as it is and
returned as the nearest long; rows with the same id are rows of their own, each a query or a candidate, but
never of that id; fewer candidates than k are all returned; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ship, written

SCALE = 64
K = 20
EVERY = 20
TREE = 4096
PAGE = 256
PIVOTS = 1024
_BLOCK = 2048  # queries in a block
_EXACT = float(1 << 53)  # sums of products below this are exact in doubles


def _prepared(scale: int):
    def run(batches):
        for batch in batches:
            ids, vectors, lengths, sizes = [], [], [], []
            for key, raw in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
                x = np.floor(scale * np.asarray(raw.values.to_numpy(zero_copy_only=False), np.float64))
                length = float(x @ x)
                if np.isfinite(length):
                    ids.append(key)
                    vectors.append(x.tobytes())
                    lengths.append(length)
                    sizes.append(len(x))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(vectors, pa.binary()), pa.array(lengths, pa.float64()), pa.array(sizes, pa.int32())],
                ["vec_id", "vector", "length", "size"])
    return run


def prepared(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, vector (doubles that are whole numbers), length (squared), size."""
    ship(embeddings.sparkSession)
    usable = "vec_id IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(usable)
    return rows.mapInArrow(_prepared(scale), "vec_id long, vector binary, length double, size int")


def _matrix(vectors: list[bytes], size: int) -> np.ndarray:
    out = np.zeros((len(vectors), size))
    for i, v in enumerate(vectors):
        x = np.frombuffer(v)
        out[i, :len(x)] = x
    return out


def _whole(x: np.ndarray) -> np.ndarray:
    """Doubles that are whole numbers as Python's."""
    return np.array([int(v) for v in x.ravel().tolist()], object).reshape(x.shape)


def _extended(x: np.ndarray, most: float) -> np.ndarray:
    """With the coordinate that gives all rows the length sqrt(most)."""
    return np.hstack((x, np.sqrt(np.maximum(0, most - (x * x).sum(1)))[:, None]))


class Tree:
    """Pages of an M-tree over whole-number vectors. Page 0 is the root."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, most: float, page: int = PAGE):
        self.ids, self.most = ids, most
        self.x = x.astype(np.int16) if len(x) and np.abs(x).max() < 32768 else x
        self.pages: list[tuple] = []
        self._points = _extended(x, most)
        self._build(np.arange(len(ids)), None, page, np.random.default_rng(len(ids)))
        del self._points

    def _distances(self, rows: np.ndarray, to: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 * self.most - 2 * (self._points[rows] @ to)))

    def _build(self, rows: np.ndarray, parent: np.ndarray | None, page: int, rng) -> int:
        """The number of a new page over ``rows`` below the routing vector ``parent``."""
        number = len(self.pages)
        self.pages.append(())
        to_parent = self._distances(rows, parent) if parent is not None else np.zeros(len(rows))
        if len(rows) <= page:
            self.pages[number] = ("leaf", rows.astype(np.int32), to_parent)
            return number
        fan = min(page, -(-len(rows) // page) * 2)
        pivots = self._points[rows[np.sort(rng.choice(len(rows), fan, replace=False))]]
        nearest = (self._points[rows] @ pivots.T).argmax(1)
        groups = [np.flatnonzero(nearest == i) for i in range(fan)]
        if max(map(len, groups)) == len(rows):  # equal vectors: any split is as good
            groups = np.array_split(np.arange(len(rows)), fan)
        routing, radius, distance, child = [], [], [], []
        for i, group in enumerate(groups):
            if len(group):
                routing.append(pivots[i])
                radius.append(self._distances(rows[group], pivots[i]).max())
                distance.append(float(np.sqrt(max(0, 2 * self.most - 2 * (pivots[i] @ parent)))) if parent is not None else 0.0)
                child.append(self._build(rows[group], pivots[i], page, rng))
        self.pages[number] = ("inner", np.array(routing), np.array(radius), np.array(distance), child)
        return number

    def search(self, key: int, q: np.ndarray, found: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """``found`` (scores, ids; best first) with this tree's vectors that belong to the best k."""
        scores, ids = found
        own = float(q @ q)
        whole = None if self.most < _EXACT and own < _EXACT else _whole(q)
        slack = 1e-6 * (1 + np.sqrt(self.most + own))
        points = self.points

        def reach() -> float:
            """The distance beyond which nothing can enter the best k."""
            return np.inf if len(scores) < k else float(np.sqrt(max(0.0, own + self.most - 2 * float(scores[-1])))) + slack

        limit, heap = reach(), [(0.0, 0, None)]
        while heap:
            bound, number, to_parent = heapq.heappop(heap)
            if bound > limit:
                break
            page = self.pages[number]
            if page[0] == "leaf":
                rows = page[1] if to_parent is None else page[1][np.abs(to_parent - page[2]) <= limit]
                new = points[rows] @ q if whole is None else _whole(points[rows]) @ whole
                keep = self.ids[rows] != key
                if len(scores) >= k:
                    keep &= new >= scores[-1]
                if keep.any():
                    scores, ids = np.concatenate((scores, new[keep])), np.concatenate((ids, self.ids[rows[keep]]))
                    best = np.lexsort((ids, -scores))[:k] if whole is None else sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]
                    scores, ids = scores[best], ids[best]
                    limit = reach()
                continue
            _, routing, radius, distance, child = page
            near = np.arange(len(child)) if to_parent is None else np.flatnonzero(np.abs(to_parent - distance) - radius <= limit)
            to = np.sqrt(np.maximum(0, own + self.most - 2 * (routing[near, :-1] @ q)))
            for i, d in zip(near.tolist(), to.tolist()):
                least = max(d - radius[i] - slack, bound)
                if least <= limit:
                    heapq.heappush(heap, (least, child[i], d))
        return scores, ids

    @property
    def points(self) -> np.ndarray:
        if "_x" not in self.__dict__:
            self._x = self.x.astype(np.float64)
        return self._x

    def __getstate__(self) -> dict:
        return {name: v for name, v in self.__dict__.items() if not name.startswith("_")}


def _assigned(pivots: np.ndarray, size: int, most: float):
    """Adds the nearest pivot and a running number, by which a pivot's rows are split evenly."""
    def run(batches):
        seen = 0
        for batch in batches:
            if batch.num_rows:
                nearest = (_extended(_matrix(batch.column("vector").to_pylist(), size), most) @ pivots.T).argmax(1)
                turn = np.arange(seen, seen + batch.num_rows)
                seen += batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("vector"), pa.array(nearest.astype(np.int32)), pa.array(turn)],
                    ["vec_id", "vector", "pivot", "turn"])
    return run


def forest(vectors: DataFrame, size: int, most: float, tree: int = TREE, page: int = PAGE, pivots: int = PIVOTS) -> DataFrame:
    """tree, data: one row per tree of ``vectors`` (vec_id, vector)."""
    n = vectors.count()
    wanted = int(min(pivots, max(1, n // tree)))
    sample = vectors.orderBy(F.xxhash64("vec_id", "vector")).limit(wanted).select("vector").collect()
    points = _extended(_matrix([r[0] for r in sample], size), most)
    dealt = vectors.mapInArrow(_assigned(points, size, most), "vec_id long, vector binary, pivot int, turn long")
    dealt = written(dealt, "mtree-dealt")
    # one count per pivot, of which there are at most PIVOTS
    counts = {r["pivot"]: r["count"] for r in dealt.groupBy("pivot").count().collect()}
    first, parts, total = [0] * len(points), [1] * len(points), 0
    for pivot in sorted(counts):
        first[pivot], parts[pivot] = total, -(-counts[pivot] // tree)
        total += parts[pivot]
    at = F.col("pivot") + 1
    first_of, parts_of = (F.element_at(F.lit(x), at) for x in (first, parts))
    split = dealt.select("vec_id", "vector", (first_of + F.pmod("turn", parts_of)).cast("int").alias("tree"))

    def build(table):
        order = np.argsort(table.column("vec_id").to_numpy(), kind="stable")
        ids = table.column("vec_id").to_numpy()[order]
        x = _matrix(table.column("vector").to_pylist(), size)[order]
        data = pickle.dumps(Tree(ids, x, most, page), protocol=5)
        return pa.table({"tree": pa.array([table.column("tree")[0].as_py()], pa.int32()), "data": pa.array([data], pa.binary())})

    return split.groupBy("tree").applyInArrow(build, "tree int, data binary")


def _searched(size: int, k: int):
    def finish(queries: dict):
        columns = [[], [], [], []]
        for key, _, (scores, ids) in queries.values():
            columns[0] += [key] * len(ids)
            columns[1] += range(1, len(ids) + 1)
            columns[2] += ids.tolist()
            columns[3] += [max(-1 << 63, min((1 << 63) - 1, int(v))) for v in scores.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()),
                                           pa.array(columns[3], pa.int64())], ["query_id", "rank", "vec_id", "score"])

    def run(batches):
        block, queries = None, {}
        for batch in batches:
            for at, tree, key, data in zip(*(batch.column(c) for c in ("block", "tree", "vec_id", "data"))):
                at, tree = at.as_py(), tree.as_py()
                if at != block:
                    if queries:
                        yield finish(queries)
                    block, queries = at, {}
                if tree < 0:  # the queries of a block come before its trees
                    queries[len(queries)] = (key.as_py(), _matrix([data.as_py()], size)[0], (np.zeros(0), np.zeros(0, np.int64)))
                elif queries:
                    found = pickle.loads(data.as_buffer())
                    for i, (key_i, q, best) in queries.items():
                        queries[i] = (key_i, q, found.search(key_i, q, best, k))
        if queries:
            yield finish(queries)
    return run


def top_k(embeddings: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, tree: int = TREE, page: int = PAGE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, its k best others."""
    spark = embeddings.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    vectors = written(prepared(embeddings, scale), "mtree-vectors")
    is_query = F.col("vec_id") % every == 0
    stats = vectors.agg(F.max("length"), F.max("size"), F.count(F.when(is_query, 1))).first()
    if not stats[2]:
        return spark.createDataFrame([], schema)
    most, size = float(stats[0]), int(stats[1])
    blocks = max(-(-stats[2] // _BLOCK), min(2 * spark.sparkContext.defaultParallelism, -(-stats[2] // 32)))
    trees = written(forest(vectors.select("vec_id", "vector"), size, most, tree, page), "mtree-trees")
    asked = vectors.where(is_query).select(
        F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(-1).alias("tree"), "vec_id", F.col("vector").alias("data"))
    sent = trees.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "tree", F.lit(0).cast("long").alias("vec_id"), "data")
    both = asked.unionByName(sent).repartitionByRange(blocks, "block").sortWithinPartitions("block", "tree", "vec_id")
    return both.mapInArrow(_searched(size, k), schema)


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
  FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
