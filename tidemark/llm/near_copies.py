"""Near copies by the words they share: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Texts of equal sets are one class. Two searches find classes to compare, and all they find is compared exactly, by the
sizes of the two sets and of what they share.

* Fingerprints (operator 5, over five-word shingles): classes within three bits, by Golay indices of their segments.
  At a similarity of 0.8 fingerprints of 64 bits differ in about ten bits, out of reach of any such budget, hence:
* Minima: ``BANDS`` keys, each made of the minima of ``ROWS`` hash functions over the set. Two sets of similarity s share
  a key with probability 1 - (1 - s^ROWS)^BANDS: at 0.8 one pair in 2.5 million is missed.

A bucket of a key is never paired with itself as a whole:

1. Each bucket's *centre*, the class whose buckets are the largest in all (a text that others are edits of is in more of
   them than its edits), is compared with the others, as are the fingerprints' pairs; components of what is similar form.
2. Classes whose buckets hold several components are looked at by their shingles, rarest first. Two sets that share 80 %
   share one of the first 20 % of each (prefix filter). Where the rarest shingle they share stands in at most ``RARE`` of
   these classes, joining those shingles finds them.
3. Else they share only frequent shingles, so each alone must hold as many as the pair must share. Such classes, few,
   are paired within their buckets, across components, each pair in the first bucket it has in common.

So the pairs compared grow with the rows but for the third step, whose number depends on how many texts consist of
frequent shingles almost wholly without being copies of their centre. Counts per key and shingle are partially
aggregated and joined back, no window holds a bucket. Components are found over classes.

Defined cases: a text of fewer than five words has one shingle, all of them; null and empty texts have none and are
equal; rows with the same id are rows of their own; an empty table gives an empty result; extra columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.common import Scratch, parts, ship
from tidemark.llm.components import components
from tidemark.llm.simhash import SEED, first_rows

SHINGLE = 5
LEAST = (4, 5)  # the similarity as a fraction, so that it is compared in whole numbers
ROWS, BANDS = 4, 28
RARE = 16
_BLOCK = 2048  # shingles hashed at a time
_RANDOM = np.random.default_rng(SEED)
_TIMES = _RANDOM.integers(0, 1 << 63, ROWS * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 63, ROWS * BANDS, np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes) -> np.ndarray:
    """Hashes of the distinct shingles, ascending."""
    words = text.lower().split()  # words as for the fingerprint
    if not words:
        return np.empty(0, np.uint64)
    size = min(SHINGLE, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[i:k], SEED) for i, k in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1:].tolist())]
    return np.unique(np.array(hashes, np.uint64))


def keys(found: np.ndarray) -> np.ndarray:
    """The keys of a set of shingles; an empty one has none."""
    if not len(found):
        return np.empty(0, np.int64)
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), _BLOCK):
        np.minimum(least, (found[i:i + _BLOCK, None] * _TIMES + _PLUS).min(axis=0), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(ROWS, BANDS):
        key = (key ^ row) * _MIX
    return key.view(np.int64)


def print_of(found: np.ndarray) -> int:
    """The 64-bit fingerprint of a set of shingle hashes: a bit is set where more than half have it."""
    if not len(found):
        return 0
    rows = np.frombuffer(found.astype(">u8").tobytes(), np.uint8).reshape(-1, 8)
    counts = sum(np.add.reduce(np.unpackbits(rows[i:i + _BLOCK], axis=1), axis=0, dtype=np.int64) for i in range(0, len(rows), _BLOCK))
    return int.from_bytes(np.packbits(2 * counts > len(rows)).tobytes(), signed=True)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *arrays])))


def _sets(batches):
    for batch in parts(batches):
        found = [shingles(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
        bits = np.array([xxhash.xxh64_intdigest(f.tobytes(), SEED) for f in found], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("h"), pa.array(bits), pa.array([len(f) for f in found], pa.int32()),
             pa.array([print_of(f) for f in found], pa.int64()), _lists([keys(f) for f in found])],
            ["doc_id", "h", "bits", "n", "print", "keys"])


def _grams(batches):
    for batch in parts(batches):
        found = [shingles(t or b"").view(np.int64) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("bits"), _lists(found)], ["bits", "grams"])


def _needed(n, m):
    """How many shingles two sets of these sizes share at least if they are similar."""
    low, high = LEAST
    return F.ceil((n + m) * low / F.lit(float(low + high)) - F.lit(1e-9))


def _similar(n, m, shared):
    low, high = LEAST
    return shared * (low + high) >= (n + m) * low


def _verified(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, n, b, m) that are similar."""
    left = grams.select(F.col("bits").alias("a"), F.col("grams").alias("x"))
    right = grams.select(F.col("bits").alias("b"), F.col("grams").alias("y"))
    return pairs.join(left, "a").join(right, "b").where(_similar(F.col("n"), F.col("m"), F.size(F.array_intersect("x", "y")))).select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, n, b, m) once each, smaller class first, without those whose sizes are too far apart."""
    turned = F.col("a") > F.col("b")
    return pairs.where((F.col("a") != F.col("b")) & _similar(F.col("n"), F.col("m"), F.least("n", "m"))).select(
        *[F.when(turned, F.col(other)).otherwise(F.col(own)).alias(own) for own, other in (("a", "b"), ("n", "m"), ("b", "a"), ("m", "n"))]).distinct()


def _of_prints(classes: DataFrame) -> DataFrame:
    """Pairs by fingerprints: classes of one with its smallest, and the smallest of two within three bits."""
    least = classes.groupBy("print").agg(F.min(F.struct("bits", "n")).alias("low"))
    same = classes.join(least, "print").select(F.col("low.bits").alias("a"), F.col("low.n").alias("n"), F.col("bits").alias("b"), F.col("n").alias("m"))
    left = least.select(F.col("print").alias("a"), F.col("low").alias("x"))
    right = least.select(F.col("print").alias("b"), F.col("low").alias("y"))
    near = simhash.links(least.select(F.col("print").alias("bits"))).join(left, "a").join(right, "b") \
        .select(F.col("x.bits").alias("a"), F.col("x.n").alias("n"), F.col("y.bits").alias("b"), F.col("y.n").alias("m"))
    return same.unionByName(near)


def _of_centres(shared: DataFrame) -> DataFrame:
    """Pairs of each class of ``shared`` (key, bits, n, score) with the centre of each of its buckets."""
    centres = shared.groupBy("key").agg(F.max(F.struct("score", "bits", "n")).alias("top"))
    return shared.join(centres, "key").select(F.col("top.bits").alias("a"), F.col("top.n").alias("n"), F.col("bits").alias("b"), F.col("n").alias("m"))


def _prefixes(apart: DataFrame, grams: DataFrame) -> DataFrame:
    """bits, n, root, keys, the rare shingles of the prefix, and ``frequent``: how many others, null if the prefix has none."""
    low, high = LEAST
    rows = grams.join(apart.select("bits"), "bits").select("bits", F.explode("grams").alias("gram"))
    counts = rows.groupBy("gram").agg(F.count("*").alias("df"))
    ranked = rows.join(counts, "gram").groupBy("bits").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("grams"))
    length = F.col("n") - F.ceil(F.col("n") * low / F.lit(float(high)) - F.lit(1e-9)) + 1
    prefix = F.slice("grams", F.lit(1), F.greatest(length.cast("int"), F.lit(1)))
    last = F.element_at(prefix, -1)["df"]
    return apart.join(ranked, "bits").select(
        "bits", "n", "root", "keys",
        F.transform(F.filter(prefix, lambda g: (g["df"] > 1) & (g["df"] <= RARE)), lambda g: g["gram"]).alias("rare"),
        F.when(last > RARE, F.size(F.filter("grams", lambda g: g["df"] > RARE))).alias("frequent"))


def _sides(rows: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    left = rows.withColumnsRenamed({"bits": "a", "root": "r", **{c: f"{c}_a" for c in more}})
    right = rows.withColumnsRenamed({"bits": "b", "n": "m", "root": "s", **{c: f"{c}_b" for c in more}})
    return left, right


def _across(prefixes: DataFrame) -> DataFrame:
    """Pairs of classes in different components that may be similar: steps 2 and 3."""
    apart = (F.col("a") < F.col("b")) & (F.col("r") != F.col("s")) & _similar(F.col("n"), F.col("m"), F.least("n", "m"))
    left, right = _sides(prefixes.select("bits", "n", "root", F.explode("rare").alias("gram")))
    rare = left.join(right, "gram").where(apart).select("a", "n", "b", "m")
    # the place of a key is its band, so an earlier key in common is one at the same smaller place
    left, right = _sides(prefixes.where("frequent IS NOT NULL").select("bits", "n", "root", "frequent", "keys", F.posexplode("keys").alias("band", "key")),
                         "frequent", "keys", "band")
    first = ~F.exists(F.zip_with(F.slice("keys_a", F.lit(1), F.col("band_a")), F.slice("keys_b", F.lit(1), F.col("band_a")), lambda x, y: x == y), lambda same: same)
    enough = F.least("frequent_a", "frequent_b") >= _needed(F.col("n"), F.col("m"))
    frequent = left.join(right, "key").where(apart & enough & first).select("a", "n", "b", "m")
    return rare.unionByName(frequent).distinct()


def grouped(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """bits, root: the component of every class of ``sets`` that has a near copy."""
    own = Scratch(docs.sparkSession)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("h").alias("h"))
    firsts = sets.groupBy("bits").agg(F.min(F.struct(order, "n", "print", "keys")).alias("f"))
    classes = own.write(firsts.select("bits", "f.n", "f.print", "f.keys", F.col("f.col1.id").alias("id"), F.col("f.col1.h").alias("h")), "classes")
    rows = classes.select("bits", "n", F.explode("keys").alias("key"))
    common = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    held = own.write(rows.join(common, "key"), "held")
    scores = held.groupBy("bits").agg(F.sum("size").alias("score"))
    shared = own.write(held.join(scores, "bits").select("key", "bits", "n", "score"), "buckets")
    own.drop("held")
    stars = own.write(_ordered(_of_prints(classes.where("n > 0").select("bits", "n", "print")).unionByName(_of_centres(shared))), "stars")

    wanted = shared.select("bits").unionByName(stars.select(F.col("a").alias("bits"))).unionByName(stars.select(F.col("b").alias("bits"))).distinct()
    picked = classes.join(wanted, "bits").select("bits", "id", F.col("h").alias("g"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    texts = texts.join(picked, texts["doc_id"].eqNullSafe(picked["id"]) & (texts["h"] == picked["g"])).select("bits", "text")
    grams = own.write(texts.mapInArrow(_grams, "bits long, grams array<long>").dropDuplicates(["bits"]), "shingles")
    first = own.write(components(_verified(stars, grams)), "found")

    labelled = shared.join(first, shared["bits"] == first["node"], "left").select("key", "bits", "n", F.coalesce("root", "bits").alias("root"))
    open_keys = labelled.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key")
    open_classes = labelled.join(open_keys, "key").select("bits", "root").distinct()
    apart = own.write(open_classes.join(classes.select("bits", "n", "keys"), "bits"), "apart")
    own.drop("buckets")
    prefixes = own.write(_prefixes(apart, grams), "prefixes")
    more = _verified(_across(prefixes).join(stars.select("a", "b"), ["a", "b"], "left_anti"), grams)
    whole = components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    own.drop()
    return whole.select(F.col("node").alias("bits"), "root")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without all but one of each component: that of the smallest id, as in ``simhash.deduplicated``."""
    spark = docs.sparkSession
    ship(spark)
    own = Scratch(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    sets = own.write(rows.mapInArrow(_sets, "doc_id long, h long, bits long, n int, print long, keys array<long>"), "sets")
    found = grouped(docs, sets)
    classes = sets.select("bits").distinct().join(found, "bits", "left").select("bits", F.coalesce("root", "bits").alias("root"))
    out = first_rows(docs, sets.select("doc_id", "h", "bits"), classes)
    own.drop()
    return out
