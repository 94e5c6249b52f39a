"""SimHash near-dedup with Golay-code fuzzy hashing (operator 5).

A document's fingerprint has a bit set where more than half of its shingle hashes have it. Equal
fingerprints form a class; classes are linked at ``DISTANCE`` or fewer differing bits.

Search. The 64 bits are cut into three segments, each padded to a word of the [23,12,7] Golay code.
Three errors leave two segments with at most one error each (pigeonhole). Every word has a nearest
codeword (distance 3 at most, the code is perfect); a word one bit away lies within distance 4 of it.
So one side of the join gets the indices of all codewords within 4 (one, or six) for the first segment
of a pair and the nearest for the second, the other side the reverse, and two fingerprints that should
link meet in a bucket of 24 bits for some pair of segments. Candidates are verified by bit count.

Copies are aggregated into classes before the join, so a group of copies is one row in it; components
are found over classes. Defined cases: null and empty texts have fingerprint zero and are linked like
any other; rows with the same id are rows of their own; an empty table gives an empty result; extra
columns are not read by ``linked`` and kept by ``deduplicated``.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import parts, settled, ship, unused, written
from tidemark.llm.components import components

SHINGLE = 3
SEED = 42
DISTANCE = 3
SEGMENTS = (22, 21, 21)
_BLOCK = 1 << 16  # shingles unpacked at a time


def fingerprint(text: bytes) -> bytes:
    """Eight bytes, most significant first."""
    words = text.lower().split()  # for bytes: A-Z only, and exactly the six ASCII white spaces
    if not words:
        return bytes(8)
    size = min(SHINGLE, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[i:k], SEED) for i, k in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1:].tolist())])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    counts = sum(np.add.reduce(np.unpackbits(rows[i:i + _BLOCK], axis=1), axis=0, dtype=np.int64) for i in range(0, len(rows), _BLOCK))
    return np.packbits(2 * counts > len(rows)).tobytes()


def _fingerprints(batches):
    for batch in parts(batches):
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        bits = np.frombuffer(b"".join(fingerprint(t or b"") for t in texts), ">i8").astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(bits)], ["doc_id", "h", "bits"])


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text) and bits (the fingerprint as a long), one row per row."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(_fingerprints, "doc_id long, h long, bits long")


# x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, the generator polynomial of the code.
GENERATOR = 0b110001110101


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits; by syndrome, the nearest error and up to six near ones."""
    low = np.array([_remainder(v) for v in range(1 << 12)], np.int32)
    high = np.array([_remainder(v << 12) for v in range(1 << 11)], np.int32)
    near = [[] for _ in range(1 << 11)]
    units = [_remainder(1 << b) for b in range(23)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= units[b]
            near[syndrome].append(sum(1 << b for b in bits))
    count = np.array([len(x) for x in near], np.int32)
    errors = np.array([x + x[:1] * (6 - len(x)) for x in near], np.int32)
    return low, high, count, errors


def nearest(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each word of 23 bits."""
    low, high, _, errors = _tables()
    return (words ^ errors[low[words & 0xFFF] ^ high[words >> 12], 0]) >> 11


def within_four(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, indices): the codewords within distance 4 of each word, one or six."""
    low, high, count, errors = _tables()
    syndrome = low[words & 0xFFF] ^ high[words >> 12]
    rows = np.repeat(np.arange(len(words)), count[syndrome])
    first = np.repeat(np.cumsum(count[syndrome]) - count[syndrome], count[syndrome])
    nth = np.arange(len(rows)) - first
    return rows, (words[rows] ^ errors[syndrome[rows], nth]) >> 11


def bucket_keys(bits: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, keys) of one side of the join: which segment of a pair is spread differs by side."""
    unsigned = bits.astype(np.int64).view(np.uint64)
    segments, shift = [], 0
    for size in SEGMENTS:
        segments.append(((unsigned >> np.uint64(shift)) & np.uint64((1 << size) - 1)).astype(np.int32))
        shift += size
    all_rows, all_keys = [], []
    for pair, (i, j) in enumerate(combinations(range(3), 2)):
        spread, single = ((i, j), (j, i))[side]
        rows, index = within_four(segments[spread])
        other = nearest(segments[single])[rows]
        first, second = (index, other) if side == 0 else (other, index)
        all_rows.append(rows)
        all_keys.append((pair << 24) | (first << 12) | second)
    return np.concatenate(all_rows), np.concatenate(all_keys)


def _bucketed(side: int):
    def run(batches):
        for batch in batches:
            bits = batch.column("bits").to_numpy(zero_copy_only=False)
            rows, keys = bucket_keys(bits, side)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(bits[rows])], ["key", "bits"])
    return run


def links(classes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b) of different fingerprints of ``classes`` (bits) at ``distance`` or fewer bits, a < b."""
    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"the segments find pairs up to distance {DISTANCE}")
    ship(classes.sparkSession)
    only = classes.select("bits")
    left = only.mapInArrow(_bucketed(0), "key int, bits long").withColumnRenamed("bits", "a")
    right = only.mapInArrow(_bucketed(1), "key int, bits long").withColumnRenamed("bits", "b")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return left.join(right, (left["key"] == right["key"]) & close).select("a", "b").distinct()


def grouped(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """bits, root: the component of every distinct fingerprint of ``prints``."""
    classes = settled(prints.select("bits").distinct())
    stars = components(links(classes, distance))
    return classes.join(stars, classes["bits"] == stars["node"], "left").select("bits", F.coalesce("root", "bits").alias("root"))


def linked(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint, component_id: one row per document."""
    prints = written(fingerprinted(docs), "fingerprints")
    ids = prints.groupBy("bits").agg(F.min("doc_id").alias("least"))
    of = grouped(prints, distance).join(ids, "bits")
    whole = of.groupBy("root").agg(F.min("least").alias("component_id"))
    known = settled(of.join(whole, "root").select("bits", "component_id"))
    return prints.join(known, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` without all but one of each component: that of the smallest id stays.

    Ids may be null (they come last) or repeated; among rows with the same id the smallest text
    hash stays, and rows equal in both are the same document, of which one stays.
    """
    prints = written(fingerprinted(docs), "fingerprints")
    return first_rows(docs, prints, grouped(prints, distance))


def first_rows(docs: DataFrame, prints: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of ``docs`` for each root of ``groups`` (bits, root); ``prints`` has the doc_id, h and bits of every row."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("h").alias("h"))
    firsts = prints.groupBy("bits").agg(F.min(order).alias("first"))
    rooted = firsts.join(groups, "bits").groupBy("root").agg(F.min("first").alias("first"))
    key, mark, times = unused(docs, "kept_id", "kept_h", "kept_times")
    kept = rooted.select(F.col("first.id").alias(key), F.col("first.h").alias(mark))
    same = prints.groupBy("doc_id", "h").agg(F.count("*").alias("n"))
    kept = kept.join(same, kept[key].eqNullSafe(same["doc_id"]) & (kept[mark] == same["h"])) \
        .select(key, mark, F.col("n").alias(times))
    kept = written(kept, "kept")
    found = docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept[key]) & (F.xxhash64(docs["text"]) == kept[mark]))
    once = found.where(F.col(times) == 1).select(*docs.columns)
    again = found.where(F.col(times) > 1).dropDuplicates([key, mark]).select(*docs.columns)
    return once.unionByName(again)
