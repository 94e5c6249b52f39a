"""Benchmark decontamination by pigeonhole edit matching (operator 10).

Texts are sequences of words (runs of letters and digits, lower-cased). A test item of m words occurs
in a document if some stretch of it is at most ``int(RATE * m)`` word edits away (insertion,
deletion, replacement). The item is split into one piece more than that budget: at least one piece
then stands unchanged in the stretch. Every document's words are numbered by the vocabulary of the
items, exact piece hits are found by rolling hash, and the neighbourhood of each hit is verified with
Myers' bit-parallel distance, whose bit vectors are as long as the item.

Test items are read in blocks of at most ``BLOCK_WORDS`` words, each sent to the tasks as one index of
bounded size; documents are scanned once per block, in place, without a shuffle. So a passage that
many documents share is one more hit in each of them.

Defined cases: null and empty texts hold no item; an item without words is in no document; an item of
fewer than 1 / RATE words must occur exactly; repeated items and rows are each reported; an empty table
gives an empty result; extra columns are not read by ``matches`` and kept by ``decontaminated``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import parts, ship

RATE = 0.2
BLOCK_WORDS = 1_000_000
_WORDS = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def budget(size: int, rate: float) -> int:
    return int(size * rate + 1e-9)


def pieces(size: int, rate: float) -> list[tuple[int, int]]:
    """(offset, length) of budget + 1 pieces whose lengths differ by one at most."""
    n = budget(size, rate) + 1
    cuts = [size * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` ids."""
    out = np.zeros(len(ids) - size + 1, np.uint64)
    for j in range(size):
        out = out * _BASE + ids[j:len(ids) - size + 1 + j]
    return out


class Index:
    """Pieces of a block of items by length and hash; items keep the numbers of their words."""

    def __init__(self, items: list[tuple], rate: float = RATE):
        self.numbers: dict[str, int] = {}
        self.items, by_size = [], {}
        for key, found in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in found]
            masks: dict[int, int] = {}
            for at, w in enumerate(ids):
                masks[w] = masks.get(w, 0) | 1 << at
            self.items.append((key, ids, masks, budget(len(ids), rate)))
            for offset, size in pieces(len(ids), rate):
                hashed = int(rolling(np.array(ids[offset:offset + size], np.uint64), size)[0])
                by_size.setdefault(size, {}).setdefault(hashed, []).append((len(self.items) - 1, offset))
        self.by_size = {size: (np.array(sorted(found), np.uint64), found) for size, found in by_size.items()}

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, place, offset in the item) of every piece that stands in ``ids``."""
        known = ids != 0
        for size, (hashes, found) in self.by_size.items():
            if len(ids) < size:
                continue
            run = known[:len(ids) - size + 1].copy()
            for j in range(1, size):
                run &= known[j:len(ids) - size + 1 + j]
            places = np.flatnonzero(run)
            if not len(places):
                continue
            here = np.zeros(len(places), np.uint64)
            for j in range(size):
                here = here * _BASE + ids[places + j]
            at = np.minimum(np.searchsorted(hashes, here), len(hashes) - 1)
            for i in np.flatnonzero(hashes[at] == here).tolist():
                place = int(places[i])
                for item, offset in found[int(here[i])]:
                    if self.items[item][1][offset:offset + size] == ids[place:place + size].tolist():
                        yield item, place, offset

    def search(self, text: list[str]) -> list[tuple[int, int, int]]:
        """(item, least distance, end of the first stretch at it) of every item in ``text``."""
        get = self.numbers.get
        ids = np.fromiter((get(w, 0) for w in text), np.uint64, len(text))
        windows: dict[int, list[tuple[int, int]]] = {}
        for item, place, offset in self.hits(ids):
            _, of, _, errors = self.items[item]
            windows.setdefault(item, []).append((max(0, place - offset - errors), place - offset + len(of) + errors))
        out = []
        for item, spans in windows.items():
            _, of, masks, errors = self.items[item]
            best = None
            for start, end in _merged(spans):
                found = myers(masks, len(of), ids[start:end].tolist(), errors)
                if found and (best is None or found[0] < best[0]):
                    best = found[0], start + found[1]
            if best:
                out.append((item, *best))
        return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def myers(masks: dict[int, int], size: int, text: list[int], most: int) -> tuple[int, int] | None:
    """(distance, end) of the first best stretch of ``text`` at most ``most`` edits from the item."""
    full, high = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score, best = full, 0, size, None
    for end, sign in enumerate(text, 1):
        equal = masks.get(sign, 0)
        x_vertical = equal | minus
        x_horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (full & ~(x_horizontal | plus))
        down = plus & x_horizontal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(x_vertical | up)), up & x_vertical
        if score <= most and (best is None or score < best[0]):
            best = score, end
    return best


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple]]:
    block, size = [], 0
    for row in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        found = words(row["text"] or "")
        if not found:
            continue
        if block and size + len(found) > block_words:
            yield block
            block, size = [], 0
        block.append((row["item_id"], found))
        size += len(found)
    if block:
        yield block


def _indexes(benchmark: DataFrame, rate: float, block_words: int):
    ship(benchmark.sparkSession)
    context = benchmark.sparkSession.sparkContext
    for block in _blocks(benchmark, block_words):
        yield context.broadcast(Index(block, rate))


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, distance, allowed, end_word: one row per document and item it holds."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, distance long, allowed long, end_word long"
    out = spark.createDataFrame([], schema)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for shared in _indexes(benchmark.withColumn("item_id", F.col("item_id").cast("long")), rate, block_words):
        def run(batches, shared=shared):
            index = shared.value
            for batch in parts(batches):
                found = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    for item, distance, end in index.search(words(text)) if text else ():
                        key, _, _, errors = index.items[item]
                        found.append((doc, key, distance, errors, end))
                columns = list(zip(*found)) or [()] * 5
                names = ["doc_id", "item_id", "distance", "allowed", "end_word"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)
        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    at = [c.lower() for c in docs.columns].index("text")
    for shared in _indexes(benchmark.withColumn("item_id", F.col("item_id").cast("long")), rate, block_words):
        def run(batches, shared=shared):
            index = shared.value
            for batch in parts(batches):
                clean = [not (text and index.search(words(text))) for text in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))
        docs = docs.mapInArrow(run, docs.schema)
    return docs
