"""Toxicity scores of a bidirectional gated recurrent network over words and characters (operator 7).

Inputs. Every word has two levels: of itself and of its character sequences (4 to 7 signs with both
ends marked), the highest of them. A level is a cautious log-odds ratio (two standard errors off) of
toxic against other documents of the training rows. In training, a document's own count is taken off,
so that a word seen in it alone says nothing.

Model. Windows of ``WINDOW`` words overlap by half and cover the whole text; a document's score is its
highest window's. Trained on each training document's window with the highest levels (the one its
score will come from) and one more.

Fitting uses at most ``SAMPLE`` labelled rows, those of the smallest id hash, on the driver; rows whose
crc32 of the id is 2 modulo 4 are held out. Scoring is one pass over all documents, without a shuffle;
windows without any level are all alike and scored once.

Defined cases: a null or empty text is one window without words; null labels and labels of unknown
documents are left out; several labels of an id count as toxic if one is; without labels of both kinds
every score is 0; a null id is not held out; an empty table gives an empty result; extra columns are
not read by ``scored`` and kept by ``accepted``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import parts, ship
from tidemark.llm.gru import LEVELS, BiGRU

WINDOW = 64
STRIDE = 32
SAMPLE = 6000
THRESHOLD = 0.3
_CACHE = 200_000
_LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams(word: str) -> set[str]:
    marked = f"^{word}$"
    return {marked[i:i + n] for n in range(4, 8) for i in range(max(1, len(marked) - n + 1))}


def _level(toxic: int, other: int, n_toxic: int, n_other: int) -> int:
    ratio = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((other + 0.5) / (n_other + 1))
    careful = ratio - 2 * math.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5))
    return min(LEVELS - 1, max(0, math.ceil((careful - 0.75) * 4)))


class Model:
    """Levels of words and character sequences, and the network; scores texts."""

    def __init__(self, words: dict[str, int], grams: dict[str, int], network: BiGRU | None):
        self.words, self.grams, self.network = words, grams, network
        self.classes: dict[bytes, int] = {}

    def __getstate__(self) -> dict:
        return {"words": self.words, "grams": self.grams, "network": self.network, "classes": {}}

    @cached_property
    def finder(self) -> ahocorasick.Automaton:
        """Finds all known character sequences of a marked word in one pass."""
        out = ahocorasick.Automaton()
        for gram, level in self.grams.items():
            out.add_word(gram, level)
        out.make_automaton()
        return out

    @cached_property
    def plain(self) -> float:
        """Score of a window without any level."""
        return float(self.network.score(np.zeros((1, WINDOW), np.uint8))[0])

    def _class(self, token: bytes) -> int:
        """Levels of the most suspicious word of a token, as one number; 0 for none."""
        best = 0
        for word in _LETTERS.findall(token.decode("utf-8", "replace").lower()):
            char = max((v for _, v in self.finder.iter(f"^{word}$")), default=0) if self.grams else 0
            best = max(best, self.words.get(word, 0) * LEVELS + char)
        return best

    def classed(self, text: bytes) -> np.ndarray:
        known, out = self.classes, []
        if len(known) > _CACHE:
            known.clear()
        for token in text.split():
            found = known.get(token)
            if found is None:
                found = known[token] = self._class(token)
            out.append(found)
        return np.array(out, np.uint8)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """The highest window score of each text."""
        if self.network is None:
            return np.zeros(len(texts), np.float32)
        best = np.full(len(texts), self.plain, np.float32)
        suspicious, owners = [], []
        for i, text in enumerate(texts):
            classes = self.classed(text)
            if not classes.any():
                continue
            rows = windows(classes)
            marked = rows.any(axis=1)
            if marked.all():
                best[i] = 0
            suspicious.append(rows[marked])
            owners.append(np.full(int(marked.sum()), i))
        if suspicious:
            np.maximum.at(best, np.concatenate(owners), self.network.score(np.concatenate(suspicious)))
        return best


def windows(classes: np.ndarray) -> np.ndarray:
    """All overlapping windows of a text, the last filled up with words without a level."""
    n = max(1, -(-max(0, len(classes) - WINDOW) // STRIDE) + 1)
    padded = np.zeros((n - 1) * STRIDE + WINDOW, np.uint8)
    padded[:len(classes)] = classes
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


def _words(text: str | None) -> set[str]:
    return set(_LETTERS.findall((text or "").lower()))


_BUCKETS = 1 << 22


def _counts(rows: list[tuple[str, int]], n_toxic: int, n_other: int) -> dict[str, tuple[dict[str, int], Counter]]:
    """Documents of each kind, toxic and other, that hold a word and a character sequence.

    Only what could have a level is counted, in bounded memory: sequences of toxic documents are first
    counted by hash bucket, then those of full buckets one by one, and other documents only for these.
    """
    toxic = [text for text, label in rows if label]
    least = next(n for n in range(1, n_toxic + 2) if _level(n, 0, n_toxic, n_other) or n > n_toxic)
    buckets = np.zeros(_BUCKETS, np.int32)
    words: Counter = Counter()
    for text in toxic:
        found = _words(text)
        words.update(found)
        buckets[list({hash(g) % _BUCKETS for w in found for g in grams(w)})] += 1
    hot: Counter = Counter()
    for text in toxic:
        hot.update({g for w in _words(text) for g in grams(w) if buckets[hash(g) % _BUCKETS] >= least})
    words, hot = ({x: n for x, n in found.items() if n >= least} for found in (words, hot))
    cold_words, cold = Counter(), Counter()
    finder = ahocorasick.Automaton()
    for gram in hot:
        finder.add_word(gram, gram)
    if hot:
        finder.make_automaton()
    for text, label in rows:
        if not label:
            found = _words(text)
            cold_words.update(w for w in found if w in words)
            cold.update({g for w in found for _, g in finder.iter(f"^{w}$")} if hot else ())
    return {"word": (words, cold_words), "char": (hot, cold)}


def fit(rows: list[tuple[str, int]], seed: int = 7) -> Model:
    """From (text, label) rows."""
    rows = [(text, int(bool(label))) for text, label in rows]
    labels = [label for _, label in rows]
    n_toxic = sum(labels)
    n_other = len(labels) - n_toxic
    if not n_toxic or not n_other:
        return Model({}, {}, None)
    counts = _counts(rows, n_toxic, n_other)

    def levels(kind: str, toxic: int, other: int) -> dict[str, int]:
        """With so many counts taken off: every document sees the others only."""
        hot, cold = counts[kind]
        return {x: v for x, n in hot.items() if (v := _level(max(0, n - toxic), max(0, cold[x] - other), n_toxic, n_other))}

    seen = {label: Model(levels("word", label, 1 - label), levels("char", label, 1 - label), None) for label in (0, 1)}
    picked, target = [], []
    rng = np.random.default_rng(seed)
    for (text, _), label in zip(rows, labels):
        all_of = windows(seen[label].classed((text or "").encode()))
        weight = (all_of // LEVELS + all_of % LEVELS).astype(np.int64)
        picked.append(all_of[int((weight ** 2).sum(1).argmax())])
        target.append(label)
        if not label and len(all_of) > 1:
            picked.append(all_of[rng.integers(len(all_of))])
            target.append(0)
    network = BiGRU(seed).fit(np.stack(picked), np.array(target, np.float32))
    return Model(levels("word", 0, 0), levels("char", 0, 0), network)


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[str, int]]:
    """At most ``sample`` (text, label) rows that are not held out, one per id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL") \
        .where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id")
    found = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return [(r["text"], r["toxic"]) for r in found.orderBy("doc_id").toLocalIterator()]


def _shared_model(docs: DataFrame, labels: DataFrame, sample: int):
    ship(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(fit(training_rows(docs, labels, sample)))


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document."""
    shared = _shared_model(docs, labels, sample)

    def run(batches):
        model = shared.value
        for batch in parts(batches):
            found = model.score([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "score"])
        model.classes.clear()  # the process serves other tasks, too

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold."""
    shared = _shared_model(docs, labels, sample)
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches):
        model = shared.value
        for batch in parts(batches):
            scores = model.score([t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()])
            yield batch.filter(pa.array(scores < threshold))
        model.classes.clear()

    return docs.mapInArrow(run, docs.schema)
