"""Token ids in word-aligned binary files (operator 6).

Documents are range-partitioned and sorted by id; each task encodes its texts with the tokenizer,
appends the end id to each, codes the ids with Simple-8b in blocks and writes one file. The files
are read back with Spark's binary reader, decoded as arrays, and give one row per document.

File: ``MAGIC``; the blocks, each its words and then its escapes; a footer of little-endian 64-bit
integers (per block: offset, words, escapes; per document: id, 1 if the id is null, ids) and at the end
the number of blocks, of documents and of ids, the footer's offset and ``MAGIC`` again.

Encoding. The tokenizer drops white space, never joins across it and encodes runs of letters and runs of
signs by themselves, in lower case. So the ids of a text are those of its words between ASCII white
space, and those of a plain word are those of its letters and of the signs after them. Texts are taken
some megabytes at a time as Arrow arrays, in which each distinct word is looked at once. Worker processes keep
the ids of up to ``CACHE`` short pieces; unseen runs of letters are encoded many to a call, as each ends with the one
token that ends a run. Any other word is given to the tokenizer as it stands.

A task writes under a name of its own and renames, so a repeated task replaces its file by the same one.
Defined cases: null and empty texts have the end id alone; null ids come first; rows with the same id
are ordered by the hash of their text; an empty table gives no files and no rows; extra columns are
not read.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import simple8b
from tidemark.llm.common import shared_path, ship

MAGIC = b"TMS8\x00\x00\x00\x01"
END_ID = 1
CACHE = 300_000
CHUNK = 8 << 20  # bytes of text encoded at a time
_FLUSH = 256 * simple8b.BLOCK  # ids coded at a time
_TAIL = struct.Struct("<4q8s")


# Latin letters (without the dotted capital I, whose lower case is no letter), then ASCII signs other than
# the apostrophe: at most two pieces for the tokenizer, whatever stands around the word.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
_PLAIN = rf"^(?P<letters>[{_LETTERS}]*)(?P<signs>[!-&(-/:-@\[-`{{-~]*)$"
_RUN = f"^[{_LETTERS}]+$"
_JOINED = 256  # words encoded in one call
_KEPT = 32  # bytes of the longest piece that is kept


def _lists(ids: list[np.ndarray], counts: np.ndarray) -> pa.ListArray:
    """Lists of ``counts`` ids each."""
    ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint32), *ids])))


class Encoder:
    """Ids of texts, from the ids of the pieces of their words, of which short ones are kept.

    A word is two pieces: letters in lower case and signs after them, or the whole word and nothing.
    """

    def __init__(self, path: str, end_id: int = END_ID, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id, self.cache = end_id, cache
        # tokens that end a piece, for cutting a joined encoding into its words
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ending = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ending[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.known, self.kept = pa.array([], pa.string()), _lists([], np.zeros(0, np.int64))  # pieces and the ids of each

    def _encode_all(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, pieces: pa.StringArray) -> pa.ListArray:
        """Ids of each piece by itself."""
        found = self._encode_all([p.decode("utf-8", "replace") for p in pieces.cast(pa.binary()).to_pylist()])
        return _lists(found, np.array([len(x) for x in found], np.int64))

    def _encode_runs(self, runs: pa.StringArray) -> pa.ListArray:
        """Ids of each run of letters, joined to texts that the tokenizer cuts at the same places."""
        starts = np.append(np.arange(0, len(runs), _JOINED), len(runs))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), runs), " ").to_pylist()
        ids, counts = self._encode_all(joined), []
        for i, found in enumerate(ids):
            ends = np.flatnonzero(self.ending[np.minimum(found, len(self.ending) - 1)]) + 1
            if len(ends) != starts[i + 1] - starts[i] or ends[-1] != len(found):
                alone = self._encode(runs[starts[i]:starts[i + 1]])
                ids[i], ends = alone.values.to_numpy(), alone.offsets.to_numpy()[1:]
            counts.append(np.diff(ends, prepend=0))
        return _lists(ids, np.concatenate([np.zeros(0, np.int64), *counts]))

    def _ids(self, pieces: pa.StringArray) -> pa.ListArray:
        """Ids of distinct pieces."""
        unseen = pieces.filter(pc.invert(pc.is_in(pieces, value_set=self.known)))
        is_run = pc.match_substring_regex(unseen, _RUN)
        runs, others = unseen.filter(is_run), unseen.filter(pc.invert(is_run))
        known = pa.concat_arrays([self.known, runs, others])
        kept = pa.concat_arrays([self.kept, self._encode_runs(runs), self._encode(others)])
        out = kept.take(pc.index_in(pieces, value_set=known))
        # when there are too many the first of these are kept, as frequent ones come early
        known, kept = (known, kept) if len(known) <= self.cache else (pieces, out)
        short = pc.less_equal(pc.binary_length(known), _KEPT)
        self.known, self.kept = known.filter(short)[:self.cache], kept.filter(short)[:self.cache]
        return out

    def __call__(self, texts: pa.StringArray | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with their end ids, ids per text)."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary())).cast(pa.binary())
        split = pc.ascii_split_whitespace(texts.fill_null(b"").view(pa.string()))
        words = split.flatten().dictionary_encode()
        plain = pc.extract_regex(words.dictionary, _PLAIN)
        letters, signs = (pc.struct_field(plain, [i]) for i in range(2))
        pieces = pa.concat_arrays([pc.coalesce(pc.utf8_lower(letters), words.dictionary), signs.fill_null("")]).dictionary_encode()
        both = self._ids(pieces.dictionary).take(pa.array(pieces.indices.to_numpy().reshape(2, -1).T.ravel()))
        by_word = pa.ListArray.from_arrays(both.offsets[::2], both.values)
        found = by_word.take(words.indices)
        ends = found.offsets.to_numpy()[split.offsets.to_numpy()[1:]]
        return np.insert(found.values.to_numpy(), ends, self.end_id), np.diff(ends, prepend=0) + 1


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """One encoder per worker process, so its pieces serve all tasks of the process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task for each core
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


class Writer:
    """Writes one file of the format above, a run of whole blocks at a time."""

    def __init__(self, out):
        self.out, self.offset = out, 0
        self.blocks, self.docs, self.waiting, self.n_ids = [], [], [], 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.offset += len(data)

    def _code(self, ids: np.ndarray) -> None:
        for words, escapes in zip(*simple8b.encode(ids)):
            self.blocks.append((self.offset, len(words), len(escapes)))
            self._put(words.astype("<u8").tobytes())
            self._put(escapes.astype("<u8").tobytes())

    def add(self, docs: list[tuple[int, int, int]], ids: np.ndarray) -> None:
        self.docs.extend(docs)
        self.waiting.append(ids)
        self.n_ids += len(ids)
        if sum(map(len, self.waiting)) >= _FLUSH:
            ids = np.concatenate(self.waiting)
            whole = len(ids) // simple8b.BLOCK * simple8b.BLOCK
            for i in range(0, whole, _FLUSH):
                self._code(ids[i:min(i + _FLUSH, whole)])
            self.waiting = [ids[whole:]]

    def close(self) -> None:
        self._code(np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32))
        footer = self.offset
        self._put(np.array(self.blocks, "<i8").tobytes())
        self._put(np.array(self.docs, "<i8").tobytes())
        self._put(_TAIL.pack(len(self.blocks), len(self.docs), self.n_ids, footer, MAGIC))


def read(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(documents as rows of id, null flag, ids; all ids) of a file."""
    n_blocks, n_docs, n_ids, footer, magic = _TAIL.unpack(data[-_TAIL.size:])
    if magic != MAGIC or data[:len(MAGIC)] != MAGIC:
        raise ValueError("not a file of token ids")
    blocks = np.frombuffer(data, "<i8", n_blocks * 3, footer).reshape(-1, 3)
    docs = np.frombuffer(data, "<i8", n_docs * 3, footer + blocks.nbytes).reshape(-1, 3)
    stored = np.frombuffer(data, "<u8", (footer - len(MAGIC)) // 8, len(MAGIC))
    if blocks[:, 2].any():
        at = (blocks[:, 0] - len(MAGIC)) // 8
        words = np.concatenate([stored[a:a + w] for a, w in zip(at, blocks[:, 1])])
        escapes = np.concatenate([stored[a + w:a + w + e] for a, w, e in zip(at, blocks[:, 1], blocks[:, 2])])
    else:
        words, escapes = stored, stored[:0]
    ids = np.concatenate([  # some blocks at a time: each needs padding while it is decoded
        simple8b.decode(words[a:b], blocks[i:i + 256, 1], min(n_ids - i * simple8b.BLOCK, 256 * simple8b.BLOCK), escapes[c:d]).astype(np.uint32)
        for i in range(0, n_blocks, 256)
        for a, b in [(blocks[:i, 1].sum(), blocks[:i + 256, 1].sum())]
        for c, d in [(blocks[:i, 2].sum(), blocks[:i + 256, 2].sum())]] or [np.zeros(0, np.uint32)])
    return docs, ids


def chunks(batches, size: int = CHUNK):
    """The same rows in batches of about ``size`` bytes of text, of whole rows."""
    waiting, held = [], 0
    for batch in batches:
        waiting.append(batch)
        held += batch.nbytes
        if held >= size:
            yield from _cut(waiting, size)
            waiting, held = [], 0
    yield from _cut(waiting, size)


def _cut(batches: list[pa.RecordBatch], size: int):
    for batch in pa.Table.from_batches(batches).combine_chunks().to_batches() if batches else []:
        lengths = pc.binary_length(batch.column("text")).fill_null(0).to_numpy()
        before = np.cumsum(lengths, dtype=np.int64) - lengths
        starts = np.flatnonzero(np.diff(before // size, prepend=-1)).tolist()
        for start, end in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(start, end - start)
    pa.default_memory_pool().release_unused()


def _location(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> list[tuple[str, int]]:
    """Write the files of ``docs`` (doc_id, text) to a shared folder; (name, ids) of each in order.

    The list has one entry per file, of many thousand documents each.
    """
    ship(docs.sparkSession)
    fs, path = _location(folder)
    fs.create_dir(path, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tie = F.xxhash64("text")
    # the number only deals equal rows, which may be any part of the table, to several tasks
    ordered = rows.repartitionByRange("doc_id", tie, F.rand(7)).sortWithinPartitions("doc_id", tie)

    def run(batches):
        fs, path = _location(folder)
        encode, writer, own = encoder(tokenizer, end_id), None, None
        name = f"part-{TaskContext.get().partitionId():06d}.ids"
        for batch in chunks(batches):
            if writer is None:
                own = f"{path}/_{name}-{uuid.uuid4().hex}"
                stream = fs.open_output_stream(own)
                writer = Writer(stream)
            ids, sizes = encode(batch.column("text"))
            writer.add([(k or 0, k is None, n) for k, n in zip(batch.column("doc_id").to_pylist(), sizes.tolist())], ids)
        if writer:
            writer.close()
            stream.close()
            fs.move(own, f"{path}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([writer.n_ids], pa.int64())], ["name", "n_ids"])

    return sorted((r["name"], r["n_ids"]) for r in ordered.mapInArrow(run, "name string, n_ids long").collect())


def read_back(docs: DataFrame, folder: str, files: list[tuple[str, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in ``files``; ``docs`` gives the session."""
    spark = docs.sparkSession
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)
    before, total = {}, 0
    for name, n in files:
        before[name], total = total, total + n
    shared = spark.sparkContext.broadcast(before)

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows, ids = read(data.as_buffer())
                ends = np.cumsum(rows[:, 2])
                starts = ends - rows[:, 2]
                view = memoryview(ids.astype("<u4")).cast("B")
                sums = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[:, 0], mask=rows[:, 1] == 1), pa.array(starts + shared.value[path.rpartition("/")[2]]),
                     pa.array(rows[:, 2]), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.ids").load(folder).select("path", "content")
    return found.mapInArrow(run, schema)


def tokenized(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Write ``docs`` as files of token ids and return one row per document, read back from them."""
    folder = folder or shared_path(docs.sparkSession, "token-ids")
    return read_back(docs, folder, write(docs, folder, tokenizer or public_tokenizers.path("word_bpe_49k.json"), end_id))
