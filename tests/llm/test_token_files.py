import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import crowded, docs, rows
from tokenizers import Tokenizer

from tidemark.llm import simple8b, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("top", [1, 2, 50, 300, 49408, 1 << 20, 1 << 32])
@pytest.mark.parametrize("n", [0, 1, 239, 4095, 4096, 4097, 30000])
def test_coding_round_trip(n, top):
    ids = np.random.default_rng(n + top).integers(0, top, n).astype(np.uint32)
    ids[::3] = np.minimum(ids[::3], 1)
    words, escapes = simple8b.encode(ids)
    whole = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (words, escapes)]
    assert (simple8b.decode(whole[0], np.array([len(w) for w in words], np.int64), n, whole[1]) == ids).all()
    assert whole[1].tolist() == ids[ids >= simple8b.ESCAPE].tolist()


def test_each_word_takes_all_that_fits():
    ids = np.random.default_rng(1).integers(0, 5000, 4096).astype(np.uint32)
    at = 0
    for word in simple8b.encode(ids)[0][0]:
        s = int(word) >> 60
        took = int(simple8b.COUNTS[s])
        for better in range(s):
            n = int(simple8b.COUNTS[better])
            assert int(max(ids[at:at + n])).bit_length() > simple8b.WIDTHS[better]
        at += took


ODD = [None, "", " ", "Hello, World!! don't stop", "a\x1cb \x85  x", "İstanbul ΣΑΣ ǅ ŉ ﬁ", "é ́ x", "<|endoftext|> a<|startoftext|>b",
       "12345 x9 9x ½", "日本語 текст 🎉🎉 ok", "tab\tnew\nline\r\n", "word***, word### $$$", "it's we'll I'M", "a_b c-d e.f", "\x00 \x01", "ſ K"]


def expected(table):
    tokenizer = Tokenizer.from_file(PATH)
    out, start = [], 0
    for key, text in sorted(table, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_files_hold_what_the_tokenizer_gives(spark):
    rng = random.Random(2)
    table = list(enumerate(ODD)) + [(100 + i, " ".join(rng.choice(ODD[3:]) for _ in range(40))) for i in range(60)] + [(None, "none"), (500, "long words " * 50000)]
    rng.shuffle(table)
    got = rows(token_files.tokenized(docs(spark, table).repartition(5)))
    assert got == sorted(expected(table), key=repr)


def test_repeated_rows_and_small_cache(spark):
    table = [(1, "same"), (1, "same"), (1, "same"), (0, "first"), (2, "last")]
    assert rows(token_files.tokenized(crowded(docs(spark, table)))) == sorted(expected(table), key=repr)
    encoder = token_files.Encoder(PATH, cache=2)
    tokenizer = Tokenizer.from_file(PATH)
    for text in ["a b c d", "c d e", "a b", "x, y; z"] * 2:
        ids, sizes = encoder([text.encode()])
        assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1] and sizes.tolist() == [len(ids)]


def test_empty_table(spark):
    assert token_files.tokenized(docs(spark, [])).count() == 0


def test_pieces_are_encoded_once_however_many_words_they_make():
    letters = [a + b for a in "abcdefgh" for b in "klmnop"]
    text = " ".join(f"{w}{s}" for w in letters for s in ("", ".", ",", ";", "!", "?")).encode()
    encoder = token_files.Encoder(PATH, cache=100)  # fewer than the words, more than their pieces
    given, encode_all = [], encoder._encode_all
    encoder._encode_all = lambda texts: given.extend(texts) or encode_all(texts)
    first = encoder([text])[0].tolist()
    assert given
    given.clear()
    assert encoder([text, text.upper()])[0].tolist() == first * 2 and not given


@pytest.mark.parametrize("cache", [0, 7, 100_000])
def test_every_text_has_the_ids_of_the_tokenizer_whatever_is_kept(cache):
    rng = random.Random(cache)
    signs = "abcXYZéÉßİıſȺⱥɃɏŉ ́ΣσяЖ日🎉'’.,;!<|>#-_0123½\t\n\r\x0b\x0c\x1c\x85\xa0 \x00"
    encoder, tokenizer = token_files.Encoder(PATH, cache=cache), Tokenizer.from_file(PATH)
    for _ in range(12):
        texts = ["".join(rng.choice(signs + "  ") for _ in range(rng.choice([0, 1, 9, 400]))).encode() for _ in range(30)]
        texts += [b"ab\xff cd\xe2\x82 ef\xe2\x82", (rng.choice(ODD) or "").encode()]
        ids, sizes = encoder(texts)
        want = [[*tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids, 1] for t in texts]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert len(encoder.known) <= cache


def test_long_pieces_are_not_kept():
    encoder = token_files.Encoder(PATH)
    for text in ("short " + "long" * 1000, "x0" * 5000 + " short", "日本" * 300 + "!"):
        ids, _ = encoder([text.encode()])
        assert ids.tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 1]
    assert set(encoder.known.to_pylist()) == {"short", ""} and len(encoder.kept) == 2


def test_chunks_hold_whole_rows_of_about_one_size():
    texts = ["x" * n for n in (0, 3, 40, 5, 5, 5, 200, 1)] + [None, "é", None]
    whole = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": pa.array(texts, pa.string())})
    for given in ([whole], [whole.slice(0, 4), whole.slice(4, 0), whole.slice(4)], [whole.slice(i, 1) for i in range(len(texts))]):
        got = list(token_files.chunks(iter(given), 50))
        assert pa.Table.from_batches(got).to_pydict() == whole.to_pydict()
        assert all(sum(len(t or "") for t in c.column("text").to_pylist()[:-1]) < 50 for c in got)
    assert len(list(token_files.chunks(iter([whole.slice(i, 1) for i in range(len(texts))]), 1 << 20))) == 1
    assert list(token_files.chunks(iter([]))) == []
