"""Measures against plain Python, the beta prior by hand, host verdicts, and odd tables."""

import random
import re

import pytest
from helpers import DOCS, crowded, docs, rows

from tidemark.llm import host_rules as H


def plain(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words by the contract's words."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \t\n\x0b\x0c\r ", "a", "a b", "a b c", "a b c a b c", "a a a a", "a a a", "x y z x y z x", "one\ntwo\none\n\n \n one",
         "# * $ % & | < > #x", "née 😀 née 😀 née", "a b a b a b c", "a\u0085b", "line\r\nline\r\nline", "  lead and trail  ", "퟿ a b a b a b"]


def test_measures(spark):
    draw = random.Random(3)
    texts = TEXTS + ["".join(draw.choice(["a ", "b ", "c\n", "d\t", "#", "  "]) for _ in range(draw.randrange(200))) for _ in range(150)]
    got = H.digest(docs(spark, list(enumerate(texts)))).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == {i: plain(t) for i, t in enumerate(texts)}
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_very_long_text(spark):
    text = " ".join(f"w{i}" for i in range(300_000)) + " w5 w6 w7"
    got = H.digest(docs(spark, [(1, text)])).first()
    assert (got.n_words, got.n_repeat_words, got.kept) == (300_003, 6, True)


GOOD = " ".join(f"word{i}" for i in range(80))
MARKED = GOOD + " #" * 20  # fails one rule that is not a base rule
SHORT = "too short"


def verdicts(spark, hosts):
    listed = [(f"{h}/{i}", t, h) for h, texts in hosts.items() for i, t in enumerate(texts)]
    table = docs(spark, [(i, t, h) for i, (_, t, h) in enumerate(listed)])
    kept = {r.doc_id: r.kept for r in H.digest(table).collect()}
    return {name: kept[i] for i, (name, _, _) in enumerate(listed)}


def test_a_bad_host_loses_its_clean_documents_and_a_small_one_is_judged_by_the_corpus(spark):
    hosts = {"good": [GOOD] * 300, "bad": [GOOD] * 20 + [SHORT] * 280, "small": [GOOD, SHORT]}
    kept = verdicts(spark, hosts)
    assert all(kept[f"good/{i}"] for i in range(300)) and not any(kept[f"bad/{i}"] for i in range(300))
    assert not kept["small/1"]
    rates = {r.host: r.rate_any for r in H.host_rates(H.measured(docs(spark, [(0, t, h) for h, ts in hosts.items() for t in ts]))).collect()}
    assert rates["good"] < 0.05 and rates["bad"] > 0.9 and 0.4 < rates["small"] < 0.52


def test_failing_documents_go_only_on_suspect_hosts(spark):
    kept = verdicts(spark, {"marked": [MARKED] * 90 + [GOOD] * 210, "calm": [MARKED] * 2 + [GOOD] * 298})
    assert not any(kept[f"marked/{i}"] for i in range(90)) and all(kept[f"marked/{i}"] for i in range(90, 300))
    assert all(kept[f"calm/{i}"] for i in range(300))


def test_prior_by_hand(spark):
    sums = spark.createDataFrame([("a", 100, 10), ("b", 100, 50), ("c", 200, 20)], "host string, n long, f long")
    sums = sums.selectExpr("host", "n", *[f"f as f_{k}" for k in (*H.RULES, "any")])
    mean = 80 / 400
    apart = (100 * (0.1 - mean) ** 2 + 100 * (0.5 - mean) ** 2 + 200 * (0.1 - mean) ** 2 - 2 * mean * (1 - mean)) / 400
    for m, s in H.priors(sums).values():
        assert m == pytest.approx(mean) and s == pytest.approx(max(2.0, mean * (1 - mean) / apart - 1))


def test_odd_tables(spark):
    assert H.digest(spark.createDataFrame([], DOCS)).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (1, GOOD, "en", None, 1), (1, GOOD, "en", None, 1), (2, GOOD, "en", "h", 1)], DOCS)
    assert [(r.doc_id, r.n_words, r.kept) for r in sorted(H.digest(odd).collect(), key=lambda r: (r.doc_id or 0))] == \
        [(None, 0, False), (1, 80, True), (1, 80, True), (2, 80, True)]
    more = crowded(odd).selectExpr("*", "2 AS n_words", "3 AS repeats", "4 AS verdict_host", "5 AS joined", "6 AS lines")
    assert rows(H.digest(more)) == rows(H.digest(odd))
