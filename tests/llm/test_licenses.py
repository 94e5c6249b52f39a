import random
import re

from helpers import crowded, docs
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import licenses
from tidemark.llm.signatures import LONGEST, rules

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def base(text):
    words = WORD.findall((text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(words)):
            if words[i:i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def check(spark, texts):
    got = sorted(licenses.digest(docs(spark, list(enumerate(texts)))).collect())
    for r, text in zip(got, texts):
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text), text
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    return [r.labels for r in got]


PARTS = ["GNU", "General", "Public", "License", "Apache", "CC", "BY", "NC", "MIT", "apache license", "cc\nby", "4.0", "é", "Kgnu", "K", "x" * 40, "-", "_", "\x00"]


def test_base_places_on_odd_texts(spark):
    texts = [None, "", "  ", "Apache License", "éapache license", "apache  --  LICENSE!", "cc by cc by", "İMIT license", "no such thing",
             "The apache license " * 9000, "MIT License", "MIT License"]
    check(spark, texts)


def test_rules_and_containment(spark):
    labels = check(spark, ["Licensed under CC BY-NC 4.0.", "Apache License, Version 2.0", "GNU General Public License, version 3 or later",
                           "SPDX-License-Identifier: MIT", "released under BSD", "Permission is hereby granted, free of charge, to any person obtaining a copy",
                           "Mozilla Public License 2.0", "the 3-clause BSD license"])
    assert labels == ["cc-by,cc-by-nc-4.0", "apache,apache-2.0", "gpl,gpl-3.0", "mit", "bsd", "mit", "mpl-2.0", "bsd-3-clause"]


def test_every_rule_passes_the_gate_and_fits_a_window():
    gate = re.compile(licenses.ABBREVIATED.replace("(?i)", ""), re.I)
    assert len(rules()) > 200
    for r in rules():
        plain = re.sub(r"\(\?:([^()|]*)[^()]*(?:\([^()]*\)[^()]*)*\)\??", r"\1", r["pattern"][2:-len(")(?= |$)")]).replace("[cs]", "c").replace("?", "")
        assert any(k in plain for k in licenses.KEYWORDS) or gate.search(plain), r["pattern"]
        assert plain.count(" ") < LONGEST


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map(" ".join), min_size=20, max_size=20))
def test_base_places_on_random_texts(spark, texts):
    check(spark, texts)


def test_empty_and_crowded(spark):
    assert licenses.digest(docs(spark, [])).count() == 0
    assert licenses.digest(crowded(docs(spark, [(None, "MIT License")]))).first().labels == "mit"


def greedy(text):
    """Every match of every rule, taken in order of length, priority and start where no taken one overlaps."""
    words, every = WORD.findall(text.translate(LOWER)), []
    for i in range(len(words)):
        near = " ".join(words[i:i + LONGEST])
        for r in rules():
            m = re.search(r["pattern"], near) if r["lead"] == words[i] and r["need"] in near else None
            if m and m[1]:
                size = m[1].count(" ") + 1
                every.append((-size, -r["rank"], i, i + size, r["label"]))
    taken = []
    for _, _, start, end, label in sorted(every):
        if not any(s < end and start < e for s, e, _ in taken):
            taken.append((start, end, label))
    return sorted(taken)


def test_a_beaten_detection_removes_no_other(spark):
    rng = random.Random(4)
    parts = ["BSD", "2", "3", "Clause", "License", "Licence", "Apache", "2.0", "MIT", "GNU", "GPL", "v3", "CC", "BY", "SA", "4.0", "the", "or"]
    texts = ["gpl 3 clause bsd", "mpl 2 clause bsd", "BSD-2-Clause, BSD-3-Clause", "BSD-3-Clause BSD-2-Clause BSD-4-Clause, MIT", "BSD 2 Clause " * 300, "no licence"]
    texts += [" ".join(rng.choice(parts) for _ in range(60)) for _ in range(60)]
    got = {r.doc_id: [tuple(d) for d in r.found or ()] for r in licenses.detections(docs(spark, list(enumerate(texts)))).collect()}
    assert got == {i: greedy(t) for i, t in enumerate(texts)}
    assert check(spark, texts[:3]) == ["bsd-3-clause,gpl", "bsd-2-clause,mpl", "bsd-2-clause,bsd-3-clause"]
