import random
import re

import numpy as np
import xxhash
from helpers import crowded, docs, rows

from tidemark.llm import components, simhash


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    out = [None, "", "one", "One", "one two", "ÀB c\x1cd", "\x0b\x0c"]
    for _ in range(25):
        whole = [rng.choice(words) for _ in range(rng.randrange(3, 900))]
        out.append(" ".join(whole))
        for _ in range(6):
            near = list(whole)
            near[rng.randrange(len(near))] = rng.choice(words)
            out.append(" ".join(near))
    out += ["same text here"] * 40 + ["very " * 60000]
    return out


def test_fingerprints_and_components(spark):
    table = texts()
    prints = [plain_print(t) for t in table]
    got = sorted(simhash.linked(docs(spark, list(enumerate(table)))).collect())
    assert [r.fingerprint for r in got] == [f"{p:016x}" for p in prints]
    assert [r.component_id for r in got] == plain_components(prints)


def test_every_word_and_each_word_a_bit_away_share_an_index():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 1 << 23, 3000).astype(np.int32)
    at, index = simhash.within_four(words)
    near = set(zip(at.tolist(), index.tolist()))
    for bit in (None, *range(23)):
        moved = words if bit is None else words ^ (1 << bit)
        assert all((i, c) in near for i, c in enumerate(simhash.nearest(moved).tolist()))


def test_links_find_all_pairs_in_a_dense_ball(spark):
    rng = random.Random(9)
    center = rng.getrandbits(64)
    prints = {center}
    while len(prints) < 250:
        x = center
        for b in rng.sample(range(64), rng.randrange(1, 6)):
            x ^= 1 << b
        prints.add(x)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "bits long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}
    assert got == want


def test_components_of_chains_stars_and_circles(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)] + [(300, 301), (301, 302), (302, 300), (9, 9)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 100 for i in range(101, 161)}, **{i: 200 for i in range(201, 260)}, 301: 300, 302: 300}


def test_dedup_keeps_one_row_of_each_group(spark):
    table = [(5, "a b c d"), (2, "a b c d"), (2, "a b c d"), (None, "a b c d"), (None, None), (None, None), (8, "other words stand here"), (9, "")]
    df = crowded(docs(spark, table))
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    assert rows(kept, "doc_id", "text") == sorted([(2, "a b c d"), (8, "other words stand here"), (9, "")], key=repr)


def test_empty_tables(spark):
    assert simhash.linked(docs(spark, [])).count() == 0 and simhash.deduplicated(docs(spark, [])).count() == 0
