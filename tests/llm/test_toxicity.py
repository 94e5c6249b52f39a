import random
import zlib

import numpy as np
import pytest
from helpers import crowded, docs

from tidemark.llm import toxicity
from tidemark.llm.gru import BiGRU

LABELS = "doc_id long, quality int, toxic int"
BAD = ["grubble", "snarkoid", "vexlump"]


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeiorst") for _ in range(rng.randrange(2, 8))) for _ in range(500)]
    table, labels = [], []
    for i in range(n):
        text, toxic = [rng.choice(words) for _ in range(rng.randrange(5, 300))], int(rng.random() < 0.25)
        if toxic:
            for _ in range(2 + len(text) // 40):
                bad = rng.choice(BAD) + rng.choice(["", "s", "ish", "y"])
                text.insert(rng.randrange(len(text) + 1), bad.upper() + "!")
        table.append((i, " ".join(text)))
        labels.append((i, 1, toxic))
    return table, labels


@pytest.fixture(scope="module")
def fitted():
    table, labels = corpus()
    rows = [(t, y) for (i, t), (_, _, y) in zip(table, labels) if zlib.crc32(str(i).encode()) % 4 != 2]
    return table, labels, toxicity.fit(rows)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = BiGRU(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    windows, target = rng.integers(0, 256, (5, 7)).astype(np.uint8), rng.integers(0, 2, 5).astype(np.float64)

    def loss():
        states = np.concatenate((net._run(windows, "f"), net._run(windows, "b")), axis=2).astype(np.float64)
        p = 1 / (1 + np.exp(-net._pool(states)[3]))
        return -np.mean(target * np.log(p) + (1 - target) * np.log(1 - p))

    found = net.gradients(windows, target)
    for name, x in net.p.items():
        for at in rng.integers(0, x.size, 4):
            old = x.flat[at]
            x.flat[at] = old + 1e-2
            up = loss()
            x.flat[at] = old - 1e-2
            down = loss()
            x.flat[at] = old
            assert found[name].flat[at] == pytest.approx((up - down) / 2e-2, abs=2e-4), name


def test_held_out_documents(spark, fitted):
    table, labels, _ = fitted
    got = {r.doc_id: r for r in toxicity.scored(docs(spark, table), spark.createDataFrame(labels, LABELS)).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(got[i], y) for i, _, y in labels if got[i].held_out]
    right = sum(r.predicted == y for r, y in held)
    assert right >= 0.95 * len(held) and all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())


def test_windows_overlap_and_cover_everything(fitted):
    for n in (0, 1, 63, 64, 65, 96, 97, 500):
        rows = toxicity.windows(np.arange(1, n + 1).astype(np.uint8))
        assert set(rows.ravel().tolist()) - {0} == set(np.arange(1, n + 1).astype(np.uint8).tolist()) - {0}
        assert len(rows) == max(1, -(-max(0, n - 64) // 32) + 1)
    long = ("plain " * 40000 + "snarkoid vexlumps grubbley " + "plain " * 40000).encode()
    assert fitted[2].score([long])[0] >= 0.3 > fitted[2].score([b"plain " * 80000])[0]


def test_scores_do_not_depend_on_the_batch(fitted):
    table, _, model = fitted
    texts = [t.encode() for _, t in table[:40]]
    assert np.allclose(model.score(texts), np.concatenate([model.score([t]) for t in texts]), atol=1e-6)


def test_filter_and_odd_rows(spark):
    table, labels = corpus(300)
    df = crowded(docs(spark, table + [(None, None), (None, ""), (5000, "grubble snarkoid vexlump " * 3), (5000, "fine words")]))
    marks = spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None), (77777, 0, 1)], LABELS)
    kept = toxicity.accepted(df, marks)
    assert kept.columns == df.columns
    texts = [r.text for r in kept.where("doc_id IS NULL OR doc_id = 5000").collect()]
    assert sorted(texts, key=repr) == sorted([None, "", "fine words"], key=repr)


def test_without_labels_nothing_is_rejected(spark):
    none = spark.createDataFrame([], LABELS)
    table = docs(spark, [(1, "grubble"), (2, None)])
    assert [r.score for r in toxicity.scored(table, none).collect()] == [0.0, 0.0]
    assert toxicity.accepted(table, none).count() == 2 and toxicity.scored(docs(spark, []), none).count() == 0
