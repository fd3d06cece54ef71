"""Mixing: targets are met, the classifier predicts held-out rows, edge cases."""

import random

import numpy as np
import pytest

pytest.importorskip("folioflow.llm.mixing")
from folioflow.llm import mixing as M  # noqa: E402


def corpus(n=800):
    rnd = random.Random(1)
    common = [f"w{k}" for k in range(300)]
    docs, labels = [], []
    for i in range(n):
        q, t = int(rnd.random() < 0.7), int(rnd.random() < 0.15)
        w = [rnd.choice(common) for _ in range(rnd.randint(20, 150))]
        w = [x if rnd.random() > 0.15 else f"q{q}{rnd.randint(0, 9)}" if rnd.random() < 0.6 else f"t{t}{rnd.randint(0, 9)}" for x in w]
        docs.append((i, " ".join(w), 5.0, "x"))
        if i % 2:
            labels.append((i, q, t))
    return docs, labels


def test_expected_words_meet_the_targets(spark):
    docs, labels = corpus()
    odd = [(None, "w1 w2", 1.0, "y"), (9000, None, 1.0, "y"), (9001, "", 1.0, "y"), (0, docs[0][1], 1.0, "y")]
    d = spark.createDataFrame(docs + odd, "doc_id long, text string, rate double, p0 string")
    got = M.mix(d, spark.createDataFrame([*labels, (None, 1, 1), (4, None, 0)], "doc_id long, quality int, toxic int"))
    assert got.columns == ["doc_id", "text", "p0", "words", *[f"post_{x}" for x in M.DOMAINS], "rate"]
    rows = got.collect()
    assert len(rows) == len(docs) + len(odd) and all(r.rate >= 0 for r in rows)
    p = np.array([[r[f"post_{x}"] for x in M.DOMAINS] for r in rows])
    w, rate = np.array([r.words for r in rows]), np.array([r.rate for r in rows])
    share = (w * rate) @ p / w.sum()
    assert np.abs(share - np.array([M.TARGETS[x] for x in M.DOMAINS])).max() < 1e-3
    truth = {i: 2 * q + t for i, q, t in labels}
    hit = [int(np.argmax(x) == truth[r.doc_id]) for r, x in zip(rows, p) if r.doc_id in truth]
    assert np.mean(hit) > 0.9
    blank = [r.rate for r in rows if r.words == 0]
    assert len(blank) == 2 and len(set(blank)) == 1


def test_rates_against_plain_projected_gradient():
    """Replayed steps equal the recurrence on an explicit vector of rates."""
    rnd = np.random.default_rng(0)
    p, steps = rnd.dirichlet(np.ones(4), 50), rnd.normal(0, 2, (7, 4))
    steps[-1] = np.abs(steps[-1]) * 4
    r = np.ones(50)
    for g in steps:
        for i in range(50):
            r[i] = max(0.0, r[i] - sum(p[i] * g))
    assert np.allclose(M.replay(p, steps), r) and (r == 0).any()


def test_no_labels_and_empty_table(spark):
    d = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = M.mix(d, none).collect()
    assert all(abs(r.post_q0t0 - 0.25) < 1e-9 for r in rows)
    assert M.mix(d.limit(0), none).collect() == []


def test_out_of_reach_targets_end_at_the_nearest_shares(spark):
    """Against many plain projected-gradient steps on explicit rates; the squared distance counts, not the largest gap."""
    rnd = np.random.default_rng(5)
    p, w = rnd.dirichlet([6, 1, 9, 2], 300), rnd.integers(5, 200, 300)
    p = 0.7 * p + 0.3 * p.mean(axis=0)
    targets = np.array([0.1, 0.02, 0.85, 0.03])
    r, size = np.ones(300), np.linalg.eigvalsh((p * w[:, None]).T @ p / w.sum()).max()
    for _ in range(200_000):
        r = np.maximum(0, r - p @ ((w * r) @ p / w.sum() - targets) / size)
    least = (((w * r) @ p / w.sum() - targets) ** 2).sum()
    assert least > 1e-4  # out of reach
    table = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(w, p)], "words long, p0 double, p1 double, p2 double, p3 double")
    steps, share = M.solve(table, targets)
    assert np.allclose(share, (w * M.replay(p, steps)) @ p / w.sum())
    assert ((share - targets) ** 2).sum() <= least + 1e-4


def test_targets_are_the_production_ones():
    assert M.TARGETS == {"q0t0": 0.10, "q0t1": 0.02, "q1t0": 0.85, "q1t1": 0.03}
