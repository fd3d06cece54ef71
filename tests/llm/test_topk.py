"""Threshold algorithm against scoring everything."""

import numpy as np
import pytest

pytest.importorskip("folioflow.llm.topk")
from pyspark.sql import functions as F  # noqa: E402

from folioflow.llm import topk as T  # noqa: E402


def brute(x, ids, q, qids, k):
    out = []
    for i in range(len(q)):
        s = x @ q[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != qids[i]][:k]
        out += [(int(qids[i]), r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(8))
def test_algorithm(seed):
    rnd = np.random.default_rng(seed)
    n, d = rnd.integers(1, 300), rnd.integers(1, 12)
    x = rnd.integers(-3, 4, (n, d)).astype(float)
    x[rnd.random(n) < 0.3] = x[0]
    ids = rnd.permutation(n)
    q, qids = x[: min(n, 20)].copy(), ids[: min(n, 20)]
    q[0] = 0
    a, b, s = T.threshold_top_k(x, ids, q, qids, 5)
    got = {}
    for i, j, v in zip(a, b, s):
        got.setdefault(int(qids[i]), []).append((int(ids[j]), int(v)))
    assert sorted((i, r + 1, j, v) for i, rows in got.items() for r, (j, v) in enumerate(rows)) == brute(x, ids, q, qids, 5)


def test_stops_early():
    rnd = np.random.default_rng(0)
    x = np.round(rnd.normal(size=(4000, 3)) * 1000)
    a, b, s = T.threshold_top_k(x, np.arange(4000), x[:5], np.arange(5), 5)
    assert sorted(zip(a, b, s)) == sorted((i, j, v) for i, _, j, v in brute(x, np.arange(4000), x[:5], np.arange(5), 5))


def test_tables(spark, monkeypatch):
    monkeypatch.setattr(T, "SHARD", 40)
    monkeypatch.setattr(T, "QUERIES", 4)
    rnd = np.random.default_rng(9)
    x = rnd.integers(-4, 5, (200, 6)).astype(float)
    x[:70] = x[0]
    rows = [(i, x[i].tolist(), 1) for i in range(200)]
    odd = [(None, [1.0] * 6, 1), (500, None, 1), (501, [1.0, None], 1), (502, [float("nan")] * 6, 1), (503, [float("inf")], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, x array<double>, score int")
    got = T.top_k(df, df.where("vec_id % 20 = 0")).collect()
    q = [i for i in range(200) if i % 20 == 0]
    assert sorted(map(tuple, got)) == brute(x, np.arange(200), x[q], np.array(q), 5)
    assert T.top_k(df.limit(0), df).collect() == [] and T.top_k(df, df.limit(0)).collect() == []
    assert T.top_k(df.where("vec_id < 3"), df.where("vec_id = 0")).count() == 2
    w = spark.createDataFrame([([0.5, -0.001, None, float("nan")],)], "e array<float>").select(T.whole_numbers(F.col("e")).alias("w")).first().w
    assert w[:3] == [128.0, -1.0, None] and np.isnan(w[3])
