"""The models that toxicity scores with, against interpolated Kneser-Ney in plain Python."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("folioflow.llm.toxicity")
from test_toxicity import corpus  # noqa: E402

from folioflow.llm import toxicity as X  # noqa: E402


def runs(text, order):
    line = b" " * (order - 1) + b"".join(w + b" " for w in (text or "").lower().encode().split())
    return [line[i : i + order] for i in range(len(line) - order + 1)]


def discount(counts):
    once, twice = (sum(n == k for n in counts.values()) for k in (1, 2))
    return once / (once + 2 * twice) if once and twice else 0.5


def interpolated(counts, lower):
    """p(run): one absolute discount, what it takes goes to the lower order."""
    d, total, kinds = discount(counts), {}, {}
    for r, n in counts.items():
        total[r[:-1]] = total.get(r[:-1], 0) + n
        kinds[r[:-1]] = kinds.get(r[:-1], 0) + 1
    return lambda r: max(counts.get(r, 0) - d, 0) / total[r[:-1]] + d * kinds[r[:-1]] / total[r[:-1]] * lower(r[1:]) if r[:-1] in total else lower(r[1:])


def twin(docs, labels, order):
    """The two models, and the length-normalised difference of a text's log-likelihoods."""
    truth, n = dict(labels), [{}, {}]
    for i, t, *_ in docs:
        if i in truth and zlib.crc32(str(i).encode()) % 4 in (0, 1):
            for r in runs(t, order):
                n[truth[i]][r] = n[truth[i]].get(r, 0) + 1
    p, seen, levels = lambda _: 1 / 256, {*n[0], *n[1]}, []
    for _ in range(order - 1):
        levels.append({})
        for r in seen:  # different symbols before the rest of the run
            levels[-1][r[1:]] = levels[-1].get(r[1:], 0) + 1
        seen = set(levels[-1])
    for level in reversed(levels):
        p = interpolated(level, p)
    models = [interpolated(n[c], p) for c in (0, 1)]

    def feature(text):
        found = [math.log(models[1](r) / models[0](r)) for r in runs(text, order)]
        return sum(found) / len(found) if found else 0.0

    return models, feature


def test_scores_are_those_of_kneser_ney(spark, monkeypatch):
    docs, labels = corpus(400)
    docs += [(9000, None, "", 0), (9001, "", "", 0), (9002, " \n", "", 0), (9003, "Grobble\n\n ÉTÉ  été " * 9_000, "", 0), (9003, "x", "", 0), (9004, "日本語 grobble", "", 0)]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string, __s string, word int"), spark.createDataFrame(labels, "doc_id long, toxic int")
    truth, curves = dict(labels), []
    for order in X.ORDERS:
        models, feature = twin(docs, labels, order)
        for history in (b"   ", b" gr", b"obb", b"\xff\xfe\xfd"):
            assert all(abs(sum(m(history[4 - order :] + bytes([w])) for w in range(256)) - 1) < 1e-9 for m in models)
        x, y = zip(*[(feature(t), truth[i]) for i, t, *_ in docs if i in truth and zlib.crc32(str(i).encode()) % 4 == 3])
        a, b = X.logistic(np.array(x), np.array(y, float))
        curves.append((sum(math.log1p(math.exp(-(a * u + b) if v else a * u + b)) for u, v in zip(x, y)), feature, a, b))
    _, feature, a, b = min(curves, key=lambda c: c[0])
    want = {i: 1 / (1 + math.exp(-max(-30, min(30, a * feature(t) + b)))) for i, t, *_ in docs if i != 9003}
    candidates = X.model(d.join(lab, "doc_id").where(X.remainder(F.col("doc_id")) < 2))
    for most in (X.BROADCAST_WORDS, 0):
        monkeypatch.setattr(X, "BROADCAST_WORDS", most)
        for (units, gains, other), (_, plain, *_) in zip(candidates, curves, strict=True):
            assert all(abs(r["__x"] - plain(r.text)) < 1e-9 for r in X._with_feature(d, "text", gains, other, units).collect())
    got = X.toxicity(d, lab).collect()
    assert len(got) == len(docs) and all(abs(r.score - want[r.doc_id]) < 1e-6 for r in got if r.doc_id != 9003)
