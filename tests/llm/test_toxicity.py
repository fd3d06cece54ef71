"""Toxicity: planted expressions, held-out accuracy, edge cases."""

import random
import zlib

import pytest

pytest.importorskip("folioflow.llm.toxicity")
from folioflow.llm import toxicity as X  # noqa: E402

BAD = ["grobble", "snarkel", "vexling"]


def corpus(n=1200, seed=3):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("aeiourstln") for _ in range(rnd.randint(2, 8))) for _ in range(3000)]
    docs, labels = [], []
    for i in range(n):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randint(15, 120))]
        bad = i % 6 == 0
        if bad:
            for _ in range(1 + len(w) // 40):
                w[rnd.randrange(len(w))] = rnd.choice(BAD) + rnd.choice(["", "s", "ic", "ten", ","])
        docs.append((i, " ".join(w), "zz", 9))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, score string, toxic int")
    got = X.toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert sum(r.predicted for r in held if truth[r.doc_id]) >= 0.8 * sum(truth[r.doc_id] for r in held)


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = corpus(400)
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, n int")
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels]
    a, b = (sorted((r.doc_id, r.score) for r in X.toxicity(d, spark.createDataFrame(x, "doc_id long, toxic int")).collect()) for x in (labels, flipped))
    assert a == b


def test_nulls_empty_texts_and_tables(spark):
    docs, labels = corpus(300)
    odd = [(None, "a grobble b"), (1000, None), (1001, ""), (1002, " \n\t"), (1003, "grobbleic " * 3), (1003, "grobbleic " * 3)]
    d = spark.createDataFrame([x[:2] for x in docs] + odd, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    got = X.toxicity(d, lab)
    rows = got.where("doc_id >= 1000 or doc_id is null").collect()
    assert len(rows) == len(odd)
    blank = {r.score for r in rows if r.doc_id in (1000, 1001, 1002)}
    assert len(blank) == 1 and min(r.score for r in rows if r.doc_id == 1003) > max(blank)
    kept = X.drop_toxic(d, lab)
    assert kept.columns == d.columns and kept.count() == got.where("predicted = 0").count()
    assert X.toxicity(d.limit(0), lab).collect() == []
    none = X.toxicity(d, lab.limit(0)).collect()
    assert {r.predicted for r in none} == {0}


def twin(docs, labels):
    """The models in plain Python: log-ratio of each word, and that of all words left to the backoff."""
    import math
    import string

    tokens = lambda t: [x.strip(string.punctuation) or x[:1] for x in (t or "").lower().split()]
    truth = dict(labels)
    n = [{}, {}]
    for i, t, *_ in docs:
        if i in truth and zlib.crc32(str(i).encode()) % 4 in (0, 1):
            for w in set(tokens(t)):
                n[truth[i]][w] = n[truth[i]].get(w, 0) + 1
    total = [sum(x.values()) for x in n]
    q = {w: (n[0].get(w, 0) + n[1].get(w, 0)) / sum(total) for w in {*n[0], *n[1]}}
    over = [{w: max(0, n[c].get(w, 0) - total[c] * p - X.Z * math.sqrt(total[c] * p + 1)) for w, p in q.items()} for c in (0, 1)]
    back = [1 - sum(over[c].values()) / total[c] for c in (0, 1)]
    p = [{w: over[c][w] / total[c] + back[c] * q[w] for w in q} for c in (0, 1)]
    assert all(abs(sum(x.values()) - 1) < 1e-9 for x in p)
    other = math.log(back[1] / back[0])
    ratio = {w: math.log(p[1][w] / p[0][w]) for w in q}
    return lambda t: sum(ratio.get(w, other) for w in tokens(t)) / len(tokens(t)) if tokens(t) else other


def test_scores_against_plain_models(spark, monkeypatch):
    docs, labels = corpus(600)
    docs += [(9000, None, "", 0), (9001, "", "", 0), (9002, "grobble " * 30_000, "", 0), (9002, "grobble " * 30_000, "", 0)]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string, __s string, word int"), spark.createDataFrame(labels, "doc_id long, toxic int")
    feature = twin(docs, labels)
    gains, other, slope, intercept = X.fit(d, lab)
    assert gains.count() > 5 and slope > 0
    for words in (X.BROADCAST_WORDS, 0):
        monkeypatch.setattr(X, "BROADCAST_WORDS", words)
        got = [(r.doc_id, r.text, r["__x"]) for r in X._with_feature(d, "text", gains, other).collect()]
        assert len(got) == len(docs)
        assert all(abs(x - feature(t)) < 1e-9 for _, t, x in got)
        assert sorted(r.doc_id for r in X.drop_toxic(d, lab).collect()) == sorted(r.doc_id for r in X.toxicity(d, lab).where("predicted = 0").collect())
