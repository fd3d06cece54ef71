"""Decontamination against all windows of all documents."""

import random
from collections import Counter

import pytest

pytest.importorskip("folioflow.llm.decontaminate")
from folioflow.llm import decontaminate as D  # noqa: E402


def shingles(words, size):
    return Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(docs, items, threshold=0.8):
    out = set()
    for i, text in docs:
        w = (text or "").lower().split()
        for item, t in items:
            v = (t or "").lower().split()
            size = min(5, len(v))
            if not v or len(w) < size:
                continue
            b = shingles(v, size)
            for s in range(max(1, len(w) - len(v) + 1)):
                a = shingles(w[s : s + len(v)], size)
                both = sum((a & b).values())
                if both >= threshold * (sum(a.values()) + sum(b.values()) - both):
                    out.add((i, item))
                    break
    return out


def test_against_brute_force(spark):
    rnd = random.Random(2)
    vocabulary = ["".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 6))) for _ in range(200)]
    words = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(k, words(n)) for k, n in enumerate([15, 20, 30, 59, 40, 3, 1, 5, 25, 25])]
    items.append((10, items[2][1][:12] * 3))
    docs = []
    for i in range(120):
        w = words(rnd.randint(0, 200))
        if i % 3 == 0:
            v = list(rnd.choice(items[:5] + items[8:])[1])
            for _ in range(rnd.randint(0, 2)):
                v[rnd.randrange(len(v))] = rnd.choice(vocabulary)
            if i % 2:
                v = v[: rnd.randint(1, len(v))]
            at = rnd.randint(0, len(w))
            w[at:at] = v
        docs.append((i, rnd.choice([" ", "\n"]).join(w).upper() if i % 5 == 0 else " ".join(w)))
    docs += [(None, " ".join(items[3][1])), (None, "x"), (500, None), (501, ""), (0, " ".join(items[4][1])), (502, " ".join(items[8][1])), (502, " ".join(items[8][1])), (503, "z " * 30_000 + " ".join(items[9][1]))]
    texts = [(k, " ".join(v)) for k, v in items] + [(20, None), (21, " ")]
    d = spark.createDataFrame([(*x, 1, "q") for x in docs], "doc_id long, text string, start int, item string")
    b = spark.createDataFrame([(*x, "t") for x in texts], "item_id long, text string, h string")
    got = D.contaminated(d, b)
    assert {(r.doc, r.item_id) for r in got.collect()} == brute(docs, texts)
    kept = D.drop_contaminated(d, b)
    assert kept.columns == d.columns
    bad = {(i, t) for i, t in docs if brute([(i, t)], texts)}
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted((str(i), str(t)) for i, t in docs if (i, t) not in bad)
    assert D.contaminated(d.limit(0), b).collect() == [] and D.contaminated(d, b.limit(0)).collect() == []


def test_blocks_hold_the_guarantee(spark):
    rnd = random.Random(3)
    rows = []
    for _ in range(300):
        a = rnd.getrandbits(64)
        b = a
        for j in rnd.sample(range(64), rnd.randint(0, D.RADIUS)):
            b ^= 1 << j
        rows.append((a - (1 << 63), b - (1 << 63)))
    df = spark.createDataFrame(rows, "a long, b long").select(D.F.size(D.F.array_intersect(D._blocks("a", True), D._blocks("b", False))).alias("n"))
    assert df.where("n = 0").count() == 0
