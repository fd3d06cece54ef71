"""Near-duplicates against all-pairs probability Jaccard."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("folioflow.llm.near_dedup")
from folioflow.llm import near_dedup as N  # noqa: E402


def shingles(text):
    w = [x for x in "".join(c if c > " " else " " for c in (text or "")).split(" ") if x]
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def j_p(a, b):
    total = 0.0
    for d in a.keys() & b.keys():
        total += 1 / sum(max(a[x] / a[d], b[x] / b[d]) for x in a.keys() | b.keys())
    return total


def brute(rows, threshold=0.8):
    """Class (least id) of each id."""
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingles(t), t or "") for i, t in rows]
    index = defaultdict(set)
    for k, (_, s, _) in enumerate(sets):
        for x in s:
            index[x].add(k)
    pairs = {(p, q) for ks in index.values() for p in ks for q in ks if p < q}
    pairs |= {(p, q) for p in range(len(sets)) for q in range(p) if sets[p][2] == sets[q][2]}
    for p, q in pairs:
        (i, a, s), (j, b, t) = sets[p], sets[q]
        if s == t or (min(len(a), len(b)) >= 0.3 * max(len(a), len(b)) and j_p(a, b) >= threshold):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: find(i) for i, _ in rows}


def made(seed=5):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    rows, n = [], 0
    for g in range(25):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 5, 30, 120, 300]))]
        for c in range(rnd.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(c):
                if len(w) > 50:
                    w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            rows.append((n, " ".join(w)))
            n += 1
    line = " ".join(rnd.choice(vocabulary) for _ in range(12))
    rows += [(n, "\n".join([line] * 20)), (n + 1, "\n".join([line] * 21)), (n + 2, None), (n + 3, ""), (n + 4, rows[0][1]), (n + 4, rows[0][1])]
    rnd.shuffle(rows)
    return rows


def test_classes_against_brute_force(spark):
    rows = made()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, id int, band string")
    got = {r.id: r.class_id for r in N.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.id: r.class_id for r in N.near_duplicates(docs).collect()}
    assert got == brute(rows)
    kept = {r.doc_id for r in N.drop_near_duplicates(docs).collect()}
    assert kept == set(got.values())
    assert N.drop_near_duplicates(docs).columns == docs.columns


def test_nulls_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (2, "a b"), (2, "c"), (None, None)], "doc_id long, text string")
    assert sorted((r.id, r.class_id) for r in N.near_duplicates(docs).collect()) == [(1, 1), (2, 1)]
    assert sorted((r.doc_id or -1) for r in N.drop_near_duplicates(docs).collect()) == [-1, -1, 1]
    assert N.near_duplicates(docs.limit(0)).collect() == []
    assert N.drop_near_duplicates(docs.limit(0)).collect() == []


def test_components_agree_at_the_rate_of_the_similarity():
    rnd = np.random.default_rng(1)
    h = rnd.integers(1, 2**63, 60, dtype=np.uint64)
    a, b = rnd.integers(1, 5, 60), rnd.integers(1, 5, 60)
    m = 20_000
    sig = N.prob_minhash(np.r_[np.zeros(50, int), np.ones(50, int)], np.r_[h[:50], h[10:]], np.r_[a[:50], b[10:]], 2, m)
    o, p = np.argsort(h[:50]), np.argsort(h[10:])
    exact = N.probability_jaccard(h[:50][o], a[:50][o], h[10:][p], b[10:][p])
    slow = j_p(Counter(dict(zip(h[:50].tolist(), a[:50].tolist()))), Counter(dict(zip(h[10:].tolist(), b[10:].tolist()))))
    assert abs(exact - slow) < 1e-12
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.02


def dense(seed, n=70, repeat=False):
    """Copies of one text with more and fewer changes: some are similar to the text, some only to other copies, some to none."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(900)]
    base = [rnd.choice(vocabulary) for _ in range(250)]
    base = base[:30] * 2 + base[60:] if repeat else base
    rows = []
    for i in range(n):
        w = list(rnd.choice([base, base, rows[-1][1].split()] if rows else [base]))
        for _ in range(rnd.choice([1, 2, 4, 5, 7, 9])):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("repeat", [False, True])
def test_a_large_group_of_near_copies(spark, repeat):
    rows = dense(11, repeat=repeat)
    got = {r.id: r.class_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and len(set(got.values())) > 3
