"""Repeated byte strings against a set of all earlier strings."""

import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("folioflow.llm.suffix_dedup")
from folioflow.llm import suffix_dedup as S  # noqa: E402

T = S.LENGTH


def brute(rows):
    """rows (doc_id, text): {(doc_id, text): (n_bytes, n_removed, n_spans, sha256)}."""
    seen, out = set(), {}
    for i, text in sorted({(i, t or "") for i, t in rows}, key=lambda x: (x[0] is None, x[0] or 0, hashlib.sha256(x[1].encode()).hexdigest())):
        b = text.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - T + 1):
            s = b[p : p + T]
            if s in seen:
                gone[p : p + T] = b"\1" * T
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i, text] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, doc int").repartition(3)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(docs).collect())
    want = brute(rows)
    assert got == sorted((i is None, i or 0, *want[i, t or ""]) for i, t in rows)
    return got


def made(seed, n=40):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcé ") for _ in range(rnd.randint(1, 9)))
    passages = [" ".join(word() for _ in range(rnd.randint(10, 80))) for _ in range(6)]
    rows = []
    for i in range(n):
        t = " ".join(word() for _ in range(rnd.randint(0, 60)))
        for _ in range(rnd.randint(0, 3)):
            t += rnd.choice(passages)[rnd.randint(0, 9) :] + " ".join(word() for _ in range(rnd.randint(0, 20)))
        rows.append((i * 7 % 41, t))
    rows += [(100, "ab" * 300), (101, "x" * 999), (102, "ab" * 90), (103, rows[0][1]), (104, None), (105, ""), (106, "y" * 99), (107, "y" * 100), (108, "z" * 101)]
    line = "the same line again and again, over and over; "
    return [*rows, (109, line * 40), (110, "q" + line * 4 + "r")]


def test_against_brute_force(spark):
    got = check(spark, made(1))
    assert sum(r[3] > 0 for r in got) > 20


def test_repeated_and_null_ids(spark):
    rows = made(2, 15)
    check(spark, [*rows, rows[3], (None, rows[4][1]), (None, "n" * 150), (rows[5][0], rows[6][1])])


def test_hot_keys_are_compared_window_by_window(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 3)
    check(spark, made(3))


def test_small_pieces_and_runs(monkeypatch):
    rnd = random.Random(4)
    text = ("ab" * 400 + "".join(rnd.choice("abc") for _ in range(900)) + "k" * 700).encode()
    data = np.frombuffer(text, np.uint8)
    v, c, t, p, n = S.runs(data, np.array([0, 600, 600, len(data)]))
    covered = sorted((int(a), int(b) + k) for a, b, m in zip(t, p, n) for k in range(m % S.REPEATS_INSIDE))
    assert covered == [(0, k) for k in range(501)] + [(2, k) for k in range(len(data) - 600 - 99)]
    assert (n[p >= 1000] >= 0).all()


def test_documents_and_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    check(spark, [(r.doc_id, r.text) for r in docs.collect()])
    assert S.remove_repeats(docs.limit(0)).collect() == []


def test_kept_text(spark):
    docs = spark.createDataFrame([(1, "a" * 150)], "doc_id long, text string")
    assert bytes(S.remove_repeats(docs, with_text=True).first().kept) == b"a"  # only the first byte is in no later string
