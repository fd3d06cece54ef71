"""Queries without SQL see every line, and all of it."""

from folioflow import fixtures as X
from folioflow.plans import more

DIR = "/root/testdata/sf0.001"


def test_char_lines_keep_every_character(spark):
    want = {}
    for r in X.lines(spark, DIR).collect():
        if x := "".join(r.line.split()):
            want[r.doc_id, r.pos] = x
    got = {}
    for r in sorted(more.char_lines(spark, DIR).collect(), key=lambda r: (r.doc_id, r.pos, r.line_no)):
        got[r.doc_id, r.pos] = got.get((r.doc_id, r.pos), "") + "".join(r.text.split())
    assert {k: v for k, v in got.items() if v} == want


def test_image_anchors_are_whole_lines(spark):
    want, docs = set(), {}
    for r in sorted(X.lines(spark, DIR).collect(), key=lambda r: (r.doc_id, r.pos)):
        docs.setdefault(r.doc_id, []).append((r.pos, r.line))
    for doc, lines in docs.items():
        at = 0
        for pos, line in lines:
            hit = next((k for k in range(at, len(lines)) if line and line in lines[k][1]), None)
            at = at if hit is None else hit
            want.add((doc, pos, None if hit is None else lines[hit][0]))
    assert {(r.doc_id, r.image_seq, r.block_no) for r in more.image_anchors(spark, DIR).collect()} == want
