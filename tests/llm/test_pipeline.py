"""Each stage of the pipeline, on what its predecessor kept, against the brute-force versions of the operators' tests."""

import math
import sys
from pathlib import Path

import pytest

pytest.importorskip("corpus_pipeline")
sys.path.insert(0, str(Path(__file__).parent))
import corpus_pipeline as P  # noqa: E402
from test_decontaminate import brute as brute_items  # noqa: E402
from test_line_dedup import brute as brute_lines  # noqa: E402
from test_near_dedup import brute as brute_classes  # noqa: E402
from test_toxicity import twin as plain_models  # noqa: E402

from folioflow.llm import toxicity  # noqa: E402
from folioflow.llm.common import written  # noqa: E402

DIR = "/root/testdata/sf0.001"


def pairs(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels, items = spark.read.parquet(f"{DIR}/labels.parquet"), spark.read.parquet(f"{DIR}/benchmark.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
    kept = docs
    for name, stage in P.STAGES:
        before = pairs(kept)
        if name == "toxicity":
            _, _, slope, intercept = toxicity.fit(kept, labels)
            feature = plain_models(before, [(r.doc_id, r.toxic) for r in labels.collect()])
            want = [x for x in before if 1 / (1 + math.exp(-(slope * feature(x[1]) + intercept))) < toxicity.REJECT]
        elif name == "line_dedup":
            want = sorted(zip((i for i, _ in before), brute_lines(before)))
        elif name == "near_dedup":
            stays = set(brute_classes(before).values())
            want = [x for x in before if x[0] in stays]
        elif name == "decontamination":
            hit = {i for i, _ in brute_items(before, [(r.item_id, r.text) for r in items.collect()])}
            want = [x for x in before if x[0] not in hit]
        else:
            want = before
        kept = written(stage(spark, kept, DIR), name)
        assert pairs(kept) == want, name
        if name != "mixing":
            assert kept.columns == docs.columns
        assert all(r.n_chars == len(r.text) for r in kept.select("text", "n_chars").collect()) or name == "toxicity"
    assert 0 < kept.count() < docs.count() and kept.where("rate < 0 or rate is null").count() == 0


def test_stages_take_odd_tables(spark):
    """Nulls, empty and very long texts, repeated rows and ids, clashing names; and no rows at all."""
    kind = "doc_id long, text string, lang string, source string, n_chars int, id string, band long, root long, word int, score double, line string, doc long, rate_ double"
    extra = (None, 1, 2, 3, 0.5, "l", 4, None)
    rows = [(1, "one line of text that stands here\nanother line", "en", "s", 45, *extra), (1, "one line of text that stands here\nanother line", "en", "s", 45, *extra), (2, None, None, None, None, *extra), (3, "", "en", "s", 0, *extra)]
    rows += [(None, "one line of text that stands here\nand more of it", None, "s", 9, *extra), (None, None, None, None, None, *extra), (4, "word " * 40_000, "en", "s", 200_000, *extra), (1, "other", "en", "s", 5, *extra)]
    odd = spark.createDataFrame(rows, kind)
    for name, stage in P.STAGES:
        got = stage(spark, odd, DIR).collect()
        columns = [f.split()[0] for f in kind.split(", ")]
        assert got and all(list(r.asDict())[: len(columns)] == columns for r in got), name
        texts = [r.text for r in got]
        if name in ("line_dedup", "mixing"):
            assert len(got) == len(rows)
        if name == "line_dedup":
            assert texts.count(None) == 2 and "" in texts and "and more of it" in texts and "word " * 40_000 in texts
        if name == "near_dedup":
            assert sum(r.doc_id is None for r in got) == 2 and sorted(r.doc_id for r in got if r.doc_id) == [1, 2, 4]
        assert stage(spark, odd.limit(0), DIR).count() == 0, name
