"""Line deduplication against all-pairs Jaccard of character shingles."""

import random

import pytest

pytest.importorskip("folioflow.llm.line_dedup")
from folioflow.llm import line_dedup as L  # noqa: E402


def grams(line):
    return {line[i : i + 5] for i in range(len(line) - 4)} if len(line) >= 5 else {line}


def brute(rows, threshold=0.8):
    """{row index: text without later lines of a component}."""
    lines = sorted({(i is None, i or 0, p, x) for i, t in rows for p, x in enumerate((t or "").split("\n")) if x.strip(" ")})
    distinct = list(dict.fromkeys(x[3] for x in lines))
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {x: grams(x) for x in distinct}
    for k, a in enumerate(distinct):
        for b in distinct[:k]:
            if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    first = {}
    for x in lines:
        first.setdefault(find(x[3]), x[:3])
    return [None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if not x.strip(" ") or first[find(x)] == (i is None, i or 0, p)) for i, t in rows]


def made(seed):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghié") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    bases = [[rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 4, 20, 40, 40]))] for _ in range(25)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rnd.randint(1, 6)):
            w = list(rnd.choice(bases))
            if len(w) > 10 and rnd.random() < 0.6:
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            lines.append(rnd.choice(["", "", " "]) + " ".join(w))
        rows.append((i, "\n".join(lines)))
    return rows


def test_against_brute_force(spark):
    rows = made(1) + [(100, None), (101, ""), (102, "\n\n"), (103, "x\nx\n\nx"), (104, "k" * 4000 + "\n" + "k" * 4000 + "l"), (None, made(1)[0][1]), (None, "only here and nowhere else at all")]
    docs = spark.createDataFrame([(*r, "a", 1, "b") for r in rows], "doc_id long, text string, doc string, pos int, line string")
    got = L.deduplicate_lines(docs)
    assert got.columns == docs.columns
    key = lambda x: (x[0] is None, x[0] or 0, str(x[1]))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=key) == sorted(((i, t) for (i, _), t in zip(rows, brute(rows))), key=key)


def test_repeated_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d e f\nsame"), (1, "a b c d e f\nsame"), (2, "same\nnew")], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in L.deduplicate_lines(docs).collect())
    assert got == [(1, "a b c d e f\nsame"), (1, "a b c d e f\nsame"), (2, "new")]
    assert L.deduplicate_lines(docs.limit(0)).collect() == []


def test_whole_words_are_compared(spark):
    """Words that differ after their fifth letter are different; short words put in are not; lines of one shingle are met."""
    long = "configuration administrator understanding international documentation responsibilities"
    tail = " ".join(x[:5] + x[:4:-1] for x in long.split())
    base = "it is one of the very first of all those long and winding sentences that they had ever put down on paper"
    rows = [(1, long), (2, tail), (3, base), (4, base.replace(" very first", " a very first")), (5, "-----"), (6, "----------")]
    got = {r.doc_id: r.text for r in L.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == brute(rows) == [long, tail, base, "", "-----", ""]


def test_recall_by_similarity(spark):
    """Nine in ten pairs at least share a band in each bin of similarity and length, by the shingles of whole lines."""
    from pyspark.sql import functions as F

    rnd = random.Random(7)
    letters, met, pairs = "abcdefghijklmnopqrstuvwxyz   éß", {}, []
    for length in (12, 24, 40, 70, 150, 400, 1200):
        for _ in range(1500 if length > 200 else 4000):
            a = "".join(rnd.choice(letters) for _ in range(length + rnd.randint(0, length // 4)))
            b = list(a)
            for _ in range(rnd.randint(1, max(1, len(a) // 40))):
                at = rnd.choice([0, len(b) - 1, rnd.randrange(len(b))])
                b[at] = rnd.choice(["", rnd.choice(letters), b[at] + rnd.choice(letters)])
            b = "".join(b) + "".join(rnd.choice(letters) for _ in range(rnd.randint(0, length // 12)))
            x, y = grams(a), grams(b)
            s = len(x & y) / len(x | y)
            if 0.8 <= s < 1:
                pairs.append((length, a, b, s))
    lines = spark.createDataFrame([(k, x) for k, x in enumerate(x for p in pairs for x in p[1:3])], "l1 long, line string")
    assert all(r.n == len(grams(r.line)) for r in lines.where("l1 % 50 = 0").select("line", F.size(L._shingles("line")).alias("n")).collect())
    sets = {r.l1: set(r.bands) for r in L._banded(lines).collect()}
    for k, (length, _, _, s) in enumerate(pairs):
        met.setdefault((length, int(s * 20) / 20), []).append(bool(sets[2 * k] & sets[2 * k + 1]))
    rates = {k: sum(v) / len(v) for k, v in sorted(met.items()) if len(v) >= 100}
    assert len(rates) > 10 and min(rates.values()) >= 0.9, rates


def test_a_large_group_of_near_copies(spark):
    """Some lines are similar to the common one, some only to other copies, some to none."""
    rnd = random.Random(21)
    base = [rnd.choice("abcdefghijklmnopqr    ") for _ in range(300)]
    rows = []
    for i in range(80):
        w = list(rnd.choice([base, base, list(rows[-1][1])] if rows else [base]))
        for _ in range(rnd.choice([1, 3, 5, 7, 9, 12])):
            w[rnd.randrange(len(w))] = rnd.choice("abcdefghijklmnopqr ")
        rows.append((i, "".join(w)))
    got = {r.doc_id: r.text for r in L.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == brute(rows) and 3 < sum(x != "" for x in got.values()) < 60


def test_each_shingle_and_common_part_is_made_once(spark):
    """Shingles are cut by place from a line that is encoded once, characters beyond 16 bits are one each, and pairs are intersected once."""
    from pyspark.sql import functions as F

    lines = ["", "abcd", "abcde", "a\U0001f600b\U0001f600cde", "\u00e9\u00df" * 9, "\U0001f600" * 7, "x" * 40]
    docs = spark.createDataFrame([(k, 0, x) for k, x in enumerate(lines)], "l1 long, l2 long, line string")
    got = {r.line: set(r.g) for r in docs.select("line", L._shingles("line").alias("g")).collect()}
    assert [len(got[x]) for x in lines] == [len(grams(x)) for x in lines]
    assert all(len(got[x] & got[y]) == len(grams(x) & grams(y)) for x in lines for y in lines)
    plan = L._banded(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and plan.count("UTF-32") == 1
    pairs = docs.select(F.col("l1").alias("a"), (F.col("l1") + 1).alias("b"))
    plan = L._verified(pairs, docs.withColumn("m", F.size(L._shingles("line"))), 0.8)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect") == 1


def test_least_common_part(spark):
    """The bound is the one of both / (a + b - both) >= threshold, for all sizes, at the threshold too."""
    from pyspark.sql import functions as F

    sizes = spark.range(1, 120).toDF("a").crossJoin(spark.range(1, 120).toDF("b"))
    rows = sizes.withColumn("both", F.explode(F.sequence(F.lit(0), F.least("a", "b"))))
    for threshold in (0.5, 0.7, 0.8, 0.9, 1.0):
        plain = F.col("both") >= threshold * (F.col("a") + F.col("b") - F.col("both"))
        assert not rows.where(plain != L._similar("a", "b", F.col("both"), threshold)).limit(1).count()
