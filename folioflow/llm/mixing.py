"""Mixing to target weights by soft membership.

(1) A classifier fitted on the labelled table (multinomial Naive Bayes over hashed words, length-normalised and calibrated by a
temperature) predicts each document's posterior over domains.  A domain is a value of (quality, toxic).  (2) Each document gets a rate
r >= 0, how often it is taken.  With t words and posteriors p, the expected words of domain d are sum(r * t * p[d]); projected
gradient steps on half the squared distance of these to the targets, preconditioned by the Gram matrix
sum(t * p * p') of the documents that are not held at 0, and beginning at r = 1, find the rates.  A step is r <- max(0, r - sum_d p[d] * g[d]), so after any number of steps a document's rate
follows from its posteriors and the list of the g's: no state by document is kept, and a step needs one aggregation of the
posterior table, of as many numbers as there are domains and their squares by length tried.  The first step solves the same problem with a
small ridge on the rates' distance from 1, by Newton steps on its dual; most often nothing is left after it.  Of the lengths tried and the plain gradient
step the one of least squared distance is taken.  It ends when the targets are met, when the projected gradient is 0 (targets out of reach:
posteriors are a mixture, rates are not negative) or after STEPS steps; a gap that remains is logged.

The classifier is fitted on at most FIT_ROWS labelled rows (least hash of the id); all else covers all documents.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm import kernels as K
from folioflow.llm.common import maybe_broadcast, written

log = logging.getLogger(__name__)
#: Labelled rows that fit the classifier at most.
FIT_ROWS = 50_000
SLOTS = 1 << 16
DOMAINS = ("q0t0", "q0t1", "q1t0", "q1t1")
#: Target share of words of each domain.
TARGETS = {"q0t0": 0.10, "q0t1": 0.02, "q1t0": 0.85, "q1t1": 0.03}
STEPS = 200
TOLERANCE = 1e-4
#: Lengths at which a preconditioned step is tried.
LENGTHS = (1.0, 0.5, 0.25, 0.0625)
#: Weights of the rates' distance from 1 in the first step's problem, each begun where the last one ended.
RIDGES = (1e-1, 1e-2, 1e-3, 1e-4, 1e-5, 1e-6)
NEWTON = 20
BACKING = 20_000.0


def _pieces(texts):
    """(first text, end, slot of each word, its text counted from the first), a piece of the texts at a time."""
    data, offsets = K.buffers(pc.utf8_lower(texts.fill_null("")))
    for i, j in K.chunks(offsets):
        o = offsets[i : j + 1]
        piece = data[o[0] : o[-1]]
        start, end, text = K.words(piece, o - o[0])
        yield i, j, (K.spans_hash(K.prefix_sums(piece), start, end) >> np.uint64(48)).astype(np.int64), text


def _domain(quality, toxic):
    return (F.when(quality > 0, 2).otherwise(0) + F.when(toxic > 0, 1).otherwise(0)).cast("int")


def _count(batches):
    """(domain, slot, n) of a partition, and slot -1 with the number of documents."""
    total = np.zeros((len(DOMAINS), SLOTS + 1), np.int64)
    for batch in batches:
        domain = batch.column(1).to_numpy(zero_copy_only=False)
        for i, j, slot, of in _pieces(batch.column(0)):
            np.add.at(total, (domain[i:j][of], slot + 1), 1)
        np.add.at(total, (domain, np.zeros(len(domain), np.int64)), 1)
    d, s = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(d.astype(np.int32)), pa.array((s - 1).astype(np.int32)), pa.array(total[d, s])], ["domain", "slot", "n"])


def posteriors_of(log_odds: np.ndarray, prior: np.ndarray, temperature: float, slot: np.ndarray, of: np.ndarray, n: int):
    """Posteriors (n x domains) and words of each text; a text without words has the prior."""
    words = np.bincount(of, minlength=n)
    s = np.stack([np.bincount(of, log_odds[d][slot], n) for d in range(len(prior))], axis=1) / np.maximum(words, 1)[:, None] * temperature
    with np.errstate(divide="ignore"):
        s += np.log(prior)
    s = np.exp(s - s.max(axis=1, keepdims=True))
    return s / s.sum(axis=1, keepdims=True), words


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """(log-likelihood ratios by domain and slot, prior, temperature) of the labelled rows; without any, nothing but an even prior."""
    flat = (np.zeros((len(DOMAINS), SLOTS)), np.full(len(DOMAINS), 1 / len(DOMAINS)), 0.0)
    known = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max(_domain(F.col("quality"), F.col("toxic"))).alias("domain"))
    known = known.orderBy(F.xxhash64("__id"), "__id").limit(FIT_ROWS)
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(maybe_broadcast(written(known, "labels")), "__id")
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(5)))
    counts = rows.where("fold > 0").select("text", "domain").mapInArrow(K.lean(_count), "domain int, slot int, n long").groupBy("domain", "slot").agg(F.sum("n").alias("n")).toPandas()
    if not len(counts):
        return flat
    total = np.zeros((len(DOMAINS), SLOTS + 1))
    total[counts["domain"].to_numpy(), counts["slot"].to_numpy() + 1] = counts["n"].to_numpy()
    prior = total[:, 0] / total[:, 0].sum()  # a domain without labelled rows gets no posterior
    pooled = (total[:, 1:].sum(axis=0) + 1e-3) / (total[:, 1:].sum() + 1e-3 * SLOTS)
    words = total[:, 1:].sum(axis=1, keepdims=True)
    # each share is drawn to the pooled one, as by BACKING words
    share = (total[:, 1:] + BACKING * pooled) / (words + BACKING)
    odds = np.log(share) - np.log(pooled)
    return odds, prior, _temperature(rows.where("fold = 0"), odds, prior)


GRID = (0.0, 1.0, 3.0, 10.0, 20.0, 40.0, 80.0, 160.0)


def _temperature(held: DataFrame, odds: np.ndarray, prior: np.ndarray) -> float:
    """The factor on the length-normalised evidence that predicts the held-out fold best (log-loss)."""
    shared = held.sparkSession.sparkContext.broadcast((odds, prior))

    def loss(batches):
        o, p0 = shared.value
        for batch in batches:
            y, out = batch.column(1).to_numpy(zero_copy_only=False), np.zeros(len(GRID))
            for i, j, slot, of in _pieces(batch.column(0)):
                out += [-np.log(np.maximum(posteriors_of(o, p0, t, slot, of, j - i)[0][np.arange(j - i), y[i:j]], 1e-12)).sum() for t in GRID]
            yield pa.RecordBatch.from_arrays([pa.array([float(x)]) for x in out], [f"t{k}" for k in range(len(GRID))])

    found = held.select("text", "domain").mapInArrow(K.lean(loss), ", ".join(f"t{k} double" for k in range(len(GRID)))).agg(*[F.sum(f"t{k}") for k in range(len(GRID))]).first()
    return GRID[int(np.argmin(found))] if found[0] is not None else 0.0


def _posteriors(model, batch_text):
    p, words = np.zeros((len(batch_text), len(DOMAINS))), np.zeros(len(batch_text), np.int64)
    for i, j, slot, of in _pieces(batch_text):
        p[i:j], words[i:j] = posteriors_of(*model, slot, of, j - i)
    return p, words


def replay(p: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Rates after the projected steps, from 1."""
    r = np.ones(len(p))
    for g in steps:
        r = np.maximum(0.0, r - p @ g)
    return r


def solve(table: DataFrame, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(steps, expected share of each domain) over the table (words, p0, p1, ...); targets are shares."""
    d = len(targets)
    names = [f"p{k}" for k in range(d)]
    total = float(table.agg(F.sum("words")).first()[0] or 0)
    if total <= 0:
        return np.zeros((0, d)), np.zeros(d)
    tries = len(LENGTHS) + 1
    outs = [f"c{k}" for k in range(tries * (d + d * d + 2))]

    def state(steps, tried):
        """For each tried further step: shares by domain, the Gram matrix of the documents whose rate is then above 0, the mean square of the rates and of their change."""

        def run(batches):
            for batch in batches:
                w = batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64)
                p = np.stack([batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(d)], axis=1)
                r, found = replay(p, steps), []
                for g in tried:
                    x = np.maximum(0.0, r - p @ g)
                    found += [(w * x) @ p, ((p * (w * (x > 0))[:, None]).T @ p).ravel(), [w @ x**2, w @ (x - r) ** 2]]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in np.concatenate(found)], outs[: len(tried) * (d + d * d + 2)])

        used = outs[: len(tried) * (d + d * d + 2)]
        found = table.select("words", *names).mapInArrow(K.lean(run), ", ".join(f"{c} double" for c in used)).agg(*[F.sum(c) for c in used]).first()
        found = np.array([x or 0.0 for x in found]).reshape(len(tried), -1) / total
        return [(x[:d], x[d:-2].reshape(d, d), x[-2], x[-1]) for x in found]

    steps = np.zeros((0, d))
    now, gram, square, _ = state(steps, np.zeros((1, d)))[0]
    size = max(np.linalg.eigvalsh(gram).max(), 1e-12)  # all rates are above 0 here: no later Gram matrix is larger
    # least squares plus a ridge on the rates' distance from 1 has the rates max(0, 1 - p * g) with g = gap / ridge: one step from 1.
    # Its dual is smooth, convex and has as many unknowns as domains: Newton steps find g
    g = np.zeros(d)
    for ridge in RIDGES:
        dual = lambda x, mean: ridge / 2 * float(x @ x) + mean / 2 + float(x @ targets)
        for _ in range(NEWTON):
            slope = ridge * g - (now - targets)
            if np.abs(now - targets).max() < TOLERANCE or np.abs(slope).max() < TOLERANCE / 100:
                break
            step = np.linalg.solve(gram + ridge * np.eye(d), slope)
            tried = np.array([g - slope / (size + ridge), *[g - x * step for x in LENGTHS]])
            there = state(steps, tried)
            best = min(range(tries), key=lambda k: dual(tried[k], there[k][2]))
            if dual(tried[best], there[best][2]) >= dual(g, square):
                break
            g, (now, gram, square, _) = tried[best], there[best]
    steps = g[None]
    for _ in range(STEPS):
        gap = now - targets
        if np.abs(gap).max() < TOLERANCE:
            break
        step = np.linalg.solve(gram + 1e-6 * max(np.trace(gram), 1e-12) * np.eye(d), gap)
        # the plain gradient step of length 1 / (largest eigenvalue) is always tried too: it never leads away
        tried = np.array([gap / size, *[x * step for x in LENGTHS]])
        there = state(steps, tried)
        if np.sqrt(there[0][3]) < TOLERANCE:  # the projected gradient is 0: these are the nearest shares
            break
        best = min(range(tries), key=lambda k: float(((there[k][0] - targets) ** 2).sum()))
        steps, (now, gram, _, _) = np.vstack([steps, tried[best]]), there[best]
    if np.abs(now - targets).max() >= TOLERANCE:
        log.warning("after %d steps the shares are %s, the targets %s", len(steps), now.round(4).tolist(), np.round(targets, 4).tolist())
    return steps, now


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all columns and: words, one posterior column by domain (post_<domain>), and rate.

    targets are the wanted shares of words (default TARGETS), scaled to sum to 1; the expected number of words stays what it is.  A text without words (null,
    empty, blank) has the prior as posteriors; its rate counts for nothing.  Rows with a null id are rated as any; they are never
    labelled.  A domain without labelled rows has posterior 0 and its target is left out.  Equal posteriors have equal rates.  Without labels all posteriors are even.  An empty table gives an empty one.  A
    column of docs that has one of the new names is replaced.
    """
    model = fit(docs, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"p{k}" for k in range(len(DOMAINS))]

    def weigh(batches):
        for batch in batches:
            p, words = _posteriors(shared.value, batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), *[pa.array(p[:, k]) for k in range(len(names))]], ["words", *names])

    table = written(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")).mapInArrow(K.lean(weigh), "words long, " + ", ".join(f"{c} double" for c in names)), "posteriors")
    wanted = np.array([(targets or TARGETS).get(d, 0.0) for d in DOMAINS], float) * (model[1] > 0)
    steps, _ = solve(table, wanted / (wanted.sum() or 1.0))
    new = ["words", *[f"post_{d}" for d in DOMAINS], "rate"]
    kept = [c for c in docs.columns if c not in new]
    at = kept.index(text_col)
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("words", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in new[1:]])

    def rate(batches):
        for batch in batches:
            p, words = _posteriors(shared.value, batch.column(at).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words.astype(np.int64)), *[pa.array(p[:, k]) for k in range(len(names))], pa.array(replay(p, steps))], [*kept, *new])

    return docs.select(*kept).mapInArrow(K.lean(rate), schema)
