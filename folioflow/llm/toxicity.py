"""Toxicity by class-conditional Kneser-Ney models with shared backoff counts.

A text's symbols are the bytes of its lower-case words, each word followed by a space; spaces stand before the first.  For each class c
(toxic, ordinary) a symbol w after the order - 1 symbols h has the probability

    p_c(w | h) = max(n_c(hw) - D_c, 0) / n_c(h) + D_c * t_c(h) / n_c(h) * q(w | h'),

n_c counts the class's symbols, t_c(h) the different symbols that follow h in it, h' is h without its first symbol.  After a history that the class does not
have p_c is q.  q, the backoff, is shared by the classes and interpolated likewise down to one symbol, over continuation counts: the number of different
symbols that precede h'w in texts of either class.  The lowest level backs off to 1 / 256.  Each level has one absolute discount, from its counts of counts,
D = n1 / (n1 + 2 n2) (DISCOUNT where either is 0).  Every p sums to one.

A text's feature is the toxic minus the ordinary log-likelihood over its number of symbols; a logistic curve fitted on labelled rows that the
models have not counted turns it into a probability.  Of the ORDERS that one is taken whose curve has the least log-loss on these rows.  Counts cover all
labelled training rows.  What scoring needs is the log-ratio of each counted run of symbols and, as q cancels in all others, that of each history's backoff weights: they are broadcast if there are at most BROADCAST_WORDS of
them, else texts meet them by a shuffle join, with the same result.  At most CALIBRATION_ROWS rows, chosen by hash, fit the curve.

WORDS, a plainer model that the pipeline uses, scores whole words: a word's backoff is the number of different documents of either class that have it, over the sum
of that, and the discount takes from a count what the backoff explains and Z standard deviations of it, D_c(w) = min(n_c(w), E + Z * sqrt(E + 1)) with
E = N_c * q(w).  Neither is a step of Kneser-Ney; a word left to the backoff as a whole has the same ratio l_1 / l_0 as any other such word.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm import kernels as K
from folioflow.llm.common import maybe_broadcast, rows_of, written

#: Symbols of a run (the last one and its history) in the models that are compared; runs are packed into a long, so at most 7.
ORDERS = (2, 3, 4)
#: Absolute discount of a level without counts of one or of two.
DISCOUNT = 0.5
#: Marks the key of a history, which has backoff weights, among those of runs.
_HISTORY = 1 << 62
#: WORDS: standard deviations of a count that the discount takes beyond what the backoff explains.
Z = 4.0
BROADCAST_WORDS = 500_000
CALIBRATION_ROWS = 50_000
REJECT = 0.3
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def remainder(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4; remainder 2 is held out, 3 fits the curve, 0 and 1 are counted."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4))


def _tokens(data: np.ndarray, offsets: np.ndarray):
    start, end, text = K.words(data, offsets)
    for _ in range(6):
        cut = _PUNCTUATION[data[end - 1]] & (end - start > 1)
        if not cut.any():
            break
        end = end - cut
    for _ in range(3):
        cut = _PUNCTUATION[data[start]] & (end - start > 1)
        if not cut.any():
            break
        start = start + cut
    return start, end, text


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word."""
    start, end, text = _tokens(data, offsets)
    return K.mix(K.spans_hash(K.prefix_sums(data), start, end) + np.uint64(99)), text


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol's run of symbols that ends with it, packed, and its text's number."""
    start, end, text = K.words(data, offsets)
    size, pad = end - start, order - 1
    first = np.r_[True, text[1:] != text[:-1]] if len(text) else np.zeros(0, bool)
    # where each word begins when words have a space after them and texts have their pad before them
    at = np.cumsum(size + 1) - size - 1 + pad * np.cumsum(first)
    line = np.full(int((size + 1).sum()) + pad * int(first.sum()), 32, np.uint8)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    line[np.repeat(at, size) + inside] = data[np.repeat(start, size) + inside]
    symbol = np.repeat(at, size + 1) + np.arange(int((size + 1).sum())) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
    run = np.zeros(len(symbol), np.uint64)
    for k in range(order):
        run = (run << np.uint64(8)) | line[symbol - pad + k]
    return run, np.repeat(text, size + 1)


class Units(NamedTuple):
    """What a model counts and scores, from the bytes and offsets of texts."""

    #: (key, text number) of whatever adds one to a count.
    counted: Callable
    #: (key, text number) of what may have a gain, and each text's length.
    scored: Callable


def symbols(order: int) -> Units:
    """Runs of order symbols, and their histories."""

    def scored(data, offsets):
        run, text = grams(data, offsets, order)
        return np.r_[run, (run >> np.uint64(8)) | np.uint64(_HISTORY)], np.r_[text, text], np.bincount(text, minlength=len(offsets) - 1)

    return Units(lambda data, offsets: grams(data, offsets, order), scored)


def _counted_words(data, offsets):
    t, h, _ = K.counted(*words(data, offsets))
    return h, t


def _scored_words(data, offsets):
    h, text = words(data, offsets)
    return h, text, np.bincount(text, minlength=len(offsets) - 1)


WORDS = Units(_counted_words, _scored_words)


def _counts(counted: Callable):
    """(word, toxic count, ordinary count) of a partition's labelled texts."""

    def combine(parts):
        u, *sums = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(u, kind="stable")
        u = u[order]
        new = np.flatnonzero(np.r_[True, u[1:] != u[:-1]]) if len(u) else np.zeros(0, np.int64)
        return (u[new], *(np.add.reduceat(x[order], new) if len(new) else x for x in sums))

    def batch_of(part):
        return pa.RecordBatch.from_arrays([K.as_long(part[0]), *(pa.array(x.astype(np.int64)) for x in part[1:])], ["word", "n1", "n0"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            data, offsets = K.buffers(pc.utf8_lower(batch.column(0)))
            for i, j in K.chunks(offsets):
                o = offsets[i : j + 1]
                h, t = counted(data[o[0] : o[-1]], o - o[0])
                if len(h):
                    bad = label[i:j][t] > 0
                    held.append(combine([(h, bad * 1, ~bad * 1)]))
                    rows += len(held[-1][0])
            if rows > 500_000:
                held = [combine(held)]
                rows = len(held[0][0])
                if rows > 250_000:
                    yield batch_of(held[0])
                    held, rows = [], 0
        if held:
            yield batch_of(combine(held))

    return run


def _counted(labelled: DataFrame, units: Units) -> DataFrame:
    counts = labelled.select("text", "toxic").mapInArrow(K.lean(_counts(units.counted)), "word long, n1 long, n0 long")
    return written(counts.groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")), "words")


def _discounts(counts: DataFrame, *names: str) -> list[float]:
    """The absolute discount of each column of counts."""
    row = counts.agg(*[F.count_if(F.col(c) == k) for c in names for k in (1, 2)]).first()
    return [row[2 * k] / (row[2 * k] + 2 * row[2 * k + 1]) if row[2 * k] and row[2 * k + 1] else DISCOUNT for k in range(len(names))]


def _last(col: str, symbols: int) -> Column:
    return F.col(col).bitwiseAND(F.lit((1 << (8 * symbols)) - 1).cast("long"))


def shared_backoff(runs: DataFrame, longest: int) -> dict[int, DataFrame]:
    """For each number of symbols below the longest, (tail, q) of the runs of so many, from the different longest runs (word) of either class."""
    levels, q = {longest: runs.select("word")}, {}
    for k in range(longest - 1, 0, -1):
        # one row for each symbol that precedes
        levels[k] = written(levels[k + 1].groupBy(_last("word", k).alias("word")).agg(F.count("*").alias("n")), "continuations")
    for k in range(1, longest):
        (d,) = _discounts(levels[k], "n")
        level = levels[k].select("word", "n", F.shiftright("word", 8).alias("h"), _last("word", k - 1).alias("tail"))
        level = level.join(level.groupBy("h").agg(F.sum("n").alias("all"), F.count("*").alias("kinds")), "h")
        level = level.join(q[k - 1], "tail") if k > 1 else level.withColumn("q", F.lit(1 / 256))
        own = F.greatest(F.lit(0.0), F.col("n") - d) / F.col("all") + d * F.col("kinds") / F.col("all") * F.col("q")
        q[k] = written(level.select(F.col("word").alias("tail"), own.alias("q")), "backoff")
    return q


def model(labelled: DataFrame) -> list[tuple[Units, DataFrame, float]]:
    """For each order its units, (word, gain) of counted runs and of their histories, and 0, the log-ratio of all else, from rows (text, toxic 0 or 1).

    A symbol's log-ratio is the gain of its run and that of its history; what is missing is 0, where both models give q.
    """
    longest = max(ORDERS)
    counts = _counted(labelled, symbols(longest))
    total = counts.agg(F.sum("n1"), F.sum("n0")).first()
    if not total[0] or not total[1]:
        return []
    q, found = shared_backoff(counts, longest), []
    for order in ORDERS:
        runs = counts if order == longest else written(counts.groupBy(_last("word", order).alias("word")).agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")), "runs")
        d = dict(zip(("n1", "n0"), _discounts(runs, "n1", "n0")))
        runs = runs.withColumns({"h": F.shiftright("word", 8), "tail": _last("word", order - 1)})
        after = runs.groupBy("h").agg(*[F.sum(c).alias(f"all_{c}") for c in d], *[F.count_if(F.col(c) > 0).alias(f"kinds_{c}") for c in d])
        weight = {c: F.when(F.col(f"all_{c}") > 0, d[c] * F.col(f"kinds_{c}") / F.col(f"all_{c}")).otherwise(1.0) for c in d}
        after = written(after.select("h", "all_n1", "all_n0", weight["n1"].alias("w_n1"), weight["n0"].alias("w_n0")), "histories")
        met = runs.join(after, "h").join(q[order - 1], "tail")
        p = {c: F.greatest(F.lit(0.0), F.col(c) - d[c]) / F.greatest(F.lit(1), F.col(f"all_{c}")) + F.col(f"w_{c}") * F.col("q") for c in d}
        back = F.log(F.col("w_n1") / F.col("w_n0"))
        gains = met.select("word", (F.log(p["n1"] / p["n0"]) - back).alias("gain"))
        found.append((symbols(order), written(gains.union(after.select(F.col("h").bitwiseOR(F.lit(_HISTORY).cast("long")), back)), "gains"), 0.0))
    return found


def word_model(labelled: DataFrame) -> list[tuple[Units, DataFrame, float]]:
    """WORDS, (word, gain) of the words whose log-ratio differs from that of all others, and that of the others, from rows (text, toxic 0 or 1)."""
    counts = _counted(labelled, WORDS)
    total = counts.agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).first()
    if not total.n1 or not total.n0:
        return []
    n = {c: float(total[c]) for c in ("n1", "n0")}
    q = (F.col("n1") + F.col("n0")) / (n["n1"] + n["n0"])
    over = {c: F.greatest(F.lit(0.0), F.col(c) - n[c] * q - Z * F.sqrt(n[c] * q + 1)) for c in n}
    found = written(counts.select("word", q.alias("q"), over["n1"].alias("x1"), over["n0"].alias("x0")).where("x1 > 0 or x0 > 0"), "over")
    lost = found.agg(F.coalesce(F.sum("x1"), F.lit(0.0)), F.coalesce(F.sum("x0"), F.lit(0.0))).first()
    back = {"n1": 1 - lost[0] / n["n1"], "n0": 1 - lost[1] / n["n0"]}
    other = float(np.log(back["n1"] / back["n0"]))
    p = lambda x, c: F.col(x) / n[c] + back[c] * F.col("q")
    return [(WORDS, written(found.select("word", (F.log(p("x1", "n1") / p("x0", "n0")) - other).alias("gain")), "gains"), other)]


def _table(gains: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys, mixed one to one, and gains, of at most BROADCAST_WORDS words."""
    found = gains.toPandas()
    key = K.mix(found["word"].to_numpy(np.int64).view(np.uint64))
    order = np.argsort(key)
    return key[order], found["gain"].to_numpy(np.float64)[order]


def features(texts, table, other: float, units: Units = WORDS) -> np.ndarray:
    """Length-normalised difference of the log-likelihoods of each text; other for one without words."""
    key, gain = table
    data, offsets = K.buffers(pc.utf8_lower(texts.fill_null("")))
    n = len(offsets) - 1
    out = np.full(n, other)
    if not len(key):
        return out
    seen = np.zeros(1 << 20, bool)
    seen[(key >> np.uint64(44)).astype(np.int64)] = True
    for i, j in K.chunks(offsets):
        o = offsets[i : j + 1]
        h, text, size = units.scored(data[o[0] : o[-1]], o - o[0])
        h = K.mix(h)
        maybe = np.flatnonzero(seen[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(key, h[maybe]), len(key) - 1)
        hit = key[at] == h[maybe]
        out[i:j] += np.bincount(text[maybe[hit]], gain[at[hit]], j - i) / np.maximum(size, 1)
    return out


def _listed(units: Units):
    """(t1, t2, size, word, n) from (t1, t2, text): each text's different words and how often they occur, and its length."""

    def run(batches):
        for batch in batches:
            data, offsets = K.buffers(pc.utf8_lower(batch.column(2).cast(pa.string())))
            ids = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]
            for i, j in K.chunks(offsets):
                o = offsets[i : j + 1]
                h, text, size = units.scored(data[o[0] : o[-1]], o - o[0])
                t, h, n = K.counted(h, text)
                yield pa.RecordBatch.from_arrays([pa.array(ids[0][i:j][t]), pa.array(ids[1][i:j][t]), pa.array(size[t]), K.as_long(h), pa.array(n.astype(np.int64))], ["t1", "t2", "size", "word", "n"])

    return run


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps with a small ridge on the slope."""
    scale = max(float(np.std(x)), 1e-9)
    z, w = np.c_[x / scale, np.ones(len(x))], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + np.array([1e-2, 1e-6]) * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag([1e-2, 1e-6]), grad)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def _with_feature(rows: DataFrame, text_col: str, gains: DataFrame, other: float, units: Units = WORDS) -> DataFrame:
    """rows with __x, the feature of the text: by broadcast of the words that have a gain, or by a join of words where there are too many."""
    if rows_of(gains) <= BROADCAST_WORDS:
        shared, names = rows.sparkSession.sparkContext.broadcast(_table(gains)), [*rows.columns, "__x"]

        def run(batches):
            for batch in batches:
                x = features(batch.column(text_col).cast(pa.string()), shared.value, other, units)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x)], names)

        return rows.mapInArrow(K.lean(run), T.StructType([*rows.schema.fields, T.StructField("__x", T.DoubleType())]))
    # a feature belongs to a text, whichever rows have it
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))
    texts = keyed.select("t1", "t2", "text")
    found = texts.mapInArrow(K.lean(_listed(units)), "t1 long, t2 long, size long, word long, n long").join(gains, "word")
    # rows of one text add up alike, so their share is the feature
    times = texts.groupBy("t1", "t2").agg(F.count("*").alias("times"))
    sums = found.groupBy("t1", "t2").agg(F.sum(F.col("n") * F.col("gain") / F.col("size")).alias("s")).join(times, ["t1", "t2"])
    sums = written(sums.select("t1", "t2", (F.col("s") / F.col("times")).alias("s")), "features")
    return keyed.join(sums, ["t1", "t2"], "left").select("row.*", (F.lit(other) + F.coalesce("s", F.lit(0.0))).alias("__x"))


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", models: Callable = model):
    """(units, gains, log-ratio of all else, slope, intercept) of the best of models, from labelled rows whose remainder is not 2; labels: columns id_col, toxic.

    An id labelled more than once counts as toxic if any label says so.  Without labels of both classes the score
    is the share of toxic labels (0 without labels).  The first model is taken if the rows that fit the curve are of one class.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = written(known.withColumn("part", remainder(F.col("__id"))).where("part <> 2"), "labels")
    share = known.agg(F.avg((F.col("toxic") > 0).cast("double")), F.count_distinct(F.col("toxic") > 0), F.count_if(F.col("part") == 3)).first()
    prior = float(share[0] or 0.0)
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(maybe_broadcast(known), "__id")
    odds = float(np.log(np.clip(prior, 1e-12, 1 - 1e-12) / (1 - np.clip(prior, 1e-12, 1 - 1e-12)))) if 0 < prior < 1 else (-30.0 if prior <= 0 else 30.0)
    found = [x for x in models(rows.where("part <> 3")) if rows_of(x[1])] if share[1] == 2 else []
    if not found:
        return None, None, 0.0, 0.0, odds
    held = rows.where("part = 3").select("__id", "text", "toxic")
    held = held.orderBy(F.xxhash64("__id")).limit(CALIBRATION_ROWS) if share[2] > CALIBRATION_ROWS else held
    held = written(held, "curve_rows") if len(found) > 1 else held
    curves = []
    for units, gains, other in found:
        xy = _with_feature(held, "text", gains, other, units).select("__x", "toxic").toPandas()
        x, y = xy["__x"].to_numpy(), (xy["toxic"].to_numpy() > 0).astype(float)
        if len(set(y)) < 2:
            return units, gains, other, 1.0, odds - other
        slope, intercept = logistic(x, y)
        curves.append((float(np.logaddexp(0, np.where(y > 0, -1, 1) * (slope * x + intercept)).mean()), units, gains, other, slope, intercept))
    return min(curves, key=lambda c: c[0])[1:]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """What fitted gives for WORDS, without the units."""
    return fitted(docs, labels, id_col, text_col, word_model)[1:]


def _scored(docs: DataFrame, rows: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows_text: str, models: Callable) -> DataFrame:
    """rows with __score."""
    units, gains, other, slope, intercept = fitted(docs, labels, id_col, text_col, models)
    found = rows.withColumn("__x", F.lit(0.0)) if gains is None else _with_feature(rows, rows_text, gains, other, units)
    odds = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.lit(slope) * F.col("__x") + F.lit(intercept)))
    return found.withColumn("__score", 1 / (1 + F.exp(-odds))).drop("__x")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", models: Callable = model) -> DataFrame:
    """One row (id_col, held_out, score, predicted) per row of docs.

    A null or empty text has no symbols and gets the score of log-likelihoods that are alike.  A null id is never held out.  Repeated rows get a
    row each; an empty table gives an empty one.  Only the id and the text are read, whatever other columns there are.
    """
    rows = docs.select(F.col(id_col), F.coalesce(remainder(F.col(id_col)) == 2, F.lit(False)).alias("held_out"), F.col(text_col).alias("__text"))
    out = _scored(docs, rows, labels, id_col, text_col, "__text", models)
    return out.select(id_col, "held_out", F.col("__score").alias("score"), (F.col("__score") >= REJECT).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", models: Callable = model) -> DataFrame:
    """docs without the rows whose score is REJECT or more; the other rows and all columns as they were."""
    return _scored(docs, docs, labels, id_col, text_col, text_col, models).where(F.col("__score") < REJECT).select(*[F.col(f"`{c}`") for c in docs.columns])
