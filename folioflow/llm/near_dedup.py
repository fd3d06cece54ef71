"""Near-duplicate documents: ProbMinHash over weighted five-word shingles, banding, exact verification, union-find.

Similarity is the probability Jaccard index of the two documents' shingle counts,
``J_P = sum over shared d of 1 / sum over d' of max(a[d'] / a[d], b[d'] / b[d])``: it does not change when the
counts of one side are all scaled, and equals the plain Jaccard index where no shingle repeats.  The probability that two
ProbMinHash components agree is J_P.

Steps: (1) one pass over the texts gives a digest, band hashes and a 4-bit sketch of the signature of each; (2) equal texts
meet by digest and only the least id goes on; (3) each bucket's centre, the member that shares most buckets with others, is
paired with the bucket's other members (a star, not all pairs), unless the sketches of the two differ in so many components
that a similarity of THRESHOLD is out of reach (four standard deviations); (4) pairs are verified exactly, the centre's text being
sent once for up to MEMBERS others; (5) union-find; (6) other members of one bucket that are in different components after
that are compared too, by the same index, block by block.  So any two documents that share a bucket are in one component or have been compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm import kernels as K
from folioflow.llm.buckets import bucket_links, open_buckets, probability_jaccard
from folioflow.llm.common import components, maybe_broadcast, rows_of, small, written

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
#: Other members of a bucket that are verified against one copy of the pivot's text.
MEMBERS = 256
#: Of BANDS * ROWS components, so many differ in four bits at most for all but a few in 100,000 pairs of similarity THRESHOLD.
DIFFER = 41
SKETCH = [f"s{k}" for k in range(8)]


def prob_minhash(text: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, size: int) -> np.ndarray:
    """Signatures (n x size, uint64) of n weighted sets given as rows (text, h, weight), distinct per text.

    Each element is a Poisson process of rate weight; each of its arrivals falls into one component at random, which keeps
    the earliest.  Rounds go over the next arrivals of all elements at once.  An element ends as soon as its arrival is
    later than every component's earliest of its text, since all its later arrivals are too.  A component's value is the
    element's hash.  Sets without elements keep 0.
    """
    best = np.full(n * size, np.inf)
    value = np.zeros(n * size, np.uint64)
    at, rate, rnd = np.zeros(len(h)), weight.astype(np.float64), 0
    while len(h):
        rnd += 1
        seed = np.uint64((rnd * 0xD1342543DE82EF95) & (2**64 - 1))
        u = K.mix(h ^ seed)
        at = at - np.log1p(-((u >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / rate
        slot = text * size + (K.mix(u + np.uint64(0x632BE59BD9B4E019)) % np.uint64(size)).astype(np.int64)
        low = at < best[slot]
        s, t, e = slot[low], at[low], h[low]
        if len(s):
            order = np.lexsort((e, t, s))
            s, t, e = s[order], t[order], e[order]
            lead = np.r_[True, s[1:] != s[:-1]]
            best[s[lead]], value[s[lead]] = t[lead], e[lead]
        late = best.reshape(n, size).max(axis=1)
        go = at < late[text]
        text, h, at, rate = text[go], h[go], at[go], rate[go]
    return value.reshape(n, size)


def _signatures(batches):
    planes = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for batch in batches:
        ids, (data, offsets) = batch.column(0), K.buffers(batch.column(1))
        n = len(offsets) - 1
        digest = np.empty((n, 2), np.int64)
        bands = np.zeros((n, BANDS), np.int64)
        bits = np.zeros((n, 8), np.uint64)
        for i in range(n):
            digest[i] = np.frombuffer(hashlib.blake2b(data[offsets[i] : offsets[i + 1]], digest_size=16).digest(), np.int64)
        for i, j in K.chunks(offsets):
            o = offsets[i : j + 1]
            h, t = K.text_shingles(data[o[0] : o[-1]], o - o[0], WORDS)
            t, h, w = K.counted(h, t)
            sig = prob_minhash(t, h, w, j - i, BANDS * ROWS).reshape(j - i, BANDS, ROWS)
            flat = K.mix(sig.reshape(j - i, BANDS * ROWS) + np.uint64(7))
            for plane in range(4):
                one = (flat >> np.uint64(plane)) & np.uint64(1)
                bits[i:j, 2 * plane] = (one[:, :64] * planes).sum(axis=1, dtype=np.uint64)
                bits[i:j, 2 * plane + 1] = (one[:, 64:] * planes[: one.shape[1] - 64]).sum(axis=1, dtype=np.uint64)
            for b in range(BANDS):
                key = np.full(j - i, b + 1, np.uint64)
                for r in range(ROWS):
                    key = K.mix(key * K.BASE + sig[:, b, r])
                bands[i:j, b] = key.view(np.int64)
            bands[i + np.setdiff1d(np.arange(j - i), t)] = 0
        empty = np.flatnonzero(~bands.any(axis=1))
        size = np.full(n, BANDS, np.int32)
        size[empty] = 0
        flat = bands[size > 0].ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(flat))
        yield pa.RecordBatch.from_arrays([ids, pa.array(digest[:, 0]), pa.array(digest[:, 1]), lists, *(K.as_long(np.ascontiguousarray(bits[:, k])) for k in range(8))], ["id", "d1", "d2", "bands", *SKETCH])


def _verify(threshold: float):
    def run(batches):
        pivot: tuple = (None, [])
        for batch in batches:
            role, a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("role", "a", "b"))
            out = []
            for k, mine in enumerate(_sets(batch.column("text"))):
                if role[k] == 0:
                    pivot = (a[k], pivot[1] if pivot[0] == a[k] else [])
                    pivot[1].append((mine[0].copy(), mine[1].copy()))
                elif pivot[0] == a[k]:
                    s = max(probability_jaccard(*one, *mine) for one in pivot[1])
                    if s >= threshold:
                        out.append((a[k], b[k], s))
            cols = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "similarity"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) of ids whose texts (id, text) have a similarity of at least threshold, with the similarity."""
    counts = pairs.groupBy("a").agg(F.count("*").alias("n"))
    keyed = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / MEMBERS)).alias("part"))
    keyed = written(keyed, "candidates")
    ends = written(keyed.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ends")
    if small(ends):  # the texts of other documents need not be shuffled
        texts = texts.join(F.broadcast(ends), "id", "left_semi")
    asked = keyed.select(F.col("b").alias("id"), F.lit(1).alias("role"), "a", "part", "b").union(
        keyed.select("a", "part").distinct().select(F.col("a").alias("id"), F.lit(0).alias("role"), "a", "part", F.col("a").alias("b"))
    )
    sent = texts.select("id", "text").join(maybe_broadcast(asked), "id").select("a", "part", "role", "b", "text")
    # the pivot's text comes before those of its part, as role sorts first
    dealt = sent.repartition("a", "part").sortWithinPartitions("a", "part", "role", "b")
    return dealt.mapInArrow(K.lean(_verify(threshold)), "a long, b long, similarity double").dropDuplicates(["a", "b"])


def _sets(texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct shingles of each text, in order, and how often each occurs; a piece of the texts at a time."""
    data, offsets = K.buffers(texts)
    for i, j in K.chunks(offsets):
        o = offsets[i : j + 1]
        h, t = K.text_shingles(data[o[0] : o[-1]], o - o[0], WORDS)
        t, h, w = K.counted(h, t)
        cut = np.searchsorted(t, np.arange(j - i + 1))
        yield from ((h[cut[k] : cut[k + 1]], w[cut[k] : cut[k + 1]]) for k in range(j - i))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row (id, class_id) per id: class_id is the least id of its near-duplicate class.

    A null text is an empty one; empty texts are copies of each other.  A null id takes no part and has no row.  An id on several rows
    stands for all its texts.  A text of fewer than five words has one shingle of all its words.  Ties go to the
    least id.  An empty table gives an empty one.  Other columns are not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id is not null")
    sig = written(rows.mapInArrow(K.lean(_signatures), "id long, d1 long, d2 long, bands array<long>, " + ", ".join(f"{k} long" for k in SKETCH)), "signatures")
    exact = sig.groupBy("d1", "d2").agg(F.min("id").alias("rep"))
    member = written(sig.select("id", "d1", "d2").join(exact, ["d1", "d2"]).select("id", "rep").distinct(), "copies")
    reps = member.where("id = rep").select("id")
    banded = sig.join(reps, "id").select("id", F.explode("bands").alias("band"), *SKETCH).dropDuplicates(["id", "band"])
    shared = written(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    buckets = written(banded.join(maybe_broadcast(shared), "band"), "members")
    weights = written(buckets.groupBy("id").agg(F.sum("n").alias("w")), "weights")
    buckets = written(buckets.drop("n").join(maybe_broadcast(weights), "id"), "buckets")
    differ = " + ".join(f"bit_count({' | '.join(f'(p.s{2 * k + h} ^ y.s{2 * k + h})' for k in range(4))})" for h in (0, 1))
    centre = buckets.groupBy("band").agg(F.max_by(F.struct("id", *SKETCH), F.struct("w", "id")).alias("p")).select("band", "p.*")
    met = centre.alias("p").join(buckets.alias("y"), F.expr("p.band = y.band and p.id <> y.id"))
    star = written(met.select("p.band", F.col("p.id").alias("a"), F.col("y.id").alias("b"), F.expr(f"{differ} <= {DIFFER}").alias("near")), "star")
    links = written(verified(star.where("near").select("a", "b").distinct(), rows, threshold).select(*_ordered()), "links")
    roots = written(components(links), "roots")
    # the centre has been compared with all others of its bucket
    mixed = open_buckets(star.select("band", F.col("b").alias("id")), roots)
    if rows_of(mixed):
        links = links.union(bucket_links(mixed, rows, _sets, threshold))
    links = written(links, "links")
    copies = member.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    roots = written(components(links.union(copies)), "roots")
    ids = member.select("id").distinct()
    return ids.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("class_id"))


def _ordered() -> tuple[Column, Column]:
    return F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each near-duplicate class: that of the least id, all columns as they were.

    Rows with a null id stay.  Of several rows with the least id of a class one stays (that of the least text).
    """
    classes = near_duplicates(docs, id_col, text_col, threshold)
    gone = written(classes.where("id <> class_id").select(F.col("id").alias("__gone")), "gone")
    kept = docs.join(maybe_broadcast(gone), F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
    again = written(docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).count().where("count > 1").select("__id"), "again")
    if not again.limit(1).count():
        return kept
    many = kept.join(maybe_broadcast(again), F.col(id_col) == F.col("__id"), "left_semi")
    one = many.groupBy(id_col).agg(F.min_by(F.struct(*[docs[c] for c in docs.columns]), F.coalesce(F.col(text_col), F.lit(""))).alias("__row")).select("__row.*")
    return kept.join(maybe_broadcast(again), F.col(id_col) == F.col("__id"), "left_anti").unionByName(one)
