"""What is left in a bucket after its star: exact comparison of members in different components, block by block.

The members of a band are dealt into parts of about BLOCK_BYTES of text.  A task indexes the shingles of one part and holds the members of the part,
then those of the band's other parts, against it: the index gives the common part of a set with all members at once.  A link is
passed on only where it joins two components that the part's links have not joined yet, so links are no more than members.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import kernels as K
from folioflow.llm.common import maybe_broadcast, rows_of, written

BLOCK_BYTES = 4 << 20


def probability_jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """J_P of two weighted sets with sorted distinct hashes; 0 where one is empty.  Without repeats it is the Jaccard index."""
    if not len(ha) or not len(hb):
        return 0.0
    both, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    if wa.max() == wa.min() and wb.max() == wb.min():
        return len(both) / (len(ha) + len(hb) - len(both))
    a, b = wa[i].astype(np.float64), wb[j].astype(np.float64)
    order = np.argsort(b / a, kind="stable")
    a, b = a[order], b[order]
    upto = np.searchsorted(b / a, b / a, "right")
    below = np.r_[0.0, np.cumsum(a)][upto] + (wa.sum() - a.sum())
    above = wb.sum() - np.r_[0.0, np.cumsum(b)][upto]
    return float((1.0 / (below / a + above / b)).sum())


class _Part:
    """Members (id, component, hashes, weights) of one part of a band, and links found among them and with others."""

    def __init__(self, threshold: float):
        self.threshold, self.members, self.index = threshold, [], None

    def add(self, probe: bool, member: tuple, out: list) -> None:
        if not probe:
            self.members.append(member)
            return
        self.close(out)
        self._probe(member, self._label.setdefault(member[1], len(self._label)), out)

    def close(self, out: list) -> None:
        if self.index is not None or not self.members:
            return
        sets = [m[2] for m in self.members]
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(h) for h in sets])
        order = np.argsort(flat, kind="stable")
        self.weight = np.concatenate([m[3] for m in self.members])[order].astype(np.float64)
        self.index, self.owner = flat[order], owner[order]
        self.size, self.total = np.array([len(h) for h in sets]), np.array([m[3].sum() for m in self.members])
        self.plain = np.array([bool(len(m[3])) and m[3].max() == m[3].min() for m in self.members])
        self._label: dict = {}
        self.of = np.array([self._label.setdefault(m[1], len(self._label)) for m in self.members])
        first = int(np.flatnonzero(self.of == np.bincount(self.of).argmax())[0])
        for k, m in enumerate(self.members):
            if self.of[k] != self.of[first]:  # the largest component's members need not ask, the others ask them
                self._probe(m, self.of[k], out)

    def _probe(self, member: tuple, mine: int, out: list) -> None:
        name, root, h, w = member
        at, end = np.searchsorted(self.index, h), np.searchsorted(self.index, h, "right")
        n = end - at
        place = np.repeat(at - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(h) else np.zeros(0, np.int64)
        owner = self.owner[place]
        both = np.bincount(owner, minlength=len(self.size))
        even = self.plain & (bool(len(w)) and w.max() == w.min())
        near = both >= self.threshold * (len(h) + self.size - both)
        if not even.all():  # J_P is at most the common share of either total
            a = np.bincount(owner, np.repeat(w.astype(np.float64), n), len(self.size))
            b = np.bincount(owner, self.weight[place], len(self.size))
            near = np.where(even, near, (a >= self.threshold * w.sum() - 1e-9) & (b >= self.threshold * self.total - 1e-9))
        for k in np.flatnonzero(near & (self.of != mine)):
            if self.of[k] != mine and (even[k] or probability_jaccard(h, w, self.members[k][2], self.members[k][3]) >= self.threshold):
                out.append((name, self.members[k][0]))
                self.of[self.of == self.of[k]] = mine


def _compare(sets: Callable, threshold: float):
    """Links (a, b) from rows (band, part, probe, id, root, text) in that order."""

    def run(batches):
        key, part, kind = None, _Part(threshold), None
        for batch in batches:
            out: list = []
            kind = batch.schema.field("id").type
            band, number, probe, names, roots = (batch.column(c).to_pylist() for c in ("band", "part", "probe", "id", "root"))
            for k, (h, w) in enumerate(sets(batch.column("text"))):
                if (band[k], number[k]) != key:
                    part.close(out)
                    key, part = (band[k], number[k]), _Part(threshold)
                part.add(bool(probe[k]), (names[k], roots[k], h.copy(), w.copy()), out)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out], kind)], ["a", "b"])
        if kind is not None:
            part.close(out := [])
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out], kind)], ["a", "b"])

    return run


def open_buckets(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(band, id, root): the rows of members (band, id) whose bucket holds more than one component; an id without a link is its own root."""
    rooted = members.join(maybe_broadcast(roots), "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
    return written(rooted.join(mixed, "band"), "open")


def bucket_links(rows: DataFrame, texts: DataFrame, sets: Callable, threshold: float) -> DataFrame:
    """Links (a, b) that, with those known, join all similar ids of each bucket, from rows (band, id, root) and texts (id, text).

    sets makes of a column of texts a list of (sorted distinct hashes, weights).
    """
    ids = written(rows.select("id").distinct(), "asked")
    mine = written(texts.join(maybe_broadcast(ids), "id", "left_semi"), "texts_asked")
    asked = rows.select("band", "id", F.col("root").cast("string").alias("root")).join(mine.select("id", F.octet_length("text").alias("size")), "id")
    mass = asked.groupBy("band").agg(F.ceil(F.sum("size") / BLOCK_BYTES).cast("int").alias("parts")).where("parts > 1")
    mass = written(mass, "parts")
    dealt = asked.drop("size").join(maybe_broadcast(mass), "band", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    held = dealt.select("band", F.col("own").alias("part"), F.lit(0).alias("probe"), "id", "root")
    if rows_of(mass):
        others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("own"))
        held = held.union(dealt.where("parts > 1").select("band", F.explode(others).alias("part"), F.lit(1).alias("probe"), "id", "root"))
    sent = held.join(mine, "id").select("band", "part", "probe", "id", "root", "text")
    kind = rows.schema["id"].dataType.simpleString()
    met = sent.repartition("band", "part").sortWithinPartitions("band", "part", "probe").mapInArrow(K.lean(_compare(sets, threshold)), f"a {kind}, b {kind}")
    return met.distinct()
