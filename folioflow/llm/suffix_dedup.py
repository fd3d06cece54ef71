"""Removal of repeated byte strings: threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every byte covered by a string of LENGTH bytes that also starts earlier (in a document of smaller id, or earlier in the
same one) is removed; matches never cross documents.

No machine holds all text, so equal windows are first brought together.  The KGRAM-byte substring of least hash inside a window of
LENGTH bytes depends on the window alone: equal windows have the same one.  Consecutive windows with the same least substring
form a run; a run's context is the bytes its windows cover.  (1) Each task lists the runs of its documents as (key, context
hash, document, start, windows); of runs of equal key and context only the earliest is dealt on, the others' windows are
repeats (this is also the combining step that keeps a very frequent passage small before the shuffle).  (2) By key, the same
among tasks.  Contexts that are alone under their key hold no repeat, unless the key occurs in them twice.  (3) The
other distinct contexts fetch their bytes.  (4) By key, contexts are concatenated, and the transform's intervals are
extended backwards, one common-prefix value per level, up to LENGTH - 1: suffixes that no level has parted share a window, and
all but the earliest of these are repeats.  Keys with more than HOT contexts skip (4): their windows are dealt out and compared
one by one, by two 64-bit hashes each, so no group has to fit a task.

Equal contexts under one key are recognised by 64 bits of BLAKE2b, which no text is known to defeat; all other windows are compared as bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import kernels as K
from folioflow.llm.common import small, written

LENGTH = 100
KGRAM = 24
#: Windows of a run at most; a longer run is split.
RUN = 1024
#: Bytes of text that are hashed or transformed at once.
PIECE = 1 << 21
HOT = 4096
REPEATS_INSIDE = 1 << 20
FIELDS = ["v", "c", "doc", "p", "n"]


def _sliding(a: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over each width consecutive entries."""
    step = 1
    while step * 2 <= width:
        a = best(a[:-step], a[step:])
        step *= 2
    rest = width - step
    return best(a[: len(a) - rest], a[rest:]) if rest else a


def runs(data: np.ndarray, offsets: np.ndarray):
    """Key, context hash, text number, start and number of windows (with REPEATS_INSIDE added) of each run."""
    n, width = len(data), LENGTH - KGRAM + 1
    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if n < LENGTH:
        return none
    sums = K.prefix_sums(data)
    at = np.arange(n - KGRAM + 1)
    gram = K.spans_hash(sums, at, at + KGRAM)
    low = _sliding(gram, width, np.minimum)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    p = np.flatnonzero(text[: n - LENGTH + 1] == text[LENGTH - 1 :])
    if not len(p):
        return none
    m = low[p]
    first = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (np.diff(p) != 1) | (np.diff(text[p]) != 0)])
    count = np.diff(np.r_[first, len(p)])
    if (count > RUN).any():
        extra = [np.arange(f, f + c, RUN) for f, c in zip(first[count > RUN], count[count > RUN])]
        first = np.unique(np.concatenate([first, *extra]))
        count = np.diff(np.r_[first, len(p)])
    start, v = p[first], m[first]
    raw = data.tobytes()
    c = np.frombuffer(b"".join([hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(start.tolist(), (start + count + LENGTH - 1).tolist())]), np.uint64)
    # how often the key occurs in the context: places that are the least of some window
    high = _sliding(np.r_[np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)], width, np.maximum)
    places = np.flatnonzero(high == gram)
    lo, hi = np.searchsorted(places, start), np.searchsorted(places, start + count + width - 1)
    times = np.where(hi - lo > 12, 2, 0)
    for k in range(12):
        inside = lo + k < hi
        times[inside] += gram[places[lo[inside] + k]] == v[inside]
    return v, c, text[start], start - offsets[text[start]], count + REPEATS_INSIDE * (times > 1)


def earliest(v, c, doc, p):
    """Order by (v, c, doc, p), and in it the first row of each (v, c)."""
    order = np.lexsort((p, doc, c, v))
    v, c = v[order], c[order]
    new = np.r_[True, (v[1:] != v[:-1]) | (c[1:] != c[:-1])] if len(v) else np.zeros(0, bool)
    return order, new


def merged(doc, start, end):
    """Union of byte ranges of each document, as sorted (doc, start, end); touching ranges are joined."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    group = np.cumsum(np.r_[0, doc[1:] != doc[:-1]]).astype(np.int64)
    span = int(end.max()) + 2
    reach = np.maximum.accumulate(end + group * span) - group * span
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])])
    return doc[new], start[new], reach[np.r_[new[1:] - 1, len(doc) - 1]]


def _spans(doc, p, n):
    """Rows for repeated windows: key by document, start, and minus the length."""
    d, s, e = merged(doc, p, p + n % REPEATS_INSIDE + LENGTH - 1)
    return K.mix(d.astype(np.int64).view(np.uint64)).view(np.int64), np.zeros(len(d), np.int64), d, s, s - e


def _batch(*parts) -> pa.RecordBatch:
    v, c, doc, p, n = (np.concatenate([np.asarray(x) for x in col]) for col in zip(*parts))
    return pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)), pa.array(c.astype(np.int64)), pa.array(doc.astype(np.int64)), pa.array(p.astype(np.int32)), pa.array(n.astype(np.int32))], FIELDS)


def _list_runs(batches):
    """(1): from (doc, text) to rows (v, c, doc, p, n); n is negative for spans already known to be repeats."""
    held, size = [], 0

    def flush():
        v, c, doc, p, n = (np.concatenate(x) for x in zip(*held))
        order, new = earliest(v, c, doc, p)
        keep, again = order[new], order[~new]
        return _batch((v[keep], c[keep], doc[keep], p[keep], n[keep]), _spans(doc[again], p[again], n[again]))

    for batch in batches:
        doc = batch.column(0).to_numpy(zero_copy_only=False)
        data, offsets = K.buffers(batch.column(1))
        for i, j in K.chunks(offsets, PIECE):
            o = offsets[i : j + 1]
            for a in range(0, max(1, int(o[-1] - o[0]) - LENGTH + 1), PIECE * 2 if j - i == 1 else 1 << 62):
                b = min(int(o[-1] - o[0]), a + PIECE * 2 + LENGTH - 1) if j - i == 1 else int(o[-1] - o[0])
                v, c, t, p, n = runs(data[o[0] + a : o[0] + b], np.array([0, b - a]) if j - i == 1 else o - o[0])
                held.append((v.view(np.int64), c.view(np.int64), doc[i + t], p + a, n))
                size += len(v)
        if size > 1_500_000:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def _meet(rows):
    """Spans of repeats among rows of windows, all of them at hand."""
    v, c, doc, p, n = rows
    order, new = earliest(v, c, doc, p)
    again = order[~new]
    return _spans(doc[again], p[again], n[again])


def _columns(batch):
    return [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)]


def _reduce_runs(batches):
    """(2): from rows in the order (v, c, doc, p) to spans of repeats and contexts to compare; holds one batch and one row."""
    last, twin = None, False  # the latest first row of a context, and whether its key has an earlier context
    for b in batches:
        cols = _columns(b)
        known = cols[4] < 0
        out = [tuple(x[known] for x in cols)]
        rows = [x[~known] for x in cols]
        if last is not None:
            rows = [np.r_[a, x] for a, x in zip(last, rows)]
        v, c, doc, p, n = rows
        if len(v):
            new = np.r_[True, (v[1:] != v[:-1]) | (c[1:] != c[:-1])]
            out.append(_spans(doc[~new], p[~new], n[~new]))
            rep = np.flatnonzero(new)
            same = v[rep][1:] == v[rep][:-1]
            before, after = np.r_[twin, same], np.r_[same, False]
            ask = rep[:-1][(before | after)[:-1] | (n[rep[:-1]] >= REPEATS_INSIDE)]
            out.append(tuple(x[ask] for x in rows))
            last, twin = [x[rep[-1:]] for x in rows], bool(before[-1])
        yield _batch(*out)
    if last is not None and (twin or last[4][0] >= REPEATS_INSIDE):
        yield _batch(tuple(last))


def shared_windows(contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, context number, start) of every window of LENGTH bytes; equal windows have the same class.

    The contexts, each closed by a terminator of its own, are sorted by suffix; level by level, the boundary between two
    neighbouring suffixes of common prefix l is found from the interval between two successive occurrences of a symbol in the
    transform that holds a boundary of l - 1 (backward extension by that symbol).  Expansion stops at LENGTH or when a level
    finds nothing.
    """
    size = np.array([len(x) + 1 for x in contexts])
    begin = np.r_[0, np.cumsum(size)]
    n = int(begin[-1])
    s = np.zeros(n + 8, np.uint64)
    s[:n] = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    ends = begin[1:] - 1
    s[ends] = 256
    final = np.zeros(n, bool)  # a terminator is among the symbols compared so far
    key = np.zeros(n, np.uint64)
    for j in range(7):
        key = (key << np.uint64(9)) | np.where(final, np.uint64(0), s[j : j + n])
        final |= s[j : j + n] == 256
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.r_[True, (k[1:] != k[:-1]) | final[order[1:]]]
    h = 7
    rank = np.empty(n + 1, np.int64)
    while True:
        rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
        rank[n] = 0
        alone = new & np.r_[new[1:], True]
        if alone.all():
            break
        tied = np.flatnonzero(~alone)
        where = order[tied]
        second = rank[np.minimum(where + h, n)]
        group = rank[where]
        deeper = np.argsort(group * (n + 1) + second, kind="stable")
        order[tied] = where[deeper]
        g, r = group[deeper], second[deeper]
        fresh = np.r_[True, (g[1:] != g[:-1]) | (r[1:] != r[:-1])]
        new[tied] |= fresh
        h *= 2
    # from here order is the suffix array and rank its inverse
    first = s[order]
    parted = np.r_[True, (first[1:] != first[:-1]) | (first[1:] == 256)]
    after = rank[np.minimum(order + 1, n - 1)]
    open_ = np.flatnonzero(~parted)
    left, right = after[open_ - 1], after[open_]
    for _ in range(LENGTH - 1):
        total = np.cumsum(parted, dtype=np.int32)
        hit = total[right] != total[left]
        if not hit.any():
            break
        parted[open_[hit]] = True
        stay = ~hit
        open_, left, right = open_[stay], left[stay], right[stay]
    cls = np.cumsum(parted)
    which = np.repeat(np.arange(len(contexts)), size)[order]
    start = order - begin[which]
    window = start <= size[which] - 1 - LENGTH
    return cls[window], which[window], start[window]


def _compare(batches):
    """(4): from rows (v, c, doc, p, n, context) to spans of repeats; without a context, windows met by hash."""
    plain, held, size, last = [], [], 0, None

    def transform(rows):
        cls, which, start = shared_windows([r[3] for r in rows])
        doc, p = (np.array([r[k] for r in rows], np.int64)[which] for k in (1, 2))
        order = np.lexsort((p + start, doc, cls))
        again = order[np.r_[False, cls[order][1:] == cls[order][:-1]]]
        return _batch(_spans(doc[again], p[again] + start[again], np.ones(len(again), np.int64)))

    for batch in batches:
        ctx = batch.column(5)
        hashed = ctx.is_null().to_numpy(zero_copy_only=False)
        cols = _columns(batch)
        if hashed.any():
            plain.append([x[hashed] for x in cols])
        for k in np.flatnonzero(~hashed):
            if size > PIECE and cols[0][k] != last:
                yield transform(held)
                held, size = [], 0
            held.append((cols[0][k], cols[2][k], cols[3][k], ctx[int(k)].as_py()))
            size += len(held[-1][3])
            last = cols[0][k]
    if held:
        yield transform(held)
    if plain:
        known = [np.concatenate(x) for x in zip(*plain)]
        spans = known[4] < 0
        yield _batch(tuple(x[spans] for x in known), _meet([x[~spans] for x in known]))


def _fetch(batches):
    """(3): from (text, asked array of (v, c, p, n, hot), doc) to contexts, or to windows for hot keys."""
    for batch in batches:
        out, wide = [], []
        data, offsets = K.buffers(batch.column("text"))
        asked, doc = batch.column("asked"), batch.column("doc").to_numpy(zero_copy_only=False)
        cut, flat = asked.offsets.to_numpy(), asked.values if asked.offset == 0 else asked.flatten()
        v, c, p, n, hot = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(5))
        cut = cut - cut[0]
        for i in range(len(doc)):
            text = data[offsets[i] : offsets[i + 1]]
            for k in range(cut[i], cut[i + 1]):
                m = int(n[k]) % REPEATS_INSIDE
                piece = text[p[k] : p[k] + m + LENGTH - 1]
                if hot[k]:
                    sums, at = K.prefix_sums(piece), np.arange(m)
                    h = K.spans_hash(sums, at, at + LENGTH)
                    g = K.spans_hash(K.prefix_sums(piece[::-1].copy()), at, at + LENGTH)[::-1]
                    wide.append((h.view(np.int64), g.view(np.int64), np.full(m, doc[i]), p[k] + at, np.ones(m, np.int64)))
                else:
                    out.append((v[k], c[k], doc[i], p[k], n[k], piece.tobytes()))
        cols = list(zip(*out)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(cols, [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary()]))], [*FIELDS, "ctx"])
        if wide:
            w = [np.concatenate(x) for x in zip(*wide)]
            order, new = earliest(*w[:4])
            again = order[~new]
            b = _batch(tuple(x[order[new]] for x in w), _spans(w[2][again], w[3][again], w[4][again]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.binary())], [*FIELDS, "ctx"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, start, end) byte ranges to remove, possibly touching, from rows (doc, text) with distinct doc numbers."""
    schema = "v long, c long, doc long, p int, n int"
    listed = docs.mapInArrow(_list_runs, schema).repartition("v").sortWithinPartitions("v", "c", "doc", "p").mapInArrow(_reduce_runs, schema)
    met = written(listed, "runs")
    asked = met.where("n > 0")
    hot = written(asked.groupBy("v").count().where(F.col("count") > HOT).select("v", F.lit(True).alias("hot")), "hot")
    asked = asked.join(F.broadcast(hot) if small(hot) else hot, "v", "left")
    asked = asked.groupBy("doc").agg(F.collect_list(F.struct("v", "c", "p", "n", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("asked"))
    asked = written(asked, "asked")
    ids = asked.select("doc")
    some = docs.join(F.broadcast(ids), "doc", "left_semi") if small(ids) else docs
    fetched = some.join(asked, "doc").select("text", "asked", "doc").mapInArrow(_fetch, schema + ", ctx binary")
    compared = fetched.repartition("v").sortWithinPartitions("v").mapInArrow(_compare, schema)
    return met.union(written(compared, "compared")).where("n < 0").select("doc", F.col("p").alias("start"), (F.col("p") - F.col("n")).alias("end"))


def _cut(with_text: bool):
    def run(batches):
        for batch in batches:
            data, offsets = K.buffers(batch.column("text"))
            spans = batch.column("spans").to_pylist()
            size, gone, count, digest, kept = [], [], [], [], []
            for i in range(len(offsets) - 1):
                text = data[offsets[i] : offsets[i + 1]]
                if spans[i]:
                    s = np.array([(x["start"], x["end"]) for x in spans[i]], np.int64)
                    _, a, b = merged(np.zeros(len(s), np.int64), s[:, 0], s[:, 1])
                    mark = np.zeros(len(text) + 1, np.int8)
                    mark[a] += 1
                    mark[b] -= 1
                    rest = text[np.cumsum(mark[:-1]) == 0].tobytes()
                else:
                    a, rest = [], text.tobytes()
                size.append(len(text))
                gone.append(len(text) - len(rest))
                count.append(len(a))
                digest.append(hashlib.sha256(rest).hexdigest())
                if with_text:
                    kept.append(rest)
            cols = [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                cols, names = [*cols, pa.array(kept, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row (doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) per row of docs.

    kept, asked for by with_text, are the remaining bytes (cuts may fall inside a UTF-8 character).  A null text is empty and keeps
    nothing.  Where ids repeat or are null, documents are ordered by id (nulls last), then by the text's SHA-256; rows of equal id
    and text are one document and get the same result.  An empty table gives an empty one; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = docs.select(F.col(id_col).cast("long").alias("i"))
    plain = ids.agg((F.count("*") == F.count("i")) & (F.count("*") == F.count_distinct("i"))).first()[0]
    if plain:
        keyed = rows.withColumn("doc", F.col("doc_id"))
        unique = keyed.select("doc", "text")
    else:
        digested = rows.withColumn("d", F.sha2("text", 256))
        # after a sort the partitions are in order, so the ids that rise within and over partitions are too; writing fixes them
        sorted_ = digested.select(F.col("doc_id").alias("i"), "d").distinct().orderBy(F.col("i").asc_nulls_last(), "d")
        numbers = written(sorted_.withColumn("doc", F.monotonically_increasing_id()), "numbers")
        keyed = digested.join(numbers.withColumnRenamed("d", "e"), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("d") == F.col("e"))).select("doc_id", "text", "doc")
        unique = keyed.groupBy("doc").agg(F.first("text").alias("text"))
    spans = repeated_spans(unique).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = written(spans, "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    found = spans.select("doc")
    if small(found):  # the texts of other documents need not be shuffled
        hit = keyed.join(F.broadcast(found), "doc", "left_semi").join(spans, "doc").select("doc_id", "text", "spans")
        rest = keyed.join(F.broadcast(found), "doc", "left_anti").select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
        return hit.mapInArrow(_cut(with_text), schema).union(rest.mapInArrow(_cut(with_text), schema))
    return keyed.join(spans, "doc", "left").select("doc_id", "text", "spans").mapInArrow(_cut(with_text), schema)
