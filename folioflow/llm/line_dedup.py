"""Fuzzy line deduplication in DataFrame functions only: MinHash signatures, banding, exact Jaccard, distributed union-find.

A line's shingles are its 5-character substrings at every place (a line of fewer characters is its own shingle), as a set of 64-bit
hashes.  The hashes, in order, close to a ring that is cut into STARTS equal arcs.  A band is the run of the next few hashes from an arc's
beginning on, a MinHash sketch of as many rows: two lines of similarity s agree in a run of r with probability s ** r.  Long lines have runs of 7,
so 16 bands find a pair of similarity 0.8 with probability 0.97; lines of fewer shingles, whose runs overlap, have shorter runs and a second
ring of rehashed shingles.  LEVELS overlap, so lines of similar enough sizes always have a level in common.

In each bucket a centre is paired with the rest (a star): first the member that shares most buckets with others, then, where
different components are left, another one.  These pairs are verified by the exact Jaccard index of all shingles, and union-find joins
them.  A centre that has been compared with all of its bucket leaves it; what then is in different
components of one bucket is compared inside a join, by the same index, so only links leave it.  Equal lines
meet by 128 bits of hash before any of this.  Of each component the earliest line stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import components, maybe_broadcast, rows_of, written

THRESHOLD = 0.8
WIDTH = 5
#: Hashes in a run, the least number of shingles that has such runs, number of rings.
LEVELS = ((3, 3, 2), (4, 8, 2), (5, 20, 2), (7, 64, 1))
STARTS_BITS = 4
STARTS = 1 << STARTS_BITS
#: The least number of each arc.
EDGES = tuple((k << (64 - STARTS_BITS)) - (1 << 63) for k in range(STARTS))
STARS = 2
#: Shared bands, one number each, that may be broadcast (16 MB of numbers); with more, they meet by shuffle.
BANDS_ROWS = 2_000_000


def _grams(line: str) -> Column:
    """The 64-bit hashes of the 5-character shingles at every place of a line, repeated ones too; of a shorter line its own hash."""
    # four bytes a character, so that a shingle is found by its place; bound by a lambda, or else the line would be encoded for each shingle
    size = 4 * WIDTH
    places = lambda wide: F.sequence(F.lit(1), F.octet_length(wide) - (size - 1), F.lit(4))
    grams = lambda wide: F.transform(places(wide), lambda i: F.xxhash64(F.call_function("substring", wide, i, F.lit(size))))
    found = F.transform(F.array(F.encode(line, "UTF-32")), lambda wide: F.when(F.octet_length(wide) < size, F.array(F.xxhash64(wide))).otherwise(grams(wide)))
    return F.get(found, F.lit(0))


def _shingles(line: str) -> Column:
    """The set of a line's shingles."""
    return F.array_distinct(_grams(line))


def _runs(r: int, run: int, low: int, high: int) -> Column:
    """Of the hashes of ring r, low <= number < high: from the first hash of each arc on, a hash of it and the next run - 1, round the ring."""
    keys = F.transform(f"leads{r}", lambda i: F.xxhash64(F.lit(run), F.slice(f"round{r}", i, F.lit(run))))
    return F.when((F.size(f"ring{r}") >= low) & (F.size(f"ring{r}") < high), keys).otherwise(F.array().cast("array<bigint>"))


def _leads(marks: str) -> Column:
    """Of each arc the place of its first hash in a ring, from marks, the ring sorted with EDGES: an edge stands behind as many edges as its number."""
    return F.array(*[(F.array_position(marks, F.lit(e)) - k).cast("int") for k, e in enumerate(EDGES)])


def _banded(lines: DataFrame) -> DataFrame:
    """lines with bands, the band keys of each, in place of line."""
    none = F.array().cast("array<bigint>")
    marks = lambda ring: F.sort_array(F.concat(ring, F.array(*[F.lit(e) for e in EDGES])))
    # an arc without hashes has the run of the next one, the last ones that of the first
    round_ = lambda ring: F.concat(ring, F.slice(ring, 1, LEVELS[-1][0]))
    spans = [(run, max(run, int(least * THRESHOLD)), LEVELS[k + 1][1] if k + 1 < len(LEVELS) else 1 << 31, many) for k, (run, least, many) in enumerate(LEVELS)]
    keys = lambda r: F.concat(*[_runs(r, run, low, high) for run, low, high, many in spans if many > r])
    # sets of one or two shingles: only equal ones are similar enough
    tiny = F.when(F.size("ring0") < LEVELS[0][1], F.array(F.xxhash64(F.lit(1), "ring0"))).otherwise(none)
    again = F.when(F.size("ring0") < LEVELS[-1][1], F.sort_array(F.transform("ring0", lambda x: F.xxhash64(F.lit(2), x)))).otherwise(none)
    rings = lines.withColumn("ring0", F.sort_array(_shingles("line"))).withColumns({"marks0": marks("ring0"), "round0": round_("ring0")})
    # leads stand beside a lambda: such a projection is compiled in pieces, without one as a single method, which is too long for the JIT compiler
    rings = rings.withColumns({"leads0": _leads("marks0"), "ring1": again}).withColumns({"marks1": marks("ring1"), "round1": round_("ring1")})
    rings = rings.withColumns({"leads1": _leads("marks1"), "keys0": keys(0)}).withColumn("bands", F.array_distinct(F.concat(tiny, "keys0", keys(1))))
    return rings.select(*[c for c in lines.columns if c != "line"], "bands")


def _place() -> Column:
    """Place of an occurrence as one number that sorts by document (null last), then line; it fits a hash aggregate's row."""
    doc = F.coalesce(F.col("doc").cast("decimal(38,0)"), F.lit(str(2**63)).cast("decimal(38,0)"))
    return (doc * F.lit(str(2**32)).cast("decimal(18,0)") + F.col("pos").cast("decimal(18,0)")).cast("decimal(38,0)")


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, row, pos, line, l1, l2, place): the lines of each row; row is a hash of the row's text, pos counts from 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("row"), F.split(text, "\n").alias("parts"))
    rows = rows.select("doc", "row", F.posexplode("parts").alias("pos", "line"))
    return rows.withColumns({"l1": F.xxhash64("line"), "l2": F.xxhash64(F.lit(1), "line"), "place": _place()})


def _similar(a: str, b: str, both: Column, threshold: float) -> Column:
    """Whether sets of a and b members, both of them common, have a Jaccard index of at least threshold."""
    total = F.col(a) + F.col(b)
    enough = lambda n: n >= threshold * (total - n)
    # against the least number that is enough: a filter or join evaluates each mention of both anew, and it is the dear part
    n = F.floor(threshold * total / (1 + threshold))
    return both >= F.when(enough(n - 1), n - 1).when(enough(n), n).when(enough(n + 1), n + 1).otherwise(n + 2)


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of l1 whose lines are similar enough, as structs (l1, l2)."""
    # sets of too different sizes can't be similar enough, whatever they share
    sizes = maybe_broadcast(written(texts.select("l1", "l2", "m"), "sizes"))
    met = pairs.join(sizes.toDF("a", "a2", "ma"), "a").join(sizes.toDF("b", "b2", "mb"), "b")
    met = met.where(F.least("ma", "mb") >= threshold * F.greatest("ma", "mb"))
    # the lines travel, not their shingles, which are eight times as large
    met = met.join(texts.select("l1", "l2", "line").toDF("a", "a2", "la"), ["a", "a2"]).join(texts.select("l1", "l2", "line").toDF("b", "b2", "lb"), ["b", "b2"])
    met = met.withColumn("both", F.size(F.array_intersect(_grams("la"), _grams("lb"))))
    met = met.where(_similar("ma", "mb", F.col("both"), threshold))
    return met.select(F.struct(F.col("a").alias("l1"), F.col("a2").alias("l2")).alias("a"), F.struct(F.col("b").alias("l1"), F.col("b2").alias("l2")).alias("b")).distinct()


def _rooted(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one component, with the root of each line (itself, if it has no link)."""
    of = written(roots.groupBy(F.col("id.l1").alias("l1")).agg(F.min("root").alias("r")), "of")
    rooted = buckets.join(maybe_broadcast(of), "l1", "left").withColumn("root", F.coalesce("r", F.struct("l1", F.lit(None).cast("long").alias("l2")))).drop("r")
    open_ = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
    return written(rooted.join(open_, "band"), "mixed")


def _rest(mixed: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between lines of one bucket in different components.

    The exact index is part of the join's condition: what is compared never leaves the join, only links do.  Two lines that share
    several buckets are compared in the least of them only.
    """
    mine = mixed.groupBy("l1").agg(F.collect_set("band").alias("bands"), F.min("root").alias("root"))
    sets = mine.join(texts, "l1").select("l1", "l2", "root", "bands", "m", _shingles("line").alias("g"))
    # written once a line, not once a bucket that it is in
    rows = written(sets, "compared").withColumn("band", F.explode("bands"))
    x, y = (rows.select(*[F.col(c).alias(f"{s}{c}") for c in rows.columns]) for s in "xy")
    near = (F.col("xband") == F.col("yband")) & (F.struct("xl1", "xl2") < F.struct("yl1", "yl2")) & (F.col("xroot") != F.col("yroot"))
    near = near & (F.least("xm", "ym") >= threshold * F.greatest("xm", "ym")) & (F.array_min(F.array_intersect("xbands", "ybands")) == F.col("xband"))
    links = x.join(y, near & _similar("xm", "ym", F.size(F.array_intersect("xg", "yg")), threshold))
    return links.select(F.struct(F.col("xl1").alias("l1"), F.col("xl2").alias("l2")).alias("a"), F.struct(F.col("yl1").alias("l1"), F.col("yl2").alias("l2")).alias("b"))


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(l1, l2, keep): the earliest (doc, pos) of the component, for each line that is repeated or similar to another."""
    lines = _lines(docs, id_col, text_col).where(F.trim("line") != "")
    # one pass over the texts gives both
    marked = written(_banded(lines.select("l1", "l2", "place", "line")), "signed")
    reps = written(marked.groupBy("l1", "l2").agg(F.min("place").alias("first"), F.count("*").alias("n")), "lines")
    signed = marked.select("l1", F.explode("bands").alias("band"))
    # combined before the shuffle, so a line that is very often repeated counts once a task
    shared = written(signed.groupBy("band").agg(F.min("l1").alias("lo"), F.max("l1").alias("hi")).where("lo <> hi").select("band"), "shared")
    buckets = written(signed.join(maybe_broadcast(shared, BANDS_ROWS), "band", "left_semi").distinct(), "members")
    weights = written(buckets.groupBy("l1").agg(F.count("*").alias("w")), "weights")
    buckets = written(buckets.join(maybe_broadcast(weights), "l1"), "buckets")
    # of each line in a bucket its text, from its earliest occurrence
    asked = written(reps.join(maybe_broadcast(weights), "l1", "left_semi").select(F.col("l1").alias("a1"), F.col("l2").alias("a2"), "first"), "asked")
    texts = lines.join(maybe_broadcast(asked), F.expr("l1 = a1 and l2 = a2 and place = first")).select("l1", "l2", "line").dropDuplicates(["l1", "l2"])
    texts = written(texts.withColumn("m", F.size(_shingles("line"))), "texts")
    links, mixed = None, buckets.withColumn("root", F.struct("l1", F.lit(None).cast("long").alias("l2")))
    for star in range(STARS):
        order = F.struct("w", "l1") if star == 0 else F.struct(F.xxhash64("l1", F.lit(star)))
        centres = mixed.groupBy("band").agg(F.max_by(F.struct("l1", "root"), order).alias("p")).select("band", F.col("p.l1").alias("centre"), F.col("p.root").alias("croot"))
        met = written(mixed.join(centres, "band").where("l1 <> centre"), "met")
        pairs = met.where(F.col("root") != F.col("croot")).select(F.least("l1", "centre").alias("a"), F.greatest("l1", "centre").alias("b")).distinct()
        found = _verified(written(pairs, "pairs"), texts, threshold)
        links = written(found if links is None else links.union(found).distinct(), "links")
        roots = written(components(links), "roots")
        # the centre has been compared with all others of its bucket
        mixed = _rooted(met.select("band", "l1", "w"), roots)
        if not rows_of(mixed):
            break
    else:
        more = written(_rest(mixed.select("band", "l1", "root"), texts, threshold), "rest")
        if rows_of(more):
            roots = written(components(links.union(more)), "roots")
    line = reps.select("l1", "l2", "first", "n", F.struct("l1", "l2").alias("id"))
    rooted = line.join(maybe_broadcast(roots), "id", "left")
    earliest = rooted.where("root is not null").groupBy("root").agg(F.min("first").alias("best"))
    found = rooted.join(maybe_broadcast(written(earliest, "earliest")), "root", "left").where("n > 1 or root is not null")
    return found.select("l1", "l2", F.coalesce("best", "first").alias("keep"))


def deduplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with all columns, the text without lines of which an equal or similar one comes earlier (by id, then line number).

    Blank lines stay.  Lines are parted by line feeds and joined again by them; a text may become empty, its row stays.
    A null text stays null.  Rows with a null id come last.  Rows of equal id count as one document: a line that two of them have at the same place
    stays in both.  An empty table gives an empty one.  Helper columns begin with __, whatever other columns there are.
    """
    classes = written(line_classes(docs, id_col, text_col, threshold), "classes")
    known = maybe_broadcast(classes)
    marked = _lines(docs, id_col, text_col).join(known, ["l1", "l2"], "left")
    stays = F.col("keep").isNull() | (F.col("keep") == F.col("place"))
    marked = marked.withColumn("stays", stays)
    hit = written(marked.where(~F.col("stays")).select("doc").distinct(), "hit")
    # only documents that lose a line are taken apart; the ids that do are few enough to broadcast, or else met by shuffle
    affected = maybe_broadcast(hit)
    row = F.struct(*[docs[c] for c in docs.columns]).alias("__row")
    keyed = docs.select(row, F.col(id_col).cast("long").alias("__doc"))
    rest = keyed.join(affected, F.col("__doc").eqNullSafe(F.col("doc")), "left_anti").select("__row.*")
    some = keyed.join(affected, F.col("__doc").eqNullSafe(F.col("doc")), "left_semi")
    lines = _lines(some.select(F.col("__doc").alias(id_col), F.col(f"__row.{text_col}").alias(text_col)), id_col, text_col)
    lines = lines.distinct() if _repeats(some) else lines
    kept = lines.join(known, ["l1", "l2"], "left").groupBy("doc", "row").agg(F.collect_list(F.when(stays, F.struct("pos", "line"))).alias("kept"))
    text = F.array_join(F.transform(F.sort_array("kept"), lambda x: x["line"]), "\n")
    kept = kept.select(F.col("doc").alias("__d"), F.col("row").alias("__r"), text.alias("__text"))
    # the text travels once, cut; the other columns meet it by document and hash of the text
    met = some.withColumn("__h", F.xxhash64(F.coalesce(F.col(f"__row.{text_col}"), F.lit("")))).withColumn("__null", F.col(f"__row.{text_col}").isNull())
    met = met.withColumn("__row", F.col("__row").dropFields(text_col)) if len(docs.columns) > 1 else met
    met = met.join(kept, F.col("__doc").eqNullSafe(F.col("__d")) & (F.col("__h") == F.col("__r")))
    new = F.when(~F.col("__null"), F.col("__text"))
    cols = [new.alias(c) if c == text_col else F.col(f"__row.{c}").alias(c) for c in docs.columns]
    return rest.unionByName(met.select(*cols))


def _repeats(some: DataFrame) -> bool:
    return bool(some.groupBy("__doc").count().where("count > 1").limit(1).count())
