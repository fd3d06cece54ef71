"""Benchmark decontamination in DataFrame functions only: SimHash of item-sized windows, multi-index Hamming search, exact check.

Texts are lower case, parted at white space; shingles have five words (an item of fewer words has one shingle of all of them)
and weigh as often as they occur.  A window has as many words as an item and begins where a shingle that the document shares with the
item puts the item's beginning; windows that share no shingle with any item have similarity 0, so leaving them out loses
nothing.  Every window and item gets a 64-bit SimHash.  The index cuts fingerprints into BLOCKS blocks and lists each item
under every value within NEAR bits of its block's value: two fingerprints at most RADIUS = BLOCKS * (NEAR + 1) - 1 bits apart
agree within NEAR in some block, so the equi-join by block value finds all pairs within the radius.  At a similarity of 0.8 two fingerprints
differ in 10 bits on average, with a standard deviation of 3.  Pairs within the radius are verified by the weighted Jaccard
index of their shingles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import BROADCAST_ROWS, maybe_broadcast, rows_of, written

WORDS = 5
THRESHOLD = 0.8
#: Bits of each block; together 64.
BLOCKS = (13, 13, 13, 13, 12)
NEAR = 3
RADIUS = len(BLOCKS) * (NEAR + 1) - 1


def _words(text: Column) -> Column:
    """The words; an empty array for a text without any."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def _hashes(words: Column, size: int) -> Column:
    """Hash of each run of size words, given the words' hashes; empty if there are fewer."""
    runs = F.sequence(F.lit(0), F.size(words) - size)
    found = F.transform(runs, lambda i: F.xxhash64(F.lit(size), *[F.get(words, i + k) for k in range(size)]))
    return F.when(F.size(words) >= size, found).otherwise(F.array().cast("array<bigint>"))


def _simhash(rows: DataFrame, key: list[str]) -> DataFrame:
    """key and fp from rows (key, h, n): of each bit the sign of the sum of n times plus or minus one."""
    sums = [F.sum(F.when(F.shiftright("h", j).bitwiseAND(F.lit(1).cast("long")) == 1, F.col("n")).otherwise(-F.col("n"))).alias(f"b{j}") for j in range(64)]
    bits = [F.when(F.col(f"b{j}") > 0, F.shiftleft(F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long")) for j in range(64)]
    return rows.groupBy(*key).agg(*sums).select(*key, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fp"))


def _blocks(fp: str, near: bool) -> Column:
    """array<struct<block, value>> of a fingerprint; near: all values within NEAR bits."""
    out, shift = [], 0
    for k, width in enumerate(BLOCKS):
        value = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long")).cast("int")
        masks = F.filter(F.sequence(F.lit(0), F.lit((1 << width) - 1)), lambda m: F.bit_count(m) <= NEAR) if near else F.array(F.lit(0))
        out.append(_block(masks, value, k))
        shift += width
    return F.concat(*out)


def _block(masks: Column, value: Column, k: int) -> Column:
    return F.transform(masks, lambda m: F.struct(F.lit(k).alias("block"), value.bitwiseXOR(m).alias("value")))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc, row, item_id, start, n_words, similarity): the best window of each document and item with similarity >= threshold.

    row is a hash of the document's text, which tells rows of equal or null id apart; equal rows give one result.  start counts words from 0;
    ties go to the earliest.  A document shorter than an item is one window.  Null and empty texts have no windows, and an item
    without words matches nothing; an item id on several rows stands for each of its texts.  Empty tables give an empty one.
    Only ids and texts are read, whatever other columns there are.
    """
    words = items.select(F.col(item_id).alias("item"), _words(F.col(item_text)).alias("w")).where(F.size("w") > 0)
    words = words.select("item", F.xxhash64(F.concat_ws(" ", "w")).alias("it"), F.size("w").alias("len"), F.transform("w", lambda w: F.xxhash64(w)).alias("w")).distinct()
    words = words.withColumn("size", F.least("len", F.lit(WORDS)))
    sizes = sorted(r.size_ for r in words.select(F.col("size").alias("size_")).distinct().collect())  # five values at most
    if not sizes:
        sizes = [WORDS]
    each = reduce(lambda a, b: a.union(b), [words.where(F.col("size") == s).select("item", "it", "len", "size", F.posexplode(_hashes(F.col("w"), s)).alias("at", "h")) for s in sizes])
    each = written(each, "items")
    placed = each.select("h", "at", "len", "size").distinct()

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("row"), F.transform(_words(text), lambda w: F.xxhash64(w)).alias("w"))
    shingled = rows.select("doc", "row", F.size("w").alias("total"), F.posexplode(F.concat(*[_hashes(F.col("w"), s) for s in sizes])).alias("p", "h"))
    hits = shingled.join(maybe_broadcast(placed), "h")
    # the place of a shingle in the concatenation tells its size's part; take that off
    part = F.lit(0)
    for s in sizes[:-1]:
        part = part + F.when(F.col("size") > s, F.greatest(F.col("total") - s + 1, F.lit(0))).otherwise(0)
    begin = F.col("p") - part - F.col("at")
    windows = hits.select("doc", "row", F.greatest(F.lit(0), F.least(begin, F.col("total") - F.col("len"))).alias("start"), "len", "size").distinct()
    windows = written(windows, "windows")
    asked = windows.groupBy("doc", "row").agg(F.collect_list(F.struct("start", "len", "size")).alias("asked"))
    # what a document asks for is as large as its windows are many, so the windows decide whether it may be broadcast
    asked = F.broadcast(asked) if rows_of(windows) <= BROADCAST_ROWS else asked
    again = rows.withColumnsRenamed({"doc": "__doc", "row": "__row"}).join(asked, F.col("__doc").eqNullSafe(F.col("doc")) & (F.col("__row") == F.col("row")))
    again = again.dropDuplicates(["doc", "row"]).select("doc", "row", "w", F.explode("asked").alias("a")).select("doc", "row", "a.*", F.expr("slice(w, a.start + 1, a.len)").alias("w"))
    again = reduce(lambda a, b: a.union(b), [again.where(F.col("size") == s).select("doc", "row", "start", "len", "size", F.explode(_hashes(F.col("w"), s)).alias("h")) for s in sizes])
    wkey, ikey = ["doc", "row", "start", "len", "size"], ["item", "it", "size"]
    ours = written(again.groupBy(*wkey, "h").agg(F.count("*").alias("n")), "window_shingles")
    theirs = written(each.groupBy(*ikey, "h").agg(F.count("*").alias("n")), "item_shingles")

    index = _simhash(theirs, ikey).select(*ikey, F.col("fp").alias("ifp"), F.explode(_blocks("fp", True)).alias("b")).select(*ikey, "ifp", "b.*")
    probes = _simhash(ours, wkey).select(*wkey, "fp", F.explode(_blocks("fp", False)).alias("b")).select(*wkey, "fp", "b.*")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= RADIUS
    index = maybe_broadcast(written(index, "index"))
    met = probes.join(index.withColumnsRenamed({"block": "ib", "value": "iv", "size": "is"}), F.expr("block = ib and value = iv and size = `is`") & near)
    pairs = written(met.select(*wkey, "item", "it").distinct(), "candidates")

    total_w, total_i = ours.groupBy(*wkey).agg(F.sum("n").alias("nw")), theirs.groupBy(*ikey).agg(F.sum("n").alias("ni"))
    null_safe = lambda a, b, key: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in key])
    # ids may be null: they meet by null-safe equality
    p = pairs.alias("p").join(ours.alias("o"), null_safe("p", "o", wkey)).select("p.*", "o.h", F.col("o.n").alias("a"))
    both = p.alias("p").join(theirs.alias("t"), null_safe("p", "t", [*ikey, "h"])).groupBy(*[F.col(f"p.{c}") for c in [*wkey, "item", "it"]]).agg(F.sum(F.least("p.a", "t.n")).alias("both"))
    both = both.alias("p").join(total_w.alias("w"), null_safe("p", "w", wkey)).select("p.*", "w.nw").alias("p").join(total_i.alias("i"), null_safe("p", "i", ikey)).select("p.*", "i.ni")
    scored = both.select("doc", "row", "item", "start", "len", (F.col("both") / (F.col("nw") + F.col("ni") - F.col("both"))).alias("similarity"))
    best = scored.where(F.col("similarity") >= threshold).groupBy("doc", "row", "item").agg(F.max_by(F.struct("start", "len", "similarity"), F.struct("similarity", -F.col("start"))).alias("b"))
    return best.select("doc", "row", F.col("item").alias("item_id"), "b.start", F.col("b.len").alias("n_words"), "b.similarity")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that hold an item; the others and all columns as they were."""
    found = contaminated(docs, items, id_col, text_col).select(F.col("doc").alias("__doc"), F.col("row").alias("__row")).distinct()
    found = maybe_broadcast(written(found, "contaminated"))
    return docs.join(found, F.col(id_col).cast("long").eqNullSafe(F.col("__doc")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("__row")), "left_anti")
