"""Folds over the few shapes or characters of one page, which depend on what was accepted before: Arrow-fed pandas, page by page."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.params import PARAMS

PAGE = ["doc_id", "page_index"]


def _covered(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    area = (a[2] - a[0]) * (a[3] - a[1])
    return w * h / area if w > 0 and h > 0 and area > 0 else 0.0


def _merged(boxes: np.ndarray, tolerance: float) -> np.ndarray:
    """Hulls of boxes that touch within the tolerance, until none touch; each pass merges all connected ones at once."""
    while len(boxes) > 1:
        low, high = boxes[:, :2] - tolerance, boxes[:, 2:]
        near = (low[:, None, :] <= high[None, :, :]).all(axis=2)
        near &= near.T
        label = np.arange(len(boxes))
        while True:
            least = np.where(near, label[None, :], len(boxes)).min(axis=1)
            if (least == label).all():
                break
            label = least
        heads = np.unique(label)
        if len(heads) == len(boxes):
            break
        boxes = np.array([[*boxes[label == k, :2].min(axis=0), *boxes[label == k, 2:].max(axis=0)] for k in heads])
    return boxes


def vector_figures(shapes: DataFrame, rasters: DataFrame, width: float, height: float, tolerance: float = 3.0) -> DataFrame:
    """(doc_id, page_index, figure_seq, x0, y0, x1, y1): drawings clustered by nearness; small or narrow clusters, those that a raster covers
    in part, and those mostly inside one accepted before are dropped."""

    def page(key, mine: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        boxes = _merged(mine[["x0", "y0", "x1", "y1"]].to_numpy(np.float64), tolerance)
        kept: list = []
        pictures = other[["x0", "y0", "x1", "y1"]].to_numpy() if len(other) else np.zeros((0, 4))
        for b in boxes[np.lexsort((boxes[:, 0], boxes[:, 1]))]:
            area = (b[2] - b[0]) * (b[3] - b[1])
            if area < 0.025 * width * height or b[2] - b[0] < 0.20 * width:
                continue
            if any(_covered(b, p) >= PARAMS.vector_raster_overlap for p in pictures) or any(_covered(b, k) >= 0.80 for k in kept):
                continue
            kept.append(b)
        return pd.DataFrame([(key[0], key[1], k, *b) for k, b in enumerate(kept)], columns=["doc_id", "page_index", "figure_seq", "x0", "y0", "x1", "y1"])

    schema = "doc_id long, page_index int, figure_seq int, x0 double, y0 double, x1 double, y1 double"
    return shapes.groupBy(*PAGE).cogroup(rasters.groupBy(*PAGE)).applyInPandas(page, schema)


def anchors(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, image_seq, block_no): for each image in order the first block, at or after the one of the image before, that
    contains its anchor's text, markup aside; null if none does.  One fold over the document's blocks as an array."""
    key = T.match_key
    listed = blocks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("block_no", key("text").alias("text")))).alias("blocks"))
    asked = images.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("image_seq", key("anchor").alias("anchor")))).alias("images"))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<image_seq:int,block_no:bigint>>").alias("out"))

    def step(acc, x):
        rest = F.slice("blocks", acc["at"] + 1, F.size("blocks"))
        hit = F.array_position(F.transform(rest, lambda b: F.contains(b["text"], x["anchor"])), True).cast("int")
        found = F.coalesce((x["anchor"] != "") & (hit > 0), F.lit(False))
        at = F.when(found, acc["at"] + hit - 1).otherwise(acc["at"])
        one = F.struct(x["image_seq"].alias("image_seq"), F.when(found, F.get("blocks", at)["block_no"]).alias("block_no"))
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    met = asked.join(listed, "doc_id", "left").withColumn("blocks", F.coalesce("blocks", F.array().cast("array<struct<block_no:bigint,text:string>>")))
    return met.select("doc_id", F.explode(F.aggregate("images", state, step)["out"]).alias("x")).select("doc_id", "x.*")


def moved_images(blocks: DataFrame, placed: DataFrame) -> DataFrame:
    """(doc_id, place, text): the blocks of a page's text with its images behind the blocks that they belong to.

    blocks (doc_id, block_no, text) holds the text blocks, placed (doc_id, image_seq, block_no, embed) the images: behind their block, in their
    order; those without one stand at the end.
    """
    last = F.lit(2**62)
    rows = blocks.select("doc_id", F.col("block_no").cast("long").alias("a"), F.lit(-1).alias("b"), "text")
    rows = rows.unionByName(placed.select("doc_id", F.coalesce(F.col("block_no").cast("long"), last).alias("a"), F.col("image_seq").cast("int").alias("b"), F.col("embed").alias("text")))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("a", "b")) - 1
    return rows.select("doc_id", place.alias("place"), "text")


def is_drawn_figure(fill: Column, x0: Column, y0: Column, x1: Column, y1: Column, rectangle: Column, width: float, height: float) -> Column:
    """A drawing under half the page that is filled with a colour (fill: array of red, green, blue) or is a rectangle of some size."""
    area, page = (x1 - x0) * (y1 - y0), width * height
    colour = F.coalesce((F.array_min(fill) < 0.96) & (F.array_max(fill) - F.array_min(fill) >= 0.08), F.lit(False))
    return (area < 0.5 * page) & (colour | (rectangle & (area >= 0.025 * page)))


def is_raster(kind: Column, image: Column) -> Column:
    """An image block that has its bytes."""
    return (kind == "image") & image.isNotNull()


def figure_region(x0: Column, y0: Column, x1: Column, y1: Column, scale: float = 2.0, margin: float = 3.0) -> Column:
    """Of a figure's picture: the region with its margin and the pixels of it."""
    w, h = x1 - x0 + 2 * margin, y1 - y0 + 2 * margin
    return F.struct((x0 - margin).alias("x0"), (y0 - margin).alias("y0"), (x1 + margin).alias("x1"), (y1 + margin).alias("y1"), F.ceil(w * scale).cast("int").alias("pixels_x"), F.ceil(h * scale).cast("int").alias("pixels_y"))


def image_counts(figures: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id, n_images): figures, and the parts of tables (doc_id, n_parts, as_image) that are shown as pictures."""
    parts = tables.where("as_image").select("doc_id", F.col("n_parts").cast("long").alias("n"))
    return figures.select("doc_id", F.lit(1).cast("long").alias("n")).unionByName(parts).groupBy("doc_id").agg(F.sum("n").alias("n_images"))


def coloured_share(pixels: Column) -> Column:
    """Share of pixels (array of red, green, blue from 0 to 255) that are light enough to be paper and yet coloured."""
    luma = lambda p: 0.299 * p[0] + 0.587 * p[1] + 0.114 * p[2]
    hit = F.filter(pixels, lambda p: (luma(p) >= 100) & (F.array_min(p) < 245))
    return F.when(F.size(pixels) > 0, F.size(hit) / F.size(pixels)).otherwise(0.0)


def joined_numbers(lines: DataFrame) -> DataFrame:
    """(doc_id, page_index, line_seq, text): a bare number and the title beside it on one baseline become one line; pairs don't overlap."""
    state = F.struct(F.lit(None).cast("struct<line_seq:int,text:string,y0:double,x0:double,x1:double>").alias("held"), F.array().cast("array<struct<line_seq:int,text:string>>").alias("out"))
    item = F.struct("y0", "x0", "line_seq", "text", "x1")

    def flush(acc):
        return F.when(acc["held"].isNotNull(), F.concat(acc["out"], F.array(F.struct(acc["held"]["line_seq"].alias("line_seq"), acc["held"]["text"].alias("text"))))).otherwise(acc["out"])

    def step(acc, x):
        gap = x["x0"] - acc["held"]["x1"]
        pair = F.coalesce(acc["held"]["text"].rlike(r"^[0-9]{1,3}[.)]$") & (F.abs(x["y0"] - acc["held"]["y0"]) <= 2) & (gap >= 0) & (gap <= 24), F.lit(False))
        mine = F.struct(x["line_seq"].alias("line_seq"), x["text"].alias("text"), x["y0"].alias("y0"), x["x0"].alias("x0"), x["x1"].alias("x1"))
        both = F.array(F.struct(acc["held"]["line_seq"].alias("line_seq"), F.concat(acc["held"]["text"], F.lit(" "), x["text"]).alias("text")))
        return F.struct(F.when(~pair, mine).alias("held"), F.when(pair, F.concat(acc["out"], both)).otherwise(flush(acc)).alias("out"))

    folded = lines.groupBy(*PAGE).agg(F.sort_array(F.collect_list(item)).alias("items"))
    return folded.select(*PAGE, F.explode(F.aggregate("items", state, step, flush)).alias("x")).select(*PAGE, "x.*")


def footnote_bodies(lines: DataFrame) -> DataFrame:
    """(doc_id, page_no, note_no, body): a body begins at a line that starts with a number referred to on its page, the first such line of each
    number, and goes on to the next one."""
    refs = F.array_distinct(F.flatten(F.collect_list(F.regexp_extract_all("line", F.lit(r"\[\^([0-9]{1,3})\]"), F.lit(1))).over(Window.partitionBy("doc_id", "page_no"))))
    n = F.regexp_extract("line", r"^([0-9]{1,3})\s+\S", 1)
    rows = lines.withColumn("refs", refs).withColumn("n", F.when((n != "") & F.array_contains("refs", n), n))
    w = Window.partitionBy("doc_id", "page_no").orderBy("pos")
    rows = rows.withColumn("first", F.row_number().over(Window.partitionBy("doc_id", "page_no", "n").orderBy("pos")) == 1)
    rows = rows.withColumn("starts", F.col("n").isNotNull() & F.col("first")).withColumn("run", F.sum(F.col("starts").cast("int")).over(w)).where("run > 0")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ")
    out = rows.groupBy("doc_id", "page_no", "run").agg(F.min_by("n", "pos").cast("int").alias("note_no"), T.sub(body, r"^[0-9]{1,3}\s+").alias("body"))
    return out.select("doc_id", "page_no", "note_no", "body")
