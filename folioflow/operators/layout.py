"""Geometry of laid-out pages: bands, repeated headers, headings, paragraphs, reading order, overlaps.

Lines have doc_id, page_index, line_seq, text, size, bold, x0, y0, x1, y1.  One shuffle by document serves all windows: those by (doc_id,
page_index) reuse the partitioning by doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.params import PARAMS

PAGE = ["doc_id", "page_index"]
# Signs of list items, titles of a summary.
SIGNS = ("▪", "❖", "➢", "✓", "●", "○", "•", "◦", "=", "*", "+")
SUMMARY = ("sumário", "roteiro de aula")


def by_document(lines: DataFrame) -> DataFrame:
    return lines.repartition("doc_id")


def overlap(inner: tuple, outer: tuple) -> Column:
    """Share of the inner box that the outer one covers; 0 for an empty box."""
    ix0, iy0, ix1, iy1 = (F.col(c) for c in inner)
    ox0, oy0, ox1, oy1 = (F.col(c) for c in outer)
    w, h = F.least(ix1, ox1) - F.greatest(ix0, ox0), F.least(iy1, oy1) - F.greatest(iy0, oy0)
    area = (ix1 - ix0) * (iy1 - iy0)
    return F.when((w > 0) & (h > 0) & (ix1 > ix0) & (iy1 > iy0), w * h / area).otherwise(0.0)


LINE, FIGURE, BOX = ("x0", "y0", "x1", "y1"), ("fx0", "fy0", "fx1", "fy1"), ("tx0", "ty0", "tx1", "ty1")


def bands(lines: DataFrame, height: float) -> DataFrame:
    """lines with band: header (top), footer (bottom) or body."""
    return lines.withColumn("band", F.when(F.col("y0") >= PARAMS.footer_band * height, "footer").when(F.col("y0") <= PARAMS.header_band * height, "header").otherwise("body"))


def repeated_headers(lines: DataFrame, height: float) -> DataFrame:
    """(doc_id, key, n_pages): header texts that stand on enough pages."""
    top = bands(lines, height).where("band = 'header'").select("doc_id", "page_index", T.running_key("text").alias("key")).where(F.length("key") >= PARAMS.header_min_chars)
    return top.groupBy("doc_id", "key").agg(F.count_distinct("page_index").alias("n_pages")).where(F.col("n_pages") >= PARAMS.header_min_pages)


def body_lines(lines: DataFrame, height: float) -> DataFrame:
    """Lines without footers and repeated headers."""
    repeated = repeated_headers(lines, height).select(F.col("doc_id").alias("d"), F.col("key").alias("k"))
    banded = bands(lines, height).where("band <> 'footer'")
    hit = (F.col("doc_id") == F.col("d")) & (T.running_key("text") == F.col("k")) & (F.col("band") == "header")
    return banded.join(repeated, hit, "left_anti").drop("band")


def printed_pages(lines: DataFrame, height: float) -> DataFrame:
    """(doc_id, page_index, label): the last footer number if every page has one and they rise, else the page's own number."""
    foot = F.when(F.col("y0") >= PARAMS.footer_band * height, F.regexp_extract_all("text", F.lit(r"\b([0-9]{1,3})\b"), F.lit(1)))
    last = F.element_at(F.filter(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("line_seq", foot.alias("n")))), lambda x: F.coalesce(x["n"], F.array().cast("array<string>")))), lambda x: x != ""), -1)
    pages = lines.groupBy(*PAGE).agg(F.when(F.size(F.flatten(F.collect_list(foot))) > 0, last).cast("int").alias("n"))
    w = Window.partitionBy("doc_id").orderBy("page_index")
    prev = F.lag("n").over(w)
    ok = F.coalesce(F.col("n").isNotNull() & (prev.isNull() | (F.col("n") > prev)), F.lit(False))
    pages = pages.withColumn("ok", ok)
    every = F.bool_and("ok").over(Window.partitionBy("doc_id"))
    return pages.select(*PAGE, F.when(every, F.col("n")).otherwise(F.col("page_index") + 1).alias("label"), every.alias("printed"))


def upper_median(lines: DataFrame) -> DataFrame:
    """(doc_id, median): the upper median of the line sizes, sorted[n / 2]."""
    return lines.groupBy("doc_id").agg(F.get(F.sort_array(F.collect_list("size")), F.floor(F.count("*") / 2).cast("int")).alias("median"))


def with_median(lines: DataFrame) -> DataFrame:
    """lines with the upper median of their document's sizes, by windows over the one partitioning by document."""
    doc = Window.partitionBy("doc_id")
    ranked = lines.withColumns({"__rank": F.row_number().over(doc.orderBy("size")), "__n": F.count("*").over(doc)})
    return ranked.withColumn("median", F.max(F.when(F.col("__rank") == F.floor(F.col("__n") / 2) + 1, F.col("size"))).over(doc)).drop("__rank", "__n")


def is_upper(c: Column) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c)


def plain_text(c) -> Column:
    """A line's text with single blanks."""
    return T.strip(T.sub(c, r"\s+", " "))


def is_block_title(t: Column) -> Column:
    return (F.lower(T.word(t)) == "bloco") & T.after(t, T.word(t)).rlike(r"^\s+[0-9]+$")


def is_title(t: Column, bold: Column, size: Column, height: Column, centered: Column, page: Column, median: Column) -> Column:
    """A heading by its text and style; capitals alone make none on the first page."""
    styled = bold | is_upper(t) | (size >= median * 1.12)
    large = centered | (size >= median * 1.08) | (height >= F.greatest(F.lit(PARAMS.heading_min_height), median * 1.08))
    ended = t.rlike(r"[.!?:;]$") | t.rlike(r"[.!?]\s+[0-9A-Za-zÀ-ÿ_]{1,3}$")
    return (
        F.when((F.length(t) < 3) | (F.length(t) > 120) | ended, False)
        .when(is_block_title(t), True)
        .when(T.numbered(t)["number"] != "", (F.length(t) <= 85) & styled)
        .when(T.lettered(t) != "", styled)
        .when(bold, True)
        .otherwise((page != 0) & is_upper(t) & (F.length(t) <= 60) & large)
    )


def _title(median: Column) -> Column:
    return is_title(F.col("t"), F.col("bold"), F.col("size"), F.col("height"), F.col("centered"), F.col("page_index"), median)


def heading_levels(lines: DataFrame, width: float, height: float) -> DataFrame:
    """(doc_id, page_index, line_seq, level): the headings.

    The words of a summary and long capitals at the top of a page are of the first level, whatever their style; numbered titles go
    deeper with each dot.
    """
    t = F.col("t")
    rows = with_median(lines).withColumn("t", plain_text("text"))
    first = F.lower(t).isin(*SUMMARY) | (is_upper(t) & (F.length(t) >= 12) & (F.col("y0") <= 0.18 * height) & (F.col("x1") - F.col("x0") <= 0.85 * width))
    number = F.when(T.numbered(t)["number"] != "", T.numbered(t)["number"]).otherwise(T.lettered(t))
    dots = F.when(is_block_title(t), 0).otherwise(F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))))
    level = F.when(first, PARAMS.heading_base_level).when(_title(F.col("median")), F.least(F.lit(PARAMS.heading_max_level), PARAMS.heading_base_level + dots))
    return rows.select(*PAGE, "line_seq", level.alias("level")).where("level is not null")


def style_key() -> list[Column]:
    return [(F.bround(F.col("size") * 2) / 2).alias("size"), F.col("bold"), F.col("centered")]


def heading_styles(lines: DataFrame) -> DataFrame:
    """(doc_id, size, bold, centered, level): the styles of headings, ranked by size, then boldness, then centring."""
    rows = with_median(lines).withColumn("t", plain_text("text")).where(_title(F.col("median")))
    styles = rows.select("doc_id", *style_key()).distinct()
    rank = F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("size"), F.desc("bold"), F.desc("centered")))
    return styles.withColumn("level", F.least(F.lit(PARAMS.heading_max_level), PARAMS.heading_base_level - 1 + rank))


def paragraphs(lines: DataFrame, width: float) -> DataFrame:
    """lines with paragraph: on a page a line goes on the one before if both are plain text of one style, and left edge (that of the text
    behind a list's marker), gap, right edge and ending allow it."""
    w = Window.partitionBy(*PAGE).orderBy("y0", "x0", "line_seq")
    rows = lines.withColumn("t", plain_text("text")).withColumns({"heads": _title(F.lit(0.0)), "style": F.struct(*style_key()), "left": F.coalesce("list_text_x", "x0")})
    prev = lambda c: F.lag(c).over(w)
    goes = (
        F.col("list_marker").isNull() & ~prev("heads") & ~F.col("heads") & (prev("style") == F.col("style"))
        & (F.abs(F.col("x0") - prev("left")) <= PARAMS.paragraph_left_tolerance)
        & (F.col("y0") - prev("y1") <= PARAMS.paragraph_gap_factor * prev("height")) & (prev("x1") >= PARAMS.paragraph_right_edge * width) & ~T.strip(prev("text")).rlike(r"[.!?:]$")
    )
    rows = rows.withColumn("starts", ~F.coalesce(goes, F.lit(False)))
    return rows.withColumn("paragraph", F.sum(F.col("starts").cast("int")).over(w)).drop("starts", "t", "heads", "style", "left")


def summary_state(lines: DataFrame) -> DataFrame:
    """lines with in_summary: the outline lines that follow a summary's title on its page without a break; they are no headings."""
    w = Window.partitionBy(*PAGE).orderBy("y0", "x0", "line_seq")
    t = plain_text("text")
    rows = lines.withColumn("opens", F.lower(t) == SUMMARY[0]).withColumn("run", F.sum(F.col("opens").cast("int")).over(w))
    inside = Window.partitionBy(*PAGE, "run").orderBy("y0", "x0", "line_seq")
    rows = rows.withColumn("breaks", F.sum((~F.col("opens") & ~t.rlike(T.OUTLINE)).cast("int")).over(inside))
    return rows.withColumn("in_summary", (F.col("run") > 0) & ~F.col("opens") & (F.col("breaks") == 0)).drop("opens", "run", "breaks")


def is_degenerate(text: Column, x0: Column, x1: Column) -> Column:
    """Lines without text or hardly any width are none."""
    return (T.strip(text) == "") | (x1 - x0 <= 2)


def bullet(text) -> Column:
    """struct<marker, text> of a line that begins with a list's sign, or what a scan makes of one; marker is null for others."""
    line = F.ltrim(F.col(text) if isinstance(text, str) else text, F.lit(" \t"))
    head = T.word(line)
    rest = T.strip(T.after(line, head))
    piped = (head == "*") & (T.word(rest) == "|")
    body = F.when(piped, T.strip(F.substr(rest, F.lit(2)))).otherwise(rest)
    marker = F.when(piped | (head == "*|"), "* |").when(head.isin(*SIGNS) | (F.upper(head) == "QO)"), head)
    return F.struct(F.when(body != "", marker).alias("marker"), body.alias("text"))


def list_marker(spans, text: Column, x0: Column) -> Column:
    """struct<marker, text_x>: a sign in a span of its own some way before the text, a typewriter's o, or a line's leading sign; null for others."""
    seen = F.filter(spans, lambda s: F.trim(s["text"]) != "")
    first, second = F.get(seen, F.lit(0)), F.get(seen, F.lit(1))
    courier = lambda s: F.contains(F.lower(F.coalesce(s["font"], F.lit(""))), F.lit("courier"))
    sign = F.trim(first["text"])
    own = (F.size(seen) >= 2) & (second["bbox"]["x0"] - first["bbox"]["x1"] >= 6) & (sign.isin(*SIGNS) | ((F.lower(sign) == "o") & courier(first)))
    typed = text.rlike(r"^o\s+\S") & F.exists(seen, courier)
    led = bullet(text)["marker"]
    pair = lambda m, x: F.struct(m.alias("marker"), x.alias("text_x"))
    return F.when(own, pair(sign, second["bbox"]["x0"])).when(typed, pair(F.lit("o"), first["bbox"]["x0"] + 18)).when(led.isNotNull(), pair(led, x0 + 18))


def styled_spans(spans, size: Column) -> Column:
    """The text of spans with notes' numbers as [^n], bold and italics; a blank where a gap parts two spans."""

    def step(acc, s):
        gap = s["bbox"]["x0"] - acc["x1"]
        blank = F.coalesce((gap > F.greatest(F.lit(0.5), 0.06 * size)) & (acc["t"] != "") & ~acc["t"].rlike(r"[ \t]$") & ~s["text"].rlike(r"^[ \t]"), F.lit(False))
        flag = lambda bit: s["flags"].bitwiseAND(F.lit(bit)) > 0
        bold = F.when(flag(16), F.concat(F.lit("**"), s["text"], F.lit("**"))).otherwise(s["text"])
        value = F.when(flag(1) & F.trim(s["text"]).rlike("^[0-9]+$"), F.concat(F.lit("[^"), F.trim(s["text"]), F.lit("]"))).when(flag(2), F.concat(F.lit("*"), bold, F.lit("*"))).otherwise(bold)
        return F.struct(F.concat(acc["t"], F.when(blank, " ").otherwise(""), value).alias("t"), s["bbox"]["x1"].alias("x1"))

    state = F.struct(F.lit("").alias("t"), F.lit(None).cast("double").alias("x1"))
    return T.strip(F.aggregate(F.filter(spans, lambda s: s["text"] != ""), state, step)["t"])


def roman_of_scan(text: Column) -> Column:
    """Il, IIl and lll before a dash at a line's beginning are the numerals II and III."""
    head = F.regexp_extract(text, "^([Il]+)", 1)
    fixed = F.when(head == "Il", "II").when(head.isin("IIl", "lll"), "III")
    return F.when(fixed.isNotNull() & T.after(text, head).rlike(r"^\s*[-–—]\s"), F.concat(fixed, T.after(text, head))).otherwise(text)


def formatted(spans, text: Column, marker: Column, x0: Column, size: Column, origin: Column) -> Column:
    """A line as Markdown: list items indented by their distance from the page's list origin, other lines with the styles of their spans."""
    bare = T.strip(text)
    level = F.greatest(F.lit(0), F.least(F.lit(5), F.bround((x0 - origin) / PARAMS.list_indent).cast("int")))
    led = bullet(bare)
    item = F.when(led["marker"].isNotNull(), led["text"]).otherwise(T.strip(T.after(bare, T.word(bare))))
    listed = F.rtrim(F.concat(F.repeat(F.lit("  "), level), F.lit("- "), item))
    whole = F.when(F.size(spans) > 0, styled_spans(spans, size)).otherwise(bare)
    sign = bullet(whole)
    return F.when(marker.isNotNull(), listed).otherwise(roman_of_scan(F.when(sign["marker"].isNotNull(), F.concat(F.lit("- "), sign["text"])).otherwise(whole)))


def reading_order(lines: DataFrame) -> DataFrame:
    """(doc_id, page_index, line_seq, row_no, place): rows by a fixed anchor, the first y of the row, then x; one fold per page."""
    item = F.struct("y0", "x0", "line_seq")
    state = F.struct(F.lit(-1e9).alias("anchor"), F.lit(0).alias("row"), F.array().cast("array<struct<row:int,x0:double,line_seq:int>>").alias("out"))

    def step(acc, x):
        new = x["y0"] > acc["anchor"] + PARAMS.row_tolerance
        row = acc["row"] + new.cast("int")
        return F.struct(F.when(new, x["y0"]).otherwise(acc["anchor"]).alias("anchor"), row.alias("row"), F.concat(acc["out"], F.array(F.struct(row.alias("row"), x["x0"].alias("x0"), x["line_seq"].alias("line_seq")))).alias("out"))

    folded = lines.groupBy(*PAGE).agg(F.sort_array(F.collect_list(item)).alias("items")).select(*PAGE, F.posexplode(F.sort_array(F.aggregate("items", state, step)["out"])).alias("place", "x"))
    return folded.select(*PAGE, F.col("x.line_seq").alias("line_seq"), F.col("x.row").alias("row_no"), "place")


def outside(rows: DataFrame, shapes: DataFrame, box: tuple, shape: tuple, ratio: float = PARAMS.overlap_owner) -> DataFrame:
    """rows that no shape of their page covers by ratio or more."""
    s = shapes.withColumnsRenamed({"doc_id": "sd", "page_index": "sp"})
    return rows.join(s, (F.col("doc_id") == F.col("sd")) & (F.col("page_index") == F.col("sp")) & (overlap(box, shape) >= ratio), "left_anti")


def owners(lines: DataFrame, figures: DataFrame) -> DataFrame:
    """(doc_id, page_index, line_seq, figure_seq): the first figure that covers the line, null if none does."""
    s = figures.withColumnsRenamed({"doc_id": "sd", "page_index": "sp"})
    met = lines.join(s, (F.col("doc_id") == F.col("sd")) & (F.col("page_index") == F.col("sp")) & (overlap(LINE, FIGURE) >= PARAMS.overlap_owner), "left")
    return met.groupBy(*PAGE, "line_seq").agg(F.min("figure_seq").alias("figure_seq"))


def events(lines: DataFrame, figures: DataFrame, tables: DataFrame) -> DataFrame:
    """Text, figures and tables of the pages as one relation (doc_id, page_index, y, x, kind, seq)."""
    shape = lambda df, y, x, kind, seq: df.select(*PAGE, F.col(y).alias("y"), F.col(x).alias("x"), F.lit(kind).alias("kind"), seq.alias("seq"))
    return shape(lines, "y0", "x0", "text", F.col("line_seq")).unionByName(shape(figures, "fy0", "fx0", "figure", F.col("figure_seq"))).unionByName(shape(tables, "ty0", "tx0", "table", F.lit(0)))


def strips(rows: DataFrame) -> DataFrame:
    """rows with strip: vertical neighbours of one width and left edge with hardly a gap are one picture."""
    w = Window.partitionBy(*PAGE).orderBy("y0", "x0", "line_seq")
    prev = lambda c: F.lag(c).over(w)
    same = (F.abs((F.col("x1") - F.col("x0")) - (prev("x1") - prev("x0"))) <= 1) & (F.abs(F.col("x0") - prev("x0")) <= 1) & (F.abs(F.col("y0") - prev("y1")) <= 3)
    rows = rows.withColumn("starts", ~F.coalesce(same, F.lit(False)))
    return rows.withColumn("strip", F.sum(F.col("starts").cast("int")).over(w)).drop("starts")


def line_records(spans: DataFrame, width: float) -> DataFrame:
    """Line fields from an array column spans: text, size, height, bold, any_bold, italic, centered, list_marker, list_text_x, and the spans."""
    seen = F.filter("spans", lambda s: F.trim(s["text"]) != "")
    state = F.struct(F.lit("").alias("t"), F.lit(None).cast("double").alias("x1"))

    def step(acc, s):
        gap = s["bbox"]["x0"] - acc["x1"]
        blank = (gap > F.greatest(F.lit(0.5), 0.06 * s["size"])) & ~acc["t"].rlike(r"\s$") & ~s["text"].rlike(r"^\s")
        return F.struct(F.concat(acc["t"], F.when(blank, " ").otherwise(""), s["text"]).alias("t"), s["bbox"]["x1"].alias("x1"))

    flag = lambda bit: (F.size(seen) > 0) & F.forall(seen, lambda s: s["flags"].bitwiseAND(F.lit(bit)) > 0)
    x0, x1 = F.array_min(F.transform("spans", lambda s: s["bbox"]["x0"])), F.array_max(F.transform("spans", lambda s: s["bbox"]["x1"]))
    y0, y1 = F.array_min(F.transform("spans", lambda s: s["bbox"]["y0"])), F.array_max(F.transform("spans", lambda s: s["bbox"]["y1"]))
    height = F.greatest(F.lit(1.0), y1 - y0)
    rest = [c for c in spans.columns if c != "spans"]
    out = spans.select(
        *rest, "spans", T.strip(F.aggregate(F.filter("spans", lambda s: s["text"] != ""), state, step)["t"]).alias("text"), F.coalesce(F.array_max(F.transform(seen, lambda s: s["size"])), height).alias("size"), height.alias("height"),
        flag(16).alias("bold"), F.exists(seen, lambda s: s["flags"].bitwiseAND(F.lit(16)) > 0).alias("any_bold"), flag(2).alias("italic"), (F.abs((x0 + x1) / 2 - width / 2) <= 0.03 * width).alias("centered"),
        x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"),
    )
    found = out.withColumn("m", list_marker("spans", F.col("text"), F.col("x0")))
    return found.withColumns({"list_marker": F.col("m.marker"), "list_text_x": F.col("m.text_x")}).drop("m")


def paragraph_texts(lines: DataFrame, width: float) -> DataFrame:
    """(doc_id, page_index, paragraph, text): the lines of each paragraph as one, parted words put together."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("y0", "x0", "line_seq", "text"))), lambda x: T.strip(x["text"]))
    return paragraphs(lines, width).groupBy(*PAGE, "paragraph").agg(T.join_lines(F.filter(parts, lambda x: x != ""), any_hyphen=True).alias("text"))
