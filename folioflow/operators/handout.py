"""Pages of handouts: footers, sites, notes, reflow and images, put together page by page.

A note's page rows are (doc_id, page_no, text); one partitioning by document serves all steps that look at several pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators.legal import let
from folioflow.params import PARAMS

_FOOT = rf"\n([0-9]{{1,4}})[ \t]*\n[ \t]*{T.SITE}[.,;:!?)]*[ \t]*(?:\n|$)"
#: A page number, with the blanks around it, at the end of what stands before a site.
_NUMBER_END = r"[ \t]\b[0-9]{1,4}[ \t]+$"


def split_pages(notes: DataFrame) -> DataFrame:
    """(doc_id, page_no, text) from Markdown (doc_id, text) whose pages end with a separator line that has their number, from 0; what follows the last is a page if it
    is not blank."""
    mark = r"\n*--- end of page=([0-9]+) ---\n*"
    numbers = F.regexp_extract_all("text", F.lit(mark), F.lit(1))
    rows = notes.select("doc_id", F.posexplode(F.arrays_zip(F.split("text", mark, -1).alias("t"), numbers.alias("n"))).alias("at", "p"))
    page = F.coalesce(F.col("p.n").cast("int") + 1, F.col("at") + 1)
    return rows.where(F.col("p.n").isNotNull() | (T.strip("p.t") != "")).select("doc_id", page.alias("page_no"), F.col("p.t").alias("text"))


def without_footer(pages: DataFrame, physical: str = "page_no") -> DataFrame:
    """pages with the first footer (a number, then a site on a line of its own) taken out and label, its number; without one the page's own."""
    number = F.regexp_extract("text", _FOOT, 1)
    return pages.select(*[c for c in pages.columns if c != "text"], F.array_join(F.split("text", _FOOT, 2), "\n").alias("text"), F.coalesce(F.nullif(number, F.lit("")), F.col(physical).cast("string")).alias("label"))


def site_key(site: Column) -> Column:
    return T.sub(F.lower(T.sub(site, r"\s*\.\s*", ".")), r"^[.,;:!?) ]+|[.,;:!?) ]+$")


def sites_of(text) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?i)({T.SITE})"), F.lit(1))


def site_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, site, n_pages) of the sites that stand on enough pages of a document, pipe rows aside."""
    lines = pages.select("doc_id", "page_no", F.explode(F.split("text", "\n")).alias("line")).where(~F.ltrim("line").startswith("|"))
    found = lines.select("doc_id", "page_no", F.explode(sites_of("line")).alias("s")).select("doc_id", "page_no", site_key(F.col("s")).alias("site"))
    return found.groupBy("doc_id", "site").agg(F.count_distinct("page_no").alias("n_pages")).where(F.col("n_pages") >= PARAMS.site_min_pages)


def without_sites(pages: DataFrame) -> DataFrame:
    """pages without lines that are a site, and without sites at a line's end that a page number precedes or that repeat over the pages.

    Pipe rows and sites inside a text stay.
    """
    often = site_pages(pages).groupBy("doc_id").agg(F.collect_set("site").alias("often"))
    rows = pages.join(often, "doc_id", "left").withColumn("often", F.coalesce("often", F.array().cast("array<string>")))

    def cleaned(line):
        tail = T.sub(F.regexp_extract(line, rf"(?i)({T.SITE})[ \t.,;:!?)]*$", 1), r"[.,;:!?)]+$")
        before = F.regexp_extract(line, rf"(?i)^(.*?){T.SITE}[ \t.,;:!?)]*$", 1)
        numbered = before.rlike(_NUMBER_END)
        goes = (tail != "") & (numbered | F.array_contains("often", site_key(tail)))
        rest = T.after(line, F.concat(before, tail))
        kept = F.concat(F.when(numbered, T.sub(before, _NUMBER_END)).otherwise(before), rest)
        return F.when(F.startswith(F.ltrim(line), F.lit("|")) | ~goes, line).otherwise(kept)

    lines = F.filter(F.split("text", "\n", -1), lambda x: F.startswith(F.ltrim(x), F.lit("|")) | ~x.rlike(T.SITE_LINE))
    return rows.select(*[F.array_join(F.transform(lines, cleaned), "\n").alias("text") if c == "text" else c for c in pages.columns])


def foot_sites(lines: DataFrame, height: float, share: float = 0.86) -> DataFrame:
    """(doc_id, page_index, sites) of the sites in the lowest part of native pages."""
    low = lines.where(F.col("y0") >= share * height).select("doc_id", "page_index", "line_seq", sites_of("text").alias("s")).where(F.size("s") > 0)
    listed = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("line_seq", "s"))), lambda x: x["s"]))
    return low.groupBy("doc_id", "page_index").agg(F.transform(listed, site_key).alias("sites"))


def drop_foot_sites(text: Column, sites: Column) -> Column:
    """A page's text without the last occurrence of each of the sites."""

    def dropped(acc, site):
        found = sites_of(acc)
        last = F.element_at(F.filter(found, lambda x: site_key(x) == site), -1)
        at = F.length(acc) - F.length(last) - F.position(F.reverse(last), F.reverse(acc)) + 1
        return F.when(last.isNotNull(), F.concat(F.substr(acc, F.lit(1), at), F.substr(acc, at + F.length(last) + 1))).otherwise(acc)

    return F.aggregate(F.coalesce(sites, F.array().cast("array<string>")), text, dropped)


def clean_scan(text, brands: tuple[str, ...] = ()) -> Column:
    """Text read from a figure without sites, lines that are a site or a brand (patterns), and blank lines."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~T.strip(x).rlike(T.SITE_LINE))
    for b in brands:
        lines = F.transform(F.filter(lines, lambda x: ~T.strip(x).rlike(f"(?i)^(?:{b})$")), lambda x: T.sub(x, rf"(?i)\b(?:{b})\b"))
    bare = F.transform(lines, lambda x: T.strip(T.sub(x, f"(?i){T.SITE}")))
    return F.array_join(F.filter(bare, lambda x: x != ""), "\n")


def note_bodies(text: Column) -> Column:
    """struct<text, notes: array<struct<number, body>>>: the footnotes' bodies taken out of a page's text.

    A body begins at a line that starts with a number referred to on the page, the first such line of each number, and goes on to the next
    body or an image.
    """

    def parted(x):
        refs = F.array_distinct(F.regexp_extract_all(x, F.lit(r"\[\^([0-9]{1,3})\]"), F.lit(1)))
        state = F.struct(F.lit("").alias("now"), F.array().cast("array<struct<number:string,body:string>>").alias("notes"), F.array().cast("array<string>").alias("kept"))

        def step(acc, line):
            n = F.regexp_extract(line, r"^([0-9]{1,3})\s+\S", 1)
            known = F.exists(acc["notes"], lambda y: y["number"] == n)
            starts = (n != "") & F.array_contains(refs, n) & ~known
            image = F.startswith(F.ltrim(line), F.lit("!["))
            now = F.when(starts, n).when(image, "").otherwise(acc["now"])
            body = T.strip(F.when(starts, T.sub(line, r"^[0-9]{1,3}\s+")).otherwise(line))
            last = F.element_at(acc["notes"], -1)
            grown = F.concat(F.slice(acc["notes"], 1, F.greatest(F.lit(0), F.size(acc["notes"]) - 1)), F.array(F.struct(last["number"].alias("number"), F.when(body == "", last["body"]).otherwise(F.concat(last["body"], F.lit(" "), body)).alias("body"))))
            notes = F.when(starts, F.concat(acc["notes"], F.array(F.struct(n.alias("number"), body.alias("body"))))).when(now != "", grown).otherwise(acc["notes"])
            return F.struct(now.alias("now"), notes.alias("notes"), F.when(now == "", F.concat(acc["kept"], F.array(line))).otherwise(acc["kept"]).alias("kept"))

        found = F.aggregate(F.split(x, "\n", -1), state, step)
        return let(found, lambda f: F.struct(F.array_join(f["kept"], "\n").alias("text"), f["notes"].alias("notes")))

    return let(text, parted)


def numbered_notes(pages: DataFrame) -> DataFrame:
    """pages with their bodies out of the text and notes, array<struct<number, body>>, numbered through the document; references follow."""
    rows = pages.withColumn("b", note_bodies(T.note_refs("text")))
    w = Window.partitionBy("doc_id").orderBy("page_no")
    first = F.coalesce(F.sum(F.size("b.notes")).over(w) - F.size("b.notes"), F.lit(0)).cast("int")
    rows = rows.withColumn("base", first)
    notes = F.transform("b.notes", lambda x, i: F.struct((F.col("base") + i + 1).alias("number"), x["body"].alias("body")))
    # references are first marked, then numbered, so a new number never meets an old one
    marked = F.aggregate(F.transform("b.notes", lambda x, i: F.struct(x["number"].alias("old"), (F.col("base") + i + 1).cast("string").alias("new"))), F.col("b.text"), lambda t, x: F.replace(t, F.concat(F.lit("[^"), x["old"], F.lit("]")), F.concat(F.lit("["), x["new"], F.lit("]"))))
    return rows.select(*[F.replace(marked, F.lit(""), F.lit("^")).alias("text") if c == "text" else c for c in pages.columns], notes.alias("notes"))


def reflowed(text: Column) -> Column:
    """A page's text in blocks of a handout: one fold over its lines."""
    state = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("now"), F.lit("").alias("indent"))
    close = lambda acc: F.when(F.size(acc["now"]) > 0, F.concat(acc["out"], F.array(F.concat(acc["indent"], T.join_lines(acc["now"]))))).otherwise(acc["out"])

    def step(acc, line):
        topic = T.is_indented_topic(line)
        starts = topic | T.is_block_start(line, True) | (F.size(acc["now"]) == 0)
        one = F.array(T.strip(line))
        return F.struct(F.when(starts, close(acc)).otherwise(acc["out"]).alias("out"), F.when(starts, one).otherwise(F.concat(acc["now"], one)).alias("now"), F.when(starts, F.when(topic, "  ").otherwise("")).otherwise(acc["indent"]).alias("indent"))

    solid = F.filter(F.split(text, "\n", -1), lambda x: T.strip(x) != "")
    return F.array_join(F.aggregate(solid, state, step, close), "\n\n")


def moved(text: Column, anchors: Column) -> Column:
    """A page's blocks with each image behind the first block, from the one of the image before it on, that holds its anchor; others at the end.

    anchors has the text before each image on the native page, in their order; without one that is found the text stays as it is.
    """

    def put(blocks):
        image = lambda b: F.startswith(F.ltrim(b), F.lit("!["))
        images, texts = F.filter(blocks, image), F.filter(blocks, lambda b: ~image(b))
        keys = F.transform(texts, T.match_key)
        state = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("places"))

        def step(acc, a):
            key = T.match_key(F.coalesce(a, F.lit("")))
            hit = F.array_position(F.transform(keys, lambda k, i: (i >= acc["at"]) & F.contains(k, key)), True).cast("int")
            found = (key != "") & (hit > 0)
            return F.struct(F.when(found, hit - 1).otherwise(acc["at"]).alias("at"), F.concat(acc["places"], F.array(F.when(found, hit - 1))).alias("places"))

        places = F.aggregate(F.slice(anchors, 1, F.size(images)), state, step)["places"]

        def whole(p):
            at = lambda j: F.filter(images, lambda x, i: F.get(p, i) == j)
            rest = F.filter(images, lambda x, i: F.get(p, i).isNull())
            lines = F.concat(F.flatten(F.transform(texts, lambda b, j: F.concat(F.array(b), at(j)))), rest)
            return F.when(F.exists(p, lambda x: x.isNotNull()), F.array_join(lines, "\n\n")).otherwise(F.array_join(blocks, "\n\n"))

        return let(places, whole)

    return F.when(F.size(anchors) > 0, let(F.split(text, "\n\n", -1), put)).otherwise(text)


def handout_pages(pages: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_no, label, text, notes): footers off, bullets plain, notes out and numbered, text in blocks, images where they belong."""
    rows = without_footer(pages).withColumn("text", T.decorated("text"))
    rows = numbered_notes(rows).withColumn("text", reflowed(F.col("text")))
    if anchors is not None:
        rows = rows.join(anchors.select("doc_id", "page_no", "anchors"), ["doc_id", "page_no"], "left")
        rows = rows.withColumn("text", moved(F.col("text"), F.coalesce("anchors", F.array().cast("array<string>")))).drop("anchors")
    return rows.withColumn("text", T.plain_bullets("text"))


def page_mark(label: Column) -> Column:
    return F.concat(F.lit("\n\n---\n*p. "), label, F.lit("*\n\n---\n\n"))


def handout_note(pages: DataFrame) -> DataFrame:
    """(doc_id, n_pages, text, notes) from the result of handout_pages: pages with their marks between them, and the list of notes."""
    listed = F.sort_array(F.collect_list(F.struct("page_no", "text", "label", "notes")))
    whole = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), listed.alias("p"))
    text = F.array_join(F.transform("p", lambda x, i: F.concat(x["text"], F.when(i < F.size("p") - 1, page_mark(x["label"])).otherwise(""))), "")
    notes = F.array_join(F.transform(F.flatten(F.transform("p", lambda x: x["notes"])), lambda n: F.concat(F.lit("[^"), n["number"].cast("string"), F.lit("]: "), n["body"])), "\n")
    return whole.select("doc_id", "n_pages", text.alias("text"), notes.alias("notes"))


def written_note(front: Column, body: Column, notes: Column) -> Column:
    """The file of a note: front matter, text, list of notes, a blank line between each two; nothing stands for what is empty."""
    return F.concat(F.array_join(F.filter(F.array(front, T.strip(body), notes), lambda x: F.coalesce(x, F.lit("")) != ""), "\n\n"), F.lit("\n"))


def scanned_blocks(native: DataFrame, ocr: DataFrame) -> DataFrame:
    """Blocks (doc_id, page_index, kind, y, x, text) of pages that were read by OCR: the native images and the text that was read."""
    return native.where("kind = 'image'").unionByName(ocr.withColumn("kind", F.lit("text")), allowMissingColumns=True)


def native_tables(tables: DataFrame, pages: DataFrame) -> DataFrame:
    """Tables of pages (doc_id, page_index, native) with native text only."""
    return tables.join(pages.where("native").select("doc_id", "page_index"), ["doc_id", "page_index"], "left_semi")
