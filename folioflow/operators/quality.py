"""Checks of notes: each returns violations or counts, never raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T


def count(text, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def marker_counts(text) -> list[Column]:
    """Negation signs, headings of each level, empty parentheses."""
    heads = [count(text, rf"(?m)^#{{{k}}}\s+\S").alias(f"h{k}") for k in range(1, 7)]
    return [count(text, "¬").alias("negation"), *heads, count(text, r"\(\s*\)").alias("empty_parens")]


def forbidden(lines: DataFrame) -> DataFrame:
    """Lines outside quotes that hold residue of pages or sites."""
    return lines.where(F.col("line").rlike(T.FORBIDDEN) & ~F.col("line").rlike(r"^\s*>"))


def page_sequence(pages: DataFrame) -> DataFrame:
    """(doc_id, n_pages, n_breaks): page labels that don't follow the one before by one."""
    w = Window.partitionBy("doc_id").orderBy("page_index")
    rows = pages.withColumn("bad", F.coalesce(F.col("label") - F.lag("label").over(w) != 1, F.lit(False)))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.count_if("bad").alias("n_breaks"))


def shallow_headings(lines: DataFrame, least: int = 4) -> DataFrame:
    return lines.where(F.col("line").rlike(rf"^#{{1,{least - 1}}}\s"))


def lost(before: DataFrame, after: DataFrame) -> DataFrame:
    """Multiset difference: rows of before that after lacks."""
    return before.exceptAll(after)


def outside_fences(body: Column) -> Column:
    """A note's text without fenced blocks; a fence that is not closed stays."""
    parts = F.split(body, "```", -1)
    closed = lambda i: (i % 2 == 1) & (i < F.size(parts) - 1)
    return F.array_join(F.filter(F.transform(parts, lambda p, i: F.when(closed(i), F.lit(None).cast("string")).when((i % 2 == 1) & ~closed(i), F.concat(F.lit("```"), p)).otherwise(p)), lambda p: p.isNotNull()), "")


def forbidden_lines(notes: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of notes (doc_id, body): lines outside fences and quotes that hold residue of pages or sites."""
    rows = notes.select("doc_id", F.posexplode(F.split(outside_fences(F.col("body")), "\n")).alias("at", "line"))
    return forbidden(rows).select("doc_id", (F.col("at") + 1).alias("line_no"), "line")


def page_marks(body) -> Column:
    """The numbers of the page marks of a note."""
    return F.transform(F.regexp_extract_all(body, F.lit(r"(?m)^\*p\. ([0-9]+)\*$"), F.lit(1)), lambda x: x.cast("int"))


def page_contents(body) -> Column:
    """A note's text page by page."""
    return F.split(body, r"\n\n---\n\*p\. [0-9]+\*\n\n---(?:\n\n|$)", -1)


def page_violations(notes: DataFrame) -> DataFrame:
    """(doc_id, problem) of notes (doc_id, body, n_pages): as many marks as pages, each one more than the one before."""
    marks = page_marks(F.col("body"))
    broken = F.exists(F.sequence(F.lit(1), F.greatest(F.size(marks) - 1, F.lit(1))), lambda i: F.coalesce(F.get(marks, i) != F.get(marks, i - 1) + 1, F.lit(False)))
    found = F.filter(F.array(F.when(F.size(marks) != F.col("n_pages"), "page count"), F.when(broken, "page order")), lambda x: x.isNotNull())
    return notes.select("doc_id", F.explode(found).alias("problem"))


def embeds(notes: DataFrame) -> DataFrame:
    """(doc_id, page_no, name, named_page) of the images embedded in notes (doc_id, body); page_no counts the text's own pages."""
    pages = notes.select("doc_id", F.posexplode(page_contents(F.col("body"))).alias("p", "content"))
    names = pages.select("doc_id", (F.col("p") + 1).alias("page_no"), F.explode(F.regexp_extract_all("content", F.lit(r"!\[\[([^\]]+)\]\]"), F.lit(1))).alias("name"))
    return names.withColumn("named_page", F.nullif(F.regexp_extract("name", r"-img[0-9]+-pg([0-9]+)\.png$", 1), F.lit("")).cast("int"))


def image_violations(notes: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, name, problem): images on another page than their name says, of a page that there is not, without a file; and, with a null name, notes
    with more or fewer embeds than files.  notes: (doc_id, body, n_pages); files: (doc_id, name)."""
    found = embeds(notes).join(notes.select("doc_id", "n_pages"), "doc_id")
    wrong = found.where("named_page <> page_no").select("doc_id", "name", F.lit("other page").alias("problem"))
    none = found.where("named_page > n_pages").select("doc_id", "name", F.lit("no such page").alias("problem"))
    lost = found.join(files, ["doc_id", "name"], "left_anti").select("doc_id", "name", F.lit("no file").alias("problem"))
    counts = notes.select("doc_id").join(found.groupBy("doc_id").agg(F.count("*").alias("e")), "doc_id", "left").join(files.groupBy("doc_id").agg(F.count_distinct("name").alias("f")), "doc_id", "left")
    odd = counts.where("coalesce(e, 0) <> coalesce(f, 0)").select("doc_id", F.lit(None).cast("string").alias("name"), F.lit("count").alias("problem"))
    return wrong.unionByName(none).unionByName(lost).unionByName(odd)


def zipped(images: DataFrame, names: DataFrame) -> DataFrame:
    """Images and embeds of a page by their order, on pages that have as many of one as of the other.

    images: (doc_id, page_no, y, x, ...); names: (doc_id, page_no, at, ...) with at the place in the text.
    """
    page = ["doc_id", "page_no"]
    w = Window.partitionBy(*page)
    a = images.withColumn("n", F.row_number().over(w.orderBy("y", "x"))).withColumn("of", F.count("*").over(w))
    b = names.withColumn("n", F.row_number().over(w.orderBy("at"))).withColumn("of", F.count("*").over(w))
    return a.join(b, [*page, "n", "of"]).drop("of")


def zipped_or_failed(tables: DataFrame, blocks: DataFrame) -> DataFrame:
    """Tables and Markdown blocks of a document by their order; raises where a document has more of one than of the other."""
    met = tables.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("table_seq"))).join(blocks.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("first_pos"))), ["doc_id", "n"], "full")
    return met.withColumn("doc_id", F.when(F.col("table_seq").isNotNull() & F.col("first_pos").isNotNull(), F.col("doc_id")).otherwise(F.raise_error(F.lit("tables and blocks differ in number"))))


def order_violations(lines: DataFrame, placed: DataFrame) -> DataFrame:
    """(doc_id, page_no, n, side): embeds that stand on the wrong side of the text next to their image.

    lines: (doc_id, page_no, y, text, covered) of the native page, covered for lines inside the image; placed: (doc_id, page_no, n, image_y, before_text,
    after_text), the note's text before and after the embed.  Lines of fewer than eight letters and digits are passed over.
    """
    key = T.letters_and_digits
    near = lines.where(~F.col("covered") & (F.length(key("text")) >= 8))
    met = placed.join(near, ["doc_id", "page_no"])
    above, below = F.col("y") < F.col("image_y"), F.col("y") >= F.col("image_y")
    ends = met.groupBy("doc_id", "page_no", "n").agg(
        F.max_by("text", F.when(above, F.struct("y", "text"))).alias("up"), F.min_by("text", F.when(below, F.struct("y", "text"))).alias("down"), F.first("before_text").alias("before_text"), F.first("after_text").alias("after_text"),
    )
    side = F.array(F.when(~F.contains(key("before_text"), key("up")), "before"), F.when(~F.contains(key("after_text"), key("down")), "after"))
    return ends.select("doc_id", "page_no", "n", F.explode(F.filter(side, lambda x: x.isNotNull())).alias("side"))


def heading_violations(notes: DataFrame, expected: dict[str, list[str]] | None = None, name: str = "name", shown: int = 5) -> DataFrame:
    """(doc_id, problem, examples): headings of fewer than four signs, citations as headings, several summaries, expected headings that are missing.

    expected lists by canonical name the headings a note must have; examples holds the first few.
    """
    lines = F.split("body", "\n")
    some = lambda hits: F.slice(hits, 1, shown)
    short = F.filter(lines, lambda x: x.rlike(r"^#{1,3}\s+\S"))
    cited = F.filter(lines, lambda x: x.rlike(r"^#{4,}\s") & x.rlike(r"(?i)Art\.\s*[0-9]|CF/88"))
    summaries = F.filter(lines, lambda x: x.rlike(r"^#{4,}\s") & (F.lower(T.strip(T.sub(x, "^#+"))) == "sumário"))
    checks = [F.struct(F.lit("short").alias("problem"), some(short).alias("examples")), F.struct(F.lit("citation").alias("problem"), some(cited).alias("examples"))]
    checks.append(F.struct(F.lit("summaries").alias("problem"), F.when(F.size(summaries) > 1, some(summaries)).otherwise(F.array().cast("array<string>")).alias("examples")))
    for note, heads in (expected or {}).items():
        absent = F.filter(F.array(*[F.lit(h) for h in heads]), lambda h: ~F.contains(F.col("body"), h))
        checks.append(F.struct(F.lit("missing").alias("problem"), F.when(T.canonical_name(F.col(name)) == note, some(absent)).otherwise(F.array().cast("array<string>")).alias("examples")))
    return notes.select("doc_id", F.explode(F.filter(F.array(*checks), lambda c: F.size(c["examples"]) > 0)).alias("c")).select("doc_id", "c.*")


def subjects(note) -> Column:
    """The lines of the front matter's subject field."""
    block = F.regexp_extract(note, r"(?m)^assunto:\s*\|-[ \t]*\n((?:[ \t]+[^\n]*(?:\n|$))*)", 1)
    return F.filter(F.transform(F.split(block, "\n"), lambda x: T.strip(x)), lambda x: x != "")


def subject_violations(notes: DataFrame, count: int | None = None) -> DataFrame:
    """(doc_id, problem) of notes (doc_id, note): no subjects, repeated ones, another number of them than it must be."""
    found = subjects(F.col("note"))
    problems = F.array(F.when(F.size(found) == 0, "empty"), F.when(F.size(found) != F.size(F.array_distinct(found)), "repeated"), F.when((F.size(found) > 0) & (F.size(found) != count), "count") if count is not None else F.lit(None).cast("string"))
    return notes.select("doc_id", F.explode(F.filter(problems, lambda x: x.isNotNull())).alias("problem"))


def cells(row) -> Column:
    """The cells of a pipe row."""
    bare = T.strip(row)
    inner = F.when(F.startswith(bare, F.lit("|")) & F.endswith(bare, F.lit("|")) & (F.length(bare) > 1), F.substr(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare)
    return F.transform(F.split(inner, r"\|", -1), lambda c: T.strip(c))


def mean_word(texts: Column) -> Column:
    """Mean over the cells with words of their mean word length; null without any."""
    from folioflow.operators.tables import average_word

    means = F.filter(F.transform(texts, average_word), lambda x: x > 0)
    return F.when(F.size(means) > 0, F.aggregate(means, F.lit(0.0), lambda a, x: a + x) / F.size(means))


def table_violations(tables: DataFrame, columns: int, n_rows: int, headers: list[str], longest: float = 14.0) -> DataFrame:
    """(doc_id, problem) of tables (doc_id, rows: array of pipe rows with header and rule): header, numbers of rows and columns, blank rows and columns,
    blanks before punctuation, list items that go on a line, words that are too long on the mean."""
    grid = F.transform("rows", cells)
    head, data = F.get(grid, F.lit(0)), F.slice(grid, 3, F.greatest(F.lit(1), F.size(grid)))
    flat = F.flatten(data)
    plain = lambda x: F.lower(T.sub(T.strip(x), r"\s+", " "))
    known = F.lit(True)
    for i, h in enumerate(headers):
        known = known & F.coalesce(F.contains(plain(F.get(head, F.lit(i))), F.lit(h.lower())), F.lit(False))
    blank_column = F.exists(F.sequence(F.lit(0), F.lit(columns - 1)), lambda i: F.forall(data, lambda r: F.coalesce(F.get(r, i), F.lit("")) == ""))
    problems = F.array(
        F.when((F.size(head) != columns) | ~known, "header"), F.when(F.size("rows") != n_rows, "rows"), F.when(F.exists(grid, lambda r: F.size(r) != columns), "columns"),
        F.when(F.exists(grid, lambda r: F.forall(r, lambda c: c == "")), "blank row"), F.when(blank_column, "blank column"), F.when(F.exists(flat, lambda c: c.rlike(r"\s[.,](?:\s|$)")), "punctuation"),
        F.when(F.exists(flat, lambda c: c.rlike(r"(?<!<br>)(?:^| )-\s+[A-Z]")), "list item"), F.when(mean_word(flat) > longest, "long words"),
    )
    return tables.select("doc_id", F.explode(F.filter(problems, lambda x: x.isNotNull())).alias("problem"))


def table_count(content) -> Column:
    """Pipe tables of a page, by their rules."""
    return F.regexp_count(content, F.lit(r"(?m)^\s*\|(?:\s*:?-{3,}:?\s*\|)+\s*$"))


def front_matter_of(note) -> Column:
    end = F.locate("\n---\n", note, 4)
    return F.when(F.startswith(note, F.lit("---\n")) & (end > 0), F.substr(note, F.lit(1), end + 4)).otherwise("")


def content_changes(notes: DataFrame) -> DataFrame:
    """(doc_id, problem) of notes (doc_id, before, after): what a repair must not change, and has: front matter, emphasised runs, images, callouts, page
    marks, rules, quotes (none may go)."""
    runs = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit(r"(\*\*[^*\n]+?\*\*|(?<!\*)\*(?!\*)[^*\n]+?(?<!\*)\*(?!\*))"), F.lit(1)))
    listed = lambda c, p: F.regexp_extract_all(c, F.lit(p), F.lit(1))
    counted = lambda runs_, x: F.size(F.filter(runs_, lambda y: y == x))
    lost = F.exists(runs("before"), lambda x: counted(runs("before"), x) > counted(runs("after"), x))
    same = lambda p: listed("before", p) == listed("after", p)
    problems = F.array(
        F.when(front_matter_of(F.col("before")) != front_matter_of(F.col("after")), "front matter"), F.when(lost, "emphasis"), F.when(~same(r"(!\[\[[^\]\n]+\]\])"), "images"),
        F.when(~same(r"(?m)^(> \[!(?:quote|attention)\][^\n]*?)[ \t]*$"), "callouts"), F.when(~same(r"(?m)^(\*p\. [0-9]+\*)$"), "page marks"),
        F.when(count("before", r"(?m)^[ \t]*---[ \t]*$") != count("after", r"(?m)^[ \t]*---[ \t]*$"), "rules"), F.when(count("after", "(?m)^>") < count("before", "(?m)^>"), "quotes"),
    )
    return notes.select("doc_id", F.explode(F.filter(problems, lambda x: x.isNotNull())).alias("problem"))


def gate_violations(notes: DataFrame) -> DataFrame:
    """(doc_id, problem) of repaired notes (doc_id, body): doubled negation signs, empty parentheses, lines that end with a dash."""
    problems = F.array(F.when(F.col("body").rlike("¬{2,}"), "negation signs"), F.when(F.col("body").rlike(r"\(\s*\)"), "empty parentheses"), F.when(F.col("body").rlike(r"(?m)–[ \t]*$"), "open title"))
    return notes.select("doc_id", F.explode(F.filter(problems, lambda x: x.isNotNull())).alias("problem"))
