"""Repairs of finished notes: each a Column to a Column; repaired is all of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.params import PARAMS

# Titles that are put right, by how they begin.
TITLES = {
    r"(?i)^4\)\s+Sanções da improbidade\b": "4) Sanções da improbidade (art. 12)",
    r"(?i)^7\)\s+Indisponibilidade de Bens\b": "7) Indisponibilidade de Bens – art. 16",
    r"(?i)^\(continuando\)\s+Procedimento Judicial\b": "*(continuando)* Procedimento Judicial - arts. 17 a 18-A",
}
PAGE_MARK = r"\n\n---\n\*p\. ([0-9]+)\*\n\n---\n"


def lines_of(text) -> Column:
    return F.split(text, "\n", -1)


def each_line(text, use) -> Column:
    """use applied to every line; use may give several lines."""
    return F.array_join(F.transform(lines_of(text), use), "\n")


def strikethrough(c) -> Column:
    """Doubled negation signs around a text are a broken strike-through."""
    return T.sub(c, "¬{2,}([^¬]+)¬{2,}", "~~$1~~")


def quote_prefix(line) -> Column:
    return F.regexp_extract(line, r"^(\s*>\s*)", 1)


def split_markers(c) -> Column:
    """What is left of doubled signs parts a line: a dot between them begins a list item.  Each part keeps the line's quote sign."""

    def parted(line):
        sign = quote_prefix(line)
        body = T.sub(T.sub(T.after(line, sign), "¬{2,}●¬{2,}\\s*¬{2,}", "\n- "), "¬{2,}(?:\\s*¬{2,})?", "\n")
        kept = F.transform(F.filter(F.split(body, "\n", -1), lambda x: T.strip(x) != ""), lambda x: F.concat(sign, F.rtrim(x)))
        return F.when(~F.contains(line, F.lit("¬¬")), line).when(F.size(kept) == 0, F.rtrim(sign)).otherwise(F.array_join(kept, "\n"))

    return each_line(c, parted)


def clamp_headings(c) -> Column:
    return T.sub(c, r"(?m)^#{1,3}(\s)", "####$1")


def _compares(line) -> Column:
    """Lines that set an old wording against a new one keep what looks like a page number."""
    return line.rlike(r"(?i)\bEra:.*\bPassou:")


def drop_page_number(c, n) -> Column:
    """The printed page number at the end of the last line that is not blank, with the blanks before it; of a quote that holds no more, the line."""

    def dropped(found):
        lines, at = found["lines"], found["at"]
        line = F.get(lines, at)
        sign = quote_prefix(line)
        body = T.after(line, sign)
        number = F.regexp_extract(body, r"(?:^|[ \t])([0-9]+)[ \t]*$", 1)
        rest = F.rtrim(F.substr(F.rtrim(body), F.lit(1), F.length(F.rtrim(body)) - F.length(number)))
        hit = (at >= 0) & (number == n.cast("string")) & ~_compares(line) & (rest.isNotNull()) & ((sign != "") | (F.length(rest) < F.length(F.rtrim(body)) - F.length(number)))
        new = F.filter(F.transform(lines, lambda x, i: F.when(i == at, F.when((rest == "") & (sign != ""), F.lit(None).cast("string")).otherwise(F.concat(sign, rest))).otherwise(x)), lambda x: x.isNotNull())
        return F.array_join(F.when(F.coalesce(hit, F.lit(False)), new).otherwise(lines), "\n")

    lines = lines_of(c)
    last = F.size(lines) - F.array_position(F.transform(F.reverse(lines), lambda x: T.strip(x) != ""), True).cast("int")
    return F.get(F.transform(F.array(F.struct(lines.alias("lines"), F.when(F.exists(lines, lambda x: T.strip(x) != ""), last).otherwise(-1).alias("at"))), dropped), F.lit(0))


def split_clauses(c) -> Column:
    """Long lines part before items, paragraphs and sub-items; each part keeps the line's quote sign."""

    def parted(line):
        sign = quote_prefix(line)
        parts = F.split(T.after(line, sign), r"(?i)[ \t]+(?=[IVXLCDM]{1,8}\s*[-–—]\s|§\s*[0-9]+\b|\(?[a-z]\)\s)", -1)
        return F.when((F.length(line) < PARAMS.long_clause) | _compares(line), line).otherwise(F.array_join(F.transform(parts, lambda x: F.concat(sign, x)), "\n"))

    return each_line(c, parted)


def plain_title(c) -> Column:
    return T.strip(T.sub(T.sub(T.strip(c), r"^#{1,6}\s*"), r"\*\*|__"))


def shown_title(line) -> Column:
    """A line without the signs of a heading; emphasis stays."""
    return T.strip(T.sub(T.strip(line), r"^#{1,6}\s*"))


def normalize_pages(text) -> Column:
    """Pages without what doubled signs and printed numbers have left, their marks kept; then long clauses part."""
    bodies, numbers = F.split(text, PAGE_MARK, -1), F.regexp_extract_all(text, F.lit(PAGE_MARK), F.lit(1))

    def page(body, i):
        n = F.get(numbers, i)
        mark = F.concat(F.lit("\n\n---\n*p. "), n, F.lit("*\n\n---\n"))
        return F.when(n.isNull(), split_markers(body)).otherwise(F.concat(drop_page_number(split_markers(body), n), mark))

    return split_clauses(F.array_join(F.transform(bodies, page), ""))


def restore_titles(text) -> Column:
    def fixed(line):
        title, out = plain_title(line), line
        for begins, whole in TITLES.items():
            out = F.when(title.rlike(begins), F.lit(whole)).otherwise(out)
        return out

    return each_line(text, fixed)


def heading_of(line) -> Column:
    """A title's line as a heading: the plan of the lesson, summary and theme, blocks, numbered titles by their depth; other lines as they are."""
    title, shown = plain_title(line), shown_title(line)
    number = F.regexp_extract(title, r"^([0-9.]*[0-9])\)\s+\S", 1)
    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    prefixed = lambda n: F.concat(F.repeat(F.lit("#"), n), F.lit(" "), shown)
    return (
        F.when(title == "", line)
        .when(F.lower(title) == "roteiro de aula", prefixed(F.lit(1)))
        .when((F.lower(title) == "sumário") | title.rlike(r"(?i)^Tema:\s*\S"), prefixed(F.lit(2)))
        .when((F.length(title) > 80) | F.endswith(title, F.lit(".")), line)
        .when(title.rlike(r"(?i)^Bloco\s+[0-9]+\s*$"), prefixed(F.lit(3)))
        .when((number != "") & ~F.contains(number, F.lit("..")), prefixed(F.least(F.lit(6), 3 + dots)))
        .otherwise(line)
    )


def format_titles(text) -> Column:
    """Titles as headings, the lines of a summary as a list up to a rule, labels of titles that go on in italics; front matter stays.

    A label whose title repeats the line before it is dropped.  One fold over the lines, as that line is what was put out before.
    """
    front = F.when(F.startswith(text, F.lit("---\n")) & (F.locate("\n---\n", text, 4) > 0), F.substr(text, F.lit(1), F.locate("\n---\n", text, 4) + 4)).otherwise("")

    def step(acc, line):
        bare = T.strip(line)
        title, shown = plain_title(bare), shown_title(bare)
        inside = acc["inside"] & (bare != "---")
        opens = F.lower(title) == "sumário"
        listed = F.when(title.rlike(r"(?i)^Tema:\s*\S"), F.concat(F.lit("## "), shown)).otherwise(F.concat(F.lit("- "), T.strip(T.sub(shown, "^[- ]+"))))
        label = F.regexp_extract(F.lower(title), r"^\((continuação|continuando)\)", 1)
        subject = T.strip(T.sub(title, r"^\([^)]*\)"))
        styled = F.contains(bare, F.lit("**")) | bare.rlike(r"(?<!\*)\*(?!\*)")
        again = (subject != "") & (F.lower(shown_title(F.coalesce(F.element_at(acc["out"], -1), F.lit("")))) == F.lower(subject)) & (F.size(acc["out"]) > 0)
        new = (
            F.when(opens, F.concat(F.lit("## "), shown))
            .when(inside & (bare != ""), listed)
            .when((label != "") & styled, line)
            .when((label != "") & again, F.lit(None).cast("string"))
            .when(label != "", F.rtrim(F.concat(F.lit("*("), label, F.lit(")* "), subject)))
            .otherwise(heading_of(line))
        )
        return F.struct((opens | inside).alias("inside"), F.when(new.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(new))).alias("out"))

    state = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("out"))
    return F.concat(front, F.array_join(F.aggregate(lines_of(T.after(text, front)), state, step)["out"], "\n"))


def replace_table(text, begins: str, ends: str, table) -> Column:
    """The lines from the first that begins with one pattern to the next that begins with the other, replaced by a table; null if either is missing."""

    def found(lines):
        first = F.array_position(F.transform(lines, lambda x: x.rlike("^(?:" + begins + ")")), True).cast("int")
        last = F.array_position(F.transform(lines, lambda x, i: x.rlike("^(?:" + ends + ")") & (i >= first - 1)), True).cast("int")
        return F.struct(lines.alias("lines"), first.alias("first"), last.alias("last"))

    def cut(x):
        whole = F.concat(F.slice(x["lines"], 1, x["first"] - 1), F.array(table), F.slice(x["lines"], x["last"] + 1, F.size(x["lines"])))
        return F.when((x["first"] > 0) & (x["last"] > 0), F.array_join(whole, "\n"))

    one = lambda v, use: F.get(F.transform(F.array(v), use), F.lit(0))
    return one(one(lines_of(text), found), cut)


def small_table(rows: Column, n_rows: int, n_columns: int) -> Column:
    """A pipe table of cells without line breaks, pipes escaped; null unless it has just so many rows and columns."""
    fits = (F.size(rows) == n_rows) & F.forall(rows, lambda r: F.size(r) == n_columns)
    line = lambda r: F.concat(F.lit("|"), F.array_join(F.transform(r, lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))), "|"), F.lit("|"))
    listed = F.transform(rows, line)
    return F.when(fits, F.array_join(F.concat(F.slice(listed, 1, 1), F.array(F.lit("|" + "---|" * n_columns)), F.slice(listed, 2, n_rows)), "\n"))


def repaired(text) -> Column:
    """All repairs: strike-through and pages where there are negation signs, then titles."""
    pages = F.when(F.contains(text, F.lit("¬")), normalize_pages(strikethrough(text))).otherwise(text)
    return format_titles(restore_titles(pages))
