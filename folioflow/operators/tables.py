"""Tables that go on over pages, and their quality flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.params import PARAMS


def is_header(cells: Column) -> Column:
    """All cells are filled, none is a list item, none is long."""
    return F.forall(cells, lambda c: (F.trim(c) != "") & ~T.is_cell_item(F.trim(c)) & (F.length(c) <= PARAMS.header_cell_chars))


def same_row(a: Column, b: Column) -> Column:
    """Rows of equal cells, case and white space aside."""
    plain = lambda r: F.transform(r, lambda c: F.lower(T.strip(T.sub(c, r"\s+", " "))))
    return plain(a) == plain(b)


def is_continuation(cells: Column) -> Column:
    """A row that goes on the one before: a cell is blank, or it is no header."""
    return F.exists(cells, lambda c: F.trim(c) == "") | ~is_header(cells)


def same_grid(a: Column, b: Column) -> Column:
    """As many column edges, each within the tolerance."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda d: d <= PARAMS.grid_tolerance)


def append_cells(row: Column, more: Column) -> Column:
    """row with the filled cells of more behind its own, by <br>; cells beyond its width are dropped."""
    cell = lambda a, b: F.when(F.trim(F.coalesce(b, F.lit(""))) == "", a).when(a == "", b).otherwise(F.concat(a, F.lit("<br>"), b))
    return F.transform(row, lambda a, i: cell(a, F.get(more, i)))


_GROUP = "start_page int, end_page int, header array<string>, rows array<array<string>>, grid array<double>, columns int, bottom double, n_parts int, as_image boolean"


def merge_parts(parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, group_no, start_page, end_page, header, rows, n_parts, as_image): tables that go on from page to page, put together.

    parts has key, page_index, table_seq (order on its page), top and bottom as shares of the page, columns, grid (column edges), rows and
    as_image.  A page's first table goes on the last one of the page before if that ends low, this begins high, columns and grid agree,
    and its first row is that table's header again or no header.  A repeated header is dropped, a row that goes on is appended to the last row.
    One fold over the document's tables.
    """
    item = F.struct("page_index", "table_seq", "top", "bottom", "columns", "grid", "rows", "as_image")
    kind = f"array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in _split(_GROUP))}>>"

    def group(start, end, header, rows, x, n, image):
        values = dict(start_page=start, end_page=end, header=header, rows=rows, grid=x["grid"], columns=x["columns"], bottom=x["bottom"], n_parts=n, as_image=image)
        return F.struct(*[v.alias(k) for k, v in values.items()])

    def step(acc, x):
        last, first = F.element_at(acc, -1), F.get(x["rows"], F.lit(0))
        again = same_row(first, last["header"])
        goes = (
            (F.size(acc) > 0) & (last["end_page"] == x["page_index"] - 1) & (x["table_seq"] == 0) & (last["bottom"] >= PARAMS.table_bottom) & (x["top"] <= PARAMS.table_top)
            & (last["columns"] == x["columns"]) & same_grid(last["grid"], x["grid"]) & (again | ~is_header(first))
        )
        n = F.size(last["rows"])
        grown = F.concat(F.slice(last["rows"], 1, F.greatest(F.lit(0), n - 1)), F.array(append_cells(F.element_at(last["rows"], -1), first)))
        rest = F.slice(x["rows"], 2, F.greatest(F.lit(0), F.size(x["rows"]) - 1))
        rows = F.when(again, F.concat(last["rows"], rest)).when(is_continuation(first), F.concat(grown, rest)).otherwise(F.concat(last["rows"], x["rows"]))
        whole = group(last["start_page"], x["page_index"], last["header"], rows, x, last["n_parts"] + 1, last["as_image"] | x["as_image"])
        new = group(x["page_index"], x["page_index"], first, x["rows"], x, F.lit(1), x["as_image"])
        return F.when(F.coalesce(goes, F.lit(False)), F.concat(F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1)), F.array(whole))).otherwise(F.concat(acc, F.array(new)))

    folded = parts.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("items"))
    out = folded.select(key, F.posexplode(F.aggregate("items", F.array().cast(kind), step)).alias("group_no", "g"))
    kept = drop_blank_columns(F.col("g.rows"), F.col("g.header"))
    return out.withColumn("kept", kept).select(key, "group_no", "g.start_page", "g.end_page", "kept.header", "kept.rows", "g.n_parts", "g.as_image")


def _split(fields: str) -> list[str]:
    return [x for x in fields.split(", ")]


def drop_blank_columns(rows: Column, header: Column) -> Column:
    """struct<header, rows> without the columns that are blank in every row."""
    width = F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))
    used = F.filter(F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.exists(rows, lambda r: F.trim(F.coalesce(F.get(r, i), F.lit(""))) != ""))
    pick = lambda r: F.filter(r, lambda c, i: F.array_contains(used, i))
    return F.struct(pick(header).alias("header"), F.transform(rows, pick).alias("rows"))


def markdown(rows: Column) -> Column:
    """A pipe table, the first row its header; shorter rows are filled with empty cells.  Empty for no rows."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    line = lambda r: F.concat(F.lit("|"), F.array_join(F.concat(r, F.array_repeat(F.lit(""), F.greatest(F.lit(0), width - F.size(r)))), "|"), F.lit("|"))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), width), "|"), F.lit("|"))
    listed = F.transform(rows, line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(listed, 1, 1), F.array(rule), F.slice(listed, 2, F.greatest(F.lit(1), F.size(listed)))), "\n")).otherwise("")


def plain_text(rows: Column) -> Column:
    """A table as text: the filled cells of each row between bars, their lines as they are; rows without any are left out."""
    filled = lambda r: F.filter(r, lambda c: c != "")
    return F.array_join(F.transform(F.filter(rows, lambda r: F.size(filled(r)) > 0), lambda r: F.array_join(F.transform(filled(r), lambda c: F.replace(c, F.lit("<br>"), F.lit("\n"))), " | ")), "\n")


def is_table(rows: Column, columns: Column) -> Column:
    """A grid that counts as a table: two rows, two columns, two columns with text at least."""
    used = F.filter(F.sequence(F.lit(0), F.greatest(columns - 1, F.lit(0))), lambda i: F.exists(rows, lambda r: F.coalesce(F.get(r, i), F.lit("")) != ""))
    return (F.size(rows) >= 2) & (columns >= 2) & (F.size(used) >= 2)


def is_compact(rows: Column) -> Column:
    """Up to three rows, one of four cells or more."""
    return (F.size(rows) > 0) & (F.size(rows) <= 3) & (F.array_max(F.transform(rows, lambda r: F.size(r))) >= 4)


def compact_law_image(law: Column, parts: Column) -> Column:
    """In notes about law a table of which any part is compact is shown as a picture; parts is an array of arrays of rows."""
    return law & F.exists(parts, is_compact)


def image_callout(names: Column, text: Column) -> Column:
    """A table as pictures, one per part, and its text in a closed callout."""
    embeds = F.array_join(F.transform(names, lambda n: F.concat(F.lit("![["), n, F.lit("]]"))), "\n\n")
    note = F.concat(F.lit("\n\n> [!note]- Texto da tabela\n"), T.quoted(text))
    return F.when(F.trim(text) != "", F.concat(embeds, note)).otherwise(embeds)


def merge_cells(rows: Column) -> Column:
    """Rows with continuation rows (some cell is blank) appended cell by cell with <br> to the row before."""

    def step(acc, r):
        goes = (F.size(acc) > 0) & F.exists(r, lambda c: F.trim(c) == "")
        last = F.element_at(acc, -1)
        grown = F.zip_with(last, r, lambda a, b: F.when(F.trim(F.coalesce(b, F.lit(""))) == "", a).when(F.trim(F.coalesce(a, F.lit(""))) == "", b).otherwise(F.concat(a, F.lit("<br>"), b)))
        return F.when(goes, F.concat(F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1)), F.array(grown))).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(rows, F.array().cast("array<array<string>>"), step)


def average_word(cell: Column) -> Column:
    """Mean length of a cell's words, <br> counting as a blank; 0 without words."""
    found = F.regexp_extract_all(F.replace(cell, F.lit("<br>"), F.lit(" ")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.when(F.size(found) > 0, F.length(F.array_join(found, "")) / F.size(found)).otherwise(0.0)


def fallback(cells: Column) -> Column:
    """True if too many cells are merged (null) or too many filled ones have glued words."""
    filled = F.filter(cells, lambda c: c.isNotNull() & (F.trim(c) != ""))
    merged = F.size(F.filter(cells, lambda c: c.isNull())) / F.greatest(F.size(cells), F.lit(1))
    glued = F.size(F.filter(filled, lambda c: average_word(c) > PARAMS.glued_chars)) / F.greatest(F.size(filled), F.lit(1))
    return (merged > PARAMS.merged_ratio) | (glued >= PARAMS.glued_ratio)


def grid(edges: Column) -> Column:
    """Sorted edges; one within the tolerance of the last merges with it, halfway between the two."""

    def step(acc, x):
        last = F.element_at(acc, -1)
        near = (F.size(acc) > 0) & (x - last <= PARAMS.grid_tolerance)
        return F.when(near, F.concat(F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1)), F.array((last + x) / 2))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(edges), F.array().cast("array<double>"), step)
