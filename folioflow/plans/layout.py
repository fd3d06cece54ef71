"""Queries over laid-out pages and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow import fixtures as X
from folioflow.functions import text as T
from folioflow.operators import layout as L
from folioflow.operators import tables as B
from folioflow.params import PARAMS
from folioflow.plans.markdown import NL, q, sql_strip, sql_sub

W, H = X.WIDTH, X.HEIGHT
LAY = X.LAYOUT_SQL
BAND = f"case when y0 >= {PARAMS.footer_band * H} then 'footer' when y0 <= {PARAMS.header_band * H} then 'header' else 'body' end"
KEY = "regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')"
HEADERS = f"headers as (select doc_id, {KEY} as key, count(distinct page_index) as n_pages from layout where {BAND} = 'header' and length({KEY}) >= {PARAMS.header_min_chars} group by 1, 2 having count(distinct page_index) >= {PARAMS.header_min_pages})"
MEDIAN = "medians as (select doc_id, list_sort(list(size))[cast(floor(count(*) / 2) as int) + 1] as median from layout group by doc_id)"
_T = sql_strip(sql_sub("text", r"\s+", " "))
_UP = "(upper(t) = t and lower(t) <> t)"
# a dotted number and what parts it from the title; a capital and a parenthesis
NUMBERED, LETTERED = "'^[0-9]+(?:[.][0-9]+)*(?:[.]\\s+|\\s*[)—–-]\\s*|\\s+)\\S'", "'^[A-Z](?:[.][0-9]+)?[)]\\s+\\S'"
TITLE = f"""(case when length(t) < 3 or length(t) > 120 or regexp_matches(t, '[.!?:;]$') or regexp_matches(t, '[.!?]\\s+[0-9A-Za-zÀ-ÿ_]{{1,3}}$') then false when regexp_matches(t, '(?i)^bloco\\s+[0-9]+$') then true
 when regexp_matches(t, {NUMBERED}) then length(t) <= 85 and (bold or {_UP} or size >= median * 1.12) when regexp_matches(t, {LETTERED}) then (bold or {_UP} or size >= median * 1.12)
 when bold then true else page_index <> 0 and {_UP} and length(t) <= 60 and (centered or size >= median * 1.08 or height >= greatest(10, median * 1.08)) end)"""
TITLES = f"{LAY}, {MEDIAN}, titled as (select * from (select l.*, {_T} as t, median from layout l join medians using (doc_id)) where {TITLE})"


def _overlap(i: str, o: str) -> str:
    ix0, iy0, ix1, iy1 = (i + c for c in ("x0", "y0", "x1", "y1"))
    ox0, oy0, ox1, oy1 = (o + c for c in ("x0", "y0", "x1", "y1"))
    w, h = f"(least({ix1}, {ox1}) - greatest({ix0}, {ox0}))", f"(least({iy1}, {oy1}) - greatest({iy0}, {oy0}))"
    return f"(case when {w} > 0 and {h} > 0 and {ix1} > {ix0} and {iy1} > {iy0} then {w} * {h} / (({ix1} - {ix0}) * ({iy1} - {iy0})) else 0 end)"


def footer_split(spark, d):
    return L.bands(X.layout(spark, d), H).groupBy("doc_id", "band").agg(F.count("*").alias("n"), F.max("page_index").alias("last_page"))


def repeated_headers(spark, d):
    return L.repeated_headers(X.layout(spark, d), H)


def body_lines(spark, d):
    return L.body_lines(X.layout(spark, d), H).select("doc_id", "page_index", "line_seq")


def printed_page_rule(spark, d):
    rows = X.layout(spark, d).withColumn("text", F.when((F.col("doc_id") % 4 == 0) & (F.col("page_index") == 1), F.replace("text", F.lit("page"), F.lit("p1 then"))).otherwise(F.col("text")))
    rows = rows.where("not (doc_id % 3 = 0 and line_seq = 7)")
    return L.printed_pages(rows, H).select("doc_id", "page_index", F.col("label").cast("long").alias("label"), "printed")


PRINTED_SQL = f"""with {LAY}, a as (select *, case when doc_id % 4 = 0 and page_index = 1 then replace(text, 'page', 'p1 then') else text end as tx from layout where not (doc_id % 3 = 0 and line_seq = 7)),
 n as (select doc_id, page_index, cast(list_last(flatten(list(case when y0 >= {PARAMS.footer_band * H} then regexp_extract_all(tx, '\\b([0-9]{{1,3}})\\b', 1) else [] end order by line_seq))) as int) as n from a group by all),
 k as (select *, n is not null and (lag(n) over w is null or n > lag(n) over w) as ok from n window w as (partition by doc_id order by page_index)), e as (select *, bool_and(coalesce(ok, false)) over (partition by doc_id) as printed from k)
 select doc_id, page_index, cast(case when printed then n else page_index + 1 end as bigint) as label, printed from e"""


def upper_median_size(spark, d):
    return L.upper_median(X.layout(spark, d))


def heading_level(spark, d):
    return L.heading_levels(X.layout(spark, d), W, H).select("doc_id", "page_index", "line_seq", F.col("level").cast("int").alias("level"))


_NUMBER = f"case when regexp_matches(t, '(?i)^bloco\\s+[0-9]+$') then '' when regexp_matches(t, {NUMBERED}) then regexp_extract(t, '^[0-9.]*[0-9]', 0) when regexp_matches(t, {LETTERED}) then split_part(t, ')', 1) else '' end"
LEVELS_SQL = f"""with {LAY}, {MEDIAN}, l as (select l.*, {_T} as t, median from layout l join medians using (doc_id)),
 v as (select doc_id, page_index, line_seq, case when lower(t) in ('sumário', 'roteiro de aula') or ({_UP} and length(t) >= 12 and y0 <= {0.18 * H} and x1 - x0 <= {0.85 * W}) then 4
 when {TITLE} then cast(least(6, 4 + length({_NUMBER}) - length(replace({_NUMBER}, '.', ''))) as int) end as level from l) select * from v where level is not null"""


def heading_styles(spark, d):
    return L.heading_styles(X.layout(spark, d)).select("doc_id", "size", "bold", "centered", F.col("level").cast("int").alias("level"))


def paragraph_islands(spark, d):
    return L.paragraphs(X.layout(spark, d), W).select("doc_id", "page_index", "line_seq", F.col("paragraph").cast("long").alias("paragraph"))


PARAGRAPH_SQL = f"""with {LAY}, h as (select *, coalesce({TITLE.replace('median', '0')}, false) as heads, coalesce(list_text_x, x0) as lft from (select *, {_T} as t from layout) l),
 p as (select *, lag(size) over w as ps, lag(bold) over w as pb, lag(centered) over w as pc, lag(heads) over w as ph, lag(lft) over w as px0, lag(x1) over w as px1, lag(y1) over w as py1, lag(text) over w as pt, lag(height) over w as pht from h window w as (partition by doc_id, page_index order by y0, x0, line_seq)),
 g as (select *, coalesce(list_marker is null and not ph and not heads and ps = size and pb = bold and pc = centered and abs(x0 - px0) <= {PARAMS.paragraph_left_tolerance} and y0 - py1 <= {PARAMS.paragraph_gap_factor} * pht and px1 >= {PARAMS.paragraph_right_edge * W} and not regexp_matches({sql_strip('pt')}, '[.!?:]$'), false) as goes from p)
 select doc_id, page_index, line_seq, cast(sum(cast(not goes as int)) over (partition by doc_id, page_index order by y0, x0, line_seq) as bigint) as paragraph from g"""


def summary_state(spark, d):
    """Lines inside a summary; the line after each summary's title is an outline line."""
    return L.summary_state(X.layout(spark, d)).where("in_summary").select("doc_id", "page_index", "line_seq")


SUMMARY_SQL = f"""with {LAY}, o as (select *, lower({_T}) = 'sumário' as opens, regexp_matches({_T}, {q(T.OUTLINE)}) as lists from layout),
 r as (select *, sum(cast(opens as int)) over (partition by doc_id, page_index order by y0, x0, line_seq) as run from o),
 b as (select *, sum(cast(not opens and not lists as int)) over (partition by doc_id, page_index, run order by y0, x0, line_seq) as breaks from r)
 select doc_id, page_index, line_seq from b where run > 0 and not opens and breaks = 0"""


def degenerate_lines(spark, d):
    lay = X.layout(spark, d)
    return lay.where(L.is_degenerate(F.col("text"), F.col("x0"), F.col("x1") - F.when(F.col("line_seq") == 2, 20).otherwise(0))).select("doc_id", "page_index", "line_seq")


def reading_order_rows(spark, d):
    return L.reading_order(X.layout(spark, d))


def figure_table_antijoin(spark, d):
    lay = X.layout(spark, d)
    return L.outside(X.figures(lay), X.boxes(lay), L.FIGURE, L.BOX).select("doc_id", "page_index", "figure_seq")


def line_table_antijoin(spark, d):
    lay = X.layout(spark, d)
    return L.outside(lay, X.boxes(lay), L.LINE, L.BOX).select("doc_id", "page_index", "line_seq")


def heading_candidates(spark, d):
    lay = X.layout(spark, d)
    return L.outside(L.outside(lay, X.boxes(lay), L.LINE, L.BOX), X.figures(lay), L.LINE, L.FIGURE).groupBy("doc_id").agg(F.count("*").alias("n"))


def line_figure_assign(spark, d):
    lay = X.layout(spark, d)
    return L.owners(lay, X.figures(lay))


def event_union(spark, d):
    lay = X.layout(spark, d)
    return L.events(lay, X.figures(lay), X.boxes(lay)).groupBy("doc_id", "page_index", "kind").agg(F.count("*").alias("n"), F.min("y").alias("top"))


def image_strip_groups(spark, d):
    rows = X.layout(spark, d).selectExpr("doc_id", "page_index", "line_seq", "x0", "x0 + 100 + 40 * (doc_id % 2) * (line_seq % 3) as x1", "cast(line_seq * 20 as double) as y0", "cast(line_seq * 20 + 18 + (line_seq % 3) * 3 - 4 * (line_seq % 2) as double) as y1")
    return L.strips(rows).select("doc_id", "page_index", "line_seq", F.col("strip").cast("long").alias("strip"))


STRIP_SQL = f"""with {LAY}, s as (select doc_id, page_index, line_seq, x0, x0 + 100 + 40 * (doc_id % 2) * (line_seq % 3) as x1, line_seq * 20 as y0, line_seq * 20 + 18 + (line_seq % 3) * 3 - 4 * (line_seq % 2) as y1 from layout),
 p as (select *, lag(x0) over w as px0, lag(x1) over w as px1, lag(y1) over w as py1 from s window w as (partition by doc_id, page_index order by y0, x0, line_seq)),
 g as (select *, coalesce(abs((x1 - x0) - (px1 - px0)) <= 1 and abs(x0 - px0) <= 1 and abs(y0 - py1) <= 3, false) as goes from p)
 select doc_id, page_index, line_seq, cast(sum(cast(not goes as int)) over (partition by doc_id, page_index order by y0, x0, line_seq) as bigint) as strip from g"""


def list_origin(spark, d):
    lay = X.layout(spark, d)
    return lay.groupBy("doc_id", "page_index").agg(F.coalesce(F.min(F.when(F.col("text").rlike(r"^A\) "), F.col("x0"))), F.lit(0.0)).alias("origin"))


_FLAGS = "case pos % 4 when 0 then 16 when 1 then 2 when 2 then 18 else 0 end"


def _spans(spark, d):
    """Lines as three spans each: the first third of the characters, the second, the rest, with flags, a font and gaps of their own; some with a list's sign before."""
    n = F.floor(F.length("line") / 3).cast("int")
    span = lambda text, flags, font, x0, x1: F.struct(text.alias("text"), (10 + F.col("pos") % 3).cast("double").alias("size"), flags.cast("int").alias("flags"), F.lit(font).alias("font"), F.struct(F.lit(float(x0)).alias("x0"), F.lit(100.0).alias("y0"), F.lit(float(x1)).alias("x1"), F.lit(112.0).alias("y1")).alias("bbox"))
    parts = F.array(span(F.substr("line", F.lit(1), n), F.expr(_FLAGS), "F", 100, 200), span(F.substr("line", n + 1, n), F.lit(16), "F", 200, 300), span(F.substr("line", 2 * n + 1, F.length("line")), F.expr(_FLAGS), "F", 302, 520))
    sign = F.array(span(F.when(F.col("pos") % 5 == 2, "•").otherwise("o"), F.lit(0), "Courier", 80, 90))
    note = F.array(span(F.lit("7"), F.lit(1), "F", 520, 524))
    rows = X.lines(spark, d).where(F.length("line") >= 9)
    return rows.select("doc_id", "pos", F.concat(F.when(F.col("pos") % 5 > 2, F.array().cast(sign_type(sign))).when(F.col("pos") % 5 > 0, sign).otherwise(F.array().cast(sign_type(sign))), parts, F.when(F.col("pos") % 3 == 0, note).otherwise(F.array().cast(sign_type(sign)))).alias("spans"))


def sign_type(_) -> str:
    return "array<struct<text:string,size:double,flags:int,font:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>"


def line_record(spark, d):
    """Line fields from spans."""
    return L.line_records(_spans(spark, d), W).select("doc_id", "pos", "text", "size", "height", "bold", "any_bold", "italic", "centered", "list_marker", "list_text_x")


def line_format(spark, d):
    """Lines as Markdown."""
    rows = L.line_records(_spans(spark, d), W)
    return rows.select("doc_id", "pos", L.formatted("spans", F.col("text"), F.col("list_marker"), F.col("x0"), F.col("size"), F.lit(40.0)).alias("text"))


_N = "cast(floor(length(line) / 3) as int)"
_A, _B, _C = f"substr(line, 1, {_N})", f"substr(line, {_N} + 1, {_N})", f"substr(line, 2 * {_N} + 1)"
_GAP = lambda x, y: f"case when regexp_matches({x}, '\\s$') or regexp_matches({y}, '^\\s') then '' else ' ' end"
_PARTS = f"""{X.LINES_SQL}, s as (select doc_id, pos, {_A} as a, {_B} as b, {_C} as c, case pos % 5 when 1 then 'o' when 2 then '•' else '' end as sign, case when pos % 3 = 0 then '7' else '' end as note, {_FLAGS} as fl from lines where length(line) >= 9),
 t as (select *, a || b || {_GAP("a || b", "c")} || c || note as body, list_filter([sign, a, b, c, note], lambda x: trim(x) <> '') as seen, (trim(a) <> '' or trim(c) <> '') as outer_seen, trim(b) <> '' as b_seen from s)"""
RECORD_SQL = f"""with {_PARTS}
 select doc_id, pos, {sql_strip("case when sign <> '' then sign || " + _GAP("sign", "a") + " || body else body end")} as text, case when len(seen) > 0 then cast(10 + pos % 3 as double) else 12.0 end as size, cast(12 as double) as height,
 len(seen) > 0 and sign = '' and note = '' and (not outer_seen or fl in (16, 18)) as bold, b_seen or (outer_seen and fl in (16, 18)) as any_bold, len(seen) > 0 and sign = '' and note = '' and not b_seen and fl in (2, 18) as italic,
 case when sign <> '' then abs(300 - 306) <= 18.36 when note <> '' then abs(312 - 306) <= 18.36 else true end as centered,
 case when sign <> '' and (trim(a) <> '' or trim(b) <> '' or trim(c) <> '' or note <> '') then sign end as list_marker, cast(case when sign = '' then null when trim(a) <> '' then 100 when trim(b) <> '' then 200 when trim(c) <> '' then 302 when note <> '' then 520 end as double) as list_text_x from t"""


def _tables(spark, d):
    """An order's lines as tables of two rows each, one to a page: with a header like all others, or one that goes on from the row before."""
    head = F.when(F.col("header") == "Part", F.array(F.lit("Part"), F.lit("Qty"), F.lit("Blank"))).otherwise(F.array(F.lit(""), F.concat(F.lit("- "), F.col("header")), F.lit("")))
    rows = F.array(head, F.array(F.concat(F.lit("row "), F.col("page_index").cast("string")), F.col("qty").cast("string"), F.lit("")))
    grid = F.array(F.lit(36.0), 200.0 + F.col("qty") % 3, F.lit(500.0))
    return X.parts(spark, d).select(F.col("order_id").alias("doc_id"), "page_index", F.lit(0).alias("table_seq"), "top", "bottom", "columns", grid.alias("grid"), rows.alias("rows"), (F.col("qty") == 50).alias("as_image"))


def table_continuation(spark, d):
    return B.merge_parts(_tables(spark, d)).select("doc_id", "group_no", "start_page", "end_page", "n_parts", "as_image", B.markdown(F.col("rows")).alias("text"))


# in a run of pages without a break a header begins a new table only where the table in hand has another one, that is, once at most
TABLE_SQL = f"""with {X.PARTS_SQL}, p as (select *, lag(page_index) over w as pp, lag(bottom) over w as pbot, lag(columns) over w as pc from parts window w as (partition by order_id order by page_index)),
 b as (select *, header = 'Part' as heads, not coalesce(pp + 1 = page_index and pbot >= {PARAMS.table_bottom} and top <= {PARAMS.table_top} and pc = columns, false) as breaks from p),
 r as (select *, sum(cast(breaks as int)) over (partition by order_id order by page_index) as run from b),
 h as (select *, first_value(heads) over (partition by order_id, run order by page_index) as led, sum(cast(heads as int)) over (partition by order_id, run order by page_index) as n_heads from r),
 g as (select *, sum(cast(breaks or (heads and not led and n_heads = 1) as int)) over (partition by order_id order by page_index) - 1 as group_no from h),
 f as (select *, page_index = min(page_index) over w as first, first_value(header) over w as led_by, first_value(heads) over w as lead_heads from g window w as (partition by order_id, group_no order by page_index)),
 k as (select *, lead(case when heads or header = led_by then '' else '<br>- ' || header end) over (partition by order_id, group_no order by page_index) as grown from f)
 select order_id as doc_id, cast(group_no as int) as group_no, min(page_index) as start_page, max(page_index) as end_page, cast(count(*) as int) as n_parts, bool_or(qty = 50) as as_image,
 max(case when first then case when heads then '|Part|Qty|Blank|' || {NL} || '|---|---|---|' else '||- ' || header || '|' || {NL} || '|---|---|' end end) || {NL} ||
 string_agg('|row ' || page_index || '|' || qty || coalesce(grown, '') || '|' || case when lead_heads then '|' else '' end, {NL} order by page_index) as text from k group by order_id, group_no"""


def table_markdown(spark, d):
    cells = F.array(F.col("header"), F.when(F.col("qty") % 5 == 0, F.lit("")).otherwise(F.col("qty").cast("string")), F.col("columns").cast("string"))
    rows = X.parts(spark, d).groupBy("order_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("page_index", cells.alias("r")))), lambda x: x["r"]).alias("rows"))
    return rows.select("order_id", B.markdown(F.concat(F.array(F.array(F.lit("a"), F.lit("b"), F.lit("c"))), B.merge_cells(F.col("rows")))).alias("text"))


def table_fallback_flags(spark, d):
    rows = X.lines(spark, d).groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.when(F.col("pos") % 4 != 3, F.when(F.col("doc_id") % 6 == 0, F.regexp_replace("line", " ", "")).otherwise(F.col("line"))).alias("c")))), lambda x: x["c"]).alias("cells"))
    return rows.select("doc_id", F.size(F.filter("cells", lambda c: c.isNull())).cast("long").alias("merged"), B.fallback(F.col("cells")).alias("as_image"))


_AVG = "case when len(regexp_extract_all(c, '[\\p{L}\\p{N}]+')) > 0 then length(array_to_string(regexp_extract_all(c, '[\\p{L}\\p{N}]+'), '')) / len(regexp_extract_all(c, '[\\p{L}\\p{N}]+')) else 0 end"
FALLBACK_SQL = f"""with {X.LINES_SQL}, c as (select doc_id, pos, case when pos % 4 <> 3 then case when doc_id % 6 = 0 then replace(line, ' ', '') else line end end as c from lines)
 select doc_id, count(*) filter (c is null) as merged, count(*) filter (c is null) / count(*) > {PARAMS.merged_ratio} or count(*) filter (trim(c) <> '' and {_AVG} > {PARAMS.glued_chars}) / greatest(count(*) filter (trim(c) <> ''), 1) >= {PARAMS.glued_ratio} as as_image from c group by doc_id"""


def table_grid(spark, d):
    edges = X.layout(spark, d).groupBy("doc_id", "page_index").agg(F.concat(F.collect_list("x0"), F.collect_list("x1")).alias("edges"))
    return edges.select("doc_id", "page_index", F.size(B.grid(F.col("edges"))).alias("n_edges"), F.element_at(B.grid(F.col("edges")), -1).alias("last_edge"))


GRID_SQL = f"""with recursive {LAY}, e as (select doc_id, page_index, unnest([x0, x1]) as x from layout), o as (select *, row_number() over (partition by doc_id, page_index order by x) as rn from e),
 r as (select doc_id, page_index, rn, x as edge, 1 as n_edges from o where rn = 1 union all
 select o.doc_id, o.page_index, o.rn, case when o.x - r.edge <= {PARAMS.grid_tolerance} then (r.edge + o.x) / 2 else o.x end, r.n_edges + cast(o.x - r.edge > {PARAMS.grid_tolerance} as int) from r join o on o.doc_id = r.doc_id and o.page_index = r.page_index and o.rn = r.rn + 1)
 select doc_id, page_index, arg_max(n_edges, rn) as n_edges, arg_max(edge, rn) as last_edge from r group by all"""
ORDER_SQL = f"""with recursive {LAY}, o as (select *, row_number() over (partition by doc_id, page_index order by y0, x0, line_seq) as rn from layout),
 r as (select doc_id, page_index, line_seq, x0, rn, y0 as anchor, 1 as row_no from o where rn = 1 union all
 select o.doc_id, o.page_index, o.line_seq, o.x0, o.rn, case when o.y0 > r.anchor + {PARAMS.row_tolerance} then o.y0 else r.anchor end, r.row_no + cast(o.y0 > r.anchor + {PARAMS.row_tolerance} as int) from r join o on o.doc_id = r.doc_id and o.page_index = r.page_index and o.rn = r.rn + 1)
 select doc_id, page_index, line_seq, row_no, cast(row_number() over (partition by doc_id, page_index order by row_no, x0, line_seq) - 1 as int) as place from r"""
_STYLE = lambda x: f"case fl when 16 then '**' || {x} || '**' when 2 then '*' || {x} || '*' when 18 then '***' || {x} || '***' else {x} end"
FORMAT_SQL = f"""with {_PARTS} select doc_id, pos, case when sign <> '' then rtrim('    - ' || {sql_strip('body')}) else {sql_strip(_STYLE('a') + " || '**' || b || '**' || case when regexp_matches(c, '^[ " + chr(92) + "t]') then '' else ' ' end || " + _STYLE('c') + " || case when note <> '' then '[^7]' else '' end")} end as text from t"""
MARKDOWN_SQL = f"""with {X.PARTS_SQL}, c as (select order_id, page_index, header, case when qty % 5 = 0 then '' else cast(qty as varchar) end as q, cast(columns as varchar) as n from parts),
 g as (select *, sum(cast(q <> '' or page_index = first as int)) over (partition by order_id order by page_index) as row_no from (select *, min(page_index) over (partition by order_id) as first from c) f),
 m as (select order_id, row_no, string_agg(header, '<br>' order by page_index) as a, arg_min(q, page_index) as b, string_agg(n, '<br>' order by page_index) as d from g group by all)
 select order_id, '|a|b|c|' || {NL} || '|---|---|---|' || {NL} || string_agg('|' || a || '|' || b || '|' || d || '|', {NL} order by row_no) as text from m group by order_id"""


QUERIES = {
    "footer_split": (footer_split, f"with {LAY} select doc_id, {BAND} as band, count(*) as n, max(page_index) as last_page from layout group by all"),
    "repeated_headers": (repeated_headers, f"with {LAY}, {HEADERS} select * from headers"),
    "body_lines": (body_lines, f"with {LAY}, {HEADERS} select doc_id, page_index, line_seq from layout l where {BAND} <> 'footer' and not ({BAND} = 'header' and exists (select 1 from headers h where h.doc_id = l.doc_id and h.key = {KEY}))"),
    "printed_page_rule": (printed_page_rule, PRINTED_SQL),
    "upper_median_size": (upper_median_size, f"with {LAY}, {MEDIAN} select * from medians"),
    "heading_level": (heading_level, LEVELS_SQL),
    "heading_styles": (heading_styles, f"with {TITLES}, s as (select distinct doc_id, size, bold, centered from titled) select *, cast(least(6, 3 + dense_rank() over (partition by doc_id order by size desc, bold desc, centered desc)) as int) as level from s"),
    "summary_state": (summary_state, SUMMARY_SQL),
    "degenerate_lines": (degenerate_lines, f"with {LAY} select doc_id, page_index, line_seq from layout where {sql_strip('text')} = '' or x1 - case when line_seq = 2 then 20 else 0 end - x0 <= 2"),
    "line_format": (line_format, FORMAT_SQL),
    "paragraph_islands": (paragraph_islands, PARAGRAPH_SQL),
    "reading_order_rows": (reading_order_rows, ORDER_SQL),
    "figure_table_antijoin": (figure_table_antijoin, f"with {X.SHAPES_SQL} select doc_id, page_index, figure_seq from figures f where not exists (select 1 from boxes b where b.doc_id = f.doc_id and b.page_index = f.page_index and {_overlap('f.f', 'b.t')} >= {PARAMS.overlap_owner})"),
    "line_table_antijoin": (line_table_antijoin, f"with {X.SHAPES_SQL} select doc_id, page_index, line_seq from layout l where not exists (select 1 from boxes b where b.doc_id = l.doc_id and b.page_index = l.page_index and {_overlap('l.', 'b.t')} >= {PARAMS.overlap_owner})"),
    "heading_candidates": (
        heading_candidates,
        f"with {X.SHAPES_SQL} select doc_id, count(*) as n from layout l where not exists (select 1 from boxes b where b.doc_id = l.doc_id and b.page_index = l.page_index and {_overlap('l.', 'b.t')} >= {PARAMS.overlap_owner}) and not exists (select 1 from figures f where f.doc_id = l.doc_id and f.page_index = l.page_index and {_overlap('l.', 'f.f')} >= {PARAMS.overlap_owner}) group by doc_id",
    ),
    "line_figure_assign": (line_figure_assign, f"with {X.SHAPES_SQL} select l.doc_id, l.page_index, l.line_seq, min(f.figure_seq) as figure_seq from layout l left join figures f on f.doc_id = l.doc_id and f.page_index = l.page_index and {_overlap('l.', 'f.f')} >= {PARAMS.overlap_owner} group by all"),
    "event_union": (
        event_union,
        f"with {X.SHAPES_SQL}, e as (select doc_id, page_index, y0 as y, 'text' as kind from layout union all select doc_id, page_index, fy0, 'figure' from figures union all select doc_id, page_index, ty0, 'table' from boxes) select doc_id, page_index, kind, count(*) as n, cast(min(y) as double) as top from e group by all",
    ),
    "image_strip_groups": (image_strip_groups, STRIP_SQL),
    "list_origin": (list_origin, f"with {LAY} select doc_id, page_index, coalesce(min(x0) filter (regexp_matches(text, '^A\\) ')), 0) as origin from layout group by all"),
    "line_record": (line_record, RECORD_SQL),
    "table_continuation": (table_continuation, TABLE_SQL),
    "table_markdown": (table_markdown, MARKDOWN_SQL),
    "table_fallback_flags": (table_fallback_flags, FALLBACK_SQL),
    "table_grid": (table_grid, GRID_SQL),
}
