"""Further queries: pages of notes, figures, footnote bodies, index blocks, and checks of images and tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflow import fixtures as X
from folioflow.functions import text as T
from folioflow.operators import cells as C
from folioflow.operators import figures as G
from folioflow.operators import reflow as R
from folioflow.params import PARAMS
from folioflow.plans import markdown as M
from folioflow.plans.markdown import JOINED, NL, START, q, sql_strip

PAGED = "cast(floor(pos / 6.0) as int)"


def process_pages(spark, d):
    """Pages reflowed one by one, with the page annotation between them."""
    blocks = R.reflow(X.marked(spark, d).withColumn("page_no", F.expr(PAGED)), ["doc_id", "page_no"])
    pages = R.note_text(blocks, ["doc_id", "page_no"])
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_no", "body"))), lambda x: F.concat(x["body"], F.lit("\n\n---\n*p. "), x["page_no"] + 1, F.lit("*\n\n---\n\n"))), "")
    return pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), T.sub(body, r"\n\n---\n\*p\. [0-9]+\*\n\n---\n\n$").alias("text"))


PAGES_SQL = f"""with {X.MARKED_SQL}, solid as (select *, {PAGED} as page_no from marked where trim(line) <> ''),
 b0 as (select *, sum(cast({START} as int)) over w - first_value(cast({START} as int)) over w as block_no from solid window w as (partition by doc_id, page_no order by pos)),
 b as (select doc_id, page_no, block_no, {JOINED} as text from (select *, {sql_strip('line')} as trimmed from b0) group by doc_id, page_no, block_no),
 p as (select doc_id, page_no, string_agg(text, {NL} || {NL} order by block_no) as body from b group by doc_id, page_no),
 j as (select doc_id, count(*) as n_pages, string_agg(body || {NL} || {NL} || '---' || {NL} || '*p. ' || (page_no + 1) || '*' || {NL} || {NL} || '---' || {NL} || {NL}, '' order by page_no) as t from p group by doc_id)
 select doc_id, n_pages, regexp_replace(t, '\\n\\n---\\n\\*p\\. [0-9]+\\*\\n\\n---\\n\\n$', '') as text from j"""


def index_block(spark, d):
    """The first run of index items among the first blocks, if it has two items at least: where it begins and how long it is."""
    level, _ = T.index_item("line")
    rows = X.marked(spark, d).selectExpr("doc_id", "pos", f"{NUMBERED} as line").where(F.col("pos") < 25 + PARAMS.outline_lines).withColumn("item", level.isNotNull())
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = rows.withColumn("seen", F.max(F.col("item").cast("int")).over(w)).withColumn("breaks", F.sum(F.when((F.col("seen") == 1) & ~F.col("item"), 1).otherwise(0)).over(w))
    return rows.where("item and breaks = 0").groupBy("doc_id").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n")).where("n >= 2 and first_pos < 25")


NUMBERED = "case when pos between doc_id % 3 and doc_id % 3 + 3 then '4.' || cast(pos as string) || ' ' || line else line end"
# the same test of an item as in the query that classifies lines
INDEX_SQL = M.INDEX_SQL.replace("from marked)", f"from (select doc_id, pos, {NUMBERED} as line from marked) where pos < {25 + PARAMS.outline_lines})", 1).rpartition("z as (")[0] + """r as (select doc_id, pos, level is not null as item from y),
 s as (select *, max(cast(item as int)) over (partition by doc_id order by pos) as seen from r), t as (select *, sum(case when seen = 1 and not item then 1 else 0 end) over (partition by doc_id order by pos) as breaks from s)
 select doc_id, min(pos) as first_pos, count(*) as n from t where item and breaks = 0 group by doc_id having count(*) >= 2 and min(pos) < 25"""


def footnote_bodies(spark, d):
    rows = X.lines(spark, d).select("doc_id", F.expr(PAGED).alias("page_no"), "pos", F.when(F.col("pos") % 6 < 2, F.concat("line", F.lit("[^"), F.col("pos") % 6 + 1, F.lit("]"))).when(F.col("pos") % 6 == 3, F.concat(F.lit("1 "), "line")).when(F.col("pos") % 6 == 4, F.concat(F.lit("7 "), "line")).otherwise(F.concat(F.lit("2 "), "line")).alias("line"))
    return G.footnote_bodies(rows)


BODIES_SQL = f"""with {X.LINES_SQL}, l as (select doc_id, {PAGED} as page_no, pos, case when pos % 6 < 2 then line || '[^' || (pos % 6 + 1) || ']' when pos % 6 = 3 then '1 ' || line when pos % 6 = 4 then '7 ' || line else '2 ' || line end as line from lines),
 r as (select *, flatten(list(regexp_extract_all(line, '\\[\\^([0-9]{{1,3}})\\]', 1)) over (partition by doc_id, page_no)) as refs, regexp_extract(line, '^([0-9]{{1,3}})\\s+\\S', 1) as k from l),
 n as (select *, case when k <> '' and list_contains(refs, k) then k end as n from r), f as (select *, n is not null and row_number() over (partition by doc_id, page_no, n order by pos) = 1 as starts from n),
 u as (select *, sum(cast(starts as int)) over (partition by doc_id, page_no order by pos) as run from f)
 select doc_id, page_no, cast(arg_min(n, pos) as int) as note_no, regexp_replace(string_agg(line, ' ' order by pos), '^[0-9]{{1,3}}\\s+', '') as body from u where run > 0 group by doc_id, page_no, run"""


def image_names(spark, d):
    """Figures numbered through each document, with the file name and the embed of each."""
    w = Window.partitionBy("doc_id").orderBy("page_index", "figure_seq")
    rows = X.figures(X.layout(spark, d)).withColumn("n", F.row_number().over(w))
    name = F.format_string("doc%d-img%d-pg%d.png", "doc_id", "n", F.col("page_index") + 1)
    return rows.select("doc_id", "page_index", "figure_seq", name.alias("name"), F.concat(F.lit("![["), name, F.lit("]]")).alias("embed"))


IMAGES_SQL = f"""with {X.SHAPES_SQL}, n as (select *, row_number() over (partition by doc_id order by page_index, figure_seq) as n from figures),
 m as (select *, 'doc' || doc_id || '-img' || n || '-pg' || (page_index + 1) || '.png' as name from n) select doc_id, page_index, figure_seq, name, '![[' || name || ']]' as embed from m"""


def dq_image_pages(spark, d):
    """Embeds that name another page than the one they stand on, and embeds without a file."""
    embeds = image_names(spark, d).select("doc_id", (F.col("page_index") + F.when(F.col("figure_seq") + F.col("doc_id") % 4 == 3, 2).otherwise(1)).alias("page_no"), "embed")
    named = embeds.withColumn("name", F.regexp_extract("embed", r"!\[\[([^\]]+)\]\]", 1)).withColumn("says", F.regexp_extract("embed", r"-pg([0-9]+)\.png", 1).cast("int"))
    files = image_names(spark, d).where("doc_id % 5 <> 0").select(F.col("name").alias("file"))
    lost = named.join(files, F.col("name") == F.col("file"), "left_anti").select("name", F.lit("file is missing").alias("problem"))
    return named.where("says <> page_no").select("name", F.lit("on another page").alias("problem")).unionByName(lost)


IMAGE_DQ_SQL = IMAGES_SQL.rpartition("select doc_id, page_index")[0] + "select name, 'on another page' as problem from m where figure_seq + doc_id % 4 = 3 union all select name, 'file is missing' from m where doc_id % 5 = 0"


def table_blocks(spark, d):
    """Runs of pipe rows: first line, rows, columns, whether the second row is a separator."""
    k = F.col("pos") % 8
    rows = X.lines(spark, d).select("doc_id", "pos", F.when(k < 4, F.when(k == 1, F.lit("| --- | :-: |")).otherwise(F.concat(F.lit("| a | "), F.regexp_replace("line", r"\|", "/"), F.lit(" |")))).otherwise(F.col("line")).alias("line"))
    rows = rows.withColumn("is", F.col("line").rlike(r"^\s*\|.*\|\s*$"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = rows.withColumn("run", F.sum((~F.col("is")).cast("int")).over(w)).where("is")
    sep = F.col("line").rlike(r"^\s*\|(?:\s*:?-{3,}:?\s*\||\s*:-:\s*\|)+\s*$")
    return rows.groupBy("doc_id", "run").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n_rows"), F.max(F.size(F.split("line", r"\|")) - 2).alias("n_columns"), F.bool_or(sep).alias("has_rule")).drop("run")


TABLES_SQL = f"""with {X.LINES_SQL}, r as (select doc_id, pos, case when pos % 8 = 1 then '| --- | :-: |' when pos % 8 < 4 then '| a | ' || replace(line, '|', '/') || ' |' else line end as line from lines),
 i as (select *, regexp_matches(line, '^\\s*\\|.*\\|\\s*$') as is_r from r), u as (select *, sum(cast(not is_r as int)) over (partition by doc_id order by pos) as run from i)
 select doc_id, min(pos) as first_pos, count(*) as n_rows, cast(max(len(string_split(line, '|')) - 2) as int) as n_columns, bool_or(regexp_matches(line, '^\\s*\\|(?:\\s*:?-{{3,}}:?\\s*\\||\\s*:-:\\s*\\|)+\\s*$')) as has_rule from u where is_r group by doc_id, run"""


def law_profile(spark, d):
    meta = F.concat_ws(" ", F.when(F.col("doc_id") % 3 == 0, F.lit("Direito Civil")).when(F.col("doc_id") % 3 == 1, F.lit("dir_penal")), "source", "lang")
    return X.table(spark, d, "documents").select("doc_id", meta.rlike(r"(?i)(?:^|[^A-Za-z0-9])(?:direito|dir)(?:[^A-Za-z0-9]|$)").alias("law"))


def content_preserved(spark, d):
    """Emphasised runs of a note before and after repair, matched by ordinal: what differs."""
    rows = X.marked(spark, d).select("doc_id", "pos", F.posexplode(F.regexp_extract_all("line", F.lit(r"\*\*[^*]+\*\*"), F.lit(0))).alias("k", "run"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "k")))
    a, b = rows.select("doc_id", "n", F.col("run").alias("before")), rows.where("doc_id % 4 <> 0 or n > 1").select("doc_id", "n", F.when(F.col("doc_id") % 7 == 0, F.upper("run")).otherwise(F.col("run")).alias("after"))
    return a.join(b, ["doc_id", "n"], "full").where(~F.col("before").eqNullSafe(F.col("after"))).select("doc_id", F.col("n").cast("long").alias("n"), "before", "after")


PRESERVED_SQL = f"""with {X.MARKED_SQL}, e as (select doc_id, pos, regexp_extract_all(line, '\\*\\*[^*]+\\*\\*', 0) as rs from marked), x as (select doc_id, pos, i as k, rs[i] as run from e, unnest(range(1, len(rs) + 1)) as u(i)),
 r as (select *, row_number() over (partition by doc_id order by pos, k) as n from x), b as (select doc_id, n, case when doc_id % 7 = 0 then upper(run) else run end as after from r where doc_id % 4 <> 0 or n > 1)
 select r.doc_id, r.n, r.run as before, b.after as after from r left join b on r.doc_id = b.doc_id and r.n = b.n where r.run is distinct from b.after"""


def ocr_callout(spark, d):
    rows = X.lines(spark, d).groupBy("doc_id", F.expr(PAGED).alias("page_no")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("t"))
    note = F.concat(F.lit("> [!note]- Texto OCR (aproximado)\n"), T.quoted("t"))
    return rows.where(F.length(F.regexp_replace("t", r"\s", "")) >= 4).select("doc_id", "page_no", note.alias("text"))


OCR_SQL = f"""with {X.LINES_SQL}, p as (select doc_id, {PAGED} as page_no, string_agg(line, {NL} order by pos) as t from lines group by all)
 select doc_id, page_no, '> [!note]- Texto OCR (aproximado)' || {NL} || array_to_string(list_transform(string_split(t, {NL}), lambda l: case when trim(l) <> '' then '> ' || l else '>' end), {NL}) as text from p where length(regexp_replace(t, '\\s', '', 'g')) >= 4"""


def numeric_fragments(spark, d):
    lay = X.layout(spark, d).withColumn("text", F.when(F.col("line_seq") % 3 == 1, F.concat(F.col("line_seq"), F.lit("."))).otherwise(F.col("text")))
    lay = lay.withColumn("y0", F.when(F.col("line_seq") % 3 == 2, 60.0 + (F.col("line_seq") - 1) * 14).when(F.col("line_seq") % 3 == 1, 60.0 + F.col("line_seq") * 14).otherwise(F.col("y0")))
    return G.joined_numbers(lay.withColumn("x0", F.when(F.col("line_seq") % 3 == 2, 60.0).otherwise(36.0)).withColumn("x1", F.lit(50.0)))


NUMBERS_SQL = f"""with recursive {X.LAYOUT_SQL}, l as (select doc_id, page_index, line_seq, case when line_seq % 3 = 1 then line_seq || '.' else text end as tx, case when line_seq % 3 = 2 then 60.0 + (line_seq - 1) * 14 when line_seq % 3 = 1 then 60.0 + line_seq * 14 else y0 end as y, case when line_seq % 3 = 2 then 60.0 else 36.0 end as x from layout),
 o as (select *, row_number() over w as rn, lead(tx) over w as nt, coalesce(regexp_matches(tx, '^[0-9]{{1,3}}[.)]$') and abs(lead(y) over w - y) <= 2 and lead(x) over w - 50 between 0 and 24, false) as pair from l window w as (partition by doc_id, page_index order by y, x, line_seq)),
 r as (select * from o where rn = 1 union all select o.* from r join o on o.doc_id = r.doc_id and o.page_index = r.page_index and o.rn = r.rn + case when r.pair then 2 else 1 end)
 select doc_id, page_index, line_seq, case when pair then tx || ' ' || nt else tx end as text from r"""


def vector_figures(spark, d):
    lay = X.layout(spark, d)
    shapes = lay.selectExpr("doc_id", "page_index", "x0", "y0", "x1", "y0 + 90 as y1")
    rasters = X.figures(lay).selectExpr("doc_id", "page_index", "fx0 as x0", "fy0 as y0", "fx1 as x1", "fy1 as y1")
    return G.vector_figures(shapes, rasters, X.WIDTH, X.HEIGHT)


def char_lines(spark, d):
    """Every line as a cell, its characters dealt over rows of twelve."""
    at = lambda k: (k % 12 * 7).cast("double")
    y = lambda k: (F.floor(k / 12) * 12 + k % 3).cast("double")
    char = lambda c, k: F.struct(c.alias("text"), at(k).alias("x0"), (y(k) - 5).alias("y0"), (at(k) + 6.5).alias("x1"), (y(k) + 5).alias("y1"), F.lit(10.0).alias("size"))
    rows = X.lines(spark, d).select("doc_id", "pos", F.filter(F.transform(F.split("line", ""), char), lambda x: F.trim(x["text"]) != "").alias("chars"))
    return C.cell_lines(rows).select("doc_id", "pos", F.posexplode("lines").alias("line_no", "text"))


def image_anchors(spark, d):
    blocks = X.lines(spark, d).select("doc_id", F.col("pos").cast("long").alias("block_no"), F.col("line").alias("text"))
    images = X.lines(spark, d).select("doc_id", F.col("pos").cast("int").alias("image_seq"), F.col("line").alias("anchor"))
    return G.anchors(images, blocks)


QUERIES = {
    "process_pages": (process_pages, PAGES_SQL),
    "index_block": (index_block, INDEX_SQL),
    "footnote_bodies": (footnote_bodies, BODIES_SQL),
    "image_names": (image_names, IMAGES_SQL),
    "dq_image_pages": (dq_image_pages, IMAGE_DQ_SQL),
    "table_blocks": (table_blocks, TABLES_SQL),
    "law_profile": (law_profile, "select doc_id, doc_id % 3 < 2 as law from documents"),
    "content_preserved": (content_preserved, PRESERVED_SQL),
    "ocr_callout": (ocr_callout, OCR_SQL),
    "numeric_fragments": (numeric_fragments, NUMBERS_SQL),
    "vector_figures": (vector_figures, None),
    "char_lines": (char_lines, None),
    "image_anchors": (image_anchors, None),
}
