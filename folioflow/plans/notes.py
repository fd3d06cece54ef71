"""Queries over handout pages, repairs, checks, cells and jobs; the SQL knows how each fixture was put together, not how it is taken apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow import fixtures as X
from folioflow.functions import text as T
from folioflow.operators import catalog as J
from folioflow.operators import cells as C
from folioflow.operators import figures as G
from folioflow.operators import handout as H
from folioflow.operators import layout as L
from folioflow.operators import postprocess as P
from folioflow.operators import quality as Q
from folioflow.operators import tables as B
from folioflow.plans import layout as M
from folioflow.plans.markdown import JOINED, NL, START, sql_strip

# a word that tells the line, then the line without signs that mean something in notes
_SIGNS = ".@/:|<>[]*_#~–—•^()?¬-"
WORDS = f"'w' || cast(pos as string) || ' ' || translate(line, '{_SIGNS}', '{' ' * len(_SIGNS)}')"
PAGE = "cast(floor(pos / 6.0) as int) + 1"
BASE = f"{X.LINES_SQL}, w as (select doc_id, pos, {PAGE} as page_no, pos % 6 as k, {WORDS} as x from lines)"


def _words(spark, d):
    return X.lines(spark, d).selectExpr("doc_id", "pos", f"{PAGE} as page_no", "pos % 6 as k", f"{WORDS} as x")


def _joined(column="t", by="\n"):
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", column))), lambda v: v[column]), by)


def _pages(spark, d, case):
    return _words(spark, d).selectExpr("doc_id", "pos", "page_no", f"{case} as t").where("t is not null").groupBy("doc_id", "page_no").agg(_joined().alias("text"))


_TOPICS = "case pos % 6 when 0 then 'A) ' || line when 2 then '  1ª) ' || line when 3 then '   ' || line when 4 then '3- ' || line else line end"


def handout_reflow(spark, d):
    from folioflow.operators import reflow as R

    return R.reflow(X.lines(spark, d).selectExpr("doc_id", "pos", f"{_TOPICS} as line"), handout=True).select("doc_id", F.col("block_no").cast("long").alias("block_no"), "text")


TOPICS_SQL = f"""with {X.LINES_SQL}, marked as (select doc_id, pos, pos % 6 as k, {_TOPICS} as line from lines), solid as (select *, trim(line) as bare from marked where trim(line) <> ''),
 s as (select *, {sql_strip('line')} as trimmed, (k = 0 and regexp_matches(line, '^A[)] +[^ ]')) or (k = 2 and regexp_matches(line, '^  1ª[)] +[^ ]')) or (k = 4 and regexp_matches(line, '^3- +[^ ]')) or (k not in (0, 2, 3, 4) and {START}) or (k = 4 and {START}) as starts from solid),
 b as (select *, sum(cast(starts as int)) over w - first_value(cast(starts as int)) over w as block_no from s window w as (partition by doc_id order by pos)),
 j as (select doc_id, cast(block_no as bigint) as block_no, {JOINED} as text, arg_min(k = 2 and regexp_matches(line, '^  1ª[)] +[^ ]'), pos) as topic from b group by doc_id, block_no)
 select doc_id, block_no, case when topic then '  ' else '' end || text as text from j"""

_NOTES = "case k when 0 then x || '<sup>1</sup>' when 1 then x || '<sup> 2 </sup>' when 2 then '1 ' || x when 3 then x when 4 then '2 ' || x else '![](i.png)' end"


def handout_pages(spark, d):
    """Pages with two notes each, a footer on each third page, and an image behind the notes."""
    pages = _pages(spark, d, _NOTES).withColumn("text", F.when(F.col("page_no") % 3 == 0, F.concat("text", F.lit("\n77\nwww.site.com.br\n"))).otherwise(F.col("text")))
    rows = H.handout_pages(pages)
    notes = F.array_join(F.transform("notes", lambda n: F.concat(n["number"].cast("string"), F.lit(" "), n["body"])), "|")
    return rows.select("doc_id", "page_no", "label", "text", notes.alias("notes"))


# all pages but the last have six lines, so each page before brings two notes
PAGES_SQL = f"""with {BASE}, p as (select doc_id, page_no, count(*) as n, max(case when k = 0 then x end) as a, max(case when k = 1 then x end) as b, max(case when k = 2 then {sql_strip('x')} end) as c,
 max(case when k = 3 then {sql_strip('x')} end) as e, max(case when k = 4 then {sql_strip('x')} end) as f, 2 * (page_no - 1) as base from w group by doc_id, page_no)
 select doc_id, page_no, case when page_no % 3 = 0 then '77' else cast(page_no as varchar) end as label,
 a || case when n > 2 then '[^' || (base + 1) || ']' else '[^1]' end || coalesce(' ' || b || case when n > 4 then '[^' || (base + 2) || ']' else '[^2]' end, '') || case when n = 6 then {NL} || {NL} || '![](i.png)' else '' end as text,
 coalesce((base + 1) || ' ' || c || coalesce(' ' || e, '') || coalesce('|' || (base + 2) || ' ' || f, ''), '') as notes from p"""


def handout_notes(spark, d):
    """Whole notes as files: front matter, pages with their marks, the list of notes."""
    pages = H.handout_pages(_pages(spark, d, _NOTES))
    notes = H.handout_note(pages)
    return notes.select("doc_id", "n_pages", H.written_note(F.lit("---\ntags:\n---"), F.col("text"), F.col("notes")).alias("note"))


NOTES_SQL = f"""with pages as ({PAGES_SQL.replace("case when page_no % 3 = 0 then '77' else cast(page_no as varchar) end", "cast(page_no as varchar)")}), n as (select doc_id, count(*) as n_pages,
 string_agg(text || case when page_no < last then {NL} || {NL} || '---' || {NL} || '*p. ' || label || '*' || {NL} || {NL} || '---' || {NL} || {NL} else '' end, '' order by page_no) as t,
 string_agg(case when notes <> '' then '[^' || replace(regexp_replace(replace(notes, '|', {NL} || '[^'), '(^|\\[\\^)([0-9]+) ', '\\1\\2]: ', 'g'), '', '') end, {NL} order by page_no) as l from (select *, max(page_no) over (partition by doc_id) as last from pages) q group by doc_id)
 select doc_id, n_pages, '---' || {NL} || 'tags:' || {NL} || '---' || {NL} || {NL} || {sql_strip('t')} || coalesce({NL} || {NL} || l, '') || {NL} as note from n"""


def site_cleanup(spark, d):
    """Sites behind a page number, repeated over pages, alone on a line, in a pipe row, and inside a text."""
    case = "case k when 0 then x || ' 12 www.um.com.br' when 1 then 'www.dois.com.br' when 2 then '| x www.um.com.br' when 3 then x || ' www.tres.com.br end' when 4 then x || ' z www.quatro.org.br.' else x end"
    return H.without_sites(_pages(spark, d, case))


SITES_SQL = f"""with {BASE}, p as (select doc_id, count(distinct page_no) filter (k = 4) as often from w group by doc_id),
 t as (select doc_id, pos, page_no, case k when 0 then x when 1 then null when 2 then '| x www.um.com.br' when 3 then x || ' www.tres.com.br end' when 4 then case when often >= 3 then x || ' z .' else x || ' z www.quatro.org.br.' end else x end as t from w join p using (doc_id))
 select doc_id, page_no, coalesce(string_agg(t, {NL} order by pos), '') as text from t group by doc_id, page_no"""


def foot_sites(spark, d):
    """Sites in the lowest part of a page, taken off the page's text once each, from behind."""
    lay = X.layout(spark, d).withColumn("text", F.when(F.col("line_seq") == 7, F.lit("page www.Pe.com.br")).otherwise(F.lit("none")))
    sites = H.foot_sites(lay, X.HEIGHT)
    pages = X.lines(spark, d).selectExpr("doc_id", "cast(floor(pos / 8.0) as int) as page_index", "pos", f"{WORDS} as x").groupBy("doc_id", "page_index").agg(F.concat(F.lit("www.pe.com.br "), _joined("x"), F.lit(" www.pe.com.br end")).alias("text"))
    met = pages.join(sites, ["doc_id", "page_index"], "left")
    return met.select("doc_id", "page_index", H.drop_foot_sites(F.col("text"), F.col("sites")).alias("text"))


FOOT_SQL = f"""with {X.LINES_SQL}, p as (select doc_id, cast(floor(pos / 8.0) as integer) as page_index, max(pos % 8) = 7 as foot, string_agg({WORDS}, {NL} order by pos) as t from lines group by all)
 select doc_id, page_index, 'www.pe.com.br ' || t || case when foot then '  end' else ' www.pe.com.br end' end as text from p"""


def scan_cleanup(spark, d):
    case = "case k when 0 then ' www.um.com.br ' when 1 then ' MARCA  um' when 2 then '  ' when 3 then x || ' www.um.com.br' when 4 then x || ' marca um e' else x end"
    pages = _pages(spark, d, case)
    return pages.select("doc_id", "page_no", H.clean_scan(F.col("text"), (r"marca\s+um",)).alias("text"))


SCAN_SQL = f"""with {BASE} select doc_id, page_no, coalesce(string_agg(case when k in (3, 5) then {sql_strip('x')} when k = 4 then {sql_strip("x || '  e'")} end, {NL} order by pos), '') as text from w group by doc_id, page_no"""


def image_moves(spark, d):
    """Two images before and between a page's blocks: the first belongs to the second block, the other's block comes before that."""
    rows = _words(spark, d).groupBy("doc_id", "page_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda v: T.strip(v["x"])).alias("b"))
    at = lambda i: F.coalesce(F.get("b", F.lit(i)), F.lit("qqq"))
    text = F.array_join(F.array(F.lit("![](a.png)"), at(0), at(1), F.lit("![](b.png)"), at(2)), "\n\n")
    return rows.select("doc_id", "page_no", H.moved(text, F.array(F.concat(F.lit("**❖ "), at(1)), at(0))).alias("text"))


MOVES_SQL = f"""with {BASE}, b as (select doc_id, page_no, {sql_strip('max(case when k = 0 then x end)')} as a, coalesce({sql_strip('max(case when k = 1 then x end)')}, 'qqq') as b, coalesce({sql_strip('max(case when k = 2 then x end)')}, 'qqq') as c from w group by all)
 select doc_id, page_no, a || {NL} || {NL} || b || {NL} || {NL} || '![](a.png)' || {NL} || {NL} || c || {NL} || {NL} || '![](b.png)' as text from b"""


def _text_lines(spark, d):
    return _words(spark, d).groupBy("doc_id").agg(_joined("x").alias("x"), F.count("*").alias("n"))


def _mark(n):
    return f"chr(10) || chr(10) || '---' || chr(10) || '*p. ' || {n} || '*' || chr(10) || chr(10) || '---' || chr(10)"


def repairs(spark, d):
    """Notes with broken strike-through, signs that part lines, printed page numbers, long clauses, titles and a summary."""
    body = f"""'---' || chr(10) || 'a: b' || chr(10) || '---' || chr(10) || '## Sumário' || chr(10) || '# 1) Um' || chr(10) || 'Tema: ' || doc_id || chr(10) || '---' || chr(10) || '1.2) Dois' || chr(10) || 'Bloco 7' || chr(10)
 || '4) Sanções da improbidade –' || chr(10) || '(continuando) 1.2) Dois' || chr(10) || '(continuação) Mais' || chr(10) || '> ' || x || ' ¬¬gone¬¬ um ¬¬ dois 3' || {_mark("'3'")} || 'Era: a Passou: b 4' || {_mark("'4'")} || lpad('', 240, 'z') || '. I – um; § 2 dois a) tres'"""
    rows = _words(spark, d).where("pos = 0").selectExpr("doc_id", f"{body} as t")
    return rows.select("doc_id", P.repaired(F.col("t")).alias("text"))


REPAIRS_SQL = f"""with {BASE} select doc_id, '---' || {NL} || 'a: b' || {NL} || '---' || {NL} || '## Sumário' || {NL} || '- 1) Um' || {NL} || '## Tema: ' || doc_id || {NL} || '---' || {NL} || '#### 1.2) Dois' || {NL} || '### Bloco 7' || {NL}
 || '### 4) Sanções da improbidade (art. 12)' || {NL} || '*(continuando)* 1.2) Dois' || {NL} || '*(continuação)* Mais' || {NL} || '> ' || x || ' ~~gone~~ um' || {NL} || '>  dois' || {_mark("'3'")} || 'Era: a Passou: b 4' || {_mark("'4'")} || lpad('', 240, 'z') || '.' || {NL} || 'I – um;' || {NL} || '§ 2 dois' || {NL} || 'a) tres' as text from w where pos = 0"""


def table_repair(spark, d):
    """A broken table between two rows of it, replaced by the one that was read from the page."""
    rows = _words(spark, d).where("pos = 0").selectExpr("doc_id", "x || chr(10) || '|Art. 9º' || chr(10) || x || chr(10) || '|O agente público' || chr(10) || 'rest' as t")
    grid = F.array(F.array(F.lit("a|b"), F.lit("c")), F.array(F.lit("d\ne"), F.lit(None).cast("string")))
    return rows.select("doc_id", P.replace_table(F.col("t"), r"\|Art\. 9º", r"\|O\s+agente público", P.small_table(grid, 2, 2)).alias("text"))


def checks_forbidden(spark, d):
    body = "case k when 0 then '```' when 1 then 'www.in' when 2 then '```' when 3 then x || ' www.out' when 4 then '  > www.q' else x end"
    rows = _words(spark, d).selectExpr("doc_id", "pos", f"{body} as t").groupBy("doc_id").agg(_joined().alias("body"))
    return Q.forbidden_lines(rows).groupBy("doc_id").agg(F.count("*").alias("n"))


def checks_pages(spark, d):
    text = f"'a' || {_mark('1')} || case when doc_id % 4 = 1 then '' else 'b' || {_mark('2')} end || case when doc_id % 4 = 2 then 'c' || {_mark('4')} else 'c' || {_mark('3')} end"
    return Q.page_violations(X.table(spark, d, "documents").selectExpr("doc_id", f"{text} as body", "3 as n_pages"))


def checks_images(spark, d):
    text = f"'![[n-img1-pg1.png]]' || {_mark('1')} || chr(10) || '![[n-img2-pg' || (2 + cast(doc_id % 3 as int)) || '.png]]' || {_mark('2')}"
    notes = X.table(spark, d, "documents").selectExpr("doc_id", f"{text} as body", "3 as n_pages")
    files = X.table(spark, d, "documents").where("doc_id % 5 <> 0").selectExpr("doc_id", "'n-img1-pg1.png' as name").unionByName(X.table(spark, d, "documents").selectExpr("doc_id", "'n-img2-pg' || (2 + cast(doc_id % 3 as int)) || '.png' as name"))
    return Q.image_violations(notes, files)


CHECK_IMAGES_SQL = """with e as (select doc_id, 'n-img2-pg' || (2 + doc_id % 3) || '.png' as name from documents) select doc_id, name, 'other page' as problem from e where doc_id % 3 > 0 union all select doc_id, name, 'no such page' from e where doc_id % 3 = 2
 union all select doc_id, 'n-img1-pg1.png', 'no file' from documents where doc_id % 5 = 0 union all select doc_id, null, 'count' from documents where doc_id % 5 = 0"""


def checks_order(spark, d):
    """An image between two lines of each page; on some pages its embed stands before both, on some behind."""
    w = _words(spark, d).where("k in (1, 3)")
    lines = w.selectExpr("doc_id", "page_no", "cast(k * 10 as double) as y", "x as text", "false as covered").unionByName(w.where("k = 1").selectExpr("doc_id", "page_no", "19.0 as y", "'inside the image' as text", "true as covered"))
    pages = w.groupBy("doc_id", "page_no").agg(F.max(F.when(F.col("k") == 1, F.col("x"))).alias("a"), F.coalesce(F.max(F.when(F.col("k") == 3, F.col("x"))), F.lit("")).alias("b"))
    kind = F.col("page_no") % 3
    before, after = F.when(kind == 0, "").when(kind == 1, F.concat(F.lit("**"), "a", F.lit("**"))).otherwise(F.concat("a", F.lit("\n"), "b")), F.when(kind == 0, F.concat("a", F.lit("\n"), "b")).when(kind == 1, F.col("b")).otherwise(F.lit(""))
    placed = pages.select("doc_id", "page_no", F.lit(0).alias("n"), F.lit(20.0).alias("image_y"), before.alias("before_text"), after.alias("after_text"))
    return Q.order_violations(lines, placed)


ORDER_SQL = f"""with {BASE}, p as (select doc_id, page_no, max(case when k = 1 then x end) as a, max(case when k = 3 then x end) as b from w where k in (1, 3) group by all),
 q as (select *, length(regexp_replace(lower(a), '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 8 as la, length(regexp_replace(lower(b), '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 8 as lb from p)
 select doc_id, page_no, 0 as n, 'before' as side from q where page_no % 3 = 0 and la union all select doc_id, page_no, 0, 'after' from q where page_no % 3 = 2 and lb"""


def checks_headings(spark, d):
    body = "'## curto' || chr(10) || '#### Art. 5 da CF' || chr(10) || '#### Sumário' || case when doc_id % 2 = 0 then chr(10) || '##### SUMÁRIO' else '' end || chr(10) || '#### ' || lang"
    notes = X.table(spark, d, "documents").selectExpr("doc_id", f"{body} as body", "'/x/Aula Í' || cast(doc_id % 3 as int) || '.md' as name")
    found = Q.heading_violations(notes, {"aula i1": ["#### en", "#### xx"]})
    return found.select("doc_id", "problem", F.array_join("examples", "|").alias("examples"))


HEADINGS_SQL = """select doc_id, 'short' as problem, '## curto' as examples from documents union all select doc_id, 'citation', '#### Art. 5 da CF' from documents union all select doc_id, 'summaries', '#### Sumário|##### SUMÁRIO' from documents where doc_id % 2 = 0
 union all select doc_id, 'missing', case when lang = 'en' then '#### xx' else '#### en|#### xx' end from documents where doc_id % 3 = 1"""


def checks_subjects(spark, d):
    items = "case doc_id % 3 when 0 then '' when 1 then '  um' || chr(10) || '  dois' || chr(10) else '  um' || chr(10) || '  um' || chr(10) end"
    notes = X.table(spark, d, "documents").selectExpr("doc_id", f"'---' || chr(10) || 'assunto: |-' || chr(10) || {items} || 'caminho: x' || chr(10) || '---' as note")
    return Q.subject_violations(notes, 2)


def checks_tables(spark, d):
    head = F.when(F.col("doc_id") % 5 == 0, "| Um | Dois |").otherwise("| Um | Dois | Três |")
    row = F.when(F.col("doc_id") % 5 == 1, "| a . | b | - c - Veja |").when(F.col("doc_id") % 5 == 2, "| a |  | palavramuitocompridasem |").otherwise("| a | b | c |")
    rows = X.table(spark, d, "documents").select("doc_id", F.array(head, F.lit("|---|---|---|"), row, F.when(F.col("doc_id") % 5 == 3, "| | | |").otherwise(row)).alias("rows"))
    return Q.table_violations(rows, 3, 4, ["Um", "dois", "três"], 9.0)


CHECK_TABLES_SQL = """select doc_id, unnest(case doc_id % 5 when 0 then ['header', 'columns'] when 1 then ['punctuation', 'list item'] when 2 then ['blank column', 'long words'] when 3 then ['blank row'] else [] end) as problem from documents"""


def table_counts(spark, d):
    case = "case k when 0 then '| ' || x || ' |' when 1 then '| --- |' when 4 then '  |:---|---:|' else x end"
    return _pages(spark, d, case).select("doc_id", "page_no", Q.table_count(F.col("text")).cast("long").alias("n"))


def note_changes(spark, d):
    before = "'---' || chr(10) || 'a: b' || chr(10) || '---' || chr(10) || '**x** and *y* ![[i.png]]' || chr(10) || '> [!quote] ' || chr(10) || '> t' || chr(10) || '*p. 1*' || chr(10) || '---'"
    after = f"case doc_id % 7 when 0 then {before} when 1 then replace({before}, 'a: b', 'a: c') when 2 then replace({before}, '**x**', 'x') when 3 then replace({before}, 'i.png', 'j.png') when 4 then replace({before}, '[!quote] ', '[!note]') when 5 then replace({before}, '*p. 1*', '*p. 2*') else replace({before}, '> t', 't') || chr(10) || '---' end"
    return Q.content_changes(X.table(spark, d, "documents").selectExpr("doc_id", f"{before} as before", f"{after} as after"))


CHANGES_SQL = """select doc_id, unnest(case doc_id % 7 when 1 then ['front matter'] when 2 then ['emphasis'] when 3 then ['images'] when 4 then ['callouts'] when 5 then ['emphasis', 'page marks'] when 6 then ['rules', 'quotes'] else [] end) as problem from documents"""


def note_gates(spark, d):
    body = "case doc_id % 4 when 0 then 'x ¬¬ y' when 1 then 'x ( )' when 2 then 'x –  ' || chr(10) || 'y' else 'x ¬ (y)' end"
    return Q.gate_violations(X.table(spark, d, "documents").selectExpr("doc_id", f"{body} as body"))


def cell_texts(spark, d):
    """Cells of three lines: a line, an item, a line that goes on."""
    rows = _words(spark, d).where("k < 3").selectExpr("doc_id", "page_no", "pos", "case k when 1 then '-' || x || ' ,' else x || ' | a' end as t").groupBy("doc_id", "page_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "t"))), lambda v: v["t"]).alias("lines"))
    return rows.select("doc_id", "page_no", C.cell_text(F.col("lines")).alias("text"))


_ONE = lambda c: sql_strip(f"regexp_replace({c}, '\\s+', ' ', 'g')")
CELLS_SQL = f"""with {BASE}, t as (select doc_id, page_no, max(case when k = 0 then {_ONE("x || ' | a'")} end) as a, max(case when k = 1 then {_ONE('x')} end) as b, max(case when k = 2 then {_ONE("x || ' | a'")} end) as c from w where k < 3 group by all)
 select doc_id, page_no, replace(regexp_replace(a || coalesce('<br>- ' || b || ',', '') || coalesce(' ' || c, ''), '\\s+([.,;!?])', '\\1', 'g'), '|', chr(92) || '|') as text from t"""


def table_rules(spark, d):
    """Small grids: whether they count as tables, are compact, and are shown as pictures in notes about law."""
    k = F.col("doc_id") % 4
    row = F.when(k == 0, F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d"))).when(k == 1, F.array(F.lit("a"), F.lit(""))).when(k == 2, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    rows = X.table(spark, d, "documents").select("doc_id", F.array_repeat(row, 2).alias("rows"))
    law = T.law_profile(F.when(F.col("doc_id") % 3 == 0, F.lit("Direito Penal")), F.lit("aula"))
    picture = B.image_callout(F.array(F.format_string("doc%d-table%d-pg%d.png", "doc_id", F.lit(1), F.lit(2))), B.plain_text(F.col("rows")))
    return rows.select("doc_id", B.is_table(F.col("rows"), F.size(F.get("rows", F.lit(0)))).alias("counts"), B.is_compact(F.col("rows")).alias("compact"), B.compact_law_image(law, F.array("rows")).alias("as_image"), picture.alias("picture"))


RULES_SQL = f"""select doc_id, doc_id % 4 in (0, 2) as counts, doc_id % 4 = 0 as compact, doc_id % 4 = 0 and doc_id % 3 = 0 as as_image, '![[doc' || doc_id || '-table1-pg2.png]]' || {NL} || {NL} || '> [!note]- Texto da tabela' || {NL} ||
 case doc_id % 4 when 0 then '> a | b | c | d' || {NL} || '> a | b | c | d' when 2 then '> a | b' || {NL} || '> a | b' else '> a' || {NL} || '> a' end as picture from documents"""


def drawn_figures(spark, d):
    """Drawings by fill and frame, rasters by their bytes, the region and pixels of each picture, its share of coloured pixels."""
    k = F.col("doc_id") % 4
    fill = F.when(k == 0, F.array(F.lit(1.0), F.lit(0.5), F.lit(0.5))).when(k == 1, F.array(F.lit(0.99), F.lit(0.99), F.lit(0.99)))
    rows = X.table(spark, d, "documents").select("doc_id", fill.alias("fill"), F.when(k == 3, 600.0).otherwise(200.0).alias("x1"), (k >= 1).alias("rect"), F.when(k < 2, "image").otherwise("text").alias("kind"), F.when(k != 1, F.lit(b"x")).alias("bytes"))
    region = G.figure_region(F.lit(10.0), F.lit(20.0), F.col("x1"), F.lit(520.5))
    pixels = F.array(F.array(F.lit(200), F.lit(180), F.lit(100)), F.array(F.lit(255), F.lit(255), F.lit(255)), F.array(F.lit(10), F.lit(10), F.lit(10)), F.when(k == 0, F.array(F.lit(240), F.lit(240), F.lit(200))).otherwise(F.array(F.lit(250), F.lit(250), F.lit(250))))
    return rows.select("doc_id", G.is_drawn_figure(F.col("fill"), F.lit(10.0), F.lit(20.0), F.col("x1"), F.lit(520.5), F.col("rect"), X.WIDTH, X.HEIGHT).alias("drawn"), G.is_raster(F.col("kind"), F.col("bytes")).alias("raster"), region["pixels_x"].alias("px"), region["pixels_y"].alias("py"), G.coloured_share(pixels).alias("coloured"))


DRAWN_SQL = "select doc_id, doc_id % 4 <> 3 as drawn, doc_id % 4 = 0 as raster, case when doc_id % 4 = 3 then 1192 else 392 end as px, 1013 as py, cast(case when doc_id % 4 = 0 then 0.5 else 0.25 end as double) as coloured from documents"


def note_names(spark, d):
    """Canonical names, bodies without front matter, keys of texts, paths and deterministic job ids."""
    rows = X.lines(spark, d).where("pos = 0").select("doc_id", "line", F.concat(F.lit("/in/Ação Número "), F.col("doc_id").cast("string"), F.lit("ª_ﬁm.PDF")).alias("path"))
    note = F.concat(F.lit("---\na: b\n---\n"), F.lit("x"), F.col("doc_id").cast("string"))
    return rows.select("doc_id", T.canonical_name(F.col("path")).alias("name"), T.body_of(note).alias("body"), T.match_key(F.concat(F.lit("**❖ “A– "), F.col("doc_id").cast("string"), F.lit("”**"))).alias("key"), T.letters_and_digits(F.lit("Ação, 1ª!")).alias("plain"), T.note_path(F.lit("DIR"), F.when(F.col("doc_id") % 2 == 0, F.lit("3"))).alias("path"), T.job_id(F.col("doc_id").cast("string")).alias("job"))


NAMES_SQL = "select doc_id, 'acao numero ' || doc_id || 'a fim' as name, 'x' || doc_id as body, 'a ' || doc_id as key, 'ação1ª' as plain, case when doc_id % 2 = 0 then 'DIR Aula 3' else 'DIR' end as path, substr(sha256(cast(doc_id as varchar)), 1, 12) as job from documents"


def _jobs(spark, d):
    return X.jobs(spark, d).dropDuplicates(["route", "id"])


def job_queue(spark, d):
    jobs = _jobs(spark, d)
    return J.fifo(jobs, jobs.where("file_hash like '%3'")).select("route", "id", F.col("place").cast("long").alias("place"))


def job_cancels(spark, d):
    jobs = _jobs(spark, d)
    asked = jobs.where("file_hash like '%1'").select("route", "id")
    return J.cancel(jobs, asked)


def job_deletes(spark, d):
    jobs = _jobs(spark, d)
    return J.deleted(jobs, jobs.where("file_hash like '%2'").select("route", "id"))


def job_log(spark, d):
    """New jobs appended to the log, and one of them looked up."""
    made = J.created(_jobs(spark, d).select("route", "id", "file_hash", "created_at"))
    return J.job(J.latest(made.select("route", "id", "file_hash", "status", "updated_at", "deleted")), "apostila", "job1").select("route", "id", "file_hash", "status")


def job_results(spark, d):
    """What workers report, and the description they read."""
    raw = F.concat(F.lit('{"disciplina":"'), "route", F.lit('","tags":["a","'), "id", F.lit('"]}'))
    return _jobs(spark, d).select("route", "id", J.result_json(F.col("route"), F.concat(F.lit("/out/"), "id", F.lit(".md")), F.length("id")).alias("result"), F.concat_ws("|", J.read_meta(raw)["disciplina"], F.array_join(J.read_meta(raw)["tags"], ",")).alias("meta"))


RESULTS_SQL = f"with {X.JOBS_SQL} select route, id, '{{\"md_path\":\"/out/' || id || '.md\",\"' || case when route = 'legislacao' then 'n_artigos' else 'n_images' end || '\":' || length(id) || '}}' as result, route || '|a,' || id as meta from jobs"


def job_archive(spark, d):
    """What goes into the archives: note, two images, original; unfinished jobs and jobs without a note say so."""
    jobs = _jobs(spark, d).select("route", "id", "status", F.when(~F.col("file_hash").like("%7"), F.concat(F.lit("/out/"), "id", F.lit("/n.md"))).alias("md_path"), F.concat("id", F.lit(".pdf")).alias("original_filename"), F.concat(F.lit("/up/"), "id").alias("upload_path"))
    images = jobs.select("route", "id", F.explode(F.array(F.lit("b.png"), F.lit("a.png"))).alias("name")).withColumn("path", F.concat(F.lit("/img/"), "name"))
    return J.archive_manifest(jobs, images).select("route", "id", F.col("place").cast("long").alias("place"), "member", "source", "problem")


ARCHIVE_SQL = f"""with {X.JOBS_SQL}, g as (select * from jobs where status = 'concluido' and file_hash not like '%7') select route, id, cast(1 as bigint) as place, 'n.md' as member, '/out/' || id || '/n.md' as source, null as problem from g
 union all select route, id, 2, 'images/a.png', '/img/a.png', null from g union all select route, id, 3, 'images/b.png', '/img/b.png', null from g union all select route, id, 4, id || '.pdf', '/up/' || id, null from g
 union all select route, id, 0, null, null, case when status <> 'concluido' then 'not finished' else 'no note' end from jobs where status <> 'concluido' or file_hash like '%7'"""


def page_blocks(spark, d):
    """Pages read by OCR: their images and the text that was read; tables of native pages only; images met by embeds in order."""
    lay = X.layout(spark, d)
    native = X.figures(lay).selectExpr("doc_id", "page_index", "'image' as kind", "fy0 as y", "fx0 as x", "cast(null as string) as text").unionByName(lay.selectExpr("doc_id", "page_index", "'text' as kind", "y0 as y", "x0 as x", "text"))
    ocr = lay.where("line_seq = 1").selectExpr("doc_id", "page_index", "y0 as y", "x0 as x", "'read ' || text as text")
    pages = lay.selectExpr("doc_id", "page_index", "doc_id % 2 = 1 as native").distinct()
    blocks = H.scanned_blocks(native, ocr).groupBy("doc_id", "page_index").agg(F.count_if(F.col("kind") == "image").alias("images"), F.count_if(F.col("kind") == "text").alias("texts"))
    tables = H.native_tables(X.boxes(lay), pages).groupBy("doc_id", "page_index").agg(F.count("*").alias("tables"))
    return blocks.join(tables, ["doc_id", "page_index"], "full").select("doc_id", "page_index", F.coalesce("images", F.lit(0)).alias("images"), F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("tables", F.lit(0)).alias("tables"))


BLOCKS_SQL = f"""with {X.SHAPES_SQL}, p as (select doc_id, page_index, count(*) filter (line_seq = 1) as texts from layout group by all), q as (select p.*, case when doc_id % 2 = 0 then 2 else 0 end as images, case when doc_id % 2 = 1 and doc_id % 3 = 0 then 1 else 0 end as tables from p)
 select doc_id, page_index, cast(images as bigint) as images, texts, cast(tables as bigint) as tables from q where images + texts + tables > 0"""


def image_pairs(spark, d):
    """Images and embeds of pages that have as many of both."""
    images = X.figures(X.layout(spark, d)).selectExpr("doc_id", "page_index as page_no", "fy0 as y", "fx0 as x", "figure_seq")
    names = images.where("page_no % 2 = 0 or figure_seq = 0").selectExpr("doc_id", "page_no", "figure_seq as at", "'e' || figure_seq as name")
    return Q.zipped(images, names).select("doc_id", "page_no", "figure_seq", "name")


def table_pairs(spark, d):
    """Tables and Markdown blocks of a document by their order; as many of both, or the query fails."""
    w = _words(spark, d).where("k = 0")
    return Q.zipped_or_failed(w.selectExpr("doc_id", "page_no as table_seq"), w.selectExpr("doc_id", "pos as first_pos")).select("doc_id", "table_seq", "first_pos")


def page_split(spark, d):
    rows = _pages(spark, d, "case k when 5 then x || '-' else x end")
    whole = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_no", "text"))), lambda v: F.concat(v["text"], F.lit("\n\n--- end of page="), (v["page_no"] - 1).cast("string"), F.lit(" ---\n\n"))), "").alias("text"))
    return H.split_pages(whole)


def paragraph_texts(spark, d):
    """Paragraphs of laid-out lines; some lines end with a hyphen."""
    lay = X.layout(spark, d).withColumn("text", F.when(F.col("line_seq") % 2 == 1, F.concat("text", F.lit("-"))).otherwise(F.col("text")))
    return L.paragraph_texts(lay, X.WIDTH).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


# a line's end with a hyphen joins to the next without it; others take a blank
PARAGRAPHS_SQL = M.PARAGRAPH_SQL.replace("with ", "with ", 1).replace("layout as (select *, y0 + size as y1", "layout as (select * replace (case when line_seq % 2 = 1 then text || '-' else text end as text), y0 + size as y1", 1).rpartition(" select doc_id")[0] + f""", n as (select *, sum(cast(not goes as int)) over (partition by doc_id, page_index order by y0, x0, line_seq) as paragraph from g),
 t as (select doc_id, page_index, paragraph, list({sql_strip('text')} order by y0, x0, line_seq) as parts from n group by all),
 j as (select doc_id, list_reduce(list_filter(parts, lambda x: x <> ''), lambda a, x: case when regexp_matches(a, '(?:^|[^-])-$') then substr(a, 1, length(a) - 1) || x else a || ' ' || x end) as text from t where len(list_filter(parts, lambda x: x <> '')) > 0 union all select doc_id, '' from t where len(list_filter(parts, lambda x: x <> '')) = 0)
 select doc_id, count(*) as n, cast(sum(length(text)) as bigint) as chars from j group by doc_id"""


def image_counts(spark, d):
    lay = X.layout(spark, d)
    tables = X.boxes(lay).selectExpr("doc_id", "2 as n_parts", "page_index % 2 = 0 as as_image")
    return G.image_counts(X.figures(lay), tables)


QUERIES = {
    "handout_reflow": (handout_reflow, TOPICS_SQL),
    "handout_pages": (handout_pages, PAGES_SQL),
    "handout_notes": (handout_notes, NOTES_SQL),
    "site_cleanup": (site_cleanup, SITES_SQL),
    "foot_sites": (foot_sites, FOOT_SQL),
    "scan_cleanup": (scan_cleanup, SCAN_SQL),
    "image_moves": (image_moves, MOVES_SQL),
    "repairs": (repairs, REPAIRS_SQL),
    "table_repair": (table_repair, f"with {BASE} select doc_id, x || {NL} || '|a\\|b|c|' || {NL} || '|---|---|' || {NL} || '|d e||' || {NL} || 'rest' as text from w where pos = 0"),
    "checks_forbidden": (checks_forbidden, f"with {BASE}, n as (select doc_id, page_no, count(*) as n from w group by all) select doc_id, sum(cast(n >= 4 as bigint) + cast(n = 2 as bigint)) as n from n group by doc_id having sum(cast(n >= 4 as bigint) + cast(n = 2 as bigint)) > 0"),
    "checks_pages": (checks_pages, "select doc_id, unnest(case doc_id % 4 when 1 then ['page count', 'page order'] when 2 then ['page order'] else [] end) as problem from documents"),
    "checks_images": (checks_images, CHECK_IMAGES_SQL),
    "checks_order": (checks_order, ORDER_SQL),
    "checks_headings": (checks_headings, HEADINGS_SQL),
    "checks_subjects": (checks_subjects, "select doc_id, unnest(case doc_id % 3 when 0 then ['empty'] when 2 then ['repeated'] else [] end) as problem from documents"),
    "checks_tables": (checks_tables, CHECK_TABLES_SQL),
    "table_counts": (table_counts, f"with {BASE} select doc_id, page_no, count(*) filter (k in (1, 4)) as n from w group by all"),
    "note_changes": (note_changes, CHANGES_SQL),
    "note_gates": (note_gates, "select doc_id, case doc_id % 4 when 0 then 'negation signs' when 1 then 'empty parentheses' else 'open title' end as problem from documents where doc_id % 4 < 3"),
    "cell_texts": (cell_texts, CELLS_SQL),
    "table_rules": (table_rules, RULES_SQL),
    "drawn_figures": (drawn_figures, DRAWN_SQL),
    "note_names": (note_names, NAMES_SQL),
    "job_queue": (job_queue, f"with {X.JOBS_SQL} select route, id, row_number() over (partition by route order by created_at, id) as place from jobs where status = 'pendente' and file_hash not like '%3'"),
    "job_cancels": (job_cancels, f"with {X.JOBS_SQL} select route, id, case status when 'pendente' then 'cancelled' when 'processando' then 'stopping' else 'refused' end as outcome, case when status = 'processando' then 4 end as stop_after from jobs where file_hash like '%1'"),
    "job_deletes": (job_deletes, f"with {X.JOBS_SQL}, d as (select * from jobs where file_hash like '%2') select route, id, 0 as step, 'stop' as what from d where status in ('pendente', 'processando') union all select route, id, 1, 'remove files' from d union all select route, id, 2, 'tombstone' from d"),
    "job_log": (job_log, f"with {X.JOBS_SQL} select route, id, file_hash, 'pendente' as status from jobs where route = 'apostila' and id = 'job1'"),
    "job_results": (job_results, RESULTS_SQL),
    "job_archive": (job_archive, ARCHIVE_SQL),
    "page_blocks": (page_blocks, BLOCKS_SQL),
    "image_pairs": (image_pairs, f"with {X.SHAPES_SQL} select doc_id, page_index as page_no, figure_seq, 'e' || figure_seq as name from figures where page_index % 2 = 0"),
    "page_split": (page_split, f"with {BASE} select doc_id, page_no, string_agg(case when k = 5 then x || '-' else x end, {NL} order by pos) as text from w group by all"),
    "paragraph_texts": (paragraph_texts, PARAGRAPHS_SQL),
    "image_counts": (image_counts, f"with {X.SHAPES_SQL}, n as (select doc_id, 1 as n from figures union all select doc_id, 2 from boxes where page_index % 2 = 0) select doc_id, cast(sum(n) as bigint) as n_images from n group by doc_id"),
    "table_pairs": (table_pairs, f"with {BASE} select doc_id, page_no as table_seq, pos as first_pos from w where k = 0"),
}
