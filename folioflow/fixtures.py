"""Relations derived from the provided tables so that every operator has something to act on.

The expressions are SQL that Spark and DuckDB read alike; LINES_SQL and the like are the DuckDB form of the same relation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))


LINES_SQL = (
    "lines as (select doc_id, cast(i - 1 as integer) as pos, l[i] as line from "
    "(select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents) s, unnest(range(1, len(s.l) + 1)) as u(i))"
)

# every line with one of twelve beginnings
MARK = """case (doc_id + pos) % 12 when 0 then '#### ' when 1 then '- ' when 2 then 'Obs.: ' when 3 then '**Art. 5, CF/88:** ' when 4 then 'I - '
 when 5 then 'ADI 54 ' when 6 then 'Súmula 11 ' when 7 then '1. ' when 8 then 'a) ' when 9 then '4.' || cast(pos % 5 as string) || ' ' else '' end || line"""


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).selectExpr("doc_id", "pos", f"{MARK} as line")


MARKED_SQL = f"{LINES_SQL}, marked as (select doc_id, pos, {MARK} as line from lines)"

# laid-out lines, whole: eight to a page, the first a header, the fourth a title of some kind, the last a footer
LAYOUT = {
    "doc_id": "doc_id",
    "page_index": "cast(floor(pos / 8.0) as int)",
    "line_seq": "cast(pos % 8 as int)",
    "text": """case when pos % 8 = 0 then 'Header of part ' || cast(doc_id % 3 as string) when pos % 8 = 7 then 'page ' || cast(cast(floor(pos / 8.0) as int) + 1 as string)
 when pos % 8 = 3 then case (doc_id + cast(floor(pos / 8.0) as int)) % 6 when 0 then 'Bloco 3' when 1 then 'CONTEUDO DA AULA ' || cast(doc_id % 50 as string) when 2 then '2.1 Tema ' || cast(doc_id as string) when 3 then 'B) Parte' when 4 then 'Sumário' else 'TEMAS' end
 when (doc_id + pos) % 6 = 1 then upper(translate(line, 'ß', 's')) when (doc_id + pos) % 6 = 2 then '2.' || cast(pos % 8 as string) || ' ' || line when (doc_id + pos) % 6 = 3 then 'A) ' || line when (doc_id + pos) % 6 = 4 then '• ' || line else line end""",
    "size": "cast(10 + (doc_id + pos) % 4 as double)",
    "bold": "(doc_id + pos) % 5 = 0",
    "centered": "(doc_id + pos) % 7 = 0",
    "height": "cast(9 + (doc_id + pos) % 6 as double)",
    "x0": "cast(36 + 18 * (length(line) % 3) as double)",
    "x1": "cast(46 + 18 * (length(line) % 3) + (length(line) % 40) * 14 as double)",
    "y0": "cast(case when pos % 8 = 0 then 20 when pos % 8 = 7 then 760 else 60 + (pos % 8) * 14 + (length(line) % 4) * 10 end as double)",
}
# a list's marker and where the text behind it begins, as the sign at the line's beginning tells
MARKERS = ["case when text like '• %' then '•' end as list_marker", "case when text like '• %' then x0 + 18 end as list_text_x"]
WIDTH, HEIGHT = 612.0, 792.0


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).selectExpr(*[f"{e} as {c}" for c, e in LAYOUT.items()]).selectExpr("*", "y0 + size as y1", *MARKERS)


LAYOUT_SQL = f"{LINES_SQL}, layout0 as (select {', '.join(f'{e} as {c}' for c, e in LAYOUT.items())} from lines), layout as (select *, y0 + size as y1, {', '.join(MARKERS)} from layout0)"

FIGURES = "select distinct doc_id, page_index, f as figure_seq, 30.0 + 200 * f as fx0, 70.0 as fy0, 240.0 + 200 * f as fx1, 120.0 + 20 * f as fy1 from {lines} where doc_id % 2 = 0"
BOXES = "select distinct doc_id, page_index, 20.0 as tx0, 90.0 as ty0, 500.0 as tx1, 190.0 as ty1 from {lines} where doc_id % 3 = 0"


def figures(lay: DataFrame) -> DataFrame:
    base = lay.where("doc_id % 2 = 0").select("doc_id", "page_index").distinct().withColumn("f", F.explode(F.array(F.lit(0), F.lit(1))))
    return base.selectExpr("doc_id", "page_index", "f as figure_seq", "cast(30.0 + 200 * f as double) as fx0", "cast(70 as double) as fy0", "cast(240.0 + 200 * f as double) as fx1", "cast(120.0 + 20 * f as double) as fy1")


def boxes(lay: DataFrame) -> DataFrame:
    return lay.where("doc_id % 3 = 0").select("doc_id", "page_index").distinct().selectExpr("*", "cast(20 as double) as tx0", "cast(90 as double) as ty0", "cast(500 as double) as tx1", "cast(190 as double) as ty1")


SHAPES_SQL = (
    f"{LAYOUT_SQL}, figures as (select doc_id, page_index, f as figure_seq, 30.0 + 200 * f as fx0, 70.0 as fy0, 240.0 + 200 * f as fx1, 120.0 + 20 * f as fy1 "
    "from (select distinct doc_id, page_index from layout where doc_id % 2 = 0) p, unnest([0, 1]) as u(f)), "
    "boxes as (select distinct doc_id, page_index, 20.0 as tx0, 90.0 as ty0, 500.0 as tx1, 190.0 as ty1 from layout where doc_id % 3 = 0)"
)

# law text out of every line of a document, whole: nine lines make an article with items, sub-items and paragraphs
CLEAN = "'x' || cast(pos % 9 as string) || ' ' || translate(line, ':;*§()_–—-', ',,        ')"
ARTICLE_NO = """(case when 1 + (7 * doc_id + cast(floor(pos / 9.0) as bigint)) % 1999 < 1000 then cast(1 + (7 * doc_id + cast(floor(pos / 9.0) as bigint)) % 1999 as string)
 else '1.' || lpad(cast((7 * doc_id + cast(floor(pos / 9.0) as bigint)) % 1999 - 999 as string), 3, '0') end || case when doc_id % 5 = 0 then '-A' else '' end)"""
LAW_LINE = f"""case pos % 9 when 0 then '**Art. ' || {ARTICLE_NO} || '.** ' || c || ':' when 1 then 'I – ' || c || ';' when 2 then 'II – ' || c || ':' when 3 then 'a) ' || c || ';' when 4 then 'b) ' || c || '.'
 when 5 then '§ 1º ' || c || '.' when 6 then '§ 2º ' || c || ' no § 5º.' when 7 then 'Parágrafo único. ' || c || '.' else '- ' || c end"""


def law_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, line): the lines of the law text."""
    return lines(spark, sf_dir).selectExpr("doc_id", "pos", f"{CLEAN} as c").selectExpr("doc_id", "pos", f"{LAW_LINE} as line")


def law(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return law_lines(spark, sf_dir).groupBy("doc_id").agg(whole.alias("law"))


LAW_LINES_SQL = f"{LINES_SQL}, cleaned as (select doc_id, pos, cast(floor(pos / 9.0) as integer) as art_seq, pos % 9 as k, {ARTICLE_NO} as art_no, {CLEAN} as c from lines)"
LAW_SQL = f"{LAW_LINES_SQL}, law as (select doc_id, string_agg({LAW_LINE}, chr(10) order by pos) as law from cleaned group by doc_id)"

# jobs out of events: several rows per hash, five statuses
JOBS = {
    "id": "'job' || cast(event_id as string)",
    "route": "case when event_id % 3 = 0 then 'legislacao' else 'apostila' end",
    "file_hash": "'h' || cast(user_id as string)",
    "status": "case event_type when 'click' then 'pendente' when 'view' then 'processando' when 'purchase' then 'concluido' when 'error' then 'erro' else 'cancelado' end",
    "created_at": "ts",
    "error_message": "case when event_type = 'error' then props end",
}


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*[f"{e} as {c}" for c, e in JOBS.items()])


JOBS_SQL = f"jobs as (select {', '.join(f'{e} as {c}' for c, e in JOBS.items())} from events)"

# parts of a table that goes on from page to page: an order's lines
PARTS = {
    "order_id": "l_orderkey",
    "page_index": "part_no",
    "columns": "3 + cast(l_orderkey % 5 = 0 and l_linenumber > 3 as int)",
    "top": "cast(l_partkey % 20 as double) / 100",
    "bottom": "cast(80 + l_suppkey % 20 as double) / 100",
    "header": "case when l_linenumber % 4 = 1 then 'Part' else 'p' || cast(l_partkey % 7 as string) end",
    "qty": "cast(l_quantity as int)",
}


NUMBERED = "cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as int)"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("*", f"{NUMBERED} as part_no").selectExpr(*[f"{e} as {c}" for c, e in PARTS.items()])


PARTS_SQL = f"parts as (select {', '.join(f'{e} as {c}' for c, e in PARTS.items())} from (select *, {NUMBERED} as part_no from lineitem))"
