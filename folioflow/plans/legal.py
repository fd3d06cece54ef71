"""Queries over law text."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow import fixtures as X
from folioflow.operators import legal as G
from folioflow.plans.markdown import NL, sql_strip


def _arts(spark, d):
    return G.articles(X.law(spark, d))


# how the fixture was put together tells what must come out: c is the cleaned line, k its place in the article
ST = sql_strip
ARTS = X.LAW_LINES_SQL
ITEMS = f"""{ARTS}, following as (select *, lead(k) over (partition by doc_id order by pos) as next_k from cleaned),
 items as (select doc_id, art_seq, cast(k - 1 as integer) as unit_seq, case k when 1 then 'I' else 'II' end as label, case when k = 1 or next_k = 3 then {ST("c")} else {ST("c || ':'")} end as text from following where k in (1, 2))"""
LETTERS = f"letters as (select doc_id, art_seq, cast(1 as integer) as unit_seq, cast(k - 3 as integer) as letter_seq, case k when 3 then 'a' else 'b' end as label, case k when 3 then {ST('c')} else {ST('c' + chr(32) + '||' + chr(32) + chr(39) + '.' + chr(39))} end as text from cleaned where k in (3, 4))"
PARS = f"""more as (select *, lead(c) over (partition by doc_id, art_seq order by pos) as next_c from cleaned),
 pars as (select doc_id, art_seq, cast(k - 5 as integer) as par_seq, case k when 5 then '§ 1º' when 6 then '§ 2º' else 'Parágrafo único' end as label,
 case k when 5 then {ST("c || '.'")} when 6 then {ST("c || ' no § 5º.'")} else {ST("c || '.' || coalesce(chr(10) || '- ' || next_c, '')")} end as text from more where k in (5, 6, 7))"""
RENDERED = f"""{ITEMS}, {LETTERS}, {PARS},
 subs as (select doc_id, art_seq, unit_seq, string_agg('  - **' || label || ')** ' || text, chr(10) order by letter_seq) as subs from letters group by all),
 listed as (select doc_id, art_seq, string_agg('- **' || label || '** –' || case when subs is null then ' ' || text else ' ' || text || ':' || chr(10) || subs end, chr(10) order by unit_seq) as listed from items left join subs using (doc_id, art_seq, unit_seq) group by all),
 parred as (select doc_id, art_seq, string_agg('**' || label || '.** ' || text, chr(10) || chr(10) order by par_seq) as parred from pars group by all),
 rendered as (select doc_id, art_seq, art_no, c || ':' || coalesce(chr(10) || chr(10) || listed, '') || coalesce(chr(10) || chr(10) || parred, '') as body from cleaned left join listed using (doc_id, art_seq) left join parred using (doc_id, art_seq) where k = 0)"""


def article_headers(spark, d):
    k = F.col("doc_id") % 3
    n = (F.col("doc_id") % 90 + 1).cast("string")
    head = F.when(k == 0, F.concat(F.lit("**Art.** **~~"), n, F.lit("~~** **o** "))).when(k == 1, F.concat(F.lit("**Art. "), n, F.lit("**\n\n**-B.** "))).otherwise(F.concat(F.lit("**Art. 1.0"), F.lpad(n, 2, "0"), F.lit(".** ")))
    return X.table(spark, d, "documents").select("doc_id", G.canonical_headers(F.concat(head, F.lit("body "), F.coalesce("text", F.lit("")))).alias("text"))


def article_tokens(spark, d):
    return _arts(spark, d).select("doc_id", "art_seq", "art_no", F.length("body").cast("long").alias("n"))


def article_units(spark, d):
    return G.units(_arts(spark, d)).select("doc_id", "art_seq", "parts.caput")


def inciso_units(spark, d):
    return G.items(_arts(spark, d)).drop("letters")


def alinea_units(spark, d):
    return G.letters(G.items(_arts(spark, d)))


def paragraph_units(spark, d):
    return G.paragraphs(_arts(spark, d))


def law_render(spark, d):
    return G.render(_arts(spark, d))


def _pages(spark, d):
    """Pages of a compilation, an article a page: a running header on all but the first, a law's title on every third from the second on."""
    w = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    g = F.col("page_no") - 1
    head = F.when(g > 0, F.concat(F.col("page_no").cast("string"), F.lit(" Codigo Geral\n"))).otherwise("")
    title = F.when(g % 3 == 1, F.concat(F.lit("## **Lei Nova "), g.cast("string"), F.lit("**\n\n### Lei n. 5\n"))).otherwise("")
    rows = X.law_lines(spark, d).groupBy("doc_id", (F.floor(F.col("pos") / 9) + 1).cast("int").alias("page_no")).agg(w.alias("t"))
    return rows.select("doc_id", "page_no", F.concat(head, title, "t").alias("text"))


def law_markers(spark, d):
    """The law in force where it changes, with the articles up to and with that page, and its marker."""
    rows = G.pages_in_force(_pages(spark, d), F.lit("Livro")).where("changed")
    return rows.select("doc_id", "page_no", "law", "seen", G.page_marker(F.col("law"), F.col("page_no").cast("string")).alias("marker"))


MARKED = f"""changes as (select distinct doc_id, art_seq, art_seq + 1 as page_no, case when art_seq = 0 then 'Livro' else 'Lei Nova ' || art_seq end as law from cleaned where art_seq = 0 or art_seq % 3 = 1),
 markers as (select doc_id, page_no, law, cast(page_no as bigint) as seen, {NL} || {NL} || '---' || {NL} || '*' || law || ' -- pg ' || page_no || '*' || {NL} || {NL} || '---' || {NL} as marker from changes)"""


def law_compile(spark, d):
    """Whole laws from their pages."""
    return G.compile_law(_pages(spark, d), F.lit("Livro"))


# in a compilation a dash at a line's beginning goes on the line before it
COMPILED = f"""with {RENDERED.replace("chr(10) || '- ' || next_c", "' ' || next_c")}, {MARKED}
 select doc_id, cast(count(*) as integer) as n_articles, string_agg({NL} || {NL} || '#### Art. ' || art_no || {NL} || {NL} || body || {NL} || coalesce(marker, ''), '' order by art_seq) as text
 from rendered left join (select doc_id, page_no - 1 as art_seq, marker from markers) using (doc_id, art_seq) group by doc_id"""


def law_notes(spark, d):
    return law_compile(spark, d).select("doc_id", G.law_note(F.concat(F.lit("Livro "), F.col("doc_id").cast("string")), F.lit("notice"), F.col("text")).alias("note"))


def loose_numbers(spark, d):
    rows = X.table(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n\n"), (F.col("doc_id") % 900).cast("string"), F.lit("\n\nnext 12\n\n3 x")).alias("t"))
    return rows.select("doc_id", G.drop_loose_numbers("t").alias("text"))


def article_count(spark, d):
    return X.law(spark, d).agg(F.sum(G.count_articles(F.col("law"))).cast("long").alias("n_articles"), F.count("*").alias("n_laws"))


QUERIES = {
    "article_headers": (
        article_headers,
        "with n as (select doc_id, doc_id % 3 as k, cast(doc_id % 90 + 1 as varchar) as n, 'body ' || coalesce(text, '') as b from documents) select doc_id, case k when 0 then '**Art. ' || n || '** ' || b when 1 then '**Art. ' || n || '-B.**  ' || b else '**Art. 1.0' || lpad(n, 2, '0') || '.** ' || b end as text from n",
    ),
    "article_tokens": (
        article_tokens,
        f"""with {ARTS}, bodies as (select doc_id, art_seq, min(art_no) as art_no, string_agg(case when k = 0 then c || ':' else {X.LAW_LINE} end, chr(10) order by pos) as body from cleaned group by doc_id, art_seq)
 select doc_id, art_seq, art_no, length({ST("body")}) as n from bodies""",
    ),
    "article_units": (article_units, f"with {ARTS} select doc_id, art_seq, c || ':' as caput from cleaned where k = 0"),
    "inciso_units": (inciso_units, f"with {ITEMS} select * from items"),
    "alinea_units": (alinea_units, f"with {ARTS}, {LETTERS} select * from letters"),
    "paragraph_units": (paragraph_units, f"with {ARTS}, {PARS} select * from pars"),
    "law_render": (law_render, f"with {RENDERED} select doc_id, art_seq, '#### Art. ' || art_no || chr(10) || chr(10) || body as text from rendered"),
    "law_markers": (law_markers, f"with {ARTS}, {MARKED} select * from markers"),
    "law_compile": (law_compile, COMPILED),
    "law_notes": (law_notes, f"with w as ({COMPILED}) select doc_id, '# Livro ' || doc_id || {NL} || {NL} || '> notice' || {NL} || {NL} || text || {NL} as note from w"),
    "loose_page_numbers": (loose_numbers, f"select doc_id, regexp_replace(coalesce(text, '') || {NL} || {NL} || (doc_id % 900) || {NL} || {NL} || 'next 12' || {NL} || {NL} || '3 x', '\\n{{2,}}[0-9]{{1,4}}\\n{{2,}}', {NL} || {NL}, 'g') as text from documents"),
    "article_count": (article_count, f"with {ARTS} select count(*) as n_articles, count(distinct doc_id) as n_laws from cleaned where k = 0"),
}
