"""Queries over lines, blocks and pages of Markdown, names and front matter."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow import fixtures as X
from folioflow.functions import text as T
from folioflow.functions.symbols import symbols
from folioflow.operators import postprocess as P
from folioflow.operators import quality as Q
from folioflow.operators import reflow as R
from folioflow.params import PARAMS


def q(pattern: str) -> str:
    """A pattern as a DuckDB string."""
    return "'" + pattern.replace("'", "''") + "'"


def sql_sub(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by.replace('$', chr(92)))}, 'g')"


def sql_strip(x: str) -> str:
    return sql_sub(x, r"^\s+|\s+$")


NL = "chr(10)"
# the first word of a line and what follows it, as the SQL sees them
HEAD, TAIL = "regexp_extract(line, '^\\S*', 0)", "regexp_replace(line, '^\\S*', '')"
START = f"""(not regexp_matches(line, '^\\s') and (left(line, 1) in ('|', '-', '•', '❖', '*') or starts_with(line, '![') or regexp_matches(line, '^[0-9]+[.][0-9]') or (starts_with(line, '<u>') and ends_with(rtrim(line), '</u>'))
 or (regexp_matches({TAIL}, '^\\s') and ({HEAD} in ('>', '#', '##', '###', '####', '#####', '######') or regexp_matches({HEAD}, '^(?:[0-9]+[).]|[(][0-9A-Za-z]+[)]|(?i:[CDILMVX]+)[.-])$')))
 or (regexp_matches({HEAD}, '^(?i:[CDILMVX]+)$') and regexp_matches({TAIL}, '^\\s+[.-]\\s'))))"""
SOLID = f"{X.MARKED_SQL}, solid as (select * from marked where trim(line) <> '')"
BLOCKS = f"{SOLID}, blocks0 as (select *, sum(cast({START} as int)) over w - first_value(cast({START} as int)) over w as block_no from solid window w as (partition by doc_id order by pos))"


def _quoted(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, {NL}), lambda l: case when trim(l) <> '' then '> ' || l else '>' end), {NL})"


def _first(x: str) -> str:
    return f"split_part({sql_sub(x, '^' + chr(92) + 's+')}, {NL}, 1)"


def reflow_blocks(spark, d):
    return R.reflow(X.marked(spark, d)).select("doc_id", F.col("block_no").cast("long").alias("block_no"), "n_lines")


def reflow_text(spark, d):
    return R.reflow(X.marked(spark, d)).select("doc_id", F.col("block_no").cast("long").alias("block_no"), "text")


# the fold of join_lines: a word parted at a line's end is a hyphen after a letter
JOINED = f"list_reduce(list(trimmed order by pos), lambda a, x: case when a = '' then x when regexp_matches(a, '[A-Za-zÀ-ÿ]-$') then substr(a, 1, length(a) - 1) || x else a || ' ' || x end)"
REFLOWED = f"{BLOCKS}, blocks as (select doc_id, cast(block_no as bigint) as block_no, count(*) as n_lines, {JOINED} as text from (select *, {sql_strip('line')} as trimmed from blocks0) group by doc_id, block_no)"


def law_quote_callout(spark, d):
    return R.law_quotes(R.reflow(X.marked(spark, d))).select("doc_id", F.col("block_no").cast("long").alias("block_no"), "text")


# the fixture's law quotes, items, sub-items, cases and digests
LAW_QUOTES = f"""{REFLOWED}, f as (select *, regexp_matches({_first('text')}, '^[-–—*"“ ]*[Aa][Rr][Tt][.]? *[0-9]') and not regexp_matches(text, '^\\s*>') as opens from blocks),
 g as (select *, regexp_matches({_first('text')}, '^(?:(?i:[CDILMVX]+) *[-–—]|[A-Za-z][)]|§)') and not regexp_matches(text, '^\\s*(?:>|!\\[)') and not opens as goes from f),
 r as (select *, sum(cast(not goes as int)) over (partition by doc_id order by block_no) as run from g),
 s as (select *, first_value(opens) over (partition by doc_id, run order by block_no) as quote, min(block_no) over (partition by doc_id, run) as m from r)
 select doc_id, case when quote then m else block_no end as block_no, case when bool_or(quote) then '> [!quote] ' || {NL} || '> LEI' || {NL} || string_agg({_quoted('text')}, {NL} || '>' || {NL} order by block_no) else min(text) end as text
 from s group by doc_id, case when quote then m else block_no end"""


def case_law_callout(spark, d):
    return R.reflow(X.marked(spark, d)).select("doc_id", F.col("block_no").cast("long").alias("block_no"), T.case_law_callout("text").alias("text"))


def alert_callout(spark, d):
    return R.reflow(X.marked(spark, d)).select("doc_id", F.col("block_no").cast("long").alias("block_no"), T.alert_callout("text").alias("text"))


def html_noise_strip(spark, d):
    return X.table(spark, d, "pages").select("page_id", T.clean_markdown("html").alias("text"))


def _clean(x: str) -> str:
    x = sql_sub(sql_sub(x, "\r\n?", "\n"), T.COMMENT)
    x = f"array_to_string(list_transform(string_split({x}, {NL}), lambda l: case when regexp_matches(l, {q(chr(94) + chr(92) + 's*' + chr(92) + '|.*' + chr(92) + '|' + chr(92) + 's*$')}) then l else {sql_sub('l', '<br' + chr(92) + 's*/?>', chr(10))} end), {NL})"
    return sql_strip(sql_sub(sql_sub(x, T.TAG), r"\n{3,}", "\n\n"))


def index_classify(spark, d):
    level, text = T.index_item("line")
    return X.marked(spark, d).select("doc_id", "pos", level.cast("int").alias("level"), text.alias("text"), T.index_heading(F.col("line")).alias("heading")).where("level is not null")


INDEX_SQL = f"""with {X.MARKED_SQL}, x as (select doc_id, pos, {sql_sub('trim(line)', '^#{1,6}' + chr(92) + 's+')} as x from marked),
 n as (select *, regexp_extract(x, '^[0-9][0-9.\\s]*', 0) as lead, regexp_replace(x, '^[0-9][0-9.\\s]*', '') as title, string_split(rtrim(regexp_replace(regexp_extract(x, '^[0-9][0-9.\\s]*', 0), '\\s*[.]\\s*', '.', 'g')), '.') as parts from x),
 m as (select *, array_to_string(parts, '.') as number, len(parts) - 1 as dots, len(list_filter(parts, lambda p: length(p) > 3 or regexp_matches(p, '[^0-9]'))) = 0 as fits,
  starts_with(x, '**') and regexp_matches(x, '[*][*]:?$') and length(x) > 4 and not contains(regexp_replace(x, '^[*][*]|[*][*]:?$', '', 'g'), '*') and regexp_replace(x, '^[*][*]|[*][*]:?$', '', 'g') <> '' as bold from n),
 y as (select doc_id, pos, case when bold then 0 when dots > 0 and fits and parts[-1] <> '' and regexp_matches(lead, '\\s$') and title <> '' then least(dots, 3) when dots = 1 and fits and parts[2] = '' and regexp_matches(lead, '[.]\\s+$') and regexp_matches(title, '^[A-Za-zÀ-ÖØ-öø-ÿ]') then 0
  when dots = 0 and fits and number <> '' and regexp_matches(title, '^[-–—]\\s*\\S') then 1 end as level, dots, number, title, bold, x from m),
 z as (select *, trim(case when bold then regexp_replace(x, '^[*][*]|[*][*]:?$', '', 'g') when dots > 0 then number || ' ' || title else number || '- ' || ltrim(substr(title, 2)) end) as text from y where level is not null)
 select doc_id, pos, cast(level as integer) as level, text, repeat('#', cast(4 + least(level, 2) as int)) || ' ' || rtrim(regexp_replace(text, '[:\\s]+$', '')) as heading from z"""


def outline_detect(spark, d):
    return R.outline(X.marked(spark, d))


OUTLINE_SQL = f"""with {X.MARKED_SQL}, r as (select *, regexp_matches(trim(line), {q(T.OUTLINE)}) as is_o from marked where pos < {PARAMS.outline_scan} and trim(line) <> ''),
 s as (select *, max(cast(is_o as int)) over (partition by doc_id order by pos) as seen from r), t as (select *, sum(case when seen = 1 and not is_o then 1 else 0 end) over (partition by doc_id order by pos) as breaks from s),
 u as (select *, row_number() over (partition by doc_id order by pos) as n from t where is_o and breaks = 0)
 select doc_id, count(*) as n, string_agg(trim(line), {NL} order by pos) as topics from u where n <= {PARAMS.outline_lines} group by doc_id"""


def bullets(spark, d):
    rows = X.lines(spark, d).select("doc_id", "pos", F.when(F.col("pos") % 3 == 0, F.concat(F.lit("  ❖ "), "line")).when(F.col("pos") % 3 == 1, F.concat("line", F.lit(" ➤ "))).otherwise(F.concat(F.lit("`o` "), "line")).alias("line"))
    return rows.select("doc_id", "pos", T.sub(T.sub("line", T.BULLET_END), r"^([ \t]*)(?:`o`|[❖➢⮚➤➥▶►∙•●○▪◦])[ \t]*", "$1- ").alias("text"))


BULLETS_SQL = f"""with {X.LINES_SQL}, b as (select doc_id, pos, case pos % 3 when 0 then '  ❖ ' || line when 1 then line || ' ➤ ' else '`o` ' || line end as line from lines)
 select doc_id, pos, {sql_sub(sql_sub('line', T.BULLET_END), '^([ ' + chr(92) + 't]*)(?:`o`|[❖➢⮚➤➥▶►∙•●○▪◦])[ ' + chr(92) + 't]*', '$1- ')} as text from b"""


def site_line_drop(spark, d):
    rows = X.lines(spark, d).select("doc_id", "pos", F.when(F.col("pos") % 5 == 0, F.concat(F.lit("www.site"), (F.col("doc_id") % 3).cast("string"), F.lit(".com.br"))).when(F.col("pos") % 5 == 1, F.concat("line", F.lit(" 8.069/1990"))).otherwise(F.col("line")).alias("line"))
    kept = rows.where(~F.col("line").rlike(T.SITE_LINE))
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))


_SITES = f"{X.LINES_SQL}, sites as (select doc_id, pos, case pos % 5 when 0 then 'www.site' || (doc_id % 3) || '.com.br' when 1 then line || ' 8.069/1990' else line end as line from lines)"


def site_repetition(spark, d):
    rows = X.lines(spark, d).select("doc_id", F.floor(F.col("pos") / 4).alias("page"), F.when(F.col("pos") % 4 == 0, F.concat(F.lit("3 www.Site"), (F.col("doc_id") % 3).cast("string"), F.lit(".com.br"))).otherwise(F.col("line")).alias("line"))
    found = rows.select("doc_id", "page", F.explode(F.regexp_extract_all("line", F.lit(T.SITE), F.lit(0))).alias("site")).select("doc_id", "page", F.lower(F.regexp_replace("site", r"[.,;:!?)]+$", "")).alias("site"))
    return found.groupBy("doc_id", "site").agg(F.count_distinct("page").alias("n_pages")).where(F.col("n_pages") >= PARAMS.site_min_pages)


SITE_REP_SQL = f"""with {X.LINES_SQL}, r as (select doc_id, cast(floor(pos / 4.0) as bigint) as page, case when pos % 4 = 0 then '3 www.Site' || (doc_id % 3) || '.com.br' else line end as line from lines),
 f as (select doc_id, page, unnest(regexp_extract_all(line, {q(T.SITE)}, 0)) as site from r) select doc_id, lower(regexp_replace(site, '[.,;:!?)]+$', '')) as site, count(distinct page) as n_pages from f group by all having count(distinct page) >= {PARAMS.site_min_pages}"""


def page_footer(spark, d):
    """One page per document with a printed number and a site at its foot: the number, the text without the footer."""
    page = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), (F.col("doc_id") % 900 + 1).cast("string"), F.lit("\nwww.site.com.br\n"))
    pattern = rf"\n([0-9]{{1,4}})[ \t]*\n[ \t]*{T.SITE}[.,;:!?)]*[ \t]*(?:\n|$)"
    rows = X.table(spark, d, "documents").select("doc_id", page.alias("page"))
    return rows.select("doc_id", F.regexp_extract("page", pattern, 1).alias("printed"), F.array_join(F.split("page", pattern, 2), "\n").alias("text"))


def footnote_refs(spark, d):
    rows = X.lines(spark, d).select("doc_id", F.floor(F.col("pos") / 5).alias("page_no"), "pos", F.concat("line", F.lit("<sup> "), (F.col("pos") % 5 + 1).cast("string"), F.lit(" </sup>")).alias("line"))
    refs = rows.select("doc_id", "page_no", F.explode(F.array_distinct(F.regexp_extract_all(T.sub("line", r"<sup>\s*([0-9]{1,3})\s*</sup>", "[^$1]"), F.lit(r"\[\^([0-9]{1,3})\]"), F.lit(1)))).alias("n"))
    return R.renumber_notes(refs.select("doc_id", "page_no", F.col("n").cast("int").alias("note_no")).distinct())


FOOTNOTE_SQL = f"""with {X.LINES_SQL}, r as (select doc_id, cast(floor(pos / 5.0) as bigint) as page_no, regexp_replace(line || '<sup> ' || (pos % 5 + 1) || ' </sup>', '<sup>\\s*([0-9]{{1,3}})\\s*</sup>', '[^\\1]', 'g') as line from lines),
 s as (select distinct doc_id, page_no, cast(unnest(regexp_extract_all(line, '\\[\\^([0-9]{{1,3}})\\]', 1)) as int) as note_no from r)
 select *, cast(row_number() over (partition by doc_id order by page_no, note_no) as int) as global_no from s"""


def logic_symbols(spark, d):
    forms = F.array(*[F.lit(x) for x in ("P -> Q", "P ^ Q v R -> ~S", "(A v B) <-> C", "x != y", "p <= q", "a => b", "plain v text", "| P -> Q |")])
    return X.lines(spark, d).select("doc_id", "pos", F.concat(F.get(forms, ((F.col("doc_id") + F.col("pos")) % 8).cast("int")), F.when(F.col("pos") % 2 == 0, F.concat(F.lit(" . "), F.col("line"))).otherwise("")).alias("line")).select("doc_id", "pos", symbols(F.col("line")).alias("text"))


_SIGNED = ["P → Q", "P ∧ Q ∨ R → ¬S", "(A ∨ B) ↔ C", "x ≠ y", "p ≤ q", "a ⇒ b", "plain v text", "| P -> Q |"]
LOGIC_SQL = f"""with {X.LINES_SQL} select doc_id, pos, ({_SIGNED!r})[(doc_id + pos) % 8 + 1] || case when pos % 2 = 0 then ' . ' || line else '' end as text from lines"""


def file_names(spark, d):
    """Slug, display name, lesson number and path of files named after documents."""
    name = F.concat(F.lit(" Aula_"), F.lpad((F.col("doc_id") % 120).cast("string"), 2, "0"), F.lit("  Ação ("), F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " "), F.lit(").pdf"))
    rows = X.table(spark, d, "documents").select("doc_id", name.alias("name"))
    n = T.lesson_number("name")
    return rows.select("doc_id", T.slugify(F.col("name")).alias("slug"), T.display_name(F.col("name")).alias("display"), n.alias("lesson"), F.when(n.isNull(), F.lit("DIR")).otherwise(F.concat(F.lit("DIR Aula "), n)).alias("path"))


_NAME = "' Aula_' || lpad(cast(doc_id % 120 as varchar), 2, '0') || '  Ação (' || replace(coalesce(text, ''), chr(10), ' ') || ').pdf'"
_STEM = "regexp_replace(name, '(.)\\.[^./]*$', '\\1')"
_SLUG = f"regexp_replace(lower(regexp_replace(regexp_replace(replace(replace(strip_accents({_STEM}), 'º', 'o'), 'ª', 'a'), '[^ -~]', '', 'g'), '[^0-9A-Za-z]+', '-', 'g')), '^-+|-+$', '', 'g')"
_DISPLAY = f"regexp_replace(regexp_replace(regexp_replace({sql_strip(_STEM)}, '\\s+', '_', 'g'), '[^A-Za-z0-9._\\-]+', '', 'g'), '^[._\\-]+|[._\\-]+$', '', 'g')"
NAMES_SQL = f"""with n as (select doc_id, {_NAME} as name from documents) select doc_id, case when {_SLUG} = '' then 'documento' else {_SLUG} end as slug, {_DISPLAY} as display,
 cast(cast(regexp_extract(name, '([0-9]{{1,3}})', 1) as int) as varchar) as lesson, 'DIR Aula ' || cast(regexp_extract(name, '([0-9]{{1,3}})', 1) as int) as path from n"""


def dedup_by_hash(spark, d):
    rows = X.table(spark, d, "documents").select("doc_id", T.file_hash(F.coalesce("text", F.lit(""))).alias("file_hash"))
    return rows.groupBy("file_hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


def tags_parse(spark, d):
    raw = F.concat("lang", F.lit(" , "), "source", F.lit(",, "), F.lit("t"), (F.col("doc_id") % 7).cast("string"))
    return X.table(spark, d, "documents").select("doc_id", F.array_join(T.tags(raw), "|").alias("tags"))


def yaml_frontmatter(spark, d):
    rows = X.table(spark, d, "documents").select("doc_id", F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)).alias("t"), "lang", "source")
    note = T.front_matter(F.lit("dir"), F.array("lang", "source"), F.lit("2024-01-01"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" # "), "t")), F.array(F.col("t")), F.concat("lang", F.lit(": "), "source"))
    return rows.select("doc_id", note.alias("yaml"))


def _yaml(v: str) -> str:
    return f"case when regexp_matches({sql_strip(v)}, {q(T.YAML_QUOTED)}) then '\"' || replace({sql_strip(v)}, '\"', '\\\"') || '\"' else {sql_strip(v)} end"


YAML_SQL = f"""with r as (select doc_id, split_part(coalesce(text, ''), {NL}, 1) as t, lang, source from documents) select doc_id, '---' || {NL} || 'disciplina: DIR' || {NL} || 'tags:' || {NL} || '  - ' || {_yaml('lang')} || {NL} || '  - ' || {_yaml('source')}
 || {NL} || 'excalidraw-plugin: parsed' || {NL} || 'data_criacao: 2024-01-01' || {NL} || case when doc_id % 2 = 0 and {sql_strip("' # ' || t")} <> '' then 'professora: ' || {_yaml("' # ' || t")} else 'professora:' end || {NL} || 'assunto: |-' || {NL} || '  ' || t || {NL}
 || 'caminho: ' || {_yaml("lang || ': ' || source")} || {NL} || '---' as yaml from r"""


def note_render(spark, d):
    """Notes: front matter and the reflowed blocks with alert and case-law callouts."""
    blocks = R.reflow(X.marked(spark, d)).select("doc_id", "block_no", T.alert_callout(T.case_law_callout("text")).alias("text"))
    notes = R.note_text(blocks)
    head = X.table(spark, d, "documents").select("doc_id", T.front_matter(F.lit("dir"), F.array("lang"), F.lit("2024-01-01"), F.lit(None).cast("string"), F.array().cast("array<string>"), F.col("source")).alias("head"))
    return head.join(notes, "doc_id").select("doc_id", "n_blocks", F.concat("head", F.lit("\n\n"), "body").alias("note"))


def _callout(x: str, test: str, title: str) -> str:
    return f"case when {test} and not regexp_matches({x}, '^\\s*>') then '{title}' || {NL} || {_quoted(x)} else {x} end"


_CASE = _callout("text", f"regexp_matches({_first('text')}, '^[-–—* ]*(?:ADI|Súmula) [0-9]')", "> [!warning] Jurisprudência")


def _alert(x: str) -> str:
    words = " or ".join(f"starts_with(strip_accents(lower(ltrim({_first(x)}, '*_-–— '))), '{w}')" for w in T.ALERTS)
    return _callout(x, f"({words})", "> [!attention] Atenção!")


NOTE_SQL = f"""with {REFLOWED}, c as (select doc_id, block_no, {_CASE} as t from blocks), e as (select doc_id, count(*) as n_blocks, string_agg({_alert('t')}, {NL} || {NL} order by block_no) as body from c group by doc_id)
 select doc_id, n_blocks, '---' || {NL} || 'disciplina: DIR' || {NL} || 'tags:' || {NL} || '  - ' || lang || {NL} || 'excalidraw-plugin: parsed' || {NL} || 'data_criacao: 2024-01-01' || {NL} || 'professora:' || {NL} || 'assunto:' || {NL} || 'caminho: ' || source || {NL} || '---' || {NL} || {NL} || body as note
 from documents join e using (doc_id)"""


def marker_counts(spark, d):
    body = F.concat(F.lit("## a\n#### b ( )\n¬x "), F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 == 0, "\n# c ()").otherwise(""))
    return X.table(spark, d, "documents").select("doc_id", body.alias("b")).select("doc_id", *[c.cast("long").alias(n) for c, n in zip(Q.marker_counts("b"), ["negation", *[f"h{k}" for k in range(1, 7)], "empty_parens"])])


COUNTS_SQL = "with b as (select doc_id, '## a' || chr(10) || '#### b ( )' || chr(10) || '¬x ' || coalesce(text, '') || case when doc_id % 3 = 0 then chr(10) || '# c ()' else '' end as b from documents) select doc_id, cast(len(regexp_extract_all(b, '¬')) as bigint) as negation, " + ", ".join(
    f"cast(len(regexp_extract_all(b, '(?m)^#{{{k}}}\\s+\\S')) as bigint) as h{k}" for k in range(1, 7)
) + ", cast(len(regexp_extract_all(b, '\\(\\s*\\)')) as bigint) as empty_parens from b"


def dq_forbidden_text(spark, d):
    rows = X.marked(spark, d).withColumn("line", F.when(F.col("pos") % 9 == 4, F.concat("line", F.lit(" www.x.com.br"))).when(F.col("pos") % 9 == 5, F.concat(F.lit("> "), "line", F.lit(" www.y"))).otherwise(F.col("line")))
    return Q.forbidden(rows).select("doc_id", "pos")


def dq_heading_depth(spark, d):
    rows = X.lines(spark, d).select("doc_id", "pos", F.concat(F.repeat(F.lit("#"), (1 + F.col("pos") % 6).cast("int")), F.lit(" "), "line").alias("line"))
    return Q.shallow_headings(rows).groupBy("doc_id").agg(F.count("*").alias("n"))


def emphasis_diff(spark, d):
    """Emphasised runs of a note that its repaired form has lost, with how often."""
    rows = X.marked(spark, d).select("doc_id", F.explode(F.regexp_extract_all("line", F.lit(r"\*\*[^*]+\*\*"), F.lit(0))).alias("run"))
    return Q.lost(rows, rows.where("doc_id % 4 <> 0")).groupBy("doc_id", "run").agg(F.count("*").alias("n"))


def postprocess_titles(spark, d):
    rows = X.marked(spark, d).select("doc_id", "pos", F.concat(F.when(F.col("pos") % 4 == 0, F.lit("## ")).otherwise(F.lit("")), "line", F.when(F.col("pos") % 3 == 0, F.lit(" ¬¬gone¬¬ x")).otherwise(F.lit("")), F.lit(" 12")).alias("line"))
    fixed = P.drop_page_number(P.split_markers(P.strikethrough(P.clamp_headings("line"))), F.lit(12))
    return rows.select("doc_id", "pos", fixed.alias("text"), P.plain_title(fixed).alias("title"))


_PT = f"select doc_id, pos, {sql_sub(sql_sub(sql_sub('b', '(?m)^#{1,3}(' + chr(92) + 's)', '####$1'), '¬{2,}([^¬]+)¬{2,}', '~~$1~~'), chr(92) + 's*¬{2,}' + chr(92) + 's*', chr(10) + '- ')} as c from (select doc_id, pos, case when pos % 4 = 0 then '## ' else '' end || line || case when pos % 3 = 0 then ' ¬¬gone¬¬ x' else '' end || ' 12' as b from marked)"
TITLES_SQL = f"""with {X.MARKED_SQL}, c as ({_PT}), t as (select doc_id, pos, case when regexp_extract(c, '(?:^|\\s)([0-9]{{1,4}})\\s*$', 1) = '12' then regexp_replace(c, '\\s*[0-9]{{1,4}}\\s*$', '') else c end as text from c)
 select doc_id, pos, text, {sql_strip(sql_sub(sql_sub('text', '^#{1,6}' + chr(92) + 's+'), chr(92) + '*' + chr(92) + '*|__'))} as title from t"""


def long_clauses(spark, d):
    return X.law(spark, d).select("doc_id", P.split_clauses(F.col("law")).alias("text"))


QUERIES = {
    "reflow_blocks": (reflow_blocks, f"with {REFLOWED} select doc_id, block_no, n_lines from blocks"),
    "reflow_text": (reflow_text, f"with {REFLOWED} select doc_id, block_no, text from blocks"),
    "law_quote_callout": (law_quote_callout, f"with {LAW_QUOTES}"),
    "case_law_callout": (case_law_callout, f"with {REFLOWED} select doc_id, block_no, {_CASE} as text from blocks"),
    "alert_callout": (alert_callout, f"with {REFLOWED} select doc_id, block_no, {_alert('text')} as text from blocks"),
    "html_noise_strip": (html_noise_strip, f"select page_id, {_clean('html')} as text from pages"),
    "index_classify": (index_classify, INDEX_SQL),
    "outline_detect": (outline_detect, OUTLINE_SQL),
    "decorative_bullets": (bullets, BULLETS_SQL),
    "site_line_drop": (site_line_drop, f"with {_SITES} select doc_id, count(*) as n_lines, string_agg(line, {NL} order by pos) as text from sites where not regexp_matches(line, {q(T.SITE_LINE)}) group by doc_id"),
    "site_repetition": (site_repetition, SITE_REP_SQL),
    "page_footer": (page_footer, "select doc_id, cast(doc_id % 900 + 1 as varchar) as printed, coalesce(text, '') || chr(10) as text from documents"),
    "footnote_numbering": (footnote_refs, FOOTNOTE_SQL),
    "logic_symbols": (logic_symbols, LOGIC_SQL),
    "file_names": (file_names, NAMES_SQL),
    "dedup_by_hash": (dedup_by_hash, "select substr(sha256(coalesce(text, '')), 1, 16) as file_hash, min(doc_id) as first_id, count(*) as n from documents group by 1"),
    "tags_parse": (tags_parse, "select doc_id, lang || '|' || source || '|t' || (doc_id % 7) as tags from documents"),
    "yaml_frontmatter": (yaml_frontmatter, YAML_SQL),
    "note_render": (note_render, NOTE_SQL),
    "marker_counts": (marker_counts, COUNTS_SQL),
    "dq_forbidden_text": (dq_forbidden_text, f"with {X.MARKED_SQL} select doc_id, pos from (select doc_id, pos, case pos % 9 when 4 then line || ' www.x.com.br' when 5 then '> ' || line || ' www.y' else line end as line from marked) where regexp_matches(line, {q(T.FORBIDDEN)}) and not regexp_matches(line, '^\\s*>')"),
    "dq_heading_depth": (dq_heading_depth, f"with {X.LINES_SQL} select doc_id, count(*) as n from lines where pos % 6 < 3 group by doc_id"),
    "emphasis_multiset_diff": (emphasis_diff, f"with {X.MARKED_SQL}, e as (select doc_id, unnest(regexp_extract_all(line, '\\*\\*[^*]+\\*\\*', 0)) as run from marked) select doc_id, run, count(*) as n from e where doc_id % 4 = 0 group by all"),
    "postprocess_titles": (postprocess_titles, TITLES_SQL),
    "long_clauses": (long_clauses, f"with {X.LAW_SQL} select doc_id, case when length(law) >= {PARAMS.long_clause} then {sql_sub('law', '; ([IVXLCDM]+ [-–]|§|[a-z]' + chr(92) + '))', ';' + chr(10) + '$1')} else law end as text from law"),
}
