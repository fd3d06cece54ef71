"""Text expressions: Column in, Column out, all inside the JVM.

Patterns are written so that they mean the same in Java and RE2: explicit classes instead of Unicode-aware ones.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.params import PARAMS

# Names of the tags that are stripped, process classes, alert words.
TAGS = "p|div|span|u|b|i|strong|em|font|sup|sub|table|tr|td|th|li|ul|ol|h[0-9]|a|img"
TAG = rf"</?(?:{TAGS})\b[^>]*>"
COMMENT = r"(?s)<!--.*?-->"
CASE_CLASSES = ("ADI", "ADPF", "ADC", "ADO", "ARE", "RE", "AGRG", "HC", "MS", "RHC", "RESP", "ARESP", "RMS", "RVC")
ALERTS = ("obs", "observacao", "observacoes", "atencao", "cuidado", "nao se esqueca")
NUMERALS = "IVXLCDM"
LIST_SIGNS = ("|", "-", "•", "❖", "*")
CONVERTED_BULLET = "\ue000"
OUTLINE = r"^[0-9]+(?:\.[0-9]+)*\.?(?:\s+|[-–—]\s*)\S"
BULLET = r"^[ \t]*(?:`o`|[❖➢⮚➤➥▶►∙•●○▪◦])[ \t]*"
BULLET_END = r"[ \t]*[❖➢⮚➤➥▶►][ \t]*$"
#: A site: a URL, a www name or a dotted name under a top-level domain; ordinary dotted text is none.
SITE = r"(?:https?://\S+|www\.[A-Za-z0-9][A-Za-z0-9./-]*|[A-Za-z0-9][A-Za-z0-9-]*(?:\.[A-Za-z0-9-]+)*\.(?:com|org|net|gov|edu|br)(?:\.br)?(?:/\S*)?)"
SITE_LINE = rf"(?i)^\s*{SITE}\s*[.,;:!?)]*\s*$"
YAML_QUOTED = r"[:#\[\]{}]|^[-?!&*|>%@`\"']"
FORBIDDEN = r"(?i)end of page=|www\.|\.com\.br"


def strip(c) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def sub(c, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(by))


def clean_markdown(c) -> Column:
    """Line ends to line feeds, no comments, <br> to line feeds except in pipe rows, no listed tags, at most one blank line."""
    c = sub(sub(c, "\r\n?", "\n"), COMMENT)
    rows = F.transform(F.split(c, "\n"), lambda x: F.when(x.rlike(r"^\s*\|.*\|\s*$"), x).otherwise(F.regexp_replace(x, r"<br\s*/?>", "\n")))
    return strip(sub(sub(F.array_join(rows, "\n"), TAG), r"\n{3,}", "\n\n"))


def word(c) -> Column:
    """The text up to the first blank."""
    return F.regexp_extract(c, r"^(\S*)", 1)


def after(c, token) -> Column:
    return F.substr(c, F.length(token) + 1)


def shape(token) -> Column:
    """A token with each run of digits as one 0."""
    return sub(token, "[0-9]+", "0")


def is_numeral(token) -> Column:
    """Roman digits and nothing else, in either case."""
    return (token != "") & (F.translate(F.upper(token), NUMERALS, "") == "")


def folded(c) -> Column:
    """Lower case without the accents of Portuguese."""
    return F.translate(F.lower(c), "áàâãéêíóôõúüç", "aaaaeeiooouuc")


def is_block_start(line, handout: bool = False) -> Column:
    """Whether a line opens a block by its first word; an indented line doesn't.

    Headings, quotes, pipe rows, images, rules, bullets, numbers with a dot or parenthesis, dotted numbers, Roman numerals with a dash or dot,
    something in parentheses, and lines that are underlined or bold as a whole.  In handouts also converted bullets, ordinals,
    numbers with a dash, and capitals (or A.1) with a parenthesis.
    """
    line = F.col(line) if isinstance(line, str) else line
    head = word(line)
    rest, form = after(line, head), shape(head)
    spaced = rest.rlike(r"^\s")
    stem = F.left(head, F.length(head) - 1)
    tests = [
        F.left(line, F.lit(1)).isin(*LIST_SIGNS),
        F.startswith(line, F.lit("![")),
        F.startswith(form, F.lit("0.0")),
        F.startswith(line, F.lit("<u>")) & F.endswith(F.rtrim(line), F.lit("</u>")),
        spaced & head.isin(">", *["#" * k for k in range(1, 7)]),
        spaced & form.isin("0.", "0)"),
        spaced & F.right(head, F.lit(1)).isin("-", ".") & is_numeral(stem),
        is_numeral(head) & rest.rlike(r"^\s+[-.]\s"),
        spaced & F.startswith(head, F.lit("(")) & F.endswith(head, F.lit(")")) & F.substr(stem, F.lit(2)).rlike("^[A-Za-z0-9]+$"),
    ]
    if handout:
        letter = F.left(head, F.lit(1)).rlike("[A-Z]")
        dash = form.isin("0-", "0–", "0—")
        tests += [spaced & form.isin(CONVERTED_BULLET, "0ª)", "0º)"), dash & rest.rlike(r"^\s+\S"), spaced & letter & F.substr(form, F.lit(2)).isin(")", ".0)")]
    found = tests[0]
    for t in tests[1:]:
        found = found | t
    return ~line.rlike(r"^\s") & found


def is_indented_topic(line) -> Column:
    """An indented line whose text opens a block of a handout by an ordinal, a number with a dash, a capital or a bullet."""
    line = F.col(line) if isinstance(line, str) else line
    bare = strip(line)
    head = word(bare)
    form, rest = shape(head), after(bare, head)
    letter = F.left(head, F.lit(1)).rlike("[A-Z]") & F.substr(form, F.lit(2)).isin(")", ".0)")
    return line.rlike(r"^\s+\S") & rest.rlike(r"^\s+\S") & (form.isin(CONVERTED_BULLET, "0ª)", "0º)", "0-", "0–", "0—") | letter)


def join_lines(parts, any_hyphen: bool = False) -> Column:
    """Lines of a paragraph joined by blanks; a word parted by a hyphen at a line's end is put together again: one after a letter, or any but a dash of two."""
    tail = r"(?:^|[^-])-$" if any_hyphen else r"[A-Za-zÀ-ÿ]-$"
    return F.aggregate(parts, F.lit(""), lambda acc, x: F.when(acc == "", x).when(acc.rlike(tail), F.concat(F.substr(acc, F.lit(1), F.length(acc) - 1), x)).otherwise(F.concat(acc, F.lit(" "), x)))


def quoted(block) -> Column:
    """Each line of a block after "> "; blank lines as ">"."""
    return F.array_join(F.transform(F.split(block, "\n"), lambda x: F.when(F.trim(x) != "", F.concat(F.lit("> "), x)).otherwise(F.lit(">"))), "\n")


def first_line(block) -> Column:
    return F.split_part(F.regexp_replace(block, r"^\s+", ""), F.lit("\n"), F.lit(1))


def unquoted(block) -> Column:
    return ~F.rlike(block, F.lit(r"^\s*>"))


def _undecorated(line) -> Column:
    """A line without the dashes, stars and quotation marks it begins with."""
    return F.ltrim(line, F.lit(" \t-–—*\"“"))


def is_law_quote(block) -> Column:
    """The first line begins with Art. and a number, perhaps after a dash, bold or a quotation mark."""
    bare = _undecorated(first_line(block))
    return (F.lower(F.left(bare, F.lit(3))) == "art") & F.substr(bare, F.lit(4)).rlike(r"^\.?\s*[0-9]") & unquoted(block)


def goes_on_law(block) -> Column:
    """The first line begins with an item, a sub-item or a paragraph."""
    line = first_line(block)
    numeral = F.regexp_extract(F.upper(line), f"^([{NUMERALS}]+)", 1)
    item = (numeral != "") & after(line, numeral).rlike(r"^\s*[-–—]")
    sole = F.startswith(sub(folded(F.left(line, F.lit(40))), r"\s+", " "), F.lit("paragrafo unico"))
    return item | line.rlike(r"^[A-Za-z]\)") | F.startswith(line, F.lit("§")) | sole


def is_case_law(block) -> Column:
    """The first line begins with the class and number of a case, or with a numbered digest."""
    bare = F.ltrim(first_line(block), F.lit(" \t-–—*"))
    name = F.regexp_extract(bare, r"^([A-Za-zÀ-ÿ]+)", 1)
    rest = after(bare, name)
    case = F.upper(name).isin(*CASE_CLASSES) & sub(rest, r"^\s*\.?\s*[nN]?\.?\s*").rlike("^[0-9]")
    # a class may stand right before its n
    glued = F.upper(F.left(name, F.length(name) - 1)).isin(*CASE_CLASSES) & F.lower(F.right(name, F.lit(1))).isin("n") & rest.rlike(r"^\.?\s*[0-9]")
    digest = (folded(name) == "sumula") & sub(sub(folded(rest), r"^\s+vinculante"), r"^\s*(?:n[ºo°]?)?\s*").rlike("^[0-9]")
    return (case | glued | digest) & unquoted(block)


def is_alert(block) -> Column:
    """The first line, without emphasis and dashes, begins with a word of warning."""
    bare = sub(folded(F.ltrim(first_line(block), F.lit("*_-–— "))), r"\s+", " ")
    found = F.startswith(bare, F.lit(ALERTS[0]))
    for x in ALERTS[1:]:
        found = found | F.startswith(bare, F.lit(x))
    return found & unquoted(block)


def callout(block, hit, title: str) -> Column:
    """The block quoted under a callout's title where hit holds, else as it is."""
    block = F.col(block) if isinstance(block, str) else block
    return F.when(hit, F.concat(F.lit(title + "\n"), quoted(block))).otherwise(block)


def case_law_callout(block) -> Column:
    return callout(block, is_case_law(block), "> [!warning] Jurisprudência")


def alert_callout(block) -> Column:
    return callout(block, is_alert(block), "> [!attention] Atenção!")


def is_cell_item(cell) -> Column:
    """A cell's text that begins with a dash, an arrow, or a number with a dot, dash or parenthesis."""
    number = F.regexp_extract(cell, "^([0-9]*)", 1)
    sign = F.left(F.ltrim(after(cell, number)), F.lit(1))
    return F.left(cell, F.lit(1)).isin("-", "→") | ((number != "") & sign.isin("-", ".", ")"))


def numbered(line) -> Column:
    """struct<number, sign, text>: a line's leading dotted number, what parts it from the text (dot, dash, parenthesis or blank) and the text.

    All are empty for a line that doesn't begin with a number or goes on without a break.
    """
    number = F.regexp_extract(line, r"^([0-9]+(?:\.[0-9]+)*)", 1)
    rest = after(line, number)
    sign = F.left(F.ltrim(rest), F.lit(1))
    dotted = rest.rlike(r"^\.\s+\S")
    signed = sign.isin("-", "–", "—", ")") & F.substr(F.ltrim(rest), F.lit(2)).rlike(r"\S")
    blank = rest.rlike(r"^\s+\S")
    good = (number != "") & (dotted | signed | blank)
    text = F.when(dotted | signed, strip(F.substr(F.ltrim(rest), F.lit(2)))).otherwise(strip(rest))
    kind = F.when(dotted, ".").when(signed, sign).otherwise(" ")
    return F.struct(F.when(good, number).otherwise("").alias("number"), F.when(good, kind).otherwise("").alias("sign"), F.when(good, text).otherwise("").alias("text"))


def lettered(line) -> Column:
    """The capital, with its dotted numbers, that a closing parenthesis and a text follow at a line's beginning; else empty."""
    head = word(line)
    label = F.left(head, F.length(head) - 1)
    good = F.endswith(head, F.lit(")")) & F.left(head, F.lit(1)).rlike("[A-Z]") & F.substr(shape(label), F.lit(2)).isin("", ".0") & after(line, head).rlike(r"^\s+\S")
    return F.when(good, label).otherwise("")


def index_item(line) -> tuple[Column, Column]:
    """(level, text) of an index line; null level if it is none.

    A line that is bold as a whole, a number and a title (level 0), a dotted number (a level for each dot, three at most), or a number
    and a dash (level 1).  Numbers have up to three digits; blanks around their dots don't count.
    """
    x = sub(F.trim(F.col(line) if isinstance(line, str) else line), r"^#{1,6}\s+")
    inner = sub(x, r"^\*\*|\*\*:?$")
    bold = F.startswith(x, F.lit("**")) & x.rlike(r"\*\*:?$") & (F.length(x) > 4) & ~F.contains(inner, F.lit("*")) & (inner != "")
    lead = F.regexp_extract(x, r"^([0-9][0-9.\s]*)", 1)
    number = F.rtrim(sub(lead, r"\s*\.\s*", "."))
    title = after(x, lead)
    parts = F.split(number, r"\.")
    fits = F.forall(parts, lambda p: p.rlike("^[0-9]{0,3}$"))
    dots = F.size(parts) - 1
    dotted = (dots > 0) & fits & ~F.endswith(number, F.lit(".")) & lead.rlike(r"\s$") & (title != "")
    parent = (dots == 1) & fits & F.endswith(number, F.lit(".")) & lead.rlike(r"\.\s+$") & title.rlike("^[A-Za-zÀ-ÖØ-öø-ÿ]")
    dash = (dots == 0) & fits & (number != "") & title.rlike(r"^[-–—]\s*\S")
    level = F.when(bold, 0).when(dotted, F.least(dots, F.lit(3))).when(parent, 0).when(dash, 1)
    text = (
        F.when(bold, F.trim(inner))
        .when(dotted, F.concat(number, F.lit(" "), title))
        .when(parent, F.concat(number, F.lit(" "), title))
        .when(dash, F.concat(number, F.lit("- "), F.ltrim(F.substr(title, F.lit(2)))))
    )
    return level, F.trim(text)


def index_heading(line) -> Column:
    level, text = index_item(line)
    marks = F.repeat(F.lit("#"), PARAMS.heading_base_level + F.least(level, F.lit(PARAMS.heading_max_level - PARAMS.heading_base_level)))
    return F.when(level.isNotNull(), F.concat(marks, F.lit(" "), F.rtrim(F.regexp_replace(text, r"[:\s]+$", ""))))


def _foldings() -> tuple[str, str, list[tuple[str, str]]]:
    """Letters of Latin blocks and compatibility forms with their plain ASCII form by Unicode decomposition: one to one, and the longer ones."""
    one, many = {}, []
    for point in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]:
        plain = unicodedata.normalize("NFKD", chr(point)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            one[chr(point)] = plain
        elif len(plain) > 1:
            many.append((chr(point), plain))
    return "".join(one), "".join(one.values()), many


ACCENTED, PLAIN, LONGER = _foldings()


def ascii_folded(c) -> Column:
    """Text in ASCII: letters without accents (composed or not), compatibility forms spelled out, all else dropped."""
    for letter, plain in LONGER:
        c = F.replace(c, F.lit(letter), F.lit(plain))
    return sub(F.translate(c, ACCENTED, PLAIN), r"[^\x00-\x7F]")


def slugify(name) -> Column:
    base = ascii_folded(F.regexp_replace(name, r"(.)\.[^./]*$", "$1"))
    base = F.lower(F.regexp_replace(F.regexp_replace(base, r"[^a-zA-Z0-9]+", "-"), r"^-+|-+$", ""))
    return F.when(base == "", "documento").otherwise(base)


def display_name(name) -> Column:
    base = F.regexp_replace(strip(F.regexp_replace(name, r"(.)\.[^./]*$", "$1")), r"\s+", "_")
    base = F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9._\-]+", ""), r"^[._\-]+|[._\-]+$", "")
    return F.when(base == "", slugify(name)).otherwise(base)


def file_hash(content) -> Column:
    return F.substring(F.sha2(F.col(content).cast("binary") if isinstance(content, str) else content.cast("binary"), 256), 1, 16)


def lesson_number(name) -> Column:
    found = F.regexp_extract(name, r"([0-9]{1,3})", 1)
    return F.when(found != "", found.cast("int").cast("string"))


def tags(raw) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def yaml_scalar(value) -> Column:
    v = strip(value)
    return F.when(v.rlike(YAML_QUOTED), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(v)


def front_matter(subject, tag_list, date, teacher, topics, path) -> Column:
    """The YAML block of a note; topics is an array of lines."""
    t = F.coalesce(strip(teacher), F.lit(""))
    p = F.coalesce(strip(path), F.lit(""))
    return F.concat_ws(
        "\n",
        F.lit("---"),
        F.concat(F.lit("disciplina: "), yaml_scalar(F.upper(subject))),
        F.when(F.size(tag_list) > 0, F.concat(F.lit("tags:\n"), F.array_join(F.transform(tag_list, lambda x: F.concat(F.lit("  - "), yaml_scalar(x))), "\n"))).otherwise(F.lit("tags:")),
        F.lit("excalidraw-plugin: parsed"),
        F.concat(F.lit("data_criacao: "), date),
        F.when(t != "", F.concat(F.lit("professora: "), yaml_scalar(t))).otherwise(F.lit("professora:")),
        F.when(F.size(topics) > 0, F.concat(F.lit("assunto: |-\n"), F.array_join(F.transform(topics, lambda x: F.concat(F.lit("  "), x)), "\n"))).otherwise(F.lit("assunto:")),
        F.when(p != "", F.concat(F.lit("caminho: "), yaml_scalar(p))).otherwise(F.lit("caminho:")),
        F.lit("---"),
    )


def running_key(text) -> Column:
    """Letters and digits only, lower case: how running headers are compared."""
    return F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "")


def match_key(text) -> Column:
    """Lower case without markup, quotation marks, dashes and bullets, single blanks: how an anchor is looked up in a block."""
    return F.trim(sub(sub(F.lower(text), "[*_`~\"“”‘’<>–—\\-❖➢⮚➤➥▶►∙•●○▪◦\ue000]", " "), r"\s+", " "))


def letters_and_digits(text) -> Column:
    """Lower case letters and digits only: how texts are compared whatever their markup."""
    return sub(F.lower(text), r"[^\p{L}\p{N}]")


def body_of(note) -> Column:
    """A note without its front matter: what follows the second rule, if it begins with one."""
    parts = F.split(note, r"(?m)^---[ \t]*$", 3)
    return F.when(F.startswith(F.ltrim(note), F.lit("---")) & (F.size(parts) == 3), strip(F.get(parts, F.lit(2)))).otherwise(note)


def canonical_name(path) -> Column:
    """The stem of a file's name as lower-case ASCII words: how notes and files are paired."""
    stem = sub(sub(path, r"^.*/"), r"(.)\.[^./]*$", "$1")
    return F.trim(sub(F.lower(ascii_folded(F.lower(stem))), "[^a-z0-9]+", " "))


def law_profile(*fields) -> Column:
    """Whether a subject, a name or a slug says that a note is about law."""
    words = F.split(folded(F.concat_ws(" ", *fields)), "[^a-z0-9]+")
    return F.arrays_overlap(words, F.array(F.lit("direito"), F.lit("dir")))


def note_path(subject: Column, lesson: Column) -> Column:
    """The subject with the number of the lesson, or alone."""
    return F.when(F.coalesce(lesson, F.lit("")) == "", subject).otherwise(F.concat(subject, F.lit(" Aula "), lesson))


def job_id(seed: Column | None = None) -> Column:
    """Twelve hexadecimal digits: of a random identifier, or of a digest of the seed."""
    return F.substring(F.sha2(seed.cast("binary"), 256), 1, 12) if seed is not None else F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12)


def decorated(text) -> Column:
    """Decorative bullets at a line's beginning as the private sign, those at its end dropped; see plain_bullets."""
    return sub(sub(text, "(?m)" + BULLET_END), "(?m)" + BULLET.replace("[ \\t]*(?:", "([ \\t]*)(?:", 1), f"$1{CONVERTED_BULLET} ")


def plain_bullets(text) -> Column:
    return F.replace(text, F.lit(CONVERTED_BULLET), F.lit("-"))


def note_refs(text) -> Column:
    """Superscript numbers as references to notes."""
    return sub(text, r"<sup>\s*([0-9]{1,3})\s*</sup>", "[^$1]")
