"""Formulas in lines of text: operators spelled in ASCII or in words become mathematical signs; prose stays as it is."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions import text as T

# Operators and their signs, words that name an operator.
ASCII = {"<->": "↔", "<=>": "⇔", "—»": "→", "—>": "→", "->": "→", "-o": "→", "=>": "⇒", "<>": "≠", "!=": "≠", "<=": "≤", ">=": "≥", "==": "≡"}
SINGLE = {">": "⇒", "=": "⇔"}
SPELLED = {"not exists": "∄", "forall": "∀", "exists": "∃"}
CUES = {
    "se e somente se": "↔", "não está contido": "⊈", "não contém ou é igual": "⊉", "não pertence": "∉", "não contido": "⊄", "não contém": "⊅", "contido ou igual": "⊆",
    "contém ou igual": "⊇", "quantificador universal": "∀", "menor ou igual": "≤", "maior ou igual": "≥", "ou exclusivo": "⊻", "bicondicional": "↔", "equivalência": "⇔",
    "equivalente": "⇔", "implicação": "⇒", "condicional": "→", "conjunção": "∧", "disjunção": "∨", "negação": "¬", "subconjunto": "⊆", "superconjunto": "⊇", "contido": "⊂",
    "contém": "⊃", "pertence": "∈", "vazio": "∅", "união": "∪", "interseção": "∩", "não existe": "∄", "para todo": "∀", "diferente": "≠", "portanto": "∴", "porque": "∵",
    "infinito": "∞", "naturais": "ℕ", "inteiros": "ℤ", "racionais": "ℚ", "reais": "ℝ", **SPELLED,
}
SUBJECTS = ("lógica", "proposição")
SIGNS = "".join(sorted({*ASCII.values(), *SINGLE.values(), *CUES.values(), *"¬⊕"}))

_EITHER = lambda words: "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))
_ALONE = r"(?<![\p{L}0-9])(?:%s)(?![\p{L}0-9])"
_CUE = _ALONE % _EITHER(CUES)
#: What stands before and behind an operator: a letter, a bracket, a negation.
_LEFT, _RIGHT = r"(?<=[A-Za-z0-9)~¬])", r"(?=[A-Za-z(~¬])"
#: A letter by itself, or the bracket on that side.
_ONE_LEFT, _ONE_RIGHT = r"((?<![A-Za-z0-9])[A-Za-z]|\))", r"([A-Za-z](?![A-Za-z0-9])|\()"
#: A between operands.  As a proposition's name A only goes with capitals, and three or more of it in a row are a word that is repeated, no formula.
_AND = {
    r"((?<![A-Za-z0-9])[B-Za-z]|\))\s+A\s+([B-Za-z](?![A-Za-z0-9])|\()": "$1 ∧ $2",
    r"((?<![A-Za-z0-9])[B-Z]|\))\s+A\s+A(?![A-Za-z0-9]|\s+A(?![A-Za-z0-9]))": "$1 ∧ A",
    r"((?:^|[^A\s]|[A-Za-z0-9]A)\s+|^|[^A-Za-z0-9\s])A\s+A\s+([B-Z](?![A-Za-z0-9])|\()": "$1A ∧ $2",
}
_UNKNOWN = r"(?<=[A-Za-z(~])\s*\?\s*(?=[A-Za-z)])"
_GLYPH = r"(?<=[A-Z)])(\s*)\p{Co}(\s*)(?=[A-Z(])"


def longest_cue(line: Column) -> Column:
    """The longest word in the line that names an operator, the first of those; empty without one."""
    found = F.regexp_extract_all(F.lower(line), F.lit(f"({_CUE})"), F.lit(1))
    return F.aggregate(found, F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best))


def in_formula(line: Column) -> Column:
    """Whether a line holds operators between operands, signs, or words of logic."""
    operators = rf"{_LEFT}\s*(?:{_EITHER([*(w for w in ASCII if w != '-o'), *SINGLE])}|\^)\s*{_RIGHT}|{_ONE_LEFT}\s*-o\s*{_RIGHT}|{_LEFT}\s+[vVA]\s+{_RIGHT}"
    return line.rlike(operators) | line.rlike(f"[{SIGNS}]") | line.rlike(_UNKNOWN) | line.rlike(_GLYPH) | F.lower(line).rlike(_CUE) | F.lower(line).rlike(_ALONE % "|".join(SUBJECTS))


def _signed(line: Column) -> Column:
    cue = longest_cue(line)
    sign = F.element_at(F.create_map(*[F.lit(x) for pair in CUES.items() for x in pair]), F.nullif(cue, F.lit("")))
    unknown = F.regexp_count(line, F.lit(_UNKNOWN)) + F.regexp_count(line, F.lit(_GLYPH))
    named = F.regexp_replace(F.regexp_replace(line, F.lit(_UNKNOWN), F.concat(F.lit(" "), sign, F.lit(" "))), F.lit(_GLYPH), F.concat(F.lit("$1"), sign, F.lit("$2")))
    x = F.when(sign.isNotNull() & (unknown == 1), named).otherwise(line)
    for spelled in sorted(ASCII, key=lambda w: (-len(w), w)):
        # a hyphen and an o also end Portuguese verbs, so they need an operand of one letter
        x = T.sub(x, rf"{_ONE_LEFT}(\s*)-o(\s*){_RIGHT}", f"$1$2{ASCII[spelled]}$3") if spelled == "-o" else T.sub(x, rf"{_LEFT}(\s*){re.escape(spelled)}(\s*){_RIGHT}", f"$1{ASCII[spelled]}$2")
    x = T.sub(x, rf"~(?=\s*[A-Za-z(])", "¬")
    for one, by in SINGLE.items():
        x = T.sub(x, rf"{_ONE_LEFT}\s*{one}\s*{_ONE_RIGHT}", f"$1 {by} $2")
    for words, by in SPELLED.items():
        x = T.sub(x, rf"(?i){_ALONE % words.replace(' ', r'\s+')}", by)
    for words, by in _AND.items():
        x = T.sub(x, words, by)
    x = T.sub(x, rf"{_ONE_LEFT}\s+[vV]\s+{_ONE_RIGHT}", "$1 ∨ $2")
    return T.sub(x, rf"{_ONE_LEFT}\s*\^\s*{_ONE_RIGHT}", "$1 ∧ $2")


def symbols(line) -> Column:
    """A line with the operators of its formulas as signs; pipe rows, lines without a formula and struck text stay."""
    line = F.col(line) if isinstance(line, str) else line
    parts = F.split(line, "~~", -1)
    # between two doubled tildes the text is struck, if it is not blank at its ends
    struck = lambda p, i: (i % 2 == 1) & (i < F.size(parts) - 1) & ~p.rlike(r"^\s|\s$|^$")
    open_text = F.array_join(F.transform(parts, lambda p, i: F.when(struck(p, i), "").otherwise(p)), " ")
    fixed = F.array_join(F.transform(parts, lambda p, i: F.when(struck(p, i), p).otherwise(_signed(p))), "~~")
    return F.when(F.startswith(F.ltrim(line), F.lit("|")) | ~in_formula(open_text), line).otherwise(fixed)
