"""Secret scans over a trigram inverted index, in DataFrame functions only.

Each rule is a regular expression with a least length.  ``trigram_query`` derives from the expression a Boolean query that every
matching text satisfies: a conjunction of disjunctions of three-character strings in lower case.  The index holds, for
every trigram that some query names, the ids of the documents that contain it; intersecting the postings of a query gives the rule's
candidates, and only these are verified by the expression itself.  Rules without a mandatory trigram scan every text.

Kinds in order: assign, access, hex (the base), then the added kinds.  Positions are code points, end exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

try:  # the standard parser's place depends on the Python version
    from re import _constants as C
    from re import _parser as P
except ImportError:  # pragma: no cover
    import sre_constants as C
    import sre_parse as P

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    kind: str
    #: An expression that Java and Python read alike; it runs leftmost, non-overlapping.
    pattern: str
    #: Least length of the group (0: the whole match); shorter matches are dropped but still use up their text.
    least: int = 0
    group: int = 0
    base: bool = False


# The expressions of the three base kinds.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, 0, True),
    Rule("hex", r"[0-9a-f]+", 24, 0, True),
)
ADDED = (
    Rule("privkey", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE + ADDED
#: Alternative spellings of a part of an expression that the derivation follows; beyond it that part is unconstrained.
SPELLINGS = 64


def _exact(node, fold: bool):
    """All strings that the parsed node can match, in lower case, or None if there are too many or they are unbounded."""
    out = {""}
    for op, arg in node:
        if op is C.LITERAL:
            part = {chr(arg).lower()}
        elif op is C.IN:
            part = set()
            for kind, value in arg:
                if kind is C.LITERAL:
                    part.add(chr(value).lower())
                elif kind is C.RANGE and value[1] - value[0] < SPELLINGS:
                    part |= {chr(x).lower() for x in range(value[0], value[1] + 1)}
                else:
                    return None
        elif op is C.SUBPATTERN:
            part = _exact(arg[-1], fold)
        elif op is C.BRANCH:
            parts = [_exact(x, fold) for x in arg[1]]
            part = None if None in parts else set().union(*parts)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] is not C.MAXREPEAT and arg[1] <= 8:
            inner = _exact(arg[2], fold)
            part = None if inner is None else {"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(inner, repeat=n)} if len(inner) ** arg[1] <= SPELLINGS else None
        else:
            return None
        if part is None or len(out) * len(part) > SPELLINGS:
            return None
        out = {a + b for a in out for b in part}
    return out


def _clauses(strings: set[str]) -> list[frozenset[str]]:
    """Clauses (each: at least one of these trigrams) that hold if one of the strings occurs."""
    if not strings or min(map(len, strings)) < 3:
        return []
    grams = [[x[i : i + 3] for i in range(len(x) - 2)] for x in strings]
    width = max(map(len, grams))
    return [frozenset(g[min(i, len(g) - 1)] for g in grams) for i in range(width)]


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Conjunction of disjunctions of trigrams that any text with a match satisfies; empty if none is mandatory."""
    found: list[frozenset[str]] = []

    def walk(node) -> None:
        run: set[str] | None = {""}
        for item in node:
            exact = _exact([item], True)
            if exact is not None and run is not None and len(run) * len(exact) <= SPELLINGS:
                run = {a + b for a in run for b in exact}
                continue
            found.extend(_clauses(run or set()))
            run = exact if exact is not None else {""}
            if exact is None:
                op, arg = item
                if op is C.SUBPATTERN:
                    walk(arg[-1])
                elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
                    walk(arg[2])
        found.extend(_clauses(run or set()))

    walk(P.parse(pattern))
    return sorted(set(found), key=sorted)


def postings(docs: DataFrame, key: str, text: str, trigrams: list[str]) -> DataFrame:
    """The index: (gram, key) for each of the trigrams that a key's text has, letters in either case."""
    low = F.lower(text)
    has = F.filter(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in trigrams]), lambda x: x.isNotNull())
    return docs.select(key, low.alias("low")).select(F.explode(has).alias("gram"), key)


def candidates(index: DataFrame, key: str, rules: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(key, kinds): the kinds whose Boolean query the key's postings satisfy."""
    clauses = sorted({c for q in rules.values() for c in q}, key=sorted)
    each = [F.bool_or(F.col("gram").isin(*sorted(c))).alias(f"c{i}") for i, c in enumerate(clauses)]
    met = index.groupBy(key).agg(*each)
    kinds = []
    for kind, query in rules.items():
        need = F.lit(True)
        for c in query:
            need = need & F.col(f"c{clauses.index(c)}")
        kinds.append(F.when(need, F.lit(kind)))
    met = met.select(key, F.filter(F.array(*kinds), lambda x: x.isNotNull()).alias("kinds"))
    return met.where(F.size("kinds") > 0)


def _effective(rule: Rule) -> tuple[str, int]:
    """An expression with the same kept matches, and the least length that is still to be tested.

    The runs of access and hex are maximal, so their least length can stand in the expression.
    """
    if rule.kind in ("access", "hex"):
        return f"{rule.pattern[:-1]}{{{rule.least - (4 if rule.kind == 'access' else 0)},}}", 0
    return rule.pattern, rule.least


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, ord, end>> of a rule's matches: the matches, and the text between them, give the positions."""
    pattern, least = _effective(rule)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    tails = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)) if least else hits
    rows = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), tails.alias("tail"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,ord:int,end:int>>").alias("out"))

    def step(acc, x):
        a = acc["at"] + F.length(x["gap"])
        b = a + F.coalesce(F.length(x["hit"]), F.lit(0))
        keep = x["hit"].isNotNull() & (F.length(x["tail"]) >= least)
        one = F.array(F.struct(a.alias("start"), F.lit(order).alias("ord"), b.alias("end")))
        return F.struct(b.alias("at"), F.when(keep, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(rows, start, step)["out"]
    return F.when(F.size(hits) > 0, found).otherwise(F.array().cast("array<struct<start:int,ord:int,end:int>>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row (id_col, n_<kind> for each kind, found) per row of docs; found is an array of (start, ord, end) by start.

    A null text is empty.  The index is keyed by id: rows that share an id (or have none) share its candidates, which is only a wider
    choice of texts to verify, so their own results stay exact.  An empty table gives an empty one; other columns aren't read.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q}
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    keyed = rows.withColumn("__key", F.coalesce(F.col("__id").cast("long"), F.xxhash64("__text")))
    if indexed:
        grams = sorted({g for q in indexed.values() for c in q for g in c})
        found = candidates(postings(keyed, "__key", "__text", grams), "__key", indexed)
        keyed = keyed.join(found, "__key", "left")
    else:
        keyed = keyed.withColumn("kinds", F.lit(None).cast("array<string>"))
    empty = F.array().cast("array<struct<start:int,ord:int,end:int>>")
    out = keyed
    for k, r in enumerate(rules):
        spans = _spans(F.col("__text"), r, k)
        if r.kind in indexed:
            spans = F.when(F.coalesce(F.array_contains("kinds", r.kind), F.lit(False)), spans).otherwise(empty)
        out = out.withColumn(f"__{r.kind}", spans)
    every = F.sort_array(F.concat(*[F.col(f"__{r.kind}") for r in rules]))
    counts = [F.size(f"__{r.kind}").cast("long").alias(f"n_{r.kind}") for r in rules]
    return out.select(F.col("__id").alias(id_col), *counts, every.alias("found"))


def rendered(found: Column, rules: tuple[Rule, ...] = RULES, base: bool = False) -> Column:
    """kind:start:end, comma-joined; base: of the base kinds only."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    last = sum(r.base for r in rules)
    kept = F.filter(found, lambda x: x["ord"] < last) if base else found
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", F.get(names, x["ord"]), x["start"], x["end"])), ",")


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, mask: str = "[secret]") -> DataFrame:
    """(id_col, text): the texts with each match of the rules replaced, kind by kind in order (matches under the least length stay)."""
    out = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    for r in rules:
        hits = F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))
        tails = F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group))
        gaps = F.split("text", r.pattern, -1)
        rows = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), tails.alias("tail"))
        least = r.least
        kept = F.transform(rows, lambda x: F.concat(x["gap"], F.when(F.length(x["tail"]) >= least, F.lit(mask)).otherwise(F.coalesce(x["hit"], F.lit("")))))  # noqa: B023
        out = out.withColumn("text", F.when(F.size(hits) > 0, F.array_join(kept, "")).otherwise(F.col("text")))
    return out


def duckdb_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The digest of scan() as DuckDB SQL, without an index."""
    found, lists = [], []
    for k, r in enumerate(rules):
        pattern, least = _effective(r)
        quoted = pattern.replace("'", "''")
        found.append(f"regexp_extract_all(t, '{quoted}', 0) as h{k}, regexp_extract_all(t, '{quoted}', {r.group if least else 0}) as l{k}, regexp_split_to_array(t, '{quoted}') as g{k}")
        lists.append(
            f"list_filter(list_transform(range(1, len(h{k}) + 1), lambda i: struct_pack(a := cast(list_sum(list_transform(g{k}[1:i], lambda x: length(x))) + "
            f"coalesce(list_sum(list_transform(h{k}[1:i - 1], lambda x: length(x))), 0) as bigint), o := {k}, n := length(h{k}[i]), g := length(l{k}[i]))), lambda x: x.g >= {least}) as k{k}"
        )
    names = ", ".join(f"'{r.kind}'" for r in rules)
    base = [k for k, r in enumerate(rules) if r.base]

    def joined(ks) -> str:
        return f"coalesce(array_to_string(list_transform(list_sort(flatten([{', '.join(f'k{k}' for k in ks)}])), lambda x: [{names}][x.o + 1] || ':' || x.a || ':' || (x.a + x.n)), ','), '')"

    counts = ", ".join(f"cast(len(k{k}) as bigint) as n_{rules[k].kind}" for k in base)
    return f"with d as (select doc_id, coalesce(text, '') as t from documents), m as materialized (select doc_id, {', '.join(found)} from d), s as materialized (select doc_id, {', '.join(lists)} from m) select doc_id, {counts}, sha256({joined(base)}) as base_sha256, {joined(range(len(rules)))} as spans from s"


def python_spans(text: str, rule: Rule) -> list[tuple[int, int]]:
    """The definition, for tests: spans of one rule by Python's own matcher."""
    return [m.span() for m in re.finditer(rule.pattern, text, re.ASCII) if len(m[rule.group]) >= rule.least]
