"""Chat formatting with tool-call linking.

Messages are rows (conv_id, turn, role, text).  An assistant's text may be a JSON object with tool_calls, an array of
{id, name, arguments (object or JSON text), depends_on (array of ids)}; a tool's text may be {tool_call_id, content}.  Where
texts are plain, as in ordinary dialogues, each user turn is a call of the tool ``reply`` with the id "turn" and the argument
prompt, and the next turn, if it is the assistant's, is its result.  Such ids are a space of their own: they never meet ids that messages name.

Calls and results are joined by (conversation, identifier).  Calls are put in a stable topological order: a call keeps its place unless it
depends on a later one; then it follows that.  With key(v) = the latest turn among v and all it depends on, the order is (key,
level, turn), where level counts the steps from the call whose turn is the key.  Calls with no dependency ahead of them in their
conversation have key = turn at once, so only conversations that have an inversion are resolved: those of up to GROUP_EDGES dependencies each in
one grouped pass, longer ones by rounds over all of them, one per link of the longest chain, until none can be placed any more.
Calls in a cycle, or that depend on one, get status ``cycle``.  Arguments are validated against the tool's schema; calls are serialised as canonical JSON (keys sorted,
no spaces, shortest numbers).
"""

from __future__ import annotations

import json
import math
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import rows_of, written

#: Schemas of tools by name; "reply" is the tool that plain dialogues call.
SCHEMAS = {"reply": {"type": "object", "required": ["prompt"], "properties": {"prompt": {"type": "string", "minLength": 1}}, "additionalProperties": False}}
#: Dependencies of a conversation that are resolved in one task.
GROUP_EDGES = 100_000
CALL = "conv_id long, turn long, ord int, call_id string, link string, name string, arguments string, valid boolean, problem string, depends_on array<string>"
RESULT = "conv_id long, turn long, link string, content string"


_LONE = re.compile("[\ud800-\udfff]")


def well_formed(text: str) -> str:
    """text with lone surrogates, which UTF-8 has no form for, spelled as their escapes."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _scalar(x) -> str:
    if isinstance(x, float):
        x = None if not math.isfinite(x) else int(x) if x.is_integer() and abs(x) < 2**53 else x
    return well_formed(json.dumps(x, ensure_ascii=False))


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, whole floats as integers; NaN and infinities become null; any depth."""
    out: list[str] = []
    todo: list = [(value, None)]  # (value, None), or (None, text to put)
    while todo:
        x, text = todo.pop()
        if text is not None:
            out.append(text)
        elif isinstance(x, dict):
            todo.append((None, "}"))
            for n, k in reversed(list(enumerate(sorted(x)))):
                todo += [(x[k], None), (None, ("," if n else "") + _scalar(k) + ":")]
            out.append("{")
        elif isinstance(x, list):
            todo.append((None, "]"))
            for n in range(len(x) - 1, -1, -1):
                todo.append((x[n], None))
                if n:
                    todo.append((None, ","))
            out.append("[")
        else:
            out.append(_scalar(x))
    return "".join(out)


_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


def problem(value, schema: dict, at: str = "$") -> str | None:
    """The first way in which value doesn't fit the schema (type, enum, bounds, required, properties, items), or None; as deep as the schema."""
    kind = schema.get("type")
    kinds = [kind] if isinstance(kind, str) else kind or []
    if kinds and not any(isinstance(value, _TYPES[k]) and not (isinstance(value, bool) and k in ("integer", "number")) for k in kinds):
        return f"{at}: not of type {'/'.join(kinds)}"
    if "enum" in schema and canonical(value) not in [canonical(x) for x in schema["enum"]]:
        return f"{at}: not one of the listed values"
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
        return f"{at}: length out of bounds"
    if isinstance(value, (int, float)) and not isinstance(value, bool) and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        return f"{at}: out of bounds"
    if isinstance(value, dict):
        for name in schema.get("required", ()):
            if name not in value:
                return f"{at}: {name} is missing"
        known = schema.get("properties", {})
        for name in sorted(value):
            if name in known:
                if found := problem(value[name], known[name], f"{at}.{name}"):
                    return found
            elif schema.get("additionalProperties") is False:
                return f"{at}: {name} is not expected"
    if isinstance(value, list) and "items" in schema:
        for k, x in enumerate(value):
            if found := problem(x, schema["items"], f"{at}[{k}]"):
                return found
    return None


def _json(text):
    if text and text.lstrip()[:1] == "{":
        try:
            found = json.loads(text)
            return found if isinstance(found, dict) else None
        except (ValueError, RecursionError):
            return None
    return None


def _name(x) -> str:
    """An identifier or name as text: strings as they are, other values in canonical JSON."""
    return well_formed(x) if isinstance(x, str) else canonical(x)


def _calls(schemas: dict):
    def run(batches):
        for batch in batches:
            out = []
            for conv, turn, role, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                found = _json(text) if role == "assistant" else None
                listed = found.get("tool_calls") if found else None
                if isinstance(listed, list):
                    calls, space = [(k, x) for k, x in enumerate(listed) if isinstance(x, dict)], "id:"
                elif role == "user":
                    calls, space = [(0, {"id": str(turn), "name": "reply", "arguments": {"prompt": text or ""}})], "turn:"
                else:
                    continue
                for k, x in calls:
                    arguments, name = x.get("arguments", {}), _name(x.get("name") or "")
                    wrong = None
                    if isinstance(arguments, str):
                        try:
                            arguments = json.loads(arguments)
                        except (ValueError, RecursionError):
                            wrong = "$: not JSON"
                    wrong = wrong or (problem(arguments, schemas[name]) if name in schemas else f"{name}: unknown tool")
                    needs = x.get("depends_on")
                    call = None if x.get("id") is None else _name(x["id"])
                    needs = [f"id:{_name(d)}" for d in needs if d is not None] if isinstance(needs, list) else []
                    out.append((conv, turn, k, call, None if call is None else space + call, name, canonical(arguments), wrong is None, wrong and well_formed(wrong), needs))
            cols = list(zip(*out)) or [[]] * 10
            types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [f.split()[0] for f in CALL.split(", ")])

    return run


def _results(batches):
    for batch in batches:
        out = []
        for conv, turn, role, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
            found = _json(text)
            if role == "tool" and found and found.get("tool_call_id") is not None:
                content = found.get("content")
                out.append((conv, turn, "id:" + _name(found["tool_call_id"]), well_formed(content) if isinstance(content, str) else canonical(content)))
            elif role == "assistant" and not (found and isinstance(found.get("tool_calls"), list)) and turn is not None:
                out.append((conv, turn, f"turn:{turn - 1}", text or ""))
        cols = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.string(), pa.string()])], ["conv_id", "turn", "link", "content"])


def _placed(edges: list[tuple]) -> list[tuple]:
    """(call, place, level) of the calls of one conversation that have a place, from its dependencies (call, what it needs)."""
    needs: dict = {}
    for at, dep in edges:
        needs.setdefault(at, []).append(dep)
    users: dict = {}
    for at, dep in edges:
        users.setdefault(dep, []).append(at)
    open_ = {at: len(deps) for at, deps in needs.items()}
    done = {dep: (dep, 0) for dep in users if dep not in needs}
    todo = list(done)
    while todo:
        for at in users.get(todo.pop(), ()):
            open_[at] -= 1
            if not open_[at]:
                place, level = max(done[d] for d in needs[at])
                done[at] = (at, 0) if at > place else (place, level + 1)
                todo.append(at)
    return [(at, *x) for at, x in done.items()]


def _resolve(key, pdf: pd.DataFrame) -> pd.DataFrame:
    rows = [(key[0], *at, *place, level) for at, place, level in _placed(list(zip(zip(pdf["turn"], pdf["ord"]), zip(pdf["need_turn"], pdf["need_ord"]))))]
    out = pd.DataFrame(rows, columns=["conv_id", "turn", "ord", "place_turn", "place_ord", "level"])
    return out.astype({"conv_id": "Int64"})


def topological(calls: DataFrame, group_edges: int = GROUP_EDGES) -> DataFrame:
    """calls (conv_id, turn, ord, link, depends_on) with place, level and status: their order is (place, level, turn, ord).

    A dependency that names no call of the conversation is ignored.  One of several calls of that id: the latest counts.
    """
    at = F.struct("turn", "ord")
    same = lambda c: F.col("conv_id").eqNullSafe(F.col(c))
    ids = calls.where("link is not null").groupBy("conv_id", "link").agg(F.max(at).alias("dep"))
    edges = calls.where("size(depends_on) > 0").select("conv_id", at.alias("at"), F.explode(F.array_distinct("depends_on")).alias("need"))
    edges = edges.join(ids.withColumnsRenamed({"conv_id": "c", "link": "i"}), same("c") & (F.col("need") == F.col("i"))).select("conv_id", "at", "dep").distinct()
    edges = written(edges, "edges")
    sizes = written(edges.groupBy("conv_id").agg(F.count("*").alias("n"), F.bool_or(F.col("dep") >= F.col("at")).alias("odd")).where("odd"), "odd")
    if not rows_of(sizes):  # turns already are a topological order
        return calls.withColumns({"place": F.struct("turn", "ord"), "level": F.lit(0), "status": F.lit("ok")})
    sizes = sizes.select(F.col("conv_id").alias("c"), "n")
    edges = written(edges.join(sizes, same("c")).drop("c"), "edges")
    flat = edges.where(F.col("n") <= group_edges).select("conv_id", "at.turn", "at.ord", F.col("dep.turn").alias("need_turn"), F.col("dep.ord").alias("need_ord"))
    one = flat.groupBy("conv_id").applyInPandas(_resolve, "conv_id long, turn long, ord int, place_turn long, place_ord int, level int")
    done = one.select("conv_id", at.alias("at"), F.struct(F.col("place_turn").alias("turn"), F.col("place_ord").alias("ord")).alias("place"), "level")
    left = written(edges.where(F.col("n") > group_edges).drop("n"), "left")
    if rows_of(left):
        needing = left.select(F.col("conv_id").alias("c"), "at")
        first = left.select("conv_id", "dep").distinct().join(needing, same("c") & (F.col("dep") == F.col("at")), "left_anti")
        long = written(first.select("conv_id", F.col("dep").alias("at"), F.col("dep").alias("place"), F.lit(0).alias("level")), "placed")
        while rows_of(left):
            d = long.select(F.col("conv_id").alias("c"), F.col("at").alias("a"), "place", "level")
            met = left.join(d, same("c") & (F.col("dep") == F.col("a")), "left")
            ready = met.groupBy("conv_id", "at").agg(F.count_if(F.col("place").isNull()).alias("open"), F.max(F.struct("place", "level")).alias("m")).where("open = 0")
            ready = written(ready.select("conv_id", "at", F.greatest("at", "m.place").alias("place"), F.when(F.col("at") > F.col("m.place"), 0).otherwise(F.col("m.level") + 1).alias("level")), "ready")
            if not rows_of(ready):
                break
            long = written(long.union(ready), "placed")
            r = ready.select(F.col("conv_id").alias("c"), F.col("at").alias("a"))
            left = written(left.join(r, same("c") & (F.col("at") == F.col("a")), "left_anti"), "left")
        done = done.union(long)
    d = done.select(F.col("conv_id").alias("c"), F.col("at").alias("a"), F.col("place").alias("p"), F.col("level").alias("l"))
    # a call that has dependencies but no place is part of a cycle, or waits for one
    waits = edges.select(F.col("conv_id").alias("cc"), F.col("at").alias("ca"), F.lit(True).alias("waits")).distinct()
    out = calls.join(d, same("c") & (at == F.col("a")), "left").join(waits, same("cc") & (at == F.col("ca")), "left")
    return out.select(*calls.columns, F.coalesce("p", at).alias("place"), F.coalesce("l", F.lit(0)).alias("level"), F.when(F.col("waits") & F.col("p").isNull(), "cycle").otherwise("ok").alias("status"))


def link_calls(messages: DataFrame, schemas: dict | None = None) -> DataFrame:
    """One row per call: conv_id, place_turn, place_ord, level, turn, ord, call_id, name, valid, problem, status, n_results, json.

    Sorting by (conv_id, place_turn, place_ord, level, turn, ord) gives each conversation's order.  json is the canonical
    {"arguments", "id", "name", "result"}: result is that of the earliest later turn (null without one); n_results counts all.  A result that comes
    before its call isn't linked.  status: ok, missing (no result), cycle.  Nulls: a null text is empty, a null role or
    turn makes no call but stays out of the way of others, a null conversation is one conversation.  Repeated equal rows
    count once.  Arguments nested deeper than the JSON parser goes are not JSON; lone surrogates are spelled as escapes.  An id that several calls of a conversation share links each to the results after it.
    Unknown columns are not read; an empty table gives an empty one.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.where("turn is not null and role is not null")
    again = rows.groupBy("conv_id", "turn", "role").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    rows = rows.distinct() if again else rows
    calls = written(rows.where("role in ('assistant', 'user')").mapInArrow(_calls(schemas or SCHEMAS), CALL), "calls")
    results = rows.where("role in ('assistant', 'tool')").mapInArrow(_results, RESULT)
    ordered = topological(calls)
    # hash join by identifier: (conversation, call id) spreads one long conversation over tasks
    r = results.select(F.col("conv_id").alias("rc"), F.col("link").alias("rid"), F.col("turn").alias("rturn"), "content")
    met = ordered.select("conv_id", "link", "turn", "ord").where("link is not null").join(r, F.col("conv_id").eqNullSafe(F.col("rc")) & (F.col("link") == F.col("rid")) & (F.col("rturn") > F.col("turn")))
    met = met.groupBy("conv_id", "turn", "ord").agg(F.count("*").alias("n_results"), F.min(F.struct("rturn", "content")).alias("r"))
    met = met.select(F.col("conv_id").alias("mc"), F.col("turn").alias("mt"), F.col("ord").alias("mo"), "n_results", F.col("r.content").alias("result"))
    out = ordered.join(met, F.col("conv_id").eqNullSafe(F.col("mc")) & (F.col("turn") == F.col("mt")) & (F.col("ord") == F.col("mo")), "left")
    quote = lambda c: F.when(F.col(c).isNull(), F.lit("null")).otherwise(F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)"))
    text = F.concat(F.lit('{"arguments":'), "arguments", F.lit(',"id":'), quote("call_id"), F.lit(',"name":'), quote("name"), F.lit(',"result":'), quote("result"), F.lit("}"))
    status = F.when(F.col("status") == "cycle", "cycle").when(F.col("n_results").isNull(), "missing").otherwise("ok")
    return out.select("conv_id", F.col("place.turn").alias("place_turn"), F.col("place.ord").alias("place_ord"), "level", "turn", "ord", "call_id", "name", "valid", "problem", status.alias("status"), F.coalesce("n_results", F.lit(0)).alias("n_results"), text.alias("json"))
