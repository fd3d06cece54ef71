"""Tool-call linking against a plain implementation."""

import json
import random

import pytest

pytest.importorskip("folioflow.llm.chat")
from folioflow.llm import chat as C  # noqa: E402

SCHEMAS = {"f": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "array", "items": {"type": "string"}}}}, **C.SCHEMAS}


def order(calls):
    """{(turn, ord): (place, level)} of one conversation's calls (turn, ord, id, needs); None for cycles and what hangs on them."""
    by = {}
    for t, o, i, _ in sorted(calls, key=lambda c: c[:2]):
        by[i] = (t, o)
    needs = {(t, o): {by[n] for n in d if n in by} for t, o, _, d in calls}
    out = {}
    while True:
        new = {v: max((out[u] for u in d), default=None) for v, d in needs.items() if v not in out and all(u in out for u in d)}
        if not new:
            return out
        for v, m in new.items():
            out[v] = (v, 0) if m is None or v > m[0] else (m[0], m[1] + 1)


def test_order_links_and_validation(spark):
    rnd = random.Random(4)
    rows, calls = [], []
    for conv in range(30):
        n = rnd.randint(2, 8)
        for t in range(n):
            listed = []
            for o in range(rnd.randint(1, 2)):
                needs = [f"c{rnd.randint(0, n)}.0" for _ in range(rnd.randint(0, 2))] if conv % 3 else []
                args = rnd.choice([{"a": 1}, {"a": -1}, {"b": ["x"]}, {"a": 2.0}, "{\"a\": 3}", "{", {"a": 1, "b": [1]}])
                listed.append({"id": f"c{t}.{o}", "name": rnd.choice(["f", "g"]), "arguments": args, "depends_on": needs})
                calls.append((conv, 2 * t, o, f"c{t}.{o}", needs))
            rows.append((conv, 2 * t, "assistant", json.dumps({"tool_calls": listed})))
            rows.append((conv, 2 * t + 1, "tool", json.dumps({"tool_call_id": f"c{t}.0", "content": {"é": t, "b": 1.0}})))
    df = spark.createDataFrame([(*r, 1) for r in rows + rows[:3]], "conv_id long, turn long, role string, text string, level int")
    got = {(r.conv_id, r.turn, r.ord): r for r in C.link_calls(df, SCHEMAS).collect()}
    assert len(got) == len(calls)
    seen = set()
    for conv in range(30):
        want = order([c[1:] for c in calls if c[0] == conv])
        for _, t, o, i, needs in [c for c in calls if c[0] == conv]:
            r = got[conv, t, o]
            if (t, o) in want:
                assert ((r.place_turn, r.place_ord), r.level) == want[t, o]
                assert r.status == ("ok" if o == 0 else "missing")
                for u in [c for c in calls if c[0] == conv and c[3] in needs]:
                    d = got[u[:3]]
                    assert (d.place_turn, d.place_ord, d.level) < (r.place_turn, r.place_ord, r.level) or (d.place_turn, d.place_ord, d.level, d.turn) < (r.place_turn, r.place_ord, r.level, r.turn)
            else:
                assert r.status == "cycle"
            seen.add(r.status)
            x = json.loads(r.json)
            assert x["id"] == i and x["result"] == (None if o else json.dumps({"b": 1, "é": t // 2}, separators=(",", ":"), ensure_ascii=False))
            if r.valid:
                assert r.name == "f" and x["arguments"]["a"] >= 0
    assert seen == {"ok", "missing", "cycle"}


def test_plain_dialogue_and_edges(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", 'hi "x"\n'), (1, 2, "assistant", "yo\\"), (1, 3, "user", ""), (2, 0, "user", None), (None, 0, "user", "a"), (None, 1, "assistant", "b"), (3, None, "user", "x"), (3, 0, None, "x"), (4, 0, "user", "long " * 50_000), (4, 1, "assistant", "{not json")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in C.link_calls(df).collect()}
    assert set(got) == {(1, 1), (1, 3), (2, 0), (None, 0), (4, 0)}
    assert json.loads(got[1, 1].json) == {"arguments": {"prompt": 'hi "x"\n'}, "id": "1", "name": "reply", "result": "yo\\"}
    assert got[1, 1].valid and got[1, 1].status == "ok"
    assert not got[1, 3].valid and got[1, 3].status == "missing" and got[1, 3].problem == "$.prompt: length out of bounds"
    assert got[None, 0].status == "ok" and got[4, 0].status == "ok"
    assert C.link_calls(df.limit(0)).collect() == []


def test_canonical_json():
    assert C.canonical({"b": [1.0, 0.5, float("nan")], "a": {"z": None, "é": True}}) == '{"a":{"z":null,"é":true},"b":[1,0.5,null]}'
    deep = {"a": json.loads("[" * 900 + "1" + "]" * 900)}
    for _ in range(40):
        deep = {"a": [deep] * 1}
    for _ in range(3000):
        deep = [deep]
    text = C.canonical(deep)
    assert text.count("[") == text.count("]") and text.startswith("[" * 3000)


def test_deep_arguments_lone_surrogates_and_ids(spark):
    call = lambda i, args: json.dumps({"tool_calls": [{"id": i, "name": "f", "arguments": args}]})
    rows = [
        (1, 0, "assistant", call("2", '{"a":1,"b":' + "[" * 1200 + "]" * 1200 + "}")),
        (1, 1, "assistant", '{"tool_calls":[{"id":"x\\ud800","name":"f\\udfff","arguments":{"a":"\\ud83d"}}]}'),
        (1, 3, "assistant", "a plain turn is no result of the call that another message names 2"),
        (1, 4, "tool", '{"tool_call_id":"x\\ud800","content":"\\udc00!"}'),
        (1, 5, "assistant", call("d", "[" * 200_000)),
        (2, 0, "user", "q"),
        (2, 1, "assistant", "[" * 5000),
    ]
    got = {(r.conv_id, r.turn): r for r in C.link_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), SCHEMAS).collect()}
    assert got[1, 0].status == "missing" and not got[1, 0].valid and "[" * 1200 in got[1, 0].json
    assert got[1, 1].status == "ok" and got[1, 1].call_id == "x\\ud800" and got[1, 1].name == "f\\udfff" and "\\udc00!" in got[1, 1].json
    assert got[1, 5].problem == "$: not JSON"
    assert got[2, 0].status == "ok"


def test_long_conversations_get_the_same_order(spark):
    rnd = random.Random(9)
    rows = []
    for conv in (1, None):
        for t in range(25):
            needs = [f"id:c{rnd.randint(0, 25)}" for _ in range(rnd.randint(0, 2))]
            rows.append((conv, t, 0, f"id:c{t}", needs))
    calls = spark.createDataFrame(rows, "conv_id long, turn long, ord int, link string, depends_on array<string>")
    a, b = (sorted(map(str, C.topological(calls, n).collect())) for n in (0, 100))
    assert a == b and len(a) == 50 and "cycle" in "".join(a)
