import json
import random
from collections import Counter, defaultdict

import duckdb
import pytest

from tesserae.llm import chat_format

SCHEMAS = {"weather": {"city": ("string", True), "days": ("integer", False)}, "add": {"a": ("number", True), "b": ("number", True), "tags": ("array", False), "more": ("object", False)}}


def call(id_, name, arguments, *needs):
    return {"id": id_, "name": name, "arguments": arguments, **({"depends_on": list(needs)} if needs else {})}


def ask(*calls, content=None):
    return json.dumps({"content": content, "tool_calls": list(calls)})


def answer(id_, content):
    return json.dumps({"tool_call_id": id_, "content": content})


@pytest.fixture(scope="module")
def chats(spark):
    rows = [
        (1, 0, "user", "Weather in Oslo?"),
        (1, 1, "tool", answer("c1", "rain")),  # before the call it answers
        (1, 2, "assistant", ask(call("c1", "weather", {"days": 2, "city": "Oslo"}))),
        (1, 3, "assistant", 'It rains.\n"quoted" é'),
        (2, 0, "assistant", ask(call("x", "add", {"b": 1.5, "a": 2, "tags": [1], "more": {"z": 1, "y": {"d": 1, "c": 2}}}, "y"))),
        (2, 1, "assistant", ask(call("y", "add", {"a": 1, "b": 2}))),
        (2, 2, "tool", answer("x", "3.5")),
        (2, 3, "tool", answer("nope", "?")),
        (3, 0, "assistant", ask(call("p", "weather", {"city": 5, "extra": 1}), call("q", "weather", {"days": 1}), call("r", "unknown", {}), call("p", "add", {"a": 1, "b": 1}))),
        (4, 0, "assistant", ask(call("m", "add", {"a": 1, "b": 1}, "n"))),
        (4, 1, "assistant", ask(call("n", "add", {"a": 1, "b": 1}, "m"))),
        (None, None, None, None), (5, 0, "user", "{not json"), (5, 1, "user", ""), (5, 1, "user", ""), (6, 0, "tool", "no json"), (6, 1, "user", '{"tool_calls": 5}'),
    ]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, row_no string, level int")


def test_links_order_and_errors(chats):
    out = chat_format.format_chats(chats, SCHEMAS)
    rows = out.collect()
    assert len(rows) == chats.count()
    by = {(r.conv_id, r.turn): r for r in rows}
    order = lambda c: [r.turn for r in sorted((r for r in rows if r.conv_id == c), key=lambda r: (r.anchor, r.level, r.turn))]
    assert order(1) == [0, 2, 1, 3] and by[1, 1].linked is True and by[1, 2].n_errors == 0
    assert order(2) == [1, 0, 2, 3] and by[2, 3].linked is False and by[2, 3].n_errors == 1
    errors = json.loads(by[3, 0].json)["errors"]
    assert errors == ["city is no string", "missing city", "repeated id p", "unknown extra", "unknown tool"] or set(errors) == {"city is no string", "missing city", "unknown extra", "unknown tool"}
    assert "cycle" in json.loads(by[4, 0].json)["errors"] and "cycle" in json.loads(by[4, 1].json)["errors"]
    assert by[2, 0].n_errors == 0


def test_canonical_json(chats):
    by = {(r.conv_id, r.turn): r.json for r in chat_format.format_chats(chats).collect()}
    for line in by.values():
        found = json.loads(line)
        assert json.dumps(found, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == line
    assert json.loads(by[2, 0])["tool_calls"][0]["arguments"] == '{"a":2,"b":1.5,"more":{"y":{"c":2,"d":1},"z":1},"tags":[1]}'
    assert by[5, 0] == '{"content":"{not json","conv_id":5,"role":"user","turn":0}' and by[None, None] == "{}"
    assert json.loads(by[6, 0])["content"] == "no json"


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    found = con.execute(chat_format.SQL)
    columns = [c[0] for c in found.description]
    got = chat_format.query(spark, sf_dir).select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, found.fetchall()))
    assert {True, False, None} == {r.linked for r in got} and {0, 1} == {r.level for r in got} and any('"cycle"' in r.json for r in got)
    assert any(w in r.json for r in got for w in ("missing query", "limit is no integer"))


def slow_links(rows):
    """(conv, turn, role, body) rows to (anchor, level, number of errors, linked) by loops; places of cycles stay as given."""
    out = []
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv]
        first, repeats = {}, Counter()
        for k, (_, turn, _, body) in sorted(enumerate(own), key=lambda x: x[1][1]):
            for c in body.get("tool_calls", []):
                if c["id"] is not None and first.setdefault(c["id"], k) != k:
                    repeats[k] += 1
        refs, errors, linked = defaultdict(set), Counter(repeats), {}
        for k, (_, _, role, body) in enumerate(own):
            wanted = [i for c in body.get("tool_calls", []) for i in c["depends_on"]]
            errors[k] += sum(c["id"] is None for c in body.get("tool_calls", []))
            if role == "tool":
                wanted.append(body.get("tool_call_id"))
                linked[k] = wanted[-1] in first
            for i in wanted:
                if i not in first:
                    errors[k] += 1
                elif first[i] != k:
                    refs[k].add(first[i])
        place = {}
        while True:
            fresh = {}
            for k, (_, turn, _, _) in enumerate(own):
                if k not in place and all(u in place for u in refs[k]):
                    top = max([place[u] for u in refs[k]], default=(turn - 1, 0))
                    fresh[k] = (turn, 0) if turn > top[0] else (top[0], top[1] + 1)
            if not fresh:
                break
            place |= fresh
        for k, (_, turn, role, _) in enumerate(own):
            out.append((conv, turn, role, *place.get(k, (turn, 0)), errors[k] + (k not in place), linked.get(k)))
    return Counter(out)


def test_random_links_equal_loops(spark):
    rnd, rows = random.Random(3), []
    for conv in range(60):
        turns = rnd.sample(range(40), 10)
        ids = [f"c{k}" for k in range(6)]
        for turn in turns:
            if rnd.random() < 0.6:
                calls = [{"id": rnd.choice([*ids, *ids, None]), "name": "add", "arguments": {"a": 1, "b": 2}, "depends_on": rnd.sample([*ids, "gone"], rnd.choice([0, 0, 1, 2]))} for _ in range(rnd.choice([1, 1, 2]))]
                ids_here = [c["id"] for c in calls]
                if len(set(ids_here)) == len(ids_here):
                    rows.append((conv, turn, "assistant", {"content": "x", "tool_calls": calls}))
            else:
                rows.append((conv, turn, "tool", {"content": "r", "tool_call_id": rnd.choice([*ids, "gone"])}))
    df = spark.createDataFrame([(c, t, r, json.dumps(b)) for c, t, r, b in rows], "conv_id long, turn long, role string, text string")
    got = Counter((r.conv_id, r.turn, r.role, r.anchor, r.level, r.n_errors, r.linked) for r in chat_format.format_chats(df, SCHEMAS).collect())
    assert got == slow_links(rows)


def test_no_messages(chats):
    assert chat_format.format_chats(chats.limit(0), SCHEMAS).count() == 0


def test_conversations_own_schemas(spark):
    """What the registered query reports: it is given no schemas."""
    weather = {"type": "object", "properties": {"city": {"type": "string", "enum": ["Oslo", "Bergen"]}, "days": {"type": ["integer", "null"]}}, "required": ["city"], "additionalProperties": False}
    tools = json.dumps({"tools": [{"type": "function", "function": {"name": "weather", "parameters": weather}}, {"name": "now", "parameters": {}}, {"name": "weather", "parameters": {}}]})
    rows = [
        (1, 0, "system", tools),
        (1, 1, "assistant", ask(call("a", "weather", {"city": "Oslo", "days": None}), call("b", "now", {"any": 1}), call("c", "now", None))),
        (1, 2, "assistant", ask(call("d", "weather", {"days": "two", "more": 1}))),
        (1, 3, "assistant", ask(call("e", "weather", {"city": "Rome"}), call("f", "nothing", {}))),
        (1, 4, "assistant", ask(call("g", "weather", {"city": 5}))),
        (2, 0, "assistant", ask(call("a", "weather", '{"city": '), call("b", "weather", [1]), call("c", "weather", {"city": 5}), call("d", "weather", '{"city": "Oslo"}'))),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): json.loads(r.json).get("errors", []) for r in chat_format.format_chats(df).collect()}
    assert got == {
        (1, 0): [], (1, 1): [], (1, 2): ["days is no integer or null", "missing city", "unknown more"], (1, 3): ["city is none of its values", "unknown tool"],
        (1, 4): ["city is no string"], (2, 0): ["arguments are no object", "arguments are no object"],
    }


def test_nothing_of_a_text_is_lost(spark):
    more = {**call("c1", "weather", {"city": "Oslo"}), "type": "function", "cache": {"b": 1, "a": 2}}
    rows = [
        (0, "assistant", json.dumps({"content": "so", "tool_calls": [more, call("c2", "add", {})], "reasoning": "why"})),
        (1, "assistant", json.dumps({"tool_calls": [call("c3", "add", {})], "reasoning": "why"})),
        (2, "tool", '{"temperature": 21}'),
        (3, "tool", '{"tool_call_id": "c1", "result": {"z": [1, 2.5], "a": null}}'),
        (4, "tool", '{"tool_call_id": "c2", "content": "x", "status": "ok"}'),
        (5, "tool", '{"tool_call_id": "c3", "content": null}'),
        (6, "tool", '{"tool_call_id": "c3", "tool_calls": 5}'),
        (7, "tool", '{"tool_call_id": "c3", "content": {"b": 1}}'),
        (8, "tool", "{}"),
    ]
    df = spark.createDataFrame([(1, *r) for r in rows], "conv_id long, turn long, role string, text string")
    lines = {r.turn: r.json for r in chat_format.format_chats(df).collect()}
    got = {k: json.loads(v) for k, v in lines.items()}
    assert all(json.dumps(got[k], sort_keys=True, separators=(",", ":"), ensure_ascii=False) == v for k, v in lines.items())
    assert got[0]["content"] == "so" and got[0]["extra"] == '{"reasoning":"why"}'
    assert got[0]["tool_calls"][0]["extra"] == '{"cache":{"a":2,"b":1},"type":"function"}' and "extra" not in got[0]["tool_calls"][1]
    assert got[1]["content"] == '{"reasoning":"why"}' and "extra" not in got[1]
    assert got[2]["content"] == '{"temperature":21}'
    assert got[3]["content"] == '{"result":{"a":null,"z":[1,2.5]}}' and got[3]["tool_call_id"] == "c1"
    assert got[4]["content"] == "x" and got[4]["extra"] == '{"status":"ok"}'
    assert "content" not in got[5] and "extra" not in got[5] and got[6]["content"] == '{"tool_calls":5}'
    assert json.loads(got[7]["content"]) == {"b": 1} and "content" not in got[8]


def test_long_chain_is_no_cycle(spark, monkeypatch):
    """Each message depends on a call of the next; a bound that is reached raises, and is never called a cycle."""
    monkeypatch.setattr(chat_format, "PARTS", 3)
    n = 9
    rows = [(1, k, "assistant", ask(call(f"c{k}", "add", {}, *([f"c{k + 1}"] if k < n - 1 else [])))) for k in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_format.format_chats(df).collect()
    assert [r.turn for r in sorted(got, key=lambda r: (r.anchor, r.level, r.turn))] == list(range(n))[::-1] and not any(r.n_errors for r in got)
    with pytest.raises(RuntimeError):
        chat_format.format_chats(df, max_rounds=4).collect()
    assert len(chat_format.format_chats(df, max_rounds=n).collect()) == n
