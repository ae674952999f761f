import json
import random

import pytest

from textmill.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, status string, json string, uid long"


def run(spark, rows, schemas=None):
    out = chat.linked(spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA), schemas).collect()
    return sorted(out, key=lambda r: (r.conv_id is None, r.conv_id or 0, r.order_turn if r.order_turn is not None else -1, r.depth, r.turn if r.turn is not None else -1, r.part))


def call(*calls):
    return json.dumps({"content": None, "tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def result(i, content="ok"):
    return json.dumps({"tool_call_id": i, "content": content})


TOOLS = json.dumps({"content": "be kind", "tools": [{"name": "add", "parameters": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}}, "additionalProperties": False}}]})


def test_links_orders_and_validates(spark):
    rows = [
        (1, 0, "system", TOOLS),
        (1, 1, "user", "add please"),
        (1, 2, "tool", result("c2", {"b": 1, "a": 2.0})),  # before its call
        (1, 3, "assistant", call(("c1", "add", {"a": 1.0}), ("c2", "add", {"a": {"$result": "c1"}}))),
        (1, 4, "tool", result("c1")),
        (1, 5, "assistant", call(("c3", "add", '{"a": -1, "z": 2}'), ("c3", "add", {"a": 1}), ("c4", "other", {}))),
        (1, 6, "tool", result("c3")),
        (1, 7, "tool", result("c3")),
        (1, 8, "tool", result("nobody")),
        (2, 0, "tool", result("c1")),
    ]
    out = run(spark, rows)
    state = {(r.conv_id, r.turn, r.part): (r.kind, r.status, r.errors) for r in out}
    assert state[1, 2, 0] == ("result", "linked", None) and state[1, 3, 1] == ("call", "answered", []) and state[1, 3, 2] == ("call", "answered", [])
    assert state[1, 5, 1] == ("call", "answered", ["$.a: below minimum", "$.z: unknown"])
    assert state[1, 5, 2][:2] == ("call", "duplicate_call") and state[1, 5, 3] == ("call", "unanswered", None)
    assert state[1, 7, 0][1] == "duplicate_result" and state[1, 8, 0][1] == state[2, 0, 0][1] == "orphan_result"
    at = {(r.turn, r.part): k for k, r in enumerate(out) if r.conv_id == 1}
    assert at[3, 1] < at[4, 0] < at[3, 2] < at[2, 0] and len(out) == len(rows) + 5
    body = next(r.json for r in out if (r.conv_id, r.turn) == (1, 2))
    assert body == '{"content":{"a":2,"b":1},"role":"tool","tool_call_id":"c2"}'


def test_cycles_and_long_chains(spark):
    loop = [(1, 0, "assistant", call(("a", "f", {"x": {"$result": "b"}}), ("b", "f", [{"$result": "a"}]))), (1, 1, "tool", result("a")), (1, 2, "tool", result("b"))]
    assert {r.status for r in run(spark, loop) if r.kind != "message"} == {"cycle"}
    chain = [(7, 0, "assistant", call(*[(f"k{j}", "f", {"$result": f"k{j - 1}"} if j else {}) for j in range(4)]))] + [(7, 9 - j, "tool", result(f"k{j}")) for j in range(4)]
    out = [(r.kind, r.call_id) for r in run(spark, chain) if r.kind != "message"]
    assert out == [x for j in range(4) for x in (("call", f"k{j}"), ("result", f"k{j}"))]


def test_very_long_chain(spark):
    n = 150
    rows = [(1, 2 * k, "assistant", call((f"k{k}", "f", {"$result": f"k{k - 1}"} if k else {}))) for k in range(n)] + [(1, 2 * k + 1, "tool", result(f"k{k}")) for k in range(n)]
    rows += [(1, 5000, "assistant", call(("join", "f", [{"$result": "k3"}, {"$result": f"k{n - 1}"}]))), (1, 4000, "tool", result("join"))]
    out = {(r.kind, r.call_id): (r.order_turn, r.depth) for r in run(spark, rows) if r.kind != "message"}
    assert all(out["call", f"k{k}"] == (2 * k, 2 * k) and out["result", f"k{k}"] == (2 * k + 1, 2 * k + 1) for k in range(n))
    assert out["call", "join"] == (5000, 2 * n) and out["result", "join"] == (5000, 2 * n + 1)


def test_random_orders_are_topological(spark):
    r = random.Random(4)
    rows, edges = [], []
    for conv in range(6):
        ids = [f"i{k}" for k in range(6)]
        turn = list(range(12))
        r.shuffle(turn)
        for k, i in enumerate(ids):
            need = [x for x in ids[:k] if r.random() < 0.4]
            rows += [(conv, turn[2 * k], "assistant", call((i, "f", {"on": [{"$result": x} for x in need]}))), (conv, turn[2 * k + 1], "tool", result(i))]
            edges += [((conv, "result", x), (conv, "call", i)) for x in need] + [((conv, "call", i), (conv, "result", i))]
    at = {(x.conv_id, x.kind, x.call_id): k for k, x in enumerate(run(spark, rows)) if x.kind != "message"}
    assert all(at[a] < at[b] for a, b in edges) and len(at) == 72


def test_defined_cases(spark):
    rows = [(None, 1, "user", "x"), (1, None, "tool", result("a")), (1, 2, None, None), (1, 3, "assistant", "{broken"), (1, 3, "assistant", "{broken"), (1, 4, "assistant", '{"tool_calls": [1, {"arguments": "text"}], "content": "é\\n"}'), (1, 5, "tool", '{"tool_call_id": 7}'), (1, 6, "user", call(("u", "f", {}))), (1, 7, "assistant", '{"tool_calls": NaN}'), (1, 8, "user", "long " * 50_000)]
    out = run(spark, rows)
    assert len(out) == len(rows) + 1
    assert sorted(r.status for r in out if r.status != "message") == ["orphan_result", "orphan_result", "unanswered"]
    assert run(spark, []) == []
    assert next(r.json for r in out if r.turn == 2) == '{"content":"","role":""}'


def test_global_schemas(spark):
    rows = [(1, 0, "assistant", call(("a", "f", {"x": "s"}), ("b", "g", {})))]
    out = {r.call_id: r for r in run(spark, rows, {"f": {"properties": {"x": {"type": "number"}}}}) if r.kind == "call"}
    assert out["a"].errors == ['$.x: not of type "number"'] and out["a"].has_schema and out["b"].errors is None and out["b"].has_schema is False


@pytest.mark.parametrize(("value", "schema", "errors"), [(True, {"type": "integer"}, 1), (1.0, {"type": "integer"}, 0), (None, {"type": ["null", "string"]}, 0), ("ab", {"minLength": 3}, 1), ([1, "x"], {"items": {"type": "number"}}, 1), (3, {"enum": [1, 2]}, 1), (3, {"const": 3, "maximum": 2}, 1), ({"k": 1}, {"additionalProperties": {"type": "string"}}, 1), ({"$result": "x"}, {"type": "string"}, 0), (1, True, 0)])
def test_validate(value, schema, errors):
    assert len(chat.validate(value, schema)) == errors


def test_canonical():
    assert chat.canonical({"b": [1.0, 1.5, True, None], "a": "é\n"}) == '{"a":"é\\n","b":[1,1.5,true,null]}'
    assert chat.canonical(json.loads(chat.canonical({"z": {"y": 1}}))) == '{"z":{"y":1}}'
    with pytest.raises(ValueError):
        chat.canonical(float("nan"))


def test_keywords_of_schemas():
    v = chat.validate
    text, whole = {"type": "string"}, {"type": "integer"}
    good_bad = [
        ({"anyOf": [text, {"type": "null"}]}, None, 1, "$: fits nothing of anyOf"),
        ({"oneOf": [whole, {"type": "number", "minimum": 5}]}, 3, 7, "$: fits more than one of oneOf"),
        ({"allOf": [whole, {"minimum": 2}]}, 2, 1, "$: below minimum"),
        ({"not": text}, 1, "a", "$: fits what it must not"),
        ({"if": whole, "then": {"minimum": 2}, "else": text}, "a", 1, "$: below minimum"),
        ({"$ref": "#/$defs/n~1m", "$defs": {"n/m": whole}}, 1, "a", '$: not of type "integer"'),
        ({"type": "object", "properties": {"next": {"$ref": "#"}}, "required": ["x"]}, {"x": 1, "next": {"x": 2}}, {"x": 1, "next": {}}, "$.next.x: missing"),
        ({"pattern": "^[a-c]+$"}, "abc", "abc\n", "$: not of the pattern"),
        ({"exclusiveMinimum": 1}, 2, 1, "$: below minimum"),
        ({"exclusiveMaximum": 1}, 0, 1, "$: above maximum"),
        ({"multipleOf": 0.1}, 0.3, 0.35, "$: not a multiple"),
        ({"uniqueItems": True}, [1, True, "1"], [{"a": 1}, {"a": 1.0}], "$: not unique"),
        ({"patternProperties": {"^n": whole}, "additionalProperties": False}, {"n1": 1}, {"m": 1}, "$.m: unknown"),
        ({"minProperties": 1}, {"a": 1}, {}, "$: too few properties"),
        ({"maxProperties": 1}, {"a": 1}, {"a": 1, "b": 2}, "$: too many properties"),
        ({"propertyNames": {"maxLength": 1}}, {"a": 1}, {"ab": 1}, "$.ab (name): too long"),
        ({"prefixItems": [text], "items": whole}, ["a", 1], ["a", "b"], '$[1]: not of type "integer"'),
        ({"contains": whole}, ["a", 1], ["a"], "$: contains too few or too many"),
        ({"properties": {"a": False}}, {}, {"a": 1}, "$.a: not allowed"),
    ]
    for schema, good, bad, error in good_bad:
        assert chat.validate(good, schema) == [] and chat.validate(bad, schema) == [error], schema
    assert v("a", {"format": "date"}) == ["$: format not checked"] and v("a", {"pattern": "("}) == ["$: pattern not checked"]
    assert v(1, {"$ref": "http://x/y"}) == v(1, {"$ref": "#/none"}) == v(1, {"$ref": "#"}) == ["$: $ref not checked"]
    assert v("a", {"anyOf": [{"format": "date"}, text]}) == [] and v("a", {"anyOf": [{"format": "date"}, whole]}) == ["$: format not checked"]
    assert v({"$result": "c"}, {"not": {}}) == [] and v({"a": {"$result": "c"}}, {"oneOf": [{"properties": {"a": whole}}, {"properties": {"a": text}}]}) == []
    assert v(1, {"minimum": "2"}) == ["$: malformed schema, not checked"]


@pytest.mark.parametrize(("value", "schema"), [("ab", {"minLength": "3"}), (1, {"minimum": "x"}), ([], {"minItems": None}), (1, {"enum": 5}), ({}, {"required": 3}), ({"a": 1}, {"properties": [["a"]], "additionalProperties": {"minimum": "x"}}), (1, {"type": [{}]}), ([1], {"prefixItems": {"a": 1}}), (1, {"multipleOf": "0"}), ({"a": 1}, {"patternProperties": [1]}), ("a", {"pattern": ["x"]}), (1, {"allOf": 3}), ({"a": 1}, {"dependentRequired": 7})])
def test_malformed_schemas(value, schema):
    assert chat.validate(value, schema) == ["$: malformed schema, not checked"]
    assert chat.validate({"x": value}, {"properties": {"x": schema}}) == ["$: malformed schema, not checked"]


def test_patterns_that_may_never_end_are_not_checked():
    import time

    began = time.time()
    for p in ("^(a+)+$", "(a|a)*$", "([a-z]+)*x", "^(?:(a*)b?)+$", "((x{1,9}){2,})+y"):
        assert chat.validate("a" * 60 + "!", {"pattern": p}) == ["$: pattern not checked"], p
    assert time.time() - began < 2
    for p, good, bad in (("^(foo|bar)+$", "foobar", "fob"), (r"^(\d{3}-)+\d$", "123-456-7", "12-3"), ("^((ab)?c)*$", "abcc", "b")):
        assert chat.validate(good, {"pattern": p}) == [] and chat.validate(bad, {"pattern": p}) == ["$: not of the pattern"]


def test_malformed_messages(spark):
    deep = "[" * 5000 + "]" * 5000
    schemas = [{"type": "object", "minProperties": "3"}, {"required": 3}, {"properties": [1]}, {"type": [{}]}, 7, None, {"properties": {"a": {"maximum": 1e308}}}]
    rows = [(k, 0, "system", json.dumps({"tools": [{"name": "f", "parameters": s}]})) for k, s in enumerate(schemas)]
    rows += [(k, 1, "assistant", '{"tool_calls":[{"id":"\\ud83d","name":"f","arguments":{"a":%s,"s":"\\udc00x\\ud83d\\ude00"}}]}' % ("9" * 400)) for k in range(len(schemas))]
    rows += [(k, 2, "tool", '{"tool_call_id":"\\ud83d","content":"\\udfff"}') for k in range(len(schemas))]
    rows += [(99, 0, "assistant", '{"tool_calls":%s}' % deep), (99, 1, "assistant", '{"tool_calls":[{"id":"a","arguments":%s}]}' % json.dumps(deep)), (99, 2, "assistant", '{"content":"\\ud83d","x":1e999}'), (99, 3, "assistant", '{"content":%s}' % ("9" * 5000))]
    out = run(spark, rows)
    calls = [r for r in out if r.kind == "call" and r.conv_id < 99]
    assert len(calls) == len(schemas) and all(r.status == "answered" and r.call_id == "\ufffd" and "\ufffdx\U0001f600" in r.json for r in calls)
    assert [r.errors for r in sorted(calls, key=lambda r: r.conv_id)][:2] == [["$: malformed schema, not checked"]] * 2
    assert chat.validate(10**400, {"type": "integer"}) == [] and chat.validate(10**400, {"maximum": 5.0}) == ["$: above maximum"]


def test_derived_calls_against_sql(spark, sf):
    import duckdb

    from textmill.llm import registry

    table = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    gaps = table.where("conv_id % 3 = 0 and turn <> 3 or conv_id % 3 = 1 and turn <> 0 or conv_id % 3 = 2 and turn <> 4")
    for t in (table, gaps):
        t.write.mode("overwrite").parquet(spark.conf.get("spark.checkpoint.dir") + "/derived/conversations.parquet")
        got = [tuple(r) for r in registry.op8_tool_call_linking(spark, spark.conf.get("spark.checkpoint.dir") + "/derived").collect()]
        db = duckdb.connect()
        conversations = t.toPandas()  # noqa: F841
        want = db.execute(chat.ORACLE).fetchall()
        key = lambda x: tuple((v is not None, v) for v in x)
        assert sorted(got, key=key) == sorted(want, key=key) and {"answered", "unanswered", "linked"} <= {x[7] for x in got}
