"""Chat formatting with tool-call linking.

A message is plain text, or (by role) a JSON object: an assistant's ``{"content": ..., "tool_calls": [{"id", "name",
"arguments"}]}``, a tool's ``{"tool_call_id", "content"}``, a system's ``{"content": ..., "tools": [{"name",
"parameters": schema}]}``. (The nested ``"function": {"name", "arguments"}`` form is read too.) Each message and each call is an
event row with its canonical JSON: keys sorted, no blanks, UTF-8, shortest numbers.

Calls and results are hash-joined by (conversation, call id); calls are joined to the conversation's tool schemas and
their arguments validated. Events are ordered topologically: a result follows its call, and a call follows the results that its
arguments name as ``{"$result": call id}``. The order is a sort key (order_turn, depth, turn, part), computed layer by layer
over the linked events only, so no conversation is ever gathered in one place, however long it is.

status: message | answered | unanswered | linked | orphan_result | duplicate_call | duplicate_result | cycle.
Of calls (results) with one id the first by (turn, part) counts. A call without a schema is valid (has_schema false).
Defined cases: a null text is an empty message; a null role is an empty role; a null conversation or turn is kept and
links nothing; text that is no such JSON object is plain; a null or missing id links nothing (unanswered, orphan);
repeated rows make repeated events; empty table: no rows; other columns are ignored. Events on a cycle keep their own turn.
Escapes of lone surrogates in a message become U+FFFD. A schema that is malformed where a value meets it (a text for a bound, a number
for `required`, ...) gives the one error `malformed schema, not checked`; one nested too deeply `too deep, not checked`.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize

EVENT = "conv_id long, turn long, part int, role string, kind string, call_id string, name string, arguments string, needs array<string>, tools array<struct<name:string,schema:string>>, json string"
TYPES = {"object": dict, "array": list, "string": str, "boolean": bool}


def canonical(value) -> str:
    """Sorted keys, no blanks, whole floats as integers; raises ValueError on NaN and infinities."""

    def plain(v):
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        if isinstance(v, float):
            if not math.isfinite(v):
                raise ValueError("no JSON number")
            return int(v) if v.is_integer() and abs(v) < 2**53 else v
        return v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _whole(value):
    """A value without lone surrogates, which no UTF-8 text can hold."""
    if isinstance(value, str):
        return re.sub("[\ud800-\udfff]", "\ufffd", value)
    if isinstance(value, list):
        return [_whole(v) for v in value]
    return {_whole(k): _whole(v) for k, v in value.items()} if isinstance(value, dict) else value


def _object(text: str):
    if not text.lstrip().startswith("{"):
        return None
    try:
        got = json.loads(text)
        if "\\u" in text:
            got = _whole(got)
        canonical(got)
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def _references(value) -> list[str]:
    """Call ids that arguments name."""
    out, stack = set(), [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            if isinstance(v.get("$result"), str):
                out.add(v["$result"])
            stack.extend(v.values())
        elif isinstance(v, list):
            stack.extend(v)
    return sorted(out)


#: Keywords that say nothing about which values are valid, or only hold or steer other keywords.
_SILENT = frozenset("$schema $id id $comment $defs definitions title description default examples example deprecated readOnly writeOnly then else contentEncoding contentMediaType contentSchema minContains maxContains".split())
_CHECKED = frozenset(
    "$ref type enum const properties required additionalProperties patternProperties propertyNames minProperties maxProperties dependentRequired dependentSchemas items prefixItems additionalItems contains "
    "minItems maxItems uniqueItems minimum maximum exclusiveMinimum exclusiveMaximum multipleOf minLength maxLength pattern allOf anyOf oneOf not if".split()
)


def _backtracks(pattern, inside: bool = False) -> bool:
    """Whether a parsed pattern repeats, without bound, something that itself repeats or starts in the same way twice."""
    for op, args in pattern:
        name = str(op)
        if name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, body = args
            if inside and high > max(1, low) or _backtracks(body, inside or high > 64):
                return True
        elif name == "BRANCH":
            heads = [str(branch[0]) if len(branch) else "" for branch in args[1]]
            if inside and (len(set(heads)) < len(heads) or not all(h.startswith("(LITERAL") for h in heads)) or any(_backtracks(b, inside) for b in args[1]):
                return True
        elif name in ("SUBPATTERN", "ASSERT", "ASSERT_NOT", "ATOMIC_GROUP") and _backtracks(args[-1] if isinstance(args, tuple) else args, inside):
            return True
    return False


@lru_cache(1024)
def _regex(pattern: str):
    """A schema's (ECMAScript) pattern; None if Python has no such pattern, or one that may take exponential time."""
    try:
        plain = re.sub(r"\\[\s\S]|\[(?:\\[\s\S]|[^\]\\])*\]|\$", lambda m: r"\Z" if m[0] == "$" else m[0].replace(r"\d", "0-9") if m[0][0] == "[" else {r"\d": "[0-9]", r"\D": "[^0-9]", r"\w": "[A-Za-z0-9_]", r"\W": "[^A-Za-z0-9_]"}.get(m[0], m[0]), pattern)
        return None if _backtracks(re._parser.parse(plain)) else re.compile(plain)
    except (re.error, OverflowError, RecursionError):
        return None


def _pointed(root, ref):
    """(found, the subschema that a local reference names)"""
    if not isinstance(ref, str) or ref != "#" and not ref.startswith("#/"):
        return False, None
    at = root
    for part in unquote(ref[2:]).split("/") if ref != "#" else []:
        part = part.replace("~1", "/").replace("~0", "~")
        if isinstance(at, dict) and part in at:
            at = at[part]
        elif isinstance(at, list) and part.isdecimal() and int(part) < len(at):
            at = at[int(part)]
        else:
            return False, None
    return True, at


def validate(value, schema, at: str = "$") -> list[str]:
    """Errors of a value under a JSON Schema. References are local ones; a reference to a result fits any schema. A keyword
    that is not checked (format, unevaluated..., other references, patterns unknown to Python) is reported as `not checked`."""
    try:
        return [*dict.fromkeys(text for _, text in _check(value, schema, at, schema, ()))]
    except RecursionError:
        return [f"{at}: too deep, not checked"]
    except (ArithmeticError, AttributeError, LookupError, TypeError, ValueError):  # such as a text for a bound
        return [f"{at}: malformed schema, not checked"]


def _check(value, schema, at: str, root, active: tuple) -> list[tuple[bool, str]]:
    """(is an error, text) of each error, and of each keyword that is not checked. ``active``: references being followed for this value."""
    if isinstance(value, dict) and isinstance(value.get("$result"), str):
        return []
    if schema is False:
        return [(True, f"{at}: not allowed")]
    if not isinstance(schema, dict):
        return []
    out = []
    bad = lambda text, where=at: out.append((True, f"{where}: {text}"))
    skip = lambda k: out.append((False, f"{at}: {k} not checked"))
    same = lambda s: _check(value, s, at, root, active)
    child = lambda v, s, where: out.extend(_check(v, s, where, root, ()))
    failed = lambda found: any(e for e, _ in found)
    kinds = schema.get("type")
    number = isinstance(value, int | float) and not isinstance(value, bool)
    if kinds is not None:
        fits = lambda k: value is None if k == "null" else number if k == "number" else number and (isinstance(value, int) or value.is_integer()) if k == "integer" else isinstance(value, TYPES.get(k, object))
        if not any(fits(k) for k in (kinds if isinstance(kinds, list) else [kinds])):
            return [(True, f"{at}: not of type {canonical(kinds)}")]
    for k in sorted(schema):
        if k not in _CHECKED and k not in _SILENT and not k.startswith("x-"):
            skip(k)
    if "$ref" in schema:
        ref = schema["$ref"]
        found, target = _pointed(root, ref)
        if not found or ref in active:
            skip("$ref")
        else:
            out += _check(value, target, at, root, (*active, ref))
    if "enum" in schema and value not in schema["enum"]:
        bad("not in enum")
    if "const" in schema and value != schema["const"]:
        bad("not the constant")
    for s in schema.get("allOf") or []:
        out += same(s)
    for key in ("anyOf", "oneOf"):
        if isinstance(schema.get(key), list):
            open_ = [f for f in map(same, schema[key]) if not failed(f)]
            sure = sum(not f for f in open_)
            if not open_:
                bad(f"fits nothing of {key}")
            elif key == "oneOf" and sure > 1 and not _references(value):
                bad("fits more than one of oneOf")
            elif not sure or key == "oneOf" and len(open_) > sure:
                out += [x for f in open_ for x in f]
    if "not" in schema and not _references(value):
        found = same(schema["not"])
        if not found:
            bad("fits what it must not")
        elif not failed(found):
            out += found
    if "if" in schema:
        found = same(schema["if"])
        if found and not failed(found):
            out += found
        elif (branch := "else" if found else "then") in schema:
            out += same(schema[branch])
    if isinstance(value, dict):
        known, patterns, rest = schema.get("properties") or {}, [], schema.get("additionalProperties")
        for p, s in (schema.get("patternProperties") or {}).items():
            if _regex(p) is None:
                skip("patternProperties")
                rest = None
            else:
                patterns.append((_regex(p), s))
        out += [(True, f"{at}.{k}: missing") for k in schema.get("required") or [] if k not in value]
        for k in sorted(value):
            own = [s for p, s in patterns if p.search(k)] + ([known[k]] if k in known else [])
            for s in own:
                child(value[k], s, f"{at}.{k}")
            if not own and rest is False:
                bad("unknown", f"{at}.{k}")
            elif not own and isinstance(rest, dict):
                child(value[k], rest, f"{at}.{k}")
            if "propertyNames" in schema:
                child(k, schema["propertyNames"], f"{at}.{k} (name)")
            out += [(True, f"{at}.{x}: missing beside {k}") for x in (schema.get("dependentRequired") or {}).get(k, []) if x not in value]
            if k in (schema.get("dependentSchemas") or {}):
                out += same(schema["dependentSchemas"][k])
        if len(value) < schema.get("minProperties", 0):
            bad("too few properties")
        if len(value) > schema.get("maxProperties", len(value)):
            bad("too many properties")
    if isinstance(value, list):
        first, rest = schema.get("prefixItems") or [], schema.get("items")
        if isinstance(rest, list):
            first, rest = rest, schema.get("additionalItems")
        for k, v in enumerate(value):
            child(v, first[k] if k < len(first) else rest, f"{at}[{k}]")
        if schema.get("uniqueItems") is True and len({canonical(v) for v in value}) < len(value):
            bad("not unique")
        if "contains" in schema:
            found = [_check(v, schema["contains"], at, root, ()) for v in value]
            sure, some = sum(not f for f in found), sum(not failed(f) for f in found)
            low, high = schema.get("minContains", 1), schema.get("maxContains", len(value))
            if some < low or sure > high:
                bad("contains too few or too many")
            elif sure < low or some > high:
                skip("contains")
    if number:
        low, high = schema.get("exclusiveMinimum"), schema.get("exclusiveMaximum")
        low, high = schema.get("minimum") if low is True else low, schema.get("maximum") if high is True else high  # draft 4 has booleans
        if value < schema.get("minimum", value) or low not in (None, False) and value <= low:
            bad("below minimum")
        if value > schema.get("maximum", value) or high not in (None, False) and value >= high:
            bad("above maximum")
        if schema.get("multipleOf") and (Fraction(str(value)) / Fraction(str(schema["multipleOf"]))).denominator != 1:
            bad("not a multiple")
    if isinstance(value, str) and "pattern" in schema:
        p = _regex(schema["pattern"])
        if p is None:
            skip("pattern")
        elif not p.search(value):
            bad("not of the pattern")
    if isinstance(value, str | list):
        low, high = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
        if len(value) < schema.get(low, 0):
            bad("too short")
        if len(value) > schema.get(high, len(value)):
            bad("too long")
    return out


def _events(conv_id, turn, role: str, text: str) -> Iterator[tuple]:
    """Event rows of one message: the message itself (part 0), then its calls."""
    got = _object(text) if role in ("assistant", "tool", "system") else None
    base = {"role": role, "content": text}
    kind, call_id, tools = "message", None, None
    calls = []
    if got is not None and role == "assistant" and isinstance(got.get("tool_calls"), list):
        base["content"] = got.get("content")
        calls = [c for c in got["tool_calls"] if isinstance(c, dict)]
    elif got is not None and role == "tool" and "tool_call_id" in got:
        kind, call_id = "result", got["tool_call_id"] if isinstance(got["tool_call_id"], str) else None
        base = {"role": role, "content": got.get("content"), "tool_call_id": got["tool_call_id"]}
    elif got is not None and role == "system" and isinstance(got.get("tools"), list):
        base["content"] = got.get("content")
        defs = [t.get("function", t) for t in got["tools"] if isinstance(t, dict)]
        tools = [{"name": t["name"], "schema": canonical(t.get("parameters", {}))} for t in defs if isinstance(t, dict) and isinstance(t.get("name"), str)]
    yield (conv_id, turn, 0, role, kind, call_id, None, None, None, tools, canonical(base))
    for k, c in enumerate(calls):
        f = c.get("function") if isinstance(c.get("function"), dict) else c
        args = f.get("arguments", {})
        if isinstance(args, str):
            parsed = _object(args)
            args = args if parsed is None else parsed
        name, own = f.get("name"), c.get("id")
        body = {"role": role, "tool_call": {"id": own, "name": name, "arguments": args}}
        yield (conv_id, turn, k + 1, role, "call", own if isinstance(own, str) else None, name if isinstance(name, str) else None, canonical(args), _references(args), None, canonical(body))


def events(conversations: DataFrame) -> DataFrame:
    import pyarrow as pa

    tool = pa.struct([("name", pa.string()), ("schema", pa.string())])
    names = ["conv_id", "turn", "part", "role", "kind", "call_id", "name", "arguments", "needs", "tools", "json"]
    types = [pa.int64(), pa.int64(), pa.int32(), *[pa.string()] * 5, pa.list_(pa.string()), pa.list_(tool), pa.string()]

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            rows = [e for r in zip(*(b[c].to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True) for e in _events(*r)]
            cols = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text")).mapInArrow(run, EVENT)


def _validated(calls: DataFrame) -> DataFrame:
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            errors = [None if s is None else validate(json.loads(a), json.loads(s)) for a, s in zip(b["arguments"].to_pylist(), b["schema"].to_pylist(), strict=True)]
            yield pa.record_batch([b["uid"], pa.array(errors, pa.list_(pa.string()))], names=["uid", "errors"])

    return calls.select("uid", "arguments", "schema").mapInArrow(run, "uid long, errors array<string>")


def _chains(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(heads, chained): nodes with no or several predecessors, (uid, turn, n); and for each other node the head above it, the steps
    from there and the latest turn on the way, (uid, head, steps, t). By pointer doubling: rounds in the logarithm of the
    longest chain. A chain that comes back to itself has no head and is in neither."""
    waits = edges.groupBy("b").agg(F.count("*").alias("n"), F.min("a").alias("a"))
    known = materialize(nodes.join(waits, F.col("uid") == F.col("b"), "left").select("uid", "turn", F.coalesce("n", F.lit(0)).alias("n"), "a"), "waits")
    heads = known.where("n <> 1").select("uid", "turn", "n")
    above = known.select(F.col("uid").alias("p"), (F.col("n") != 1).alias("p_head"))
    open_ = known.where("n = 1").join(above, F.col("a") == F.col("p")).select("uid", F.col("a").alias("head"), F.lit(1).alias("steps"), F.col("turn").alias("t"), F.col("p_head").alias("done"))
    chained = materialize(open_, "chains")
    for _ in range(known.count().bit_length() + 1):
        if not chained.where("not done").limit(1).count():
            break
        up = chained.select(F.col("uid").alias("u"), F.col("head").alias("h"), F.col("steps").alias("s"), F.col("t").alias("t2"), F.col("done").alias("d"))
        far = chained.where("not done").join(up, F.col("head") == F.col("u")).select("uid", F.col("h").alias("head"), (F.col("steps") + F.col("s")).alias("steps"), F.greatest("t", "t2").alias("t"), F.col("d").alias("done"))
        chained = materialize(chained.where("done").unionByName(far), "chains")
    return heads, chained.where("done").select("uid", "head", "steps", "t")


def _layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(uid, order_turn, depth, cycle) of ``nodes`` (uid, turn): an event comes after all its predecessors in ``edges`` (a
    before b). Chains of single predecessors are taken in one stride (`_chains`); the heads that wait for several events are
    placed layer by layer, each once all that it waits for are placed."""
    heads, chained = _chains(nodes, edges)
    heads = materialize(heads, "heads")
    reach = heads.select("uid", F.col("uid").alias("head"), F.lit(0).alias("steps"), F.lit(None).cast("long").alias("t")).unionByName(chained)
    several = heads.where("n > 1")
    weighted = edges.join(several.select(F.col("uid").alias("b")), "b").join(reach, F.col("a") == F.col("uid")).select("b", "head", "steps", "t")
    weighted = materialize(weighted, "head-edges")
    front = materialize(heads.where("n = 0").select("uid", F.col("turn").alias("order_turn"), F.lit(0).alias("depth")), "layer")
    placed, arrived = front, None
    waiting = several.limit(1).count() > 0
    while waiting:
        came = weighted.join(front, F.col("head") == F.col("uid")).groupBy("b").agg(F.count("*").alias("m"), F.max(F.greatest("order_turn", "t")).alias("t"), F.max(F.col("depth") + F.col("steps")).alias("d"))
        arrived = came if arrived is None else arrived.unionByName(came).groupBy("b").agg(F.sum("m").alias("m"), F.max("t").alias("t"), F.max("d").alias("d"))
        arrived = materialize(arrived, "arrived")
        ready = arrived.join(several, F.col("b") == F.col("uid")).where("m = n")
        front = materialize(ready.select("uid", F.greatest("t", "turn").alias("order_turn"), (F.col("d") + 1).cast("int").alias("depth")), "layer")
        waiting = front.limit(1).count() > 0
        if waiting:
            placed = materialize(placed.unionByName(front), "placed")
            arrived = materialize(arrived.join(front, F.col("b") == F.col("uid"), "left_anti"), "arrived")
    top = placed.select(F.col("uid").alias("head"), "order_turn", "depth")
    out = reach.join(top, "head").select("uid", F.greatest("order_turn", "t").alias("order_turn"), (F.col("depth") + F.col("steps")).cast("int").alias("depth"))
    out = materialize(out, "placed")
    stuck = nodes.join(out, "uid", "left_anti").select("uid", F.col("turn").alias("order_turn"), F.lit(0).alias("depth"), F.lit(True).alias("cycle"))
    return out.withColumn("cycle", F.lit(False)).unionByName(stuck)


def linked(conversations: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """One row per event: conv_id, turn, part, role, kind, call_id, name, status, has_schema, errors (of a
    call's arguments), order_turn, depth, json. ``schemas``: tool schemas for all conversations, beside their own."""
    spark = conversations.sparkSession
    ev = materialize(events(conversations).withColumn("uid", F.monotonically_increasing_id()), "events")
    place = F.struct("turn", "part", "uid")
    known = lambda kind: ev.where((F.col("kind") == kind) & F.col("call_id").isNotNull() & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    first = lambda kind, name: known(kind).groupBy("conv_id", "call_id").agg(F.min(place).alias("p")).select("conv_id", "call_id", F.col("p.uid").alias(name))
    pairs = materialize(first("call", "call_uid").join(first("result", "result_uid"), ["conv_id", "call_id"], "full"), "pairs")
    calls = ev.where("kind = 'call'")
    own = ev.where("tools is not null and conv_id is not null").select("conv_id", "turn", F.posexplode("tools").alias("k", "t"))
    own = own.groupBy("conv_id", F.col("t.name").alias("name")).agg(F.max(F.struct("turn", "k", F.col("t.schema").alias("schema"))).alias("s")).select("conv_id", "name", F.col("s.schema").alias("own"))
    own = materialize(own, "schemas")
    shared = spark.createDataFrame([(k, canonical(v)) for k, v in (schemas or {}).items()], "name string, shared string")
    with_schema = calls.join(broadcast_if_small(own), ["conv_id", "name"], "left").join(F.broadcast(shared), "name", "left").withColumn("schema", F.coalesce("own", "shared"))
    checked = materialize(_validated(with_schema), "validated")

    answer = pairs.where("call_uid is not null and result_uid is not null")
    edges = answer.select(F.col("call_uid").alias("a"), F.col("result_uid").alias("b"))
    needs = calls.where("conv_id is not null and turn is not null").select("conv_id", F.col("uid").alias("b"), F.explode("needs").alias("call_id"))
    edges = edges.unionByName(needs.join(answer, ["conv_id", "call_id"]).select(F.col("result_uid").alias("a"), "b"))
    edges = materialize(edges.distinct(), "order-edges")
    touched = edges.select(F.col("a").alias("uid")).union(edges.select("b")).distinct()
    order = materialize(_layers(materialize(ev.join(touched, "uid").select("uid", "turn"), "order-nodes"), edges), "order")

    role_of = answer.select(F.col("call_uid").alias("uid"), F.lit("answered").alias("s")).union(answer.select("result_uid", F.lit("linked")))
    alone = pairs.where("call_uid is null or result_uid is null").select(F.coalesce("call_uid", "result_uid").alias("uid"), F.when(F.col("call_uid").isNotNull(), "unanswered").otherwise("orphan_result").alias("s"))
    out = ev.join(role_of.union(alone), "uid", "left").join(order, "uid", "left").join(checked, "uid", "left")
    plain_id = F.col("call_id").isNull() | F.col("conv_id").isNull() | F.col("turn").isNull()
    status = (
        F.when(F.col("kind") == "message", "message").when(F.col("cycle"), "cycle").when(F.col("s").isNotNull(), F.col("s"))
        .when(F.col("kind") == "call", F.when(plain_id, "unanswered").otherwise("duplicate_call")).otherwise(F.when(plain_id, "orphan_result").otherwise("duplicate_result"))
    )
    has = F.when(F.col("kind") == "call", F.col("errors").isNotNull()).alias("has_schema")
    return out.select("conv_id", "turn", "part", "role", "kind", "call_id", "name", status.alias("status"), has, "errors", F.coalesce("order_turn", "turn").alias("order_turn"), F.coalesce("depth", F.lit(0)).alias("depth"), "json")


REPLY = {"type": "object", "required": ["text", "turn"], "properties": {"after": {}, "text": {"type": "string", "minLength": 30}, "turn": {"type": "integer", "maximum": 4}}, "additionalProperties": False}


def as_calls(conversations: DataFrame) -> DataFrame:
    """Plain turns told as tool calls, every row kept: turn 0 brings the schema of the tool `reply`; an odd turn calls it with its
    text (from turn 3 on after the result of the call two turns before) and in every other odd turn also the unknown tool `note`;
    an even turn from 2 on is the result of the call before it. Rows that are JSON objects already stay as they are."""
    text, turn = F.coalesce("text", F.lit("")), F.col("turn").cast("long")
    call_id = lambda k: F.concat(F.lit("turn-"), (turn - k).cast("string"))
    message = F.to_json(F.struct(text.alias("content")))
    system = F.concat(F.left(message, F.length(message) - 1), F.lit(',"tools":[' + json.dumps({"name": "reply", "parameters": REPLY}) + "]}"))
    after = F.when(turn >= 3, F.struct(call_id(2).alias("$result")))
    reply = F.to_json(F.struct(call_id(0).alias("id"), F.lit("reply").alias("name"), F.struct(text.alias("text"), turn.alias("turn"), after.alias("after")).alias("arguments")))
    note = F.to_json(F.struct(F.concat(F.lit("note-"), turn.cast("string")).alias("id"), F.lit("note").alias("name"), F.struct(F.char_length(text).alias("chars")).alias("arguments")))
    calls = F.concat(F.left(message, F.length(message) - 1), F.lit(',"tool_calls":['), reply, F.when(turn % 4 == 1, F.concat(F.lit(","), note)).otherwise(""), F.lit("]}"))
    result = F.to_json(F.struct(call_id(1).alias("tool_call_id"), text.alias("content")))
    plain = turn.isNotNull() & (turn >= 0) & ~F.startswith(F.ltrim(text), F.lit("{"))
    kind = F.when(turn == 0, "system").when(turn % 2 == 1, "assistant").otherwise("tool")
    told = F.when(turn == 0, system).when(turn % 2 == 1, calls).otherwise(result)
    return conversations.select("conv_id", "turn", F.when(plain, kind).otherwise(F.col("role")).alias("role"), F.when(plain, told).otherwise(F.col("text")).alias("text"))


#: `linked(as_calls(conversations))`, its errors joined, for tables of plain turns.
ORACLE = """
WITH d AS (SELECT conv_id, turn, coalesce(text, '') AS text, CAST(to_json(coalesce(text, '')) AS VARCHAR) AS j FROM conversations),
g AS (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM (SELECT DISTINCT conv_id, turn FROM conversations)),
s AS (SELECT conv_id, turn, min(turn) OVER (PARTITION BY conv_id, island) AS begins, max(turn) OVER (PARTITION BY conv_id, island) AS ends, min(turn) OVER (PARTITION BY conv_id) = 0 AS tools FROM g),
e AS (SELECT d.*, begins, ends, tools, begins + (begins + 1) % 2 AS first_call FROM d JOIN s USING (conv_id, turn)),
m AS (SELECT conv_id, turn, CAST(0 AS INTEGER) AS part, CASE WHEN turn = 0 THEN 'system' ELSE 'assistant' END AS role, 'message' AS kind, CAST(NULL AS VARCHAR) AS call_id, CAST(NULL AS VARCHAR) AS name, 'message' AS status,
  CAST(NULL AS BOOLEAN) AS has_schema, CAST(NULL AS VARCHAR) AS errors, CAST(0 AS INTEGER) AS depth, '{"content":' || j || ',"role":"' || CASE WHEN turn = 0 THEN 'system' ELSE 'assistant' END || '"}' AS json FROM e WHERE turn = 0 OR turn % 2 = 1),
c AS (SELECT conv_id, turn, 1, 'assistant', 'call', 'turn-' || turn, 'reply', CASE WHEN turn < ends THEN 'answered' ELSE 'unanswered' END, tools,
  CASE WHEN tools THEN array_to_string(list_filter([CASE WHEN len(text) < 30 THEN '$.text: too short' END, CASE WHEN turn > 4 THEN '$.turn: above maximum' END], lambda x: x IS NOT NULL), '; ') END, CAST(turn - first_call AS INTEGER),
  '{"role":"assistant","tool_call":{"arguments":{' || CASE WHEN turn >= 3 THEN '"after":{"$result":"turn-' || (turn - 2) || '"},' ELSE '' END || '"text":' || j || ',"turn":' || turn || '},"id":"turn-' || turn || '","name":"reply"}}' FROM e WHERE turn % 2 = 1),
n AS (SELECT conv_id, turn, 2, 'assistant', 'call', 'note-' || turn, 'note', 'unanswered', false, NULL, 0, '{"role":"assistant","tool_call":{"arguments":{"chars":' || len(text) || '},"id":"note-' || turn || '","name":"note"}}' FROM e WHERE turn % 4 = 1),
r AS (SELECT conv_id, turn, 0, 'tool', 'result', 'turn-' || (turn - 1), NULL, CASE WHEN turn > begins THEN 'linked' ELSE 'orphan_result' END, NULL, NULL, CASE WHEN turn > begins THEN CAST(turn - first_call AS INTEGER) ELSE 0 END,
  '{"content":' || j || ',"role":"tool","tool_call_id":"turn-' || (turn - 1) || '"}' FROM e WHERE turn > 0 AND turn % 2 = 0)
SELECT conv_id, turn, part, role, kind, call_id, name, status, has_schema, errors, turn AS order_turn, depth, json
FROM (SELECT * FROM m UNION ALL SELECT * FROM c UNION ALL SELECT * FROM n UNION ALL SELECT * FROM r)
"""
