"""Operator 4: chat formatting with tool-call linking.

Messages carry calls and results in their text, as
``<tool_call>{"id", "name", "arguments", "after"}</tool_call>`` and
``<tool_result>{"id", "content"}</tool_result>``. They are parsed into items,
calls and results are hash-joined by conversation and identifier, calls are put
in topological order of what they come ``after``, arguments are validated
against the tools' schemas, and each item is serialised as canonical JSON.

There is one row for each item, never one for a whole conversation, so a
conversation of any length stays spread over many tasks. Only identifiers and
links of a conversation come together to be ordered, as long as they are at
most ``FOLD``; those of longer ones are placed in rounds of joins. Sorting by
``conv_id, order_turn, level, turn, item`` is the order to write it in.
"""

from __future__ import annotations

import json
import math
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import settle, unsettle

_MARK = re.compile(r"<tool_(call|result)>")
_SPACE = re.compile(r"\s*")
#: Calls and links of a conversation that one fold places, at most.
FOLD = 50_000

#: The tools that the query knows.
SCHEMAS = {
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
    "lookup": {"type": "object", "properties": {"key": {"type": "string"}, "fields": {"type": "array", "items": {"type": "string"}}}, "required": ["key"]},
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1, "maximum": 100}}, "required": ["query"]},
}
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
_KEYWORDS = {"type", "enum", "minimum", "maximum", "minLength", "maxLength", "required", "properties", "additionalProperties", "items"}
_NOTES = {"title", "description", "default", "examples", "$schema", "$id", "$comment"}


#: Whole numbers from here on are written with an exponent where that is exact.
_LONG = 10**21


def _plain(value):
    """``value`` with one form for each number: 1, 1.0 and 1e0 are 1; what JSON text can't hold is a ValueError."""
    if isinstance(value, dict):
        return {_plain(k): _plain(x) for k, x in value.items()}
    if isinstance(value, list):
        return [_plain(x) for x in value]
    if isinstance(value, str):
        value.encode("utf-8")  # a lone surrogate fails
    elif isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("not finite")
        return int(value) if value.is_integer() and abs(value) < _LONG else value
    elif isinstance(value, int) and not isinstance(value, bool) and abs(value) >= _LONG:
        try:
            return float(value) if int(float(value)) == value else value
        except OverflowError:
            return value
    return value


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, characters as they are and one form for each number."""
    return json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _refuse(x):
    raise ValueError(x)


_JSON = json.JSONDecoder(parse_constant=_refuse)


def check_schema(schema, at: str = "$") -> None:
    """A ValueError for a schema that ``validate`` can't hold arguments against in full: another keyword or type, or one of the wrong form."""
    if not isinstance(schema, dict):
        raise ValueError(f"{at}: a schema is an object")
    if unknown := sorted(set(schema) - _KEYWORDS - _NOTES):
        raise ValueError(f"{at}: unknown keyword {unknown[0]}")
    kinds = schema.get("type", [])
    for kind in [kinds] if isinstance(kinds, str) else kinds:
        if kind not in _TYPES and kind not in ("number", "integer"):
            raise ValueError(f"{at}: unknown type {kind}")
    for k, x in schema.get("properties", {}).items():
        check_schema(x, f"{at}.{k}")
    if not isinstance(schema.get("additionalProperties", True), bool):
        check_schema(schema["additionalProperties"], f"{at}.*")
    if "items" in schema:
        check_schema(schema["items"], f"{at}[]")


def validate(value, schema: dict, at: str = "$") -> str | None:
    """The first thing wrong with ``value``, or None, by a schema that ``check_schema`` lets pass."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds or []

    def is_a(kind: str) -> bool:
        if kind in ("number", "integer"):
            return isinstance(value, int | float) and not isinstance(value, bool) and (kind == "number" or isinstance(value, int) or value.is_integer())
        return isinstance(value, _TYPES[kind])

    if kinds and not any(map(is_a, kinds)):
        return f"{at}: not {' or '.join(kinds)}"
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        return f"{at}: not in enum"
    if isinstance(value, int | float) and not isinstance(value, bool) and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        return f"{at}: out of range"
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
        return f"{at}: length out of range"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for k in schema.get("required", []):
            if k not in value:
                return f"{at}.{k}: missing"
        for k in sorted(value):
            inner = known.get(k, schema.get("additionalProperties", {}))
            if inner is False:
                return f"{at}.{k}: not known"
            if isinstance(inner, dict) and (found := validate(value[k], inner, f"{at}.{k}")):
                return found
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        for k, x in enumerate(value):
            if found := validate(x, schema["items"], f"{at}[{k}]"):
                return found
    return None


def _item(kind: str, body, role: str | None, turn, schemas: dict) -> tuple:
    if not isinstance(body, dict) or not isinstance(body.get("id"), str):
        raise ValueError("no identifier")
    call_id, after, status = body["id"], None, "ok"
    shown = {"id": call_id, "role": role, "turn": turn, "type": kind}
    if kind == "result":
        shown["content"] = body.get("content")
    else:
        shown |= {"arguments": body.get("arguments"), "name": body.get("name")}
        after = sorted({x for x in body["after"] if isinstance(x, str)}) if isinstance(body.get("after"), list) else []
        canonical(after)
        schema = schemas.get(body.get("name")) if isinstance(body.get("name"), str) else None
        status = "unknown_tool" if schema is None else "invalid" if validate(body.get("arguments"), schema) else "ok"
    return kind, call_id, status, after, canonical(shown)


def parse(role: str | None, turn, text: str | None, schemas: dict) -> list[tuple]:
    """(kind, call_id, status, after, json) of each item of a message, in its order."""
    out, at, text = [], 0, text or ""

    def plain(part: str) -> None:
        out.append(("text", None, "ok", None, canonical({"content": part, "role": role, "turn": turn})))

    look, unclosed = 0, set()
    while len(unclosed) < 2 and (m := _MARK.search(text, look)):
        kind, close, look = m[1], f"</tool_{m[1]}>", m.end()
        end = -1 if kind in unclosed else text.find(close, look)
        if end < 0:  # no mark without its end
            unclosed.add(kind)
            continue
        try:
            # what stands in a string of the JSON is no end
            body, stop = _JSON.raw_decode(text, _SPACE.match(text, look).end())
            stop = _SPACE.match(text, stop).end()
            if not text.startswith(close, stop):
                raise ValueError("more than JSON")
            end = stop
            item = _item(kind, body, role, turn, schemas)
        except (ValueError, RecursionError, OverflowError):  # not JSON, or such that no canonical text exists
            item = (kind, None, "broken", None, canonical({"content": text[look:end], "role": role, "turn": turn}))
        if text[at : m.start()].strip():
            plain(text[at : m.start()])
        out.append(item)
        look = at = end + len(close)
    if text[at:].strip() or not out:
        plain(text[at:])
    return out


def place(calls: list[tuple[str, int, list[str]]]) -> list[tuple[str, int, int]]:
    """call_id, order_turn and level of a conversation's calls (call_id, turn, after), each after what it comes after; those on or behind a cycle are left out."""
    turn = {i: t for i, t, _ in calls}
    waits, follow, level = {}, {}, {}
    for i, _, after in calls:
        deps = [x for x in after if x in turn]
        waits[i] = len(deps)
        for x in deps:
            follow.setdefault(x, []).append(i)
    ready, out = deque(i for i, n in waits.items() if not n), []
    while ready:
        i = ready.popleft()
        out.append((i, turn[i], level.setdefault(i, 1)))
        for j in follow.get(i, ()):
            turn[j], level[j] = max(turn[j], turn[i]), max(level.get(j, 1), level[i] + 2)
            waits[j] -= 1
            if not waits[j]:
                ready.append(j)
    return out


_ITEM = "conv_id long, turn long, item int, kind string, call_id string, status string, after array<string>, json string"
_ARROW = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("item", pa.int32()), ("kind", pa.string()), ("call_id", pa.string()), ("status", pa.string()), ("after", pa.list_(pa.string())), ("json", pa.string())])


def with_calls(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with the calls of a made-up assistant, as that table holds none.

    Every assistant message ends with a call whose tool and arguments follow
    from conv_id and turn; it comes after the call two turns before, with a new
    beginning every eight turns. Every user message but a conversation's first begins with the result of the call one
    turn before.
    """
    k = F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(10)).cast("int")
    at = lambda back: F.concat(F.lit("c"), (F.col("turn") - back).cast("string"))
    name = F.element_at(F.array(*map(F.lit, ("search", "lookup", "calculate", "translate"))), k % 4 + 1)
    arguments = F.struct(F.col("role").alias("query"), (k * 15).alias("limit"), F.when(k > 2, F.lit("x")).alias("key"), F.when(k > 5, F.lit("1+1")).alias("expression"))
    call = F.to_json(F.struct(name.alias("name"), at(0).alias("id"), F.when(F.col("turn") % 8 >= 2, F.array(at(2))).otherwise(F.array().cast("array<string>")).alias("after"), arguments.alias("arguments")))
    result = F.to_json(F.struct(at(1).alias("id"), k.alias("content")))
    text = F.when(F.col("role") == "assistant", F.concat("text", F.lit("<tool_call>"), call, F.lit("</tool_call>")))
    text = text.when((F.col("role") == "user") & (F.col("turn") > 0), F.concat(F.lit("<tool_result>"), result, F.lit("</tool_result>"), F.col("text")))
    return conversations.select("conv_id", "turn", "role", text.otherwise(F.col("text")).alias("text"))


def _in_rounds(nodes: DataFrame) -> DataFrame:
    """conv_id, call_id, order_turn and level as by ``place``, by joins alone: each round places what all predecessors of are placed."""
    edges = settle(nodes.select("conv_id", "call_id", F.explode("after").alias("dep")).join(nodes.select("conv_id", F.col("call_id").alias("dep")), ["conv_id", "dep"]))
    placed = settle(nodes.join(edges.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", F.col("turn").alias("order_turn"), F.lit(1).alias("level")))
    n = placed.count()
    while n:
        # calls all of whose predecessors have their place; what never gets one is on or behind a cycle
        ready = edges.join(placed.select("conv_id", F.col("call_id").alias("dep"), "order_turn", "level"), ["conv_id", "dep"], "left").groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.count("level").alias("known"), F.max("order_turn").alias("t"), F.max("level").alias("l")).where("n = known")
        new = ready.join(placed.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").join(nodes.select("conv_id", "call_id", "turn"), ["conv_id", "call_id"]).select("conv_id", "call_id", F.greatest("turn", "t").alias("order_turn"), (F.col("l") + 2).alias("level"))
        more = settle(placed.unionByName(new))
        before, n = n, more.count()
        unsettle(placed)
        placed = more
        if n == before:
            break
    return placed


def link(messages: DataFrame, schemas: dict | None = None) -> DataFrame:
    """The items of messages (conv_id, turn, role, text), linked and ordered.

    Returns conv_id, turn, item, kind (text, call, result), call_id, status,
    order_turn, level and json. status of a call: ok, unknown_tool, invalid
    (arguments fail the schema), broken (not JSON or without id), duplicate
    (another call of the conversation has the id and comes first), cycle (comes
    after itself), pending (no result); of a result: ok, orphan (no such call),
    broken. The first that holds in the order broken, duplicate, cycle,
    unknown_tool, invalid, pending is given. level: 0 for text, orphans and
    broken items; a call is one above the results it comes after, a result one
    above its call; identifiers that no call has are left out. order_turn is no
    earlier than that of what an item follows. A null or empty text is one
    empty text item. A null conv_id or turn stays null and links with nothing.
    Repeated rows give repeated items (of repeated calls all but one are
    duplicates). What is JSON but has no canonical text (numbers that no double
    holds, lone surrogates, nesting too deep to read) is broken. A conversation
    with more than ``FOLD`` calls and links takes as many rounds as its longest
    chain. A schema that ``check_schema`` refuses is a ValueError before
    anything is read. An empty table gives no rows.
    """
    schemas = SCHEMAS if schemas is None else schemas
    for name, schema in schemas.items():
        check_schema(schema, name)

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(conv, turn, k, *x) for k, x in enumerate(parse(role, turn, text, schemas))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)] if rows else [pa.array([], f.type) for f in _ARROW], schema=_ARROW)

    given = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    # numbered once and written, so that of copies one can be told from the others
    all_ = settle(given.mapInArrow(items, _ITEM).withColumn("row", F.monotonically_increasing_id()))
    linked = F.col("call_id").isNotNull() & F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    calls = all_.where(linked & (F.col("kind") == "call"))
    # the first by place; of copies at one place, the one of the lowest hash, then of the lowest number
    lead = F.min(F.struct("turn", "item", F.xxhash64("json").alias("h"), "row", "after")).alias("lead")
    nodes = settle(calls.groupBy("conv_id", "call_id").agg(lead).select("conv_id", "call_id", F.col("lead.turn").alias("turn"), F.col("lead.row").alias("first"), "lead.after"))
    size = nodes.groupBy("conv_id").agg(F.sum(F.size("after") + 1).alias("size"))
    large = settle(size.where(F.col("size") > FOLD).select("conv_id"))
    some = not large.isEmpty()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(c, *x) for c, calls in zip(*(x.to_pylist() for x in batch.columns), strict=True) for x in place([(x["call_id"], x["turn"], x["after"]) for x in calls])]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int32()))], names=["conv_id", "call_id", "order_turn", "level"])

    short = nodes.join(large, "conv_id", "left_anti") if some else nodes
    placed = short.groupBy("conv_id").agg(F.collect_list(F.struct("call_id", "turn", "after")).alias("calls")).mapInArrow(fold, "conv_id long, call_id string, order_turn long, level int")
    if some:
        placed = placed.unionByName(_in_rounds(nodes.join(large, "conv_id", "left_semi")))
    results = all_.where(linked & (F.col("kind") == "result") & (F.col("status") == "ok"))
    answered = results.groupBy("conv_id", "call_id").agg(F.count("*").alias("answers"))
    known = nodes.select("conv_id", "call_id", "first").join(placed, ["conv_id", "call_id"], "left").join(answered, ["conv_id", "call_id"], "left")
    known = settle(known.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), "first", "order_turn", "level", "answers"))
    tied = all_.where(linked).join(known, (F.col("conv_id") == F.col("c")) & (F.col("call_id") == F.col("i")), "left")
    call, other = tied.where("kind = 'call'").withColumn("main", F.col("row") == F.col("first")), tied.where("kind <> 'call'")
    status = F.when(~F.col("main"), "duplicate").when(F.col("level").isNull(), "cycle").when(F.col("status") != "ok", F.col("status")).when(F.col("answers").isNull(), "pending").otherwise("ok")
    cols = ["conv_id", "turn", "item", "kind", "call_id", "status", "order_turn", "level", "json"]
    top = F.coalesce(F.col("level"), F.lit(0))
    call = call.select("conv_id", "turn", "item", "kind", "call_id", status.alias("status"), F.greatest("turn", "order_turn").alias("order_turn"), F.when(F.col("main"), top).otherwise(0).alias("level"), "json")
    other = other.select("conv_id", "turn", "item", "kind", "call_id", F.when(F.col("c").isNull(), "orphan").otherwise(F.col("status")).alias("status"), F.greatest("turn", "order_turn").alias("order_turn"), F.when(F.col("level").isNull(), 0).otherwise(F.col("level") + 1).alias("level"), "json")
    plain = all_.where(~linked).select("conv_id", "turn", "item", "kind", "call_id", "status", F.col("turn").alias("order_turn"), F.lit(0).alias("level"), "json")
    return plain.select(cols).unionByName(call.select(cols)).unionByName(other.select(cols))
