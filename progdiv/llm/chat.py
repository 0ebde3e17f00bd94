"""Chat formatting with tool calls linked to their results.

An assistant message may be a JSON object with tool_calls: a list of {id, name, arguments}; a tool message is
{tool_call_id, content}. Calls and results are hash-joined by conversation and identifier. A call depends on
another when its arguments hold {"$result": id}; calls are ordered by depth, and each result is moved behind its call's
message in that order. Arguments are validated against the tools' schemas, and every message becomes
canonical JSON: keys sorted, no spaces, no escapes that JSON doesn't need.
"""

from __future__ import annotations

import json
import math
import re
from fractions import Fraction
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from progdiv.llm.common import drop_table, materialize

#: Levels of calls kept as tables of their own before they are written as one.
_LEVELS = 32
#: Dependencies of a conversation that one task orders.
_SMALL = 1 << 16
#: Turns ranked together.
_SPAN = 256
_CALL = "array<struct<id:string,name:string,arguments:string,needs:array<string>,problems:array<string>>>"


def canonical(value: Any) -> str:
    """Canonical JSON; ValueError for numbers that JSON lacks and for text that UTF-8 lacks."""
    made = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    made.encode()
    return made


def _object(fields: dict[str, str]) -> str:
    """An object of values that are canonical already."""
    return "{" + ",".join(f'"{k}":{fields[k]}' for k in sorted(fields)) + "}"


def _is(value: Any, kind: str) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    return {
        "object": isinstance(value, dict), "array": isinstance(value, list), "string": isinstance(value, str), "boolean": isinstance(value, bool),
        "null": value is None, "number": number, "integer": number and math.isfinite(value) and value == int(value),
    }.get(kind, False)


def _key(value: Any) -> str:
    """One text for equal JSON values: booleans are no numbers, 1 and 1.0 are one."""

    def plain(v: Any) -> Any:
        if isinstance(v, list):
            return [plain(x) for x in v]
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return int(v) if isinstance(v, float) and v.is_integer() else v

    return canonical(plain(value))


#: Keywords that say nothing about validity.
_NOTES = {"$schema", "$id", "$comment", "$defs", "definitions", "title", "description", "default", "examples", "format", "deprecated", "readOnly", "writeOnly"}
#: Keywords that violations() checks.
_CHECKS = {
    "type", "enum", "const", "properties", "required", "additionalProperties", "minProperties", "maxProperties", "items", "minItems", "maxItems", "uniqueItems",
    "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern", "allOf", "anyOf", "oneOf", "not", "$ref",
}


def _limits(value: Any) -> list[tuple[str, str, float]]:
    """Keywords of a least and a greatest number for value, and the number they are held against."""
    if isinstance(value, str):
        return [("minLength", "maxLength", len(value))]
    if isinstance(value, list):
        return [("minItems", "maxItems", len(value))]
    if isinstance(value, dict):
        return [("minProperties", "maxProperties", len(value))]
    return [("minimum", "maximum", value)] if _is(value, "number") else []


def _referred(root: Any, ref: str) -> Any:
    """What a reference within the schema, as #/a/b, names; None if nothing."""
    found = root
    for part in ref.split("/")[1:] if ref == "#" or ref.startswith("#/") else ["", ""]:
        part = part.replace("~1", "/").replace("~0", "~")
        found = found.get(part) if isinstance(found, dict) else None
    return found


def violations(value: Any, schema: Any, at: str = "$", root: Any = None, through: tuple[str, ...] = ()) -> list[str]:
    """Where value breaks schema, by the keywords in _CHECKS of JSON Schema; another keyword that could reject a value is named
    as unsupported, as are references out of the schema or in a circle."""
    root = schema if root is None else root
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: not allowed"]
    if isinstance(value, dict) and set(value) == {"$result"}:
        return []  # known only when the other call has run
    found = [f"{at}: unsupported keyword {k}" for k in sorted(schema.keys() - _CHECKS - _NOTES)]
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [*found, f"{at}: not {' or '.join(kinds)}"]
    if "enum" in schema and _key(value) not in map(_key, schema["enum"]):
        found.append(f"{at}: not in enum")
    if "const" in schema and _key(value) != _key(schema["const"]):
        found.append(f"{at}: not the constant")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        extra = schema.get("additionalProperties", True)
        for k, v in value.items():
            if k in known:
                found += violations(v, known[k], f"{at}.{k}", root)
            elif extra is False:
                found.append(f"{at}.{k}: unknown")
            else:
                found += violations(v, extra, f"{at}.{k}", root)
    if isinstance(value, list):
        found += [x for i, v in enumerate(value) for x in violations(v, schema.get("items", {}), f"{at}[{i}]", root)]
        if schema.get("uniqueItems") and len(set(map(_key, value))) < len(value):
            found.append(f"{at}: items repeat")
    for low, high, size in _limits(value):
        found += [f"{at}: below {low}"] * (low in schema and size < schema[low]) + [f"{at}: above {high}"] * (high in schema and size > schema[high])
    if _is(value, "number"):
        found += [f"{at}: not above exclusiveMinimum"] * ("exclusiveMinimum" in schema and value <= schema["exclusiveMinimum"])
        found += [f"{at}: not below exclusiveMaximum"] * ("exclusiveMaximum" in schema and value >= schema["exclusiveMaximum"])
        if "multipleOf" in schema and (not math.isfinite(value) or Fraction(str(value)) % Fraction(str(schema["multipleOf"]))):
            found.append(f"{at}: not a multiple")
    if isinstance(value, str) and "pattern" in schema:
        try:
            found += [f"{at}: not as pattern"] * (not re.search(schema["pattern"], value))
        except re.error:
            found.append(f"{at}: unsupported pattern")
    found += [x for part in schema.get("allOf", []) for x in violations(value, part, at, root, through)]
    for k in ("anyOf", "oneOf"):
        if k in schema:
            fits = sum(not violations(value, part, at, root, through) for part in schema[k])
            found += [f"{at}: fits none of {k}"] * (not fits) + [f"{at}: fits several of oneOf"] * (k == "oneOf" and fits > 1)
    if "not" in schema and not violations(value, schema["not"], at, root, through):
        found.append(f"{at}: fits not")
    if "$ref" in schema:
        target = _referred(root, schema["$ref"])
        if target is None or schema["$ref"] in through:
            found.append(f"{at}: unsupported $ref")
        else:
            found += violations(value, target, at, root, (*through, schema["$ref"]))
    return found


def _needs(value: Any) -> list[str]:
    if isinstance(value, dict):
        if set(value) == {"$result"} and isinstance(value["$result"], str):
            return [value["$result"]]
        return [x for v in value.values() for x in _needs(v)]
    return [x for v in value for x in _needs(v)] if isinstance(value, list) else []


def parse(role: str | None, text: str | None, schemas: dict[str, dict]) -> dict:
    """content, calls and result_id of one message.

    Text that is not such JSON is plain content, and so is JSON nested too deep to read, or with numbers beyond doubles,
    NaN or lone surrogates, which have no canonical form."""
    plain = {"content": text, "calls": [], "result_id": None}
    if not text or role not in ("assistant", "tool") or not text.lstrip().startswith("{"):
        return plain
    try:
        value = json.loads(text)
        canonical(value)
        return _message(role, value, schemas) or plain
    except (ValueError, RecursionError):
        return plain


def _message(role: str, value: dict, schemas: dict[str, dict]) -> dict | None:
    if role == "tool" and isinstance(value.get("tool_call_id"), str):
        content = value.get("content")
        return {"content": content if isinstance(content, str) or content is None else canonical(content), "calls": [], "result_id": value["tool_call_id"]}
    if role != "assistant" or not isinstance(value.get("tool_calls"), list):
        return None
    calls = []
    for c in value["tool_calls"]:
        c = c if isinstance(c, dict) else {}
        problems = [f"no {k}" for k in ("id", "name") if not isinstance(c.get(k), str)]
        arguments = c.get("arguments", {})
        if isinstance(arguments, str):
            try:
                parsed = json.loads(arguments)
                canonical(parsed)
                arguments = parsed
            except (ValueError, RecursionError):
                problems.append("arguments are not JSON")
        name = c.get("name")
        if isinstance(name, str):
            problems += violations(arguments, schemas[name]) if name in schemas else ["unknown tool"]
        calls.append({"id": c.get("id") if isinstance(c.get("id"), str) else None, "name": name if isinstance(name, str) else None, "arguments": canonical(arguments), "needs": sorted(set(_needs(arguments))), "problems": problems})
    content = value.get("content")
    return {"content": content if isinstance(content, str) or content is None else canonical(content), "calls": calls, "result_id": None}


def _parsed(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    call = pa.struct([("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("needs", pa.list_(pa.string())), ("problems", pa.list_(pa.string()))])

    def run(batches):
        for batch in batches:
            found = [parse(r, t, schemas) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            cols = [pa.array([f["content"] for f in found], pa.string()), pa.array([f["calls"] for f in found], pa.list_(call)), pa.array([f["result_id"] for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("message", "conv_id", "turn", "role")), *cols], names=["message", "conv_id", "turn", "role", "content", "calls", "result_id"])

    return messages.mapInArrow(run, f"message bigint, conv_id string, turn bigint, role string, content string, calls {_CALL}, result_id string")


def _by_rounds(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """conv_id, id, depth of the calls that edges reach. Each round finds the calls of one depth, until a round makes no call
    ready."""
    key = ["conv_id", "id"]
    level = materialize(calls.select(*key).distinct().join(edges, key, "left_anti").withColumn("depth", F.lit(0)), "depths")
    levels, depth = [level], 0
    while not edges.isEmpty() and not level.isEmpty():
        depth += 1
        met = level.select("conv_id", F.col("id").alias("need"))
        rest = materialize(edges.join(met, ["conv_id", "need"], "left_anti"), "needs")
        ready = edges.join(met, ["conv_id", "need"], "left_semi").select(*key).distinct().join(rest, key, "left_anti")
        level = materialize(ready.withColumn("depth", F.lit(depth)), "depths")
        drop_table(edges)
        edges = rest
        levels.append(level)
        if len(levels) > _LEVELS:
            done = materialize(reduce(DataFrame.union, levels), "depths")
            for old in levels[:-1]:
                drop_table(old)
            levels = [done]
    return reduce(DataFrame.union, levels)


def _in_one(table: pa.Table) -> pa.Table:
    """Depths of one conversation's calls that have or are dependencies."""
    conv = table.column("conv_id")[0]
    needs: dict[str, list[str]] = {}
    users: dict[str, list[str]] = {}
    for a, b in zip(table.column("id").to_pylist(), table.column("need").to_pylist(), strict=True):
        needs.setdefault(a, []).append(b)
        users.setdefault(b, []).append(a)
    open_ = {a: len(x) for a, x in needs.items()}
    ready, depth, found = [b for b in users if b not in needs], 0, {}
    while ready:
        found |= dict.fromkeys(ready, depth)
        after = []
        for b in ready:
            for a in users.get(b, ()):
                open_[a] -= 1
                if not open_[a]:
                    after.append(a)
        ready, depth = after, depth + 1
    return pa.table([pa.array([conv.as_py()] * len(found), table.schema.field("conv_id").type), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int32())], names=["conv_id", "id", "depth"])


def _depths(calls: DataFrame) -> DataFrame:
    """conv_id, id, depth: 0 without dependencies, else one more than the deepest; no row in a cycle or behind one.

    Conversations of at most _SMALL dependencies are ordered by one task each, larger ones by rounds over all.
    """
    key = ["conv_id", "id"]
    known = calls.select("conv_id", F.col("id").alias("need")).distinct()
    edges = materialize(calls.select("conv_id", "id", F.explode("needs").alias("need")).join(known, ["conv_id", "need"]).distinct(), "needs")
    large = materialize(edges.groupBy("conv_id").count().where(F.col("count") > _SMALL).select("conv_id"), "large")
    small = edges.join(large, "conv_id", "left_anti").groupBy("conv_id").applyInArrow(_in_one, f"conv_id {calls.schema['conv_id'].dataType.simpleString()}, id string, depth int")
    one = calls.select(*key).distinct().where("conv_id IS NOT NULL")
    free = one.join(edges.select(*key).union(edges.select("conv_id", "need")), key, "left_anti").withColumn("depth", F.lit(0))
    found = materialize(free.union(small), "depths")
    if large.isEmpty():
        return found
    rounds = _by_rounds(calls.join(large, "conv_id", "left_semi"), materialize(edges.join(large, "conv_id", "left_semi"), "needs"))
    return found.union(rounds.join(found, key, "left_anti"))


def format_chats(messages: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """conv_id, turn, role, position, json, n_calls, n_linked, n_valid, problems: one row a message.

    Positions count from 0 in a conversation: by turn, results behind their call's message. Of several calls or
    results of one identifier the earliest turn links. Calls without result, results without call, invalid
    arguments, unknown tools, cycles and results that came before their call are listed in problems. Null texts
    have null content; null roles stay; rows without conv_id are one conversation and rows without turn come first;
    repeated rows are messages each; an empty table gives no rows.
    """
    conv = F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit(""))  # joins need a key
    base = messages.select(conv.alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").withColumn("message", F.monotonically_increasing_id())
    parsed = materialize(_parsed(base, schemas or {}), "messages")
    calls = parsed.select("conv_id", "turn", "message", F.posexplode("calls").alias("at", "call")).select("conv_id", "turn", "message", "at", "call.*").where("id IS NOT NULL")
    results = parsed.where("result_id IS NOT NULL").groupBy("conv_id", F.col("result_id").alias("id")).agg(F.min(F.struct("turn", "message")).alias("result"))
    linked = calls.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "message", "at")).alias("call"))
    depths = _depths(calls)
    linked = linked.join(results, ["conv_id", "id"], "left").join(depths, ["conv_id", "id"], "left")
    linked = materialize(linked.select("conv_id", "id", F.col("call.turn").alias("call_turn"), F.col("call.message").alias("call_message"), F.col("call.at").alias("at"), "depth", F.col("result.turn").alias("result_turn"), F.col("result.message").alias("result_message")), "linked")
    of_calls = calls.join(linked, ["conv_id", "id"]).groupBy("message").agg(F.collect_list(F.struct("id", "depth", (F.col("result_message").isNotNull() & (F.col("call_message") == F.col("message"))).alias("linked"))).alias("found"))
    of_result = linked.where("result_message IS NOT NULL").select(F.col("result_message").alias("message"), "call_turn", "at", F.col("depth").alias("call_depth"), F.lit(True).alias("has_call"))
    rows = parsed.join(of_calls, "message", "left").join(of_result, "message", "left")
    rows = rows.select("*", F.coalesce("call_turn", "turn").alias("a_turn"), F.when(F.col("has_call"), 1).otherwise(0).alias("phase"))
    order = [F.col("a_turn").asc_nulls_first(), "phase", F.col("call_depth").asc_nulls_last(), "at", "turn", "role", "content", "message"]
    rows = rows.withColumn("span", F.floor(F.coalesce("a_turn", F.lit(0)) / _SPAN))
    rows = materialize(rows.withColumn("own", F.row_number().over(Window.partitionBy("conv_id", "span").orderBy(*order)) - 1), "ordered")
    before = Window.partitionBy("s_conv").orderBy("s_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy(F.col("conv_id").alias("s_conv"), F.col("span").alias("s_span")).count()
    spans = spans.select("s_conv", "s_span", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    rows = rows.join(spans, (F.col("conv_id") == F.col("s_conv")) & (F.col("span") == F.col("s_span")))
    rows = rows.select(F.when(F.col("conv_id") != "", F.col("conv_id")).cast("long").alias("conv_id"), "turn", "role", (F.col("before") + F.col("own")).cast("long").alias("position"), "content", "calls", "result_id", "found", "has_call", (F.col("call_turn") > F.col("turn")).alias("early"))

    def write(batches):
        for batch in batches:
            out = {k: [] for k in ("json", "n_calls", "n_linked", "n_valid", "problems")}
            for r in batch.select(["role", "content", "calls", "result_id", "found", "has_call", "early"]).to_pylist():
                found = {f["id"]: f for f in r["found"] or []}
                made, problems, n_linked, n_valid = [], [], 0, 0
                for at, c in enumerate(r["calls"] or []):
                    f = found.get(c["id"]) or {"depth": 0, "linked": False}
                    n_linked += f["linked"]
                    n_valid += not c["problems"]
                    problems += [f"{c['id']}: {p}" for p in c["problems"]] + [f"{c['id']}: no result"] * (not f["linked"]) + [f"{c['id']}: cycle"] * (f["depth"] is None)
                    made.append((f["depth"] if f["depth"] is not None else math.inf, at, {"arguments": c["arguments"], "id": canonical(c["id"]), "name": canonical(c["name"])}))
                message = {"content": canonical(r["content"]), "role": canonical(r["role"])}
                if r["result_id"] is not None:
                    message["tool_call_id"] = canonical(r["result_id"])
                    problems += [f"{r['result_id']}: no call"] * (not r["has_call"]) + [f"{r['result_id']}: before its call"] * bool(r["early"])
                if made:
                    message["tool_calls"] = "[" + ",".join(_object(m[2]) for m in sorted(made, key=lambda m: m[:2])) + "]"
                for k, v in zip(out, (_object(message), len(made), n_linked, n_valid, problems), strict=True):
                    out[k].append(v)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("conv_id", "turn", "role", "position")), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], names=["conv_id", "turn", "role", "position", *out])

    return rows.mapInArrow(write, "conv_id bigint, turn bigint, role string, position bigint, json string, n_calls bigint, n_linked bigint, n_valid bigint, problems array<string>")
