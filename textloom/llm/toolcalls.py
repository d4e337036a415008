"""Chat formatting with linked tool calls.

A turn whose text is a JSON object may carry tool calls, {"tool_calls": [{"id", "name",
"arguments"}], "content"}, or be a result, {"tool_call_id", "content"}.  Calls and results are
hash-joined by conversation and identifier.  Messages are put in topological order: a
result comes after its call, and a call after the results that its arguments refer to
({"$ref": "<call id>"}); otherwise turns keep their order.  Arguments are validated
against the tools' schemas, and every message is serialised as canonical JSON (sorted
keys, no spaces).  Messages stay rows: no conversation is gathered into one task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import read_table, running_sums, written
from textloom.llm.registry import register

MESSAGES_PER_RUN = 4096

#: Tools known to the query; any mapping of the same form can be given.
TOOL_SCHEMAS = {
    "search": {
        "required": ["query"],
        "properties": {
            "query": {"type": "string"},
            "limit": {"type": "integer", "minimum": 1, "maximum": 100},
            "filters": {"type": "object", "properties": {
                "lang": {"type": "string", "enum": ["de", "en", "es", "fr"]},
                "tags": {"type": "array", "items": {"type": "string"}}}},
        },
    },
    "calculate": {
        "required": ["expression"],
        "properties": {"expression": {"type": "string", "minLength": 1}, "precision": {"type": "integer", "minimum": 0, "maximum": 15}},
    },
}
_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}
_LONE = re.compile("[\ud800-\udfff]")


def canonical(value) -> str:
    """JSON with sorted keys and no spaces; halves of surrogate pairs stay escapes."""
    out = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", out)


def parsed(text: str):
    """The value of a JSON text, None if it is none, holds NaN or an infinity, or nests too deep."""
    def refuse(_):
        raise ValueError

    try:
        return json.loads(text, parse_constant=refuse)
    except (ValueError, RecursionError):
        return None


def _is(value, kind: str) -> bool:
    if kind == "integer" and isinstance(value, float):
        return value.is_integer()
    return isinstance(value, _TYPES[kind]) and (kind == "boolean" or not isinstance(value, bool))


def _same(a, b) -> bool:
    return canonical(a) == canonical(b)


def schema_errors(value, schema: dict, path: str) -> Iterator[str]:
    """What breaks `schema` in `value`, outer before inner: type (one or several), enum, minimum, maximum, minLength,
    maxLength, minItems, maxItems, items, required, properties and additionalProperties (false unless given).
    A reference to another call's result fits everywhere."""
    if isinstance(value, dict) and set(value) == {"$ref"}:
        return
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        yield f"{path} is no {' or '.join(kinds)}"
        return
    if "enum" in schema and not any(_same(value, v) for v in schema["enum"]):
        yield f"{path} is none of its values"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            yield f"{path} is too small"
        if value > schema.get("maximum", value):
            yield f"{path} is too large"
    if isinstance(value, (str, list)):
        low, high = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
        if len(value) < schema.get(low, 0):
            yield f"{path} is too short"
        if len(value) > schema.get(high, len(value)):
            yield f"{path} is too long"
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            yield from schema_errors(v, schema["items"], f"{path}[{i}]")
    if isinstance(value, dict):
        inner, more = schema.get("properties", {}), schema.get("additionalProperties", "properties" not in schema)
        at = f"{path}." if path else ""
        yield from (f"missing {at}{k}" for k in sorted(schema.get("required", ())) if k not in value)
        for k in sorted(value):
            if k in inner:
                yield from schema_errors(value[k], inner[k], f"{at}{k}")
            elif more is False:
                yield f"unknown {at}{k}"
            elif isinstance(more, dict):
                yield from schema_errors(value[k], more, f"{at}{k}")


def argument_errors(name: str, arguments, schemas: dict) -> list[str]:
    """What is wrong with a call's arguments, in a fixed order."""
    if name not in schemas:
        return [f"unknown tool {name}"]
    if not isinstance(arguments, dict):
        return ["arguments are no object"]
    return list(schema_errors(arguments, {"properties": {}, **schemas[name], "type": "object"}, ""))


def _refs(value) -> Iterator[str]:
    if isinstance(value, dict):
        if set(value) == {"$ref"} and isinstance(value["$ref"], str):
            yield value["$ref"]
        for v in value.values():
            yield from _refs(v)
    elif isinstance(value, list):
        for v in value:
            yield from _refs(v)


def parse_message(role: str | None, text: str | None, schemas: dict) -> tuple[str, list[str], str | None, list[str], list[str]]:
    """(canonical JSON, call ids, answered call id, referred call ids, errors).

    A text that is no such JSON, nests too deep to be read or names identifiers that are no Unicode is plain content."""
    try:
        out = _tool_message(role, text, schemas)
        if out is not None:
            "".join([*out[1], out[2] or "", *out[3], *out[4]]).encode()
            return out
    except (RecursionError, UnicodeEncodeError):
        pass
    return canonical({"content": text, "role": role}), [], None, [], []


def _tool_message(role: str | None, text: str | None, schemas: dict) -> tuple | None:
    body = parsed(text) if text and role in ("assistant", "tool") and text.lstrip()[:1] == "{" else None
    if not isinstance(body, dict):
        return None
    calls = body.get("tool_calls") if role == "assistant" else None
    if isinstance(calls, list) and all(isinstance(c, dict) and isinstance(c.get("id"), str) for c in calls):
        out, errors, refs = [], [], set()
        for c in calls:
            arguments = c.get("arguments")
            if isinstance(arguments, str):
                inner = parsed(arguments)
                arguments = arguments if inner is None else inner
            name = str(c.get("name"))
            errors += [f"{c['id']}: {e}" for e in argument_errors(name, arguments, schemas)]
            refs.update(_refs(arguments))
            out.append({"arguments": arguments, "id": c["id"], "name": name})
        message = {"content": body.get("content"), "role": role, "tool_calls": out}
        return canonical(message), [c["id"] for c in calls], None, sorted(refs), errors
    if role == "tool" and isinstance(body.get("tool_call_id"), str):
        message = {"content": body.get("content"), "role": role, "tool_call_id": body["tool_call_id"]}
        return canonical(message), [], body["tool_call_id"], [], []
    return None


def format_chats(turns: DataFrame, schemas: dict | None = None, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per row of `turns`: conv_id, turn, position (gapless from 0 in the conversation), json,
    n_calls, linked (calls of this message with a result, or 1 for a result with a call),
    errors (array<string>: bad arguments, calls without result, results without call, cycles).

    Null roles and texts are JSON null; null conversation ids are one conversation; null turns
    come first; repeated rows are messages of their own, and of several calls with one id the
    first turn's counts; an empty table gives no rows; other columns are ignored."""
    known = TOOL_SCHEMAS if schemas is None else schemas
    base = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [parse_message(r, t, known) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            cols = list(zip(*parsed)) if parsed else [()] * 5
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(cols, (pa.string(), strings, pa.string(), strings, strings))]],
                ["conv_id", "turn", "json", "calls", "answers", "refs", "errors"])

    kind = base.schema["conv_id"].dataType.simpleString()
    messages = written(base.mapInArrow(run, f"conv_id {kind}, turn long, json string, calls array<string>, answers string, refs array<string>, errors array<string>"), "messages")

    # calls and results by identifier; a message is known by its conversation and turn
    calls = messages.select("conv_id", F.col("turn").alias("call_turn"), F.explode("calls").alias("call")).groupBy("conv_id", "call").agg(F.min("call_turn").alias("call_turn"))
    results = messages.where("answers is not null").groupBy("conv_id", F.col("answers").alias("call")).agg(F.min("turn").alias("result_turn"))
    pairs = written(calls.withColumnRenamed("conv_id", "c").join(results, F.col("c").eqNullSafe(results.conv_id) & (calls.call == results.call), "full").select(
        F.coalesce("c", "conv_id").alias("conv_id"), F.coalesce(calls.call, results.call).alias("call"), "call_turn", "result_turn"), "tool-pairs")
    refs = messages.select("conv_id", F.col("turn").alias("later"), F.explode("refs").alias("call"))
    p = pairs.withColumnRenamed("conv_id", "c").withColumnRenamed("call", "k")
    answered = messages.where("answers is not null").select("conv_id", F.col("turn").alias("later"), F.col("answers").alias("call"))
    before = (refs.join(p, refs.conv_id.eqNullSafe(p.c) & (refs.call == p.k)).select("conv_id", "later", F.col("result_turn").alias("earlier"))
              .unionByName(answered.join(p, answered.conv_id.eqNullSafe(p.c) & (answered.call == p.k)).select("conv_id", "later", F.col("call_turn").alias("earlier")))
              .where("earlier is not null and earlier <> later").distinct())
    before = written(before, "tool-order")

    # a message's place is its turn or, if later, just behind what it depends on: (turn, depth)
    places = messages.select("conv_id", "turn").distinct().withColumn("at", F.struct(F.col("turn").alias("t"), F.lit(0).alias("d")))
    moved = before.where("earlier > later")
    order_key = {}
    if moved.limit(1).count():
        places, order_key = _settle(places, before)
    looped = order_key.get("looped")
    joined = messages.join(places.select(F.col("conv_id").alias("pc"), F.col("turn").alias("pt"), "at"), F.col("conv_id").eqNullSafe(F.col("pc")) & F.col("turn").eqNullSafe(F.col("pt"))).drop("pc", "pt")
    linked_calls = p.where("call_turn is not null and result_turn is not null").groupBy("c", F.col("call_turn").alias("m")).agg(F.count("*").alias("linked"))
    linked_results = p.where("call_turn is not null").select("c", F.col("k"), F.lit(1).alias("has_call"))
    open_calls = p.where("result_turn is null").groupBy("c", F.col("call_turn").alias("m")).agg(F.sort_array(F.collect_list(F.concat("k", F.lit(": no result")))).alias("open"))
    for side, columns in ((linked_calls, ["linked"]), (open_calls, ["open"])):
        s = side.select(F.struct(*side.columns).alias("s"))
        joined = joined.join(s, F.col("conv_id").eqNullSafe(F.col("s.c")) & F.col("turn").eqNullSafe(F.col("s.m")), "left").withColumns(
            {c: F.col(f"s.{c}") for c in columns}).drop("s")
    s = linked_results.select(F.struct("*").alias("s"))
    joined = joined.join(s, F.col("conv_id").eqNullSafe(F.col("s.c")) & (F.col("answers") == F.col("s.k")), "left").withColumn("has_call", F.col("s.has_call")).drop("s")
    if looped is not None:
        s = looped.select(F.struct("*").alias("s"))
        joined = joined.join(s, F.col("conv_id").eqNullSafe(F.col("s.conv_id")) & F.col("turn").eqNullSafe(F.col("s.turn")), "left").withColumn("in_cycle", F.col("s").isNotNull()).drop("s")
    else:
        joined = joined.withColumn("in_cycle", F.lit(False))
    none = F.array().cast("array<string>")
    errors = F.concat("errors", F.coalesce("open", none),
                      F.when(F.col("answers").isNotNull() & F.col("has_call").isNull(), F.array(F.concat("answers", F.lit(": no call")))).otherwise(none),
                      F.when(F.col("in_cycle"), F.array(F.lit("dependency cycle"))).otherwise(none))
    full = joined.select("conv_id", "turn", "json", "at", F.size("calls").cast("long").alias("n_calls"),
                         F.when(F.col("answers").isNotNull(), F.coalesce("has_call", F.lit(0))).otherwise(F.coalesce("linked", F.lit(0))).cast("long").alias("linked"),
                         errors.alias("errors"), F.lit(1).cast("long").alias("one"))
    bucket = F.floor(F.coalesce(F.col("at.t"), F.lit(-(1 << 62))) / MESSAGES_PER_RUN)
    out = running_sums(full, ["conv_id"], [F.col("at"), F.col("turn"), F.col("json")], bucket, {"position": "one"})
    return out.select("conv_id", "turn", "position", "json", "n_calls", "linked", "errors")


def _settle(places: DataFrame, before: DataFrame) -> tuple[DataFrame, dict]:
    """Place messages level by level, each behind those it depends on.  Messages of a cycle, and what
    depends on one, never get ready; they keep their own turns and are returned as looped."""
    edges = before
    while edges.limit(1).count():
        waiting = edges.select(F.struct("conv_id", "later").alias("w")).distinct()
        blocked = edges.join(waiting, F.col("conv_id").eqNullSafe(F.col("w.conv_id")) & (F.col("earlier") == F.col("w.later")), "left_semi").select(
            F.struct("conv_id", "later").alias("b")).distinct()
        ready = written(edges.join(blocked, F.col("conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("later") == F.col("b.later")), "left_anti"), "tool-ready")
        if not ready.limit(1).count():
            return places, {"looped": edges.select("conv_id", F.col("later").alias("turn")).distinct()}
        behind = ready.withColumnRenamed("conv_id", "c").join(places, F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("earlier") == F.col("turn"))).groupBy("c", "later").agg(
            F.max(F.struct(F.col("at.t").alias("t"), (F.col("at.d") + 1).alias("d"))).alias("least"))
        places = written(places.join(behind, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("later")), "left").select(
            "conv_id", "turn", F.greatest("at", "least").alias("at")), "tool-places")
        done = ready.select(F.struct("conv_id", "later").alias("r")).distinct()
        edges = written(edges.join(done, F.col("conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("later") == F.col("r.later")), "left_anti"), "tool-order")
    return places, {}


def tool_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the given turns, numbered 0, 4, 8, ..., and behind each of the assistant's a message
    that calls tools, with a result for most calls.

    The kind of call follows from k = (31 * conv_id + 7 * turn) mod 10: sound calls (0); wrong types and a missing
    argument (1); a number out of range and no result (2); an unknown tool (3); errors in nested values (4); arguments
    as text, and a result that comes before its call (5); a reference to the result of the call two turns on, in turns
    0 and 1 of every four (6); an unknown argument (7); a result for a call that isn't there (8); two calls in one
    message, one without a result (9)."""
    def quoted(value) -> Column:
        whole = F.to_json(F.struct(value.alias("a")), {"ignoreNullFields": "false"})
        return F.substring(whole, F.lit(6), F.length(whole) - 6)

    at, text = F.col("turn"), quoted(F.col("text"))
    key = (F.coalesce(F.col("conv_id"), F.lit(0)) * 31 + F.coalesce(at, F.lit(0)) * 7) % 10
    plain = F.concat(F.lit('{"query":'), text, F.lit("}"))
    arguments = (F.when(F.col("k") == 0, F.concat(F.lit('{"query":'), text, F.lit(',"limit":'), at + 1, F.lit("}")))
                 .when(F.col("k") == 1, F.lit('{"limit":"5"}'))
                 .when(F.col("k") == 2, F.concat(F.lit('{"precision":40,"expression":"1+'), at, F.lit('"}')))
                 .when(F.col("k") == 4, F.concat(F.lit('{"query":'), text, F.lit(',"filters":{"tags":["a",1],"lang":"xx"}}')))
                 .when(F.col("k") == 5, quoted(plain))
                 .when((F.col("k") == 6) & (at % 4 < 2), F.concat(F.lit('{"query":{"$ref":"c'), at + 2, F.lit('"}}')))
                 .when(F.col("k") == 7, F.concat(F.lit('{"query":'), text, F.lit(',"colour":1}')))
                 .otherwise(plain))
    name = F.when(F.col("k") == 2, "calculate").when(F.col("k") == 3, "paint").otherwise("search")
    second = F.when(F.col("k") == 9, F.concat(F.lit(',{"name":"calculate","id":"d'), at, F.lit('","arguments":{"expression":"2"}}'))).otherwise("")
    call = F.concat(F.lit('{"tool_calls":[{"id":"c'), at, F.lit('","name":"'), name, F.lit('","arguments":'), arguments, F.lit("}"), second, F.lit("]}"))
    answered = F.when(F.col("k") == 8, F.concat(F.lit("x"), at)).when(F.col("k") != 2, F.concat(F.lit("c"), at))
    result = F.concat(F.lit('{"tool_call_id":"'), answered, F.lit('","content":"'), F.coalesce(F.length("text"), F.lit(0)), F.lit(' characters"}'))
    rows = F.array(
        F.struct((at * 4).alias("turn"), F.col("role").alias("role"), F.col("text").alias("text")),
        F.when(F.col("role") == "assistant", F.struct((at * 4 + 1).alias("turn"), F.lit("assistant").alias("role"), call.alias("text"))),
        F.when((F.col("role") == "assistant") & result.isNotNull(),
               F.struct((at * 4 + F.when(F.col("k") == 5, -1).otherwise(2)).alias("turn"), F.lit("tool").alias("role"), result.alias("text"))))
    return turns.withColumn("k", key).select("conv_id", F.explode(rows).alias("row")).where("row is not null").select("conv_id", "row.*")


SQL = """
WITH a AS (
  SELECT conv_id, turn AS t, (31 * conv_id + 7 * turn) % 10 AS k, coalesce(to_json(text)::VARCHAR, 'null') AS q, text,
    (text IS NULL)::BIGINT AS gap
  FROM conversations WHERE role = 'assistant'),
b AS (
  SELECT a.*, a.k = 6 AND a.t % 4 < 2 AS refers, a.k NOT IN (2, 8) AS answered,
    CASE WHEN a.k = 6 AND a.t % 4 < 2 AND n.k NOT IN (2, 8)
      THEN CASE WHEN n.k = 5 THEN (4 * n.t + 1) * 16 + 2 ELSE (4 * n.t + 2) * 16 + 1 END
      ELSE (4 * a.t + 1) * 16 END AS call_at
  FROM a LEFT JOIN a AS n ON n.conv_id = a.conv_id AND n.t = a.t + 2),
m AS (
  SELECT conv_id, 4 * turn AS turn, 4 * turn * 16 AS place,
    '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}' AS json,
    0 AS n_calls, 0 AS linked, 0 AS n_errors
  FROM conversations
  UNION ALL
  SELECT conv_id, 4 * t + 1, call_at,
    '{"content":null,"role":"assistant","tool_calls":[{"arguments":'
    || CASE WHEN k = 0 THEN '{"limit":' || (t + 1) || ',"query":' || q || '}'
            WHEN k = 1 THEN '{"limit":"5"}'
            WHEN k = 2 THEN '{"expression":"1+' || t || '","precision":40}'
            WHEN k = 4 THEN '{"filters":{"lang":"xx","tags":["a",1]},"query":' || q || '}'
            WHEN refers THEN '{"query":{"$ref":"c' || (t + 2) || '"}}'
            WHEN k = 7 THEN '{"colour":1,"query":' || q || '}'
            ELSE '{"query":' || q || '}' END
    || ',"id":"c' || t || '","name":"' || CASE k WHEN 2 THEN 'calculate' WHEN 3 THEN 'paint' ELSE 'search' END || '"}'
    || CASE WHEN k = 9 THEN ',{"arguments":{"expression":"2"},"id":"d' || t || '","name":"calculate"}' ELSE '' END || ']}',
    CASE WHEN k = 9 THEN 2 ELSE 1 END, answered::BIGINT,
    CASE WHEN k IN (1, 2) THEN 2 WHEN k = 3 THEN 1 WHEN refers THEN 0 WHEN k = 4 THEN 2 + gap WHEN k IN (7, 8, 9) THEN 1 + gap ELSE gap END
  FROM b
  UNION ALL
  SELECT conv_id, CASE WHEN k = 5 THEN 4 * t - 1 ELSE 4 * t + 2 END, greatest((4 * t + CASE WHEN k = 5 THEN -1 ELSE 2 END) * 16, CASE WHEN k = 8 THEN 0 ELSE call_at + 1 END),
    '{"content":"' || coalesce(length(text), 0) || ' characters","role":"tool","tool_call_id":"' || CASE WHEN k = 8 THEN 'x' ELSE 'c' END || t || '"}',
    0, (k <> 8)::BIGINT, (k = 8)::BIGINT
  FROM b WHERE k <> 2)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY place, turn) - 1 AS position, json,
  n_calls::BIGINT AS n_calls, linked::BIGINT AS linked, n_errors::BIGINT AS n_errors
FROM m
"""


@register("op6_tool_call_linking", SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations with calls and results by a fixed rule (`tool_turns`), as the given table holds none."""
    got = format_chats(tool_turns(read_table(spark, sf_dir, "conversations")))
    return got.select("conv_id", "turn", "position", "json", "n_calls", "linked", F.size("errors").cast("long").alias("n_errors"))
