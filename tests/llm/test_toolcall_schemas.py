"""Argument schemas with nested values, and texts that are awkward JSON."""

from __future__ import annotations

import json

from textloom.llm import toolcalls
from textloom.llm.toolcalls import argument_errors, parse_message

SCHEMAS = {
    "book": {"required": ["when", "who"], "properties": {
        "when": {"type": "object", "required": ["day"], "properties": {"day": {"type": "integer", "minimum": 1, "maximum": 31}, "hour": {"type": ["integer", "null"]}}},
        "who": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "object", "properties": {"name": {"type": "string", "minLength": 2, "maxLength": 5}}}},
        "kind": {"enum": ["a", 1, None]}, "rate": {"type": "number"}, "sure": {"type": "boolean"}}},
    "free": {"additionalProperties": {"type": "string"}},
    "any": {"additionalProperties": True},
}


def test_nested_schemas():
    ok = {"when": {"day": 3, "hour": None}, "who": [{"name": "ann"}], "kind": 1, "rate": 2, "sure": True}
    assert argument_errors("book", ok, SCHEMAS) == []
    cases = [
        ({}, ["missing when", "missing who"]),
        ({"when": {}, "who": []}, ["missing when.day", "who is too short"]),
        ({"when": {"day": 0}, "who": [{}, {}, {}]}, ["when.day is too small", "who is too long"]),
        ({"when": {"day": 32, "hour": "x", "min": 1}, "who": [{"name": "a"}, 7]},
         ["when.day is too large", "when.hour is no integer or null", "unknown when.min", "who[0].name is too short", "who[1] is no object"]),
        ({**ok, "kind": True, "rate": True, "sure": 1}, ["kind is none of its values", "rate is no number", "sure is no boolean"]),
        ({**ok, "kind": None, "rate": 1.5, "when": {"day": 3.0}}, []),
        ({**ok, "when": {"day": 3.5}}, ["when.day is no integer"]),
        ({**ok, "when": {"$ref": "c"}, "who": [{"name": {"$ref": "d"}}]}, []),
    ]
    for arguments, want in cases:
        assert argument_errors("book", arguments, SCHEMAS) == want, arguments
    assert argument_errors("free", {"x": "y", "z": 1}, SCHEMAS) == ["z is no string"]
    assert argument_errors("any", {"x": [1]}, SCHEMAS) == []
    assert argument_errors("book", [1], SCHEMAS) == ["arguments are no object"] and argument_errors("none", {}, SCHEMAS) == ["unknown tool none"]


def test_awkward_json_is_plain_content():
    plain = lambda text, role="assistant": (toolcalls.canonical({"content": text, "role": role}), [], None, [], [])
    call = '{"tool_calls":[{"id":"c","name":"any","arguments":%s}]}'
    for text in ("{", "", None, "{}", '{"tool_calls":[{"id":3}]}', call % "NaN", call % ("9" * 5000), call % ("[" * 200_000 + "]" * 200_000),
                 call % '{"x":{"$ref":"\\ud800"}}', '{"tool_calls":[{"id":"\\ud800","name":"any","arguments":{}}]}'):
        assert parse_message("assistant", text, SCHEMAS) == plain(text), text and text[:60]
    for depth in (50, 900, 3000, 20_000):  # whole or plain, never a crash
        got = parse_message("assistant", call % ('{"x":' * depth + "1" + "}" * depth), SCHEMAS)
        assert got[1] in (["c"], []) and isinstance(json.loads(got[0]) if depth < 100 else got[0], (dict, str))
    got = parse_message("assistant", call % '{"x":"a\\ud800b"}', SCHEMAS)
    assert '"a\\ud800b"' in got[0] and got[0].encode() and got[1] == ["c"]


def test_derived_calls_keep_every_turn(spark):
    rows = [(c, t, r, x) for c in (None, 0, 1, 2, 7) for t, (r, x) in enumerate(
        [("system", "s"), ("assistant", None), ("assistant", 'q"\\\n'), ("user", ""), ("assistant", "x" * 50_000), (None, "n"), ("assistant", "é")])]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = toolcalls.tool_turns(table).collect()
    assert {(r.conv_id, r.turn // 4, r.role, r.text) for r in got if r.turn % 4 == 0} == set(rows)
    calls = [r for r in got if r.turn % 4 == 1]
    assert len(calls) == 5 * 4 and all(json.loads(r.text)["tool_calls"][0]["id"] == f"c{r.turn // 4}" for r in calls)
    texts = {(c, t): x for c, t, _, x in rows}
    for r in calls:
        arguments = json.loads(r.text)["tool_calls"][0]["arguments"]
        arguments = json.loads(arguments) if isinstance(arguments, str) else arguments
        if "query" in arguments and not isinstance(arguments["query"], dict):
            assert arguments["query"] == texts[r.conv_id, r.turn // 4]
    out = toolcalls.format_chats(toolcalls.tool_turns(table)).collect()
    assert len(out) == len(got)
    for c in {r.conv_id for r in out}:
        assert sorted(r.position for r in out if r.conv_id == c) == list(range(sum(r.conv_id == c for r in out)))
