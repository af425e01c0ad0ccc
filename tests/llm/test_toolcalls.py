from __future__ import annotations

import json

from llm.helpers import collected
from pyspark.sql import functions as F

from quillspark.llm import toolcalls

Field = toolcalls.Field
SCHEMAS = {
    "add": {"x": Field("integer", True), "y": Field("number"), "after": Field("array")},
    "book": {
        "kind": Field("string", True, values=["in", "out"]), "count": Field("integer", least=1, most=9), "tags": Field("array", items="string"),
        "at": Field("object", fields={"day": Field("integer", True, least=1, most=31), "place": Field("object", fields={"name": Field("string", True)})}), "after": Field("array"),
    },
}
CALLS, RESULTS = "conv_id long, call_id string, turn long, tool string, arguments string", "conv_id long, call_id string, turn long, content string"


def link(spark, calls, results):
    df = toolcalls.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS)
    return {(r["conv_id"], r["call_id"], r["turn"]): r for r in collected(df)}


def test_order_follows_needs_not_turns(spark):
    calls = [(1, "a", 1, "add", '{"x": 1, "after": ["c"]}'), (1, "b", 2, "add", '{"x": 1}'), (1, "c", 3, "add", '{"x": 1, "after": ["b"]}')]
    rows = link(spark, calls, [(1, c, 9, c * 2) for c in "abc"])
    assert [(k[1], r["level"], r["place"], r["errors"]) for k, r in sorted(rows.items())] == [("a", 2, 3, ""), ("b", 0, 1, ""), ("c", 1, 2, "")]
    message = json.loads(rows[1, "a", 1]["message"])
    assert message == {"arguments": {"after": ["c"], "x": 1}, "id": "a", "level": 2, "name": "add", "place": 3, "result": "aa"}
    assert rows[1, "a", 1]["message"].startswith('{"arguments":{"after":["c"],"x":1}')


def test_arguments_are_checked(spark):
    cases = {
        "a": ('{"x": "1"}', "type:x"), "b": ('{"y": 1.5}', "missing:x"), "c": ('{"x": 1, "z": 2, "b": 3}', "unknown:b,unknown:z"), "d": ('{"x": ', "invalid_json"), "e": (None, "invalid_json"),
        "f": ("[1]", "invalid_json"), "g": ('{"x": 1.5, "y": null}', "type:x,type:y"), "h": ('{"x": 1, "after": ["zz"]}', "unknown_need"), "i": ('{"x": 1, "x": 2}', "invalid_json"),
    }
    rows = link(spark, [(1, c, 1, "add", text) for c, (text, _) in cases.items()], [(1, c, 2, "r") for c in cases])
    assert {k[1]: r["errors"] for k, r in rows.items()} == {c: e for c, (_, e) in cases.items()}


def test_bounds_items_and_nested_fields_are_checked(spark):
    cases = {
        "a": ('{"kind": "in", "count": 9, "tags": ["x", ""], "at": {"day": 1, "place": {"name": "n"}}}', ""), "b": ('{"kind": "up", "count": 0}', "range:count,value:kind"),
        "c": ('{"kind": "in", "tags": ["x", 1]}', "items:tags"), "d": ('{"kind": "in", "tags": [null]}', "items:tags"), "e": ('{"kind": "in", "tags": []}', ""),
        "f": ('{"kind": "in", "at": {"hour": 3}}', "missing:at.day,unknown:at.hour"), "g": ('{"kind": "in", "at": {"day": 32, "place": {"name": 5}}}', "range:at.day,type:at.place.name"),
        "h": ('{"kind": 1, "count": "3", "at": []}', "type:at,type:count,type:kind"), "i": ('{"kind": "out", "count": 2.0}', ""), "j": ('{"kind": "out", "count": 2.5}', "type:count"),
    }
    rows = link(spark, [(1, c, 1, "book", text) for c, (text, _) in cases.items()], [(1, c, 2, "r") for c in cases])
    assert {k[1]: r["errors"] for k, r in rows.items()} == {c: e for c, (_, e) in cases.items()}
    assert json.loads(rows[1, "i", 1]["message"])["arguments"]["count"] == 2


def test_long_chains_and_clashing_columns(spark):
    calls = [(1, f"c{i:03d}", i, "add", json.dumps({"x": i, "after": [f"c{i - 1:03d}"] if i else []})) for i in range(25)]
    extra = lambda df: df.select("*", *[F.lit("x").alias(c) for c in ("level", "place", "errors", "message", "parsed", "need", "needs", "row", "n", "answer", "first", "unknown")])
    df = toolcalls.link(extra(spark.createDataFrame(calls, CALLS)), extra(spark.createDataFrame([(1, c[1], 99, "r") for c in calls], RESULTS)), SCHEMAS)
    assert sorted((r["turn"], r["level"], r["place"]) for r in collected(df)) == [(i, i, i + 1) for i in range(25)]


def test_awkward_rows(spark):
    calls = [
        (1, "a", 1, "add", '{"x": 1, "after": ["b"]}'), (1, "b", 2, "add", '{"x": 1, "after": ["a"]}'), (1, "c", 3, "add", '{"x": 1, "after": ["a"]}'),  # a cycle, and behind it
        (2, "a", 1, "add", '{"x": 1}'), (2, "a", 1, "add", '{"x": 1}'), (2, "a", 5, "other", "{}"),  # a repeated id
        (3, None, 1, "add", '{"x": 1}'), (None, "a", 2, "add", '{"x": 1}'), (4, "q", 1, None, ""),
        (5, "a", 1, "add", '{"x": 1, "y": ' + "1" * 20 + ', "after": ["a", "a", null]}'),
    ]
    results = [(2, "a", 3, "late"), (2, "a", 2, "first"), (2, "zz", 1, "lost"), (3, None, 1, "no id"), (None, "a", 7, "no conversation")]
    rows = link(spark, calls, results)
    assert [rows[1, c, t]["errors"] for c, t in (("a", 1), ("b", 2), ("c", 3))] == ["cycle,no_result"] * 3
    assert rows[2, "a", 1]["n_results"] == 2 and json.loads(rows[2, "a", 1]["message"])["result"] == "first"
    assert (2, "a", 5) not in rows and rows[2, "zz", 1]["errors"] == "orphan_result"
    assert rows[3, None, 1]["level"] in (0, None) and rows[None, "a", 7]["errors"] == "orphan_result"
    assert rows[4, "q", 1]["errors"] == "unknown_tool,no_result"
    assert rows[5, "a", 1]["errors"] == "cycle,no_result"
    assert link(spark, [], []) == {}


def test_whole_texts_reach_the_messages(spark):
    awkward = ['say "hi"', "back\\slash \\n \\u0041", "line\nend\r\n\ttab", "Ünï 日本語 😀 é", "{}[],:\x01\x1f\x7f", "</script>\u2028", "'quoted' {0} $1 \\1", "x" * 100_000 + '"end']
    rows = [(c, t, "assistant" if t % 2 == 0 else "user", awkward[(c + t) % len(awkward)] * (1 + c % 3) + "." * (c % 11)) for c in range(60) for t in range(6)]
    text = {(c, t): x for c, t, _, x in rows}
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = collected(toolcalls.link(toolcalls.calls_of(conversations), toolcalls.results_of(conversations), toolcalls.SCHEMAS))
    assert sum(r["tool"] is not None for r in found) == 180
    seen = set()
    for r in found:
        message = json.loads(r["message"])
        assert r["message"].startswith("{" + json.dumps(min(message)) + ":") and list(message) == sorted(message)
        if r["tool"] is None:
            assert message["result"] == text[r["conv_id"], r["turn"]] and r["errors"] == "orphan_result"
            continue
        own, answer = text[r["conv_id"], r["turn"]], text[r["conv_id"], r["turn"] + 1]
        assert ("invalid_json" in r["errors"]) == (len(own) % 17 == 0 and len(own) % 29 != 0)
        assert message.get("result") == (None if len(answer) % 7 == 0 else answer)
        if "arguments" in message:
            assert len(own) % 17 and message["arguments"].get("query") == (None if len(own) % 13 == 0 else own)
            seen.add((r["conv_id"] + r["turn"]) % len(awkward))
    assert len(seen) == len(awkward)
