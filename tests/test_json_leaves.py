"""JSON of any shape, and settings in layers, against plain Python."""

import json

from plumbline.operators import json_leaves
from pyspark.sql import functions as F


def test_deep_and_wide_documents(spark):
    deep = "mail a@b.example.org"
    for i in range(50):
        deep = {"n": deep} if i % 2 else [deep, i]
    wide = {"list": [{"m": f"x{i}@y.example.org"} for i in range(10_000)], "q\"uote": "a@b.example.org", "none": None, "empty": [{}, [], ""]}
    rows = [(1, json.dumps(deep)), (2, json.dumps(wide)), (3, "no json: a@b.example.org"), (4, None), (5, '"a@b.example.org"'), (6, "null"), (7, "[]"), (8, '{"": 1.50, "b": true}')]
    docs = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: r.text for r in json_leaves.mask_json(docs, ["id"], "text", ("email",)).collect()}
    masked = lambda t: json.loads(t.replace("a@b.example.org", "[REDACTED:email]"))
    assert json.loads(got[1]) == masked(rows[0][1]) and got[3] == "no json: [REDACTED:email]" and got[4] is None
    assert json.loads(got[2]) == {**masked(rows[1][1]), "list": [{"m": "[REDACTED:email]"}] * 10_000}
    assert got[5] == '"[REDACTED:email]"' and got[6] == "null" and got[7] == "[]" and json.loads(got[8]) == {"": 1.5, "b": True}


def test_paths(spark):
    docs = spark.createDataFrame([(1, '{"a": [{"m": "x@y.example.org"}, ["z"]], "b": {"c": 1}}'), (2, "plain x@y.example.org"), (3, None)], "id long, text string")
    found = {tuple(r) for r in json_leaves.detect_json(docs, ["id"], "text").collect()}
    assert found == {(1, "a.0.m", "email", "x@y.example.org"), (2, "", "email", "x@y.example.org")}


def deep_merge(low, high):
    if not (isinstance(low, dict) and isinstance(high, dict)):
        return high
    return {**low, **{k: deep_merge(low[k], v) if k in low else v for k, v in high.items() if v is not None}}


def flat(value, path=""):
    if isinstance(value, dict) and value:
        return {p: v for k, x in value.items() for p, v in flat(x, f"{path}.{k}" if path else k).items()}
    return {} if value is None else {path: value}


def test_layers(spark):
    layers = [
        {"llm": {"model": "m", "heat": 1, "keys": [1, 2]}, "a": {"b": {"c": 1, "d": 2}}, "x": 1, "y": {"z": 1}},
        {"llm": {"heat": None, "keys": [3]}, "a": {"b": 5}, "x": {"deep": 1}, "agents": {"judge": {"model": "own", "heat": None}, "scribe": {"extra": True}}},
        {"a": {"b": {"e": 9}}, "y": 7},
        {"y": {"w": 2}, "agents": {"scribe": {"model": "  "}}},
    ]
    df = spark.createDataFrame([("k", i, json.dumps(x)) for i, x in enumerate(layers)] + [("empty", 0, "{}"), ("k", 9, None)], "k string, layer int, text string")
    made = json_leaves.merged(df.select("k", "layer", F.parse_json("text").alias("doc")), ["k"], "layer", "doc").cache()
    want = {}
    for x in layers:
        want = deep_merge(want, x)
    assert {r.path: json.loads(r.value) for r in made.collect()} == flat(want)
    got = {(r.owner, r.path): json.loads(r.value) for r in json_leaves.inherited_settings(made, ["k"], "llm", "agents").collect()}
    assert got == {("judge", "model"): "own", ("judge", "heat"): 1, ("judge", "keys"): [3], ("scribe", "model"): "m", ("scribe", "heat"): 1, ("scribe", "keys"): [3], ("scribe", "extra"): True}
