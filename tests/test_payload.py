"""Payload schemas at every depth."""

import pytest

from shelfmark.operators import payload

TREE = {
    "type": "object",
    "required": ["name"],
    "additionalProperties": False,
    "properties": {"name": {"type": "string", "pattern": "^[a-z]+$"}, "kids": {"type": "array", "items": {"$ref": "#/$defs/node"}}, "n": {"type": ["integer", "null"], "minimum": 0}, "any": {}},
    "$defs": {"node": {"type": "object", "required": ["v"], "additionalProperties": False, "properties": {"v": {"type": "number"}, "kids": {"type": "array", "items": {"$ref": "#/$defs/node"}}}}},
}


def faults(spark, rows, schema=TREE):
    df = spark.createDataFrame(rows, "id int, path string, v string, body string, kind string")
    return sorted(tuple(r) for r in payload.violations(df, "id", "body", schema).collect())


def test_faults_at_every_depth_of_a_recursive_schema(spark):
    deep = '{"name": "a", "kids": [{"v": 1, "kids": [{"v": "x", "kids": [{"kids": [], "v": 2, "w/~": 1}]}, {"kids": [7]}]}]}'
    rows = [(1, "p", "v", deep, "k"), (2, "p", "v", "{", "k"), (3, "p", "v", None, "k"), (4, "p", "v", "[]", "k"), (5, "p", "v", '{"name": "A", "n": -1, "any": [{"q": 1}]}', "k"), (6, "", "", '{"name": "b", "n": null}', ""), (7, "", "", '{"name": "b", "n": 2.0}', ""), (8, "", "", '{"n": 2.5}', "")]
    assert faults(spark, rows) == sorted([
        (1, "/kids/0/kids/0/v", "type", "STRING"),
        (1, "/kids/0/kids/0/kids/0", "extra", "w/~"),
        (1, "/kids/0/kids/1", "missing", "v"),
        (1, "/kids/0/kids/1/kids/0", "type", "BIGINT"),
        (2, "", "json", ""),
        (4, "", "type", "ARRAY"),
        (5, "/n", "value", "-1"),
        (5, "/name", "value", "A"),
        (8, "", "missing", "name"),
        (8, "/n", "type", "DECIMAL"),
    ])


def test_paths_are_escaped_and_empty_frames_have_no_faults(spark):
    closed = {"type": "object", "properties": {"a/b": {"type": "object", "properties": {"~": {"type": "null"}}}}}
    assert faults(spark, [(1, "", "", '{"a/b": {"~": 3}}', "")], closed) == [(1, "/a~1b/~0", "type", "BIGINT")]
    assert faults(spark, []) == []
    with pytest.raises(KeyError):
        payload.rules_of({"$ref": "#/$defs/none", "$defs": {}})


def test_summary_keeps_the_first_faults(spark):
    body = "{" + ",".join(f'"x{i}": 1' for i in range(9)) + "}"
    s = payload.summary(payload.violations(spark.createDataFrame([(1, body)], "id int, body string"), "id", "body", TREE), "id", shown=3)
    assert [tuple(r) for r in s.select("id", "n_faults", "first_faults").collect()] == [(1, 10, ["<root>: extra x0", "<root>: extra x1", "<root>: extra x2"])]
