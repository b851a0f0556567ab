import json
from datetime import datetime

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citewise.operators.shred import _parse_deep, element_paths, entity_table, entity_tables, nodes, objects, parse_json, shred

JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(max_size=4), c, max_size=4), max_leaves=20)


def plain(v):
    """numbers as written, as the parser gives them"""
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, list):
        return [plain(x) for x in v]
    return json.dumps(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def rebuild(rows_):
    made, root = {}, None
    for me, parent, _owner, label, ordinal, kind, scalar, _shape, _path in rows_:
        v = {} if kind == "object" else [] if kind == "array" else {"true": True, "false": False}[scalar] if kind == "bool" else scalar
        made[me] = v
        if parent is None:
            root = v
        elif ordinal is None:
            made[parent][label] = v
        else:
            assert len(made[parent]) == ordinal
            made[parent].append(v)
    return root


@settings(max_examples=150, deadline=None)
@given(JSON)
def test_round_trip(value):
    text = json.dumps(value)
    parsed = parse_json(text) if not isinstance(value, str) else value
    assert _parse_deep(text) == plain(value)
    if not isinstance(value, str):
        assert parsed == plain(value)
        assert rebuild(nodes(parsed)) == plain(value)


@pytest.mark.parametrize("text", ["", " ", "{", '{"a":1', "[1,]", '{"a":1,}', "{'a':1}", "[1] x", "NaN", "[Infinity]", "<html>", '"<html>"', '["a\nb"]', "[01]", '{"a" 1}', "]", "[1}", '{"a":}', "nul"])
def test_invalid(text):
    with pytest.raises(ValueError):
        parse_json(text)
    if text != '"<html>"':
        with pytest.raises(ValueError):
            _parse_deep(text)


def test_wrapped_and_deep():
    assert parse_json(json.dumps(json.dumps({"a": [1]}))) == {"a": ["1"]}
    deep = "[" * 60_000 + "{}" + "]" * 60_000
    assert sum(1 for n in nodes(parse_json(deep), "containers") if n[5] == "object") == 1


SCHEMA = "record_id string, payload string, fetched_at timestamp_ntz"
T = datetime(2026, 6, 1)


def test_paths(spark):
    doc = {"tasks": [{"result": [None, 3, {"items": [{"a": 1}, [{"b": {"c": []}}]]}]}], "a": {"b": [[1, 2, {}, {"x": 1}]]}, "n": {"m": 1}}
    data = [("r1", json.dumps(doc), T), ("r1", json.dumps(doc), T), ("r2", "[" + json.dumps(doc)[:-3], T), ("r3", None, T), ("r4", "", T), (None, '[{"k": 1}]', T), ("r5", json.dumps('[{"q": [{}]}]'), T)]
    df = spark.createDataFrame(data, SCHEMA).withColumn("node", F.lit("clash")).withColumn("path", F.lit(0))
    got = rows(element_paths({"s": (df, "record_id", "payload")}))
    want = ["a.b[0][2]", "a.b[0][3]", "tasks[0]", "tasks[0].result[2]", "tasks[0].result[2].items[0]", "tasks[0].result[2].items[1][0]"]
    assert got == sorted([*(("s", "r1", p) for p in want), ("s", None, "[0]"), ("s", "r5", "[0]"), ("s", "r5", "[0].q[0]")], key=str)
    assert element_paths({"s": (df.limit(0), "record_id", "payload")}).count() == 0


def test_entities_take_the_latest_text(spark):
    old, new = '{"items": [{"t": "x"}]}', '{"items": [{"t": "y", "n": 2, "deep": {"t": "z"}}, {"n": null, "t": ["l"]}, 5]}'
    df = spark.createDataFrame([("r", old, T), ("r", new, datetime(2026, 7, 1)), ("r", new, datetime(2026, 7, 1)), ("e", "{}", T)], SCHEMA)
    got = entity_table(df, "record_id", "payload", "fetched_at", "items[]", ("t", "n"))
    assert [(r["record_id"], r["parent_node"], r["ordinal"], r["path"], r["t"], r["n"]) for r in got.orderBy("ordinal").collect()] == [("r", 0, 0, "items[0]", "y", "2"), ("r", 0, 1, "items[1]", None, None)]


def test_adjacency(spark):
    df = spark.createDataFrame([("r", '{"a": [true, "\\ud800"], "b": 1.50}', T)], SCHEMA)
    got = [(r["node"], r["parent"], r["owner"], r["label"], r["ordinal"], r["kind"], r["scalar"]) for r in shred(df, "record_id", "payload").orderBy("node").collect()]
    assert got == [(0, None, None, None, None, "object", None), (1, 0, 0, "a", None, "array", None), (2, 1, 0, "a", 0, "bool", "true"), (3, 1, 0, "a", 1, "string", "?"), (4, 0, 0, "b", None, "number", "1.50")]


def test_objects_of_every_shape(spark):
    text = json.dumps({"a": [{"x": 1, "in": [{"y": "p"}, 5, {"y": None, "deep": {"z": True}}]}, [{"q": 2}]], "items": {"x": "alone"}})
    df = spark.createDataFrame([("r", text), ("r", text), ("r", "{"), ("s", json.dumps(json.dumps({"x": 3}))), (None, None)], "id string, t string")
    found = objects({"one": (df, "id", "t")})
    all_ = {r["path"]: r for r in found.where("record_id = 'r'").collect()}
    assert found.where("record_id = 'r'").count() == len(all_)
    assert {p: r["fields"] for p, r in all_.items()} == {"": {}, "a[0]": {"x": "1"}, "a[0].in[0]": {"y": "p"}, "a[0].in[2]": {"y": None}, "a[0].in[2].deep": {"z": "true"}, "a[1][0]": {"q": "2"}, "items": {"x": "alone"}}
    above = {r["node"]: p for p, r in all_.items()}
    assert {p: above.get(r["parent_node"]) for p, r in all_.items()} == {"": None, "a[0]": "", "a[0].in[0]": "a[0]", "a[0].in[2]": "a[0]", "a[0].in[2].deep": "a[0].in[2]", "a[1][0]": "", "items": ""}
    tables = entity_tables(found)
    assert {k[1] for k in tables} == {"", "a[]", "a[].in[]", "a[].in[].deep", "a[][]", "items"}
    assert sorted((r["path"], r["ordinal"], r["f_y"] or "") for r in tables["one", "a[].in[]"].collect()) == [("a[0].in[0]", 0, "p"), ("a[0].in[2]", 2, "")]
    assert [(r["record_id"], r["f_x"]) for r in tables["one", ""].where("record_id = 's'").collect()] == [("s", "3")]
    with pytest.raises(ValueError):
        entity_tables(found, 2)


def test_nodes_and_objects_of_all_sources(spark, small):
    from citewise.plans.problems import QUERIES

    kinds = QUERIES["p6_nodes"](spark, small).where("kind = 'object'").select("src", "record_id", "doc", "node", "owner", "path").distinct()
    got = QUERIES["p6_objects"](spark, small)
    assert {r["src"] for r in kinds.select("src").distinct().collect()} == {"audits", "dfs_backlinks_anchors", "dfs_serp_advanced"}
    assert rows(got.select("src", "record_id", "doc", "node", "parent_node", "path")) == rows(kinds)
    paths = got.where("ordinal is not null").select("src", "record_id", "path").distinct()
    assert rows(paths) == rows(QUERIES["p6_found"](spark, small))


def test_paths_follow_the_links_of_deep_and_odd_texts(spark):
    deep = "[" * 3_000 + "{}" + "]" * 3_000
    texts = [("a", '{"x": [{"y": {"z": [null, {"": [{}]}]}}]}'), ("b", '[{"k": [1, {}]}, []]'), ("c", "7"), ("d", deep), ("e", '{".": [{}]}'), (None, "[{}]"), ("a", '{"x": [{}]}')]
    df = spark.createDataFrame(texts, "id string, t string").coalesce(1)
    got = {(r["record_id"], r["path"]) for r in element_paths({"s": (df, "id", "t")}).collect()}
    assert got == {("a", "x[0]"), ("a", "x[0].y.z[1]"), ("a", "x[0].y.z[1].[0]"), ("b", "[0]"), ("b", "[0].k[1]"), ("d", "[0]" * 3_000), ("e", "..[0]"[1:]), (None, "[0]")}
