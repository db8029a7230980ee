"""Walks of arbitrary JSON against recursive functions."""

import hashlib
import json

from orebed.sources import models, stores

MODEL = {
    "name": "Building", "id": "b1", "geometry": {"id": "hidden"},
    "elements": [
        {"id": "w1", "type": "Wall", "level": "L1", "parameters": {"Height": {"value": 3.5, "unit": "m", "group": "Size"}, "Fire": {"Rating": {"value": "EI60"}, "Doc": {"value": None}}, "Loose": " x "}},
        {"id": "w2", "applicationId": "other", "children": [{"category": "Door", "properties": [{"name": "Width", "value": 900}, "no object", {"val": True}]}]},
        [{"wrapped": {"elementId": 7, "name": ""}}], "text", 5, None,
    ],
    "relations": [{"from": "w1", "to": "w2", "type": "joins"}, {"from": "w1", "to": "w2", "type": "joins"}, {"source_id": "w2"}, "odd"],
    "info": {"Area": 12, "Empty": "", "Flag": False, "Nested": {"value": [1, 2]}},
}


def test_walk(spark):
    rows = [("m", json.dumps(MODEL)), ("list", json.dumps([{"id": "a"}, {"id": "a2", "elements": [{"id": "a3"}]}])), ("scalar", "5"), ("broken", "{"), ("none", None), ("plain", '{"x": {"y": 1}}')]
    elements, relations, properties = models.walk(spark.createDataFrame(rows, "k string, payload string"), "k", "payload")
    made = "path-" + hashlib.sha1(b"$.elements[1].children[0]").hexdigest()[:16]
    got = {(r.import_id, r.source_id): r for r in elements.collect()}
    assert set(got) == {("m", "b1"), ("m", "w1"), ("m", "w2"), ("m", made), ("m", "7"), ("list", "a"), ("list", "a2"), ("list", "a3")}
    assert (got["m", "w1"].object_type, got["m", "w1"].name, got["m", "w1"].level, got["m", "w1"].path) == ("Wall", "Wall", "L1", "$.elements[0]")
    assert json.loads(got["m", "w1"].attributes) == {"id": "w1", "level": "L1", "type": "Wall"}
    want = {("m", "b1", "w1", "contains"), ("m", "b1", "w2", "contains"), ("m", "w2", made, "contains"), ("m", "b1", "7", "contains"), ("m", "w1", "w2", "joins"), ("list", "a2", "a3", "contains")}
    assert {tuple(r) for r in relations.collect()} == want and relations.count() == len(want)
    assert sorted(map(tuple, properties.collect())) == sorted([
        ("m", "w1", "Height", "3.5", "number", "m", "Size"), ("m", "w1", "Rating", "EI60", "text", "", ""), ("m", "w1", "Loose", "x", "text", "", ""), ("m", made, "Width", "900", "number", "", ""),
        ("m", made, "properties_2", "true", "bool", "", ""), ("m", "b1", "Area", "12", "number", "", ""), ("m", "b1", "Flag", "false", "bool", "", ""), ("m", "b1", "Nested", "[1,2]", "json", "", ""),
    ])
    near = {(r.import_id, r.source_id): r for r in models.neighbourhood(elements, relations, properties, 2, 1).collect()}
    assert [tuple(x) for x in near["m", "w2"].relations] == [("contains", "b1", "w2"), ("contains", "w2", made)]
    assert [x.name for x in near["m", "w1"].properties] == ["Loose"] and near["list", "a"].relations is None


def plain_leaves(v, path=""):
    if isinstance(v, dict):
        for k, x in v.items():
            yield from plain_leaves(x, f"{path}/{k}" if path else k)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from plain_leaves(x, f"{path}[{i}]")
    else:
        yield path, None if v is None else json.dumps(v) if not isinstance(v, str) else v


def test_leaves(spark):
    texts = [json.dumps(MODEL), "[]", "{}", "[[1, [2]], {}]", '"text"', "nope", None, '{"a": {"b": [{"c": null}]}}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, payload string")
    got = sorted((r.id, r.path, str(r.value)) for r in models.leaves(df, "id", "payload").collect())
    want = sorted((i, p, str(v)) for i, t in enumerate(texts) if t not in ("nope", None) for p, v in plain_leaves(json.loads(t)))
    assert got == want
    deep = models.leaves(spark.createDataFrame([(1, '{"a": {"b": {"c": 1}}}')], "id int, payload string"), "id", "payload", 1).collect()
    assert [(r.path, r.value) for r in deep] == [("a", '{"b":{"c":1}}')]
    assert models.leaves(df.limit(0), "id", "payload").count() == 0


def test_files_are_replaced_whole(spark, tmp_path):
    schema = "collection string, file string, ordinal int, text string"
    root = f"{tmp_path}/store"
    old = [(c, f"f{i}", o, f"{c}{i}{o}") for c in ("a", "b/ö") for i in range(9) for o in range(3)]
    df = spark.createDataFrame(old, schema)
    stores.replace_files(df, df, root, 4)
    seen = lambda: sorted((r.collection, r.file, r.ordinal, r.text) for r in stores.stored_points(spark, root).collect())
    assert seen() == sorted(old)
    new = spark.createDataFrame([("a", "f1", 0, "new"), ("a", "f1", 0, "newer"), ("a", "f9", 0, "more"), ("a", "f2", 5, "not asked for")], schema)
    files = spark.createDataFrame([("a", "f1"), ("a", "f9"), ("a", "f3"), ("c", "f0")], "collection string, file string")
    want = sorted([r for r in old if r[0] != "a" or r[1] not in ("f1", "f3")] + [("a", "f1", 0, "new"), ("a", "f9", 0, "more")])
    for _ in range(2):
        stores.replace_files(new, files, root, 4)
        assert seen() == want
    every = spark.createDataFrame([("b/ö", f"f{i}") for i in range(9)], "collection string, file string")
    stores.replace_files(new.limit(0), every, root, 4)
    assert seen() == [r for r in want if r[0] == "a"]
    assert len({r.point_id for r in stores.stored_points(spark, root).collect()}) == len(seen())


def test_levels_are_not_stored(spark):
    df = spark.createDataFrame([("m", json.dumps(MODEL))], "k string, payload string")
    for out in (models.leaves(df, "k", "payload"), *models.walk(df, "k", "payload")):
        assert "ExistingRDD" not in out._jdf.queryExecution().optimizedPlan().toString() and "LogicalRDD" not in out._jdf.queryExecution().optimizedPlan().toString()
