"""Requests, paths, neighbourhoods and readiness on odd inputs, and the plans of the joins."""

import pytest
from gleaner.operators import paths, readiness, requests
from gleaner.plans import catalog
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["path_relations", "nearest_roots", "anchor_neighbours"])
def test_joins_are_on_keys(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Join" in plan


def test_odd_requests(spark):
    raw = [None, "", "[]", "null", "{}", '{"goal": null, "needles": null, "slots": []}', '{"goal": "x", "slots": 7}', '{"goal": "x", "slots": {"": "Who?"}}', '{"goal": "x", "want": "", "scope": null}', '{"goal": "x", "slots": [' + ",".join(f'"Who {i}?"' for i in range(15)) + "]}"]
    df = spark.createDataFrame([(i, r, "kept") for i, r in enumerate(raw)], "request_id int, request string, extra string")
    got = {r.request_id: r for r in requests.parsed(df).collect()}
    assert len(got) == len(raw) and all(r.extra == "kept" and r.want == "fact" and r.scope == "new" for r in got.values())
    assert [got[i].warnings for i in range(4)] == [["no object"]] * 4 and got[4].warnings == got[5].warnings == ["goal is missing"]
    assert got[6].warnings == ["slots are no array"] and [s.id for s in got[7].slots] == ["slot_1"] and got[8].warnings == []
    assert len(got[9].slots) == requests.SLOTS and got[9].warnings == ["too many slots"]
    assert requests.parsed(df.where("false")).collect() == []


def test_related_paths(spark):
    left = spark.createDataFrame([("/a/",), ("/a/b/c",), ("/ab",), (None,), ("/",)], "l string")
    right = spark.createDataFrame([("/a/b", 1), ("/a", 2), ("/a", 3), (None, 4)], "r string, n int")
    got = sorted((x.l, x.n, x.relation) for x in paths.related(left, right, "l", "r").collect())
    assert got == [("/", 1, "above"), ("/", 2, "above"), ("/", 3, "above"), ("/a/", 1, "above"), ("/a/", 2, "equal"), ("/a/", 3, "equal"), ("/a/b/c", 1, "below"), ("/a/b/c", 2, "below"), ("/a/b/c", 3, "below")]
    far = spark.createDataFrame([("/a/1/2/3/4",), ("/a/1/2/3/4/5",), ("/z",), (None,), ("/a",)], "p string")
    got = {x.p: (x.r, x.distance) for x in paths.nearest_root(far, right, "p", "r").collect()}
    assert got == {"/a/1/2/3/4": ("/a", 4), "/a/1/2/3/4/5": (None, None), "/z": (None, None), None: (None, None), "/a": ("/a", 0)}
    got = {x.p: x.above for x in paths.chains(far.unionByName(spark.createDataFrame([("/a/1/2",)], "p string")), "p").collect()}
    assert got == {"/a/1/2/3/4": 2, "/a/1/2/3/4/5": 3, "/z": 0, "/a": 0, "/a/1/2": 1}


def test_neighbourhoods_merge(spark):
    units = spark.range(400).select(F.lit(1).alias("doc_id"), F.col("id").alias("idx"))
    for width in (1, 7, 64):
        at = spark.createDataFrame([(1, 3), (1, 3), (1, 6), (1, 300), (2, 5), (1, None)], "doc_id int, idx int")
        got = sorted((r.idx, r.low, r.n_anchors) for r in paths.around(at, units, 1, 2, width).collect())
        assert got == [(k, 2, 2) for k in range(2, 9)] + [(k, 299, 1) for k in range(299, 303)]


def test_readiness(spark):
    answers = spark.createDataFrame([(1, "a", "resolved", "abc def", 0.95), (1, "b", "resolved", "in May 2020", 0.95), (2, "a", "partial", None, None)], "doc_id int, slot string, status string, value string, confidence double")
    slot = "array<struct<id: string, asked: string>>"
    asked = [(1, 1, "focus", []), (2, 1, "verify", [("a", "fact")]), (3, 1, "verify", [("a", "How many?"), ("b", "How many things?")]), (4, 1, "verify", [("b", "When?")]), (5, 2, "focus", [("a", "")]), (6, 2, "verify", [("a", "")]), (7, 3, "focus", None), (8, 1, "focus", [("z", ""), ("a", ""), ("z", "")])]
    got = {r.request_id: r for r in readiness.judged(spark.createDataFrame(asked, f"request_id int, doc_id int, mode string, slots {slot}"), answers).collect()}
    assert {i: r.verdict for i, r in got.items()} == {1: "complete", 2: "complete", 3: "complete", 4: "complete", 5: "nearly_complete", 6: "verify", 7: "read", 8: "extend"}
    assert got[8].new_slots == ["z"] and got[5].open_slots == ["a"]
    forms = [("Tools: 12", 0.95, "category", False), ("Tools", 0.95, "category", True), ("May: 3", 0.95, "category", True), ("soon", 0.95, "date", True), ("17 April 2026", 0.95, "date", False), ("ab", 0.95, "", True), ("12", 0.95, "count", False), ("x y z [clipped]", 0.95, "", True), ("long one", 0.5, "", True)]
    df = spark.createDataFrame(forms, "v string, c double, a string, want boolean")
    assert df.where(readiness.doubtful(F.col("v"), F.col("c"), F.col("a")) != F.col("want")).collect() == []
