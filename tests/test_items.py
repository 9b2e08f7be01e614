"""Collection items and key paths: stated results."""

import json

from gleaner.operators import items


def test_mail():
    text = "From: a@b\r\nsubject:  Hello there \r\nnot a header\r\nDate: May\r\n\r\nbody one\r\n\r\n  body two"
    assert items.item(text, "text") == ("Hello there", "a@b", "May", "not a header body one body two")
    assert items.item("Subject: only", "text") == ("only", "", "", "Subject: only")
    assert items.item("plain\n\nFrom: late", "text") == ("", "", "", "plain From: late")
    assert items.item("", "text") == ("", "", "", "")
    assert len(items.item("word " * 500, "text")[3]) == 260


def test_outlines():
    assert items.outline('{"a": 1, "b": 2}', "json") == "top_keys: a, b"
    assert items.outline('[{"x": 1}, 2]', "json") == "list_len: 2; item_keys: x"
    assert items.outline("[]", "json") == "list_len: 0"
    assert items.outline("k: v", "yaml") == "top_keys: k"
    assert items.outline('a,"b,c"\n1,2\n3,4', "csv") == "columns: a, b,c; sample_rows: 2"
    assert items.outline("{", "json") == items.outline("7", "json") == items.outline("", "csv") == ""


def test_leaves():
    data = {"a": [1, {"b": None}], "c": {"d": True, "e": []}, "f": "x"}
    assert list(items.leaves(data)) == [("$.a[0]", "1"), ("$.a[1].b", ""), ("$.c.d", "True"), ("$.f", "x")]
    assert list(items.leaves(data, whole_lists=True))[-2:] == [("$.c.e", "[]"), ("$.f", "x")]
    long = list(items.leaves(list(range(250))))
    assert len(long) == 201 and long[199:] == [("$[199]", "199"), ("$.length", "250")]
    assert list(items.leaves({"a": ["é", 1]}, whole_lists=True)) == [("$.a", '["é", 1]')]


def test_over_rows(spark):
    rows = [(1, json.dumps({"a": {"b": [1, 2]}})), (2, None), (3, "{"), (None, "5")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((repr(r.doc_id), r.idx, r.path, r.value) for r in items.key_paths(df).collect())
    assert got == [("1", 0, "$.a.b[0]", "1"), ("1", 1, "$.a.b[1]", "2"), ("None", 0, "$", "5")]
    mail = {r.doc_id: r.snippet for r in items.items(df).collect()}
    assert mail == {1: '{"a": {"b": [1, 2]}}', 2: "", 3: "{", None: "5"}
