"""XML, workbooks and JSON shapes on odd inputs."""

import io
import zipfile

from gleaner.operators import sketch
from gleaner.sources import workbooks, xml_rows
from pyspark.sql import functions as F


def test_odd_xml(spark):
    long = "<r>" + "<a>t</a>" * 9_000 + "</r>"
    rows = [(1, None), (2, ""), (3, "no xml"), (4, "<a><b>x</b><c"), (5, "<a x='1'>one <b/> two</a>"), (5, "<p:q xmlns:p='u'/>"), (6, long), (None, "<a/>")]
    df = spark.createDataFrame(rows, "k int, x string").withColumn("path", F.lit("z"))
    got = [tuple(r) for r in xml_rows.elements(df, "k", "x").collect()]
    of = lambda k: [(r[1], r[2], r[6], bool(r[7])) for r in got if r[0] == k]
    assert not of(1) and [x[3] for x in of(2)] == [True] == [x[3] for x in of(3)]
    assert of(4) == [(0, "/a", "", False), (1, "/a/b", "x", False), (2, None, None, True)]
    assert sorted(of(5), key=str) == [(0, "/a", "one", False), (0, "/p:q", "", False), (1, "/a/b", "", False)]
    assert len(of(6)) == 9_001 and [x[0] for x in of(6)] == list(range(9_001)) and of(None) == [(0, "/a", "", False)]
    told = {r.k: r for r in xml_rows.profile(xml_rows.elements(df, "k", "x"), "k").collect()}
    assert told[6].child_counts == {"a": 9_000} and told[4].error and told[4].root == "a" and told[None].child_counts is None
    assert xml_rows.elements(df.where("false"), "k", "x").collect() == []


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", text)
    return out.getvalue()


def test_odd_workbooks(spark):
    sheet = '<worksheet><sheetData><row r="2"><c r="C2" t="s"><v>1</v></c><c><f>1+1</f><v>2</v></c></row><row/><row><c t="inlineStr"><is><t>a</t><t>b</t></is></c><c t="s"><v>9</v></c></row></sheetData></worksheet>'
    books = [(1, None), (2, b"no zip"), (3, zipped()), (4, zipped(xl__worksheets__sheet10=sheet, xl__worksheets__sheet2="<worksheet/>", xl__sharedStrings="<sst><si><t>x</t></si><si><r><t>y</t></r><r><t>z</t></r></si></sst>")), (5, zipped(xl__worksheets__sheet1="<worksheet><sheetData><row><c><v>1</v></c></row>"))]
    df = spark.createDataFrame(books, "k int, c binary")
    found = workbooks.sheets(df, "k", "c")
    assert sorted((r.k, r.place, r.sheet, bool(r.error)) for r in found.collect()) == [(2, 0, None, True), (4, 1, "Sheet1", False), (4, 2, "Sheet2", False), (5, 1, "Sheet1", False)]
    got = sorted((tuple(r)[:5] for r in workbooks.cells(found).collect()), key=str)
    assert got == [(2, 0, None, None, None), (4, 2, "Sheet2", 2, ["", "", "yz", "2"]), (4, 2, "Sheet2", 4, ["ab", "9"]), (5, 1, "Sheet1", 1, ["1"]), (5, 1, "Sheet1", None, None)]
    assert sorted((r.line, r.cells) for r in workbooks.cells(found, [0]).where("k = 4").collect()) == [(4, ["ab"])]
    assert workbooks.relevant(found, ["two", "HEET2"]).where("k = 4").count() == 1 and workbooks.relevant(found, ["none"]).count() == 4
    made = spark.createDataFrame([(1, workbooks.book({"a": [["h", "i"], ["x & <y>", "shared"], [None, 2.5]], "b": []}))], "k int, c binary")
    assert [(r.sheet, r.line, r.cells) for r in workbooks.cells(workbooks.sheets(made, "k", "c")).orderBy("line").collect()] == [("a", 1, ["h", "i"]), ("a", 2, ["x & <y>", "shared"]), ("a", 3, ["", "2.5"])]
    assert workbooks.column_number("AB3") == 27 and workbooks.column_number("7") is None


def test_odd_json(spark):
    deep = "[" * 9 + "1" + "]" * 9
    df = spark.createDataFrame([(1, None), (2, "nope"), (3, "null"), (4, '"text"'), (5, "[]"), (6, "{}"), (7, '{"a": [1, "x", null, {"a.b": true}]}'), (8, deep), (8, "2.5")], "k int, j string")
    got = {(r.path, r.kind): (r.n, r.least, r.most) for r in sketch.shapes(df, "j").collect()}
    assert got["$", "missing"][0] == got["$", "invalid"][0] == got["$", "null"][0] == 1 and got["$", "string"] == (1, 4.0, 4.0) and got["$", "array"] == (2, 0.0, 1.0)
    assert got["$.a[]", "number"] == (1, 1.0, 1.0) and got["$.a[]", "null"][0] == 1 and got["$.a[].a.b", "boolean"][0] == 1 and got["$" + "[]" * 6, "array"][0] == 1 and ("$" + "[]" * 7, "array") not in got
    flat = sorted((r.k, r.path, r.value) for r in sketch.scalars(df, "k", "j", 3).where("k > 3").collect() if r.value is not None)
    assert flat == [(4, "$", "text"), (7, "$.a[]", "1"), (7, "$.a[]", "x"), (7, "$.a[].a.b", "true"), (8, "$", "2.5")]
    assert sketch.shapes(df.where("false"), "j").collect() == []
