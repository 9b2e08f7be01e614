"""Ranking, reading of chosen files only, detection, row reads and routing on odd inputs."""

from gleaner.operators import collection, files, gate, rows
from gleaner.operators.relevance import Request
from gleaner.sources import tables
from pyspark.sql import functions as F

ASKED = "request_id string, collection string, goal string, needles array<string>, must_keep array<string>"


def test_only_chosen_files_are_read(spark, tmp_path):
    for k in range(30):
        (tmp_path / f"f{k}.txt").write_text(f"text {k}\r\nmore")
    items = spark.createDataFrame([("c", f"f{k}.txt", "gold" if k in (3, 17) else None, "silver" if k == 9 else None) for k in range(30)], "collection string, name string, subject string, about string")
    asked = spark.createDataFrame([("r", "c", "gold silvers", None, None)], ASKED)
    best = sorted((r.rank, r.name, r.score) for r in collection.ranked(items, asked, 10).collect())
    assert best == [(1, "f17.txt", 3.0), (2, "f3.txt", 3.0), (3, "f9.txt", 1.5)]
    read = collection.texts_of(spark, [str(tmp_path / n) for _, n, _ in best])
    assert sorted(f.rsplit("/", 1)[1] for f in read.inputFiles()) == ["f17.txt", "f3.txt", "f9.txt"]
    assert sorted(r.text for r in read.collect()) == ["text 17\nmore", "text 3\nmore", "text 9\nmore"]
    assert collection.texts_of(spark, []).count() == 0
    assert tables.texts(spark, str(tmp_path)).where("text = 'text 3\nmore'").count() == 1 and tables.texts(spark, str(tmp_path)).count() == 30


def test_chosen_keys_reach_the_scan(spark, tmp_path):
    spark.range(1000).withColumn("text", F.lit("x")).repartitionByRange(8, "id").write.parquet(str(tmp_path / "t"))
    table, chosen = spark.read.parquet(str(tmp_path / "t")), spark.createDataFrame([(5,), (700,), (None,), (5,)], "id long")
    few, many = collection.only(table, "id", chosen), collection.only(table, "id", chosen, most=1)
    assert sorted(r.id for r in few.collect()) == sorted(r.id for r in many.collect()) == [5, 700]
    assert "PushedFilters: [In(id, [5,700])]" in few._jdf.queryExecution().executedPlan().toString()


def test_ranking_of_odd_requests(spark):
    items = spark.createDataFrame([("c", f"n{k:02d}", None, None) for k in range(12)] + [("d", None, "s", "a")], "collection string, name string, subject string, about string")
    asked = spark.createDataFrame([("none", "c", None, None, None), ("stop", "c", "find all the emails", [], []), ("other", "x", "n01", None, None), ("one", "c", "", ["n07"], None)], ASKED)
    got = {}
    for r in collection.ranked(items, asked, 10).collect():
        got.setdefault(r.request_id, []).append((r.rank, r.name, r.score))
    assert sorted(got["none"]) == sorted(got["stop"]) == [(k + 1, f"n{k:02d}", 0.1) for k in range(8)]
    assert got["one"] == [(1, "n07", 3.0)] and "other" not in got
    assert [r[0] for r in spark.range(1).select(collection.terms(F.lit("the class losses abc's is")).alias("t")).collect()] == [["class", "clas", "losses", "losse", "abc"]]
    assert spark.range(1).select(collection.wants_digest(F.lit("please audit it"))).first()[0]


def test_files(spark):
    df = spark.createDataFrame([("/r/a.CSV", 1024), ("/r/b", None), (None, 5), ("/r/.hidden/x.md", 9), ("/r/.bashrc", 9), ("/r/Z.md", 1), ("/r/x.tar.gz", 1), ("/s/y.md", 1)], "path string, size long")
    got = {r.path: (r.type, r.large, r.supported) for r in files.detected(df).collect()}
    assert got["/r/a.CSV"] == ("csv", True, True) and got["/r/b"] == ("text", False, False) and got["/r/x.tar.gz"][0] == "gz" and got["/r/.bashrc"][0] == "text" and len(got) == 7
    assert [(r.name, r.is_folder) for r in files.candidates(df, "/r").collect()] == [("a.CSV", False), ("b", False), ("x.tar.gz", False), ("Z.md", False)]
    assert [r.path for r in files.content(df, "/r").orderBy("path").collect()] == ["/r/.hidden/x.md", "/r/Z.md", "/r/a.CSV"] and files.folders(df.where("false"), "/r").collect() == []
    docs = spark.createDataFrame([(1, "One\ntwo one\nthree"), (2, None)], "doc_id int, text string")
    assert [(r.doc_id, r.line) for r in files.raw_lines(docs, "ONE").collect()] == [(1, 1), (1, 2)]
    assert docs.select(files.raw_range(F.col("text"), 4, 7)).first()[0] == "two"


def test_rows(spark):
    df = spark.createDataFrame([(k, f"n{k % 3}", "x" if k == 5 else None, k * 2) for k in range(40)], "id int, label string, note string, total int")
    assert rows.columns(df.columns, Request("the label")) == ["id", "label"] and rows.columns(df.columns, Request("", ("zzz",))) == df.columns and rows.columns(df.columns, Request("")) == df.columns
    assert not rows.whole(df, Request("all rows"), "focus") and rows.whole(df.limit(30), Request("all rows"), "scout") and not rows.whole(df.limit(3), Request("rows", want="table"), "scout") and rows.whole(df.limit(3), Request("all 3 daily records"), "refine")
    got = rows.read(df, Request("", ("x", "note")), ["id"]).collect()
    assert got[0].text == "id=5 | note=x" and got[0].score == 4.5 and len(got) == rows.BLOCKS
    assert [r.text for r in rows.read(df, Request("", ("zzz",)), ["id"]).collect()] == [f"id={k} | label=n{k} | note= | total={2 * k}" for k in range(3)]
    same = spark.createDataFrame([(k, "hit") for k in range(9)], "id int, word string")
    assert len(rows.read(same, Request("word", ("hit",)), ["id"]).collect()) == 8
    tight = rows.read(df, Request("", ("n1",)), ["id"], budget=100).collect()
    assert len(tight) == 1 and rows.read(df.where("false"), Request("", ("a",)), ["id"]).collect() == []
    assert rows.next_request(Request("g", tuple("abcdefgh"))).needles == tuple("abcdef")


def test_gate_beyond_the_usual(spark):
    found = spark.createDataFrame([("a", "text", "md", 100, "", "x", True), ("b", "csv", "csv", 9, "force", "x", True), ("c", "text", "", 9000, "", "x", False), ("d", "bin", "bin", 9000, "force", "x", True)], "k string, type string, ending string, size long, override string, goal string, large boolean")
    assert {r.k: (r.mode, r.code) for r in gate.objects(found, "k").collect()} == {"a": ("advisory", "document_boundary"), "b": ("force", "override"), "c": ("native", "below_benefit_floor"), "d": ("native", "unsupported")}
    zero = spark.createDataFrame([("full_fidelity", True), ("selective_read", True), ("selective_read", False)], "goal string, long_pdf boolean").selectExpr("*", *[f"0 AS {c}" for c in ("n", "n_bytes", "n_text", "n_structured", "n_tabular", "n_code", "n_log", "n_kinds")])
    assert sorted(r.code for r in gate.collections(zero, "goal").collect()) == ["collection_long_document", "empty_collection", "native_full_fidelity"]
    assert [r[0] for r in spark.createDataFrame([(" Compute_or_Edit",), (None,), ("full_fidelity",)], "g string").select(gate.shaped(F.col("g"))).collect()] == ["edit_or_execute", "unknown", "full_fidelity"]
