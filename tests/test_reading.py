"""The chained read on written documents and requests."""

import json

from gleaner.operators import reading
from pyspark.sql import functions as F


def asked(spark, *rows):
    made = [(k, doc, mode, budget, None if said is None else json.dumps(said)) for k, (doc, mode, budget, said) in enumerate(rows)]
    return spark.createDataFrame(made, "request_id int, doc_id int, mode string, budget int, request string")


def test_reads(spark):
    page = "# Report\n\nAn overview of the year.\n\nRevenue was 500 units.\n\n# Roadmap\n\nFirst the gateway exposes typed calls.\n\n- second item\n\nThird thing"
    docs = spark.createDataFrame([(1, page, "x"), (2, "", "y"), (3, None, "z"), (4, "\n\n".join(f"line {k}" for k in range(9)), "w")], "doc_id int, text string, idx string")
    requests = asked(
        spark, (1, "focus", None, {"goal": "g", "needles": ["revenue", "gateway typed"], "want": "count"}), (1, "scout", None, {"goal": "x"}), (1, "refine", None, {"goal": "the roadmap section", "needles": ["roadmap"], "scope": "expand"}),
        (2, None, None, {"goal": "x", "needles": ["a"]}), (3, None, None, {"goal": "x", "needles": ["a"]}), (9, None, None, None), (4, None, 1, {"goal": "", "needles": ["zzz", "line 0"]}), (4, None, 500, {"goal": "g", "needles": ["zzz"], "want": "list"}),
    )
    got = {r.request_id: r for r in reading.read_texts(docs, requests).collect()}
    texts = lambda k: [b.text for b in got[k].blocks]
    assert len(got) == 8 and got[0].way == "scored" and texts(0)[0] == "Revenue was 500 units." and got[0].open == []
    assert got[1].way == "overview" and texts(1)[0] == "An overview of the year." and len(texts(1)) <= 4
    assert got[2].way == "section" and texts(2)[0] == "# Roadmap" and texts(2)[-1] == "Third thing" and got[2].blocks[0].score == 8.0
    assert [(got[k].way, got[k].blocks, got[k].open) for k in (3, 4, 5)] == [("none", [], ["a"]), ("none", [], ["a"]), ("none", [], [])]
    assert texts(6) == ["line 0"] + texts(6)[1:] and got[6].open == ["zzz"]
    assert texts(7) == [f"line {k}" for k in range(5)] and {b.score for b in got[7].blocks} == {0.1}
    assert reading.read_texts(docs, requests.where("false")).collect() == []


def test_blocks_that_do_not_fit_are_passed_over(spark):
    units = spark.createDataFrame([(1, k, f"L{k}", t, "") for k, t in enumerate(["key " + "x" * 150, "key " + "y" * 190, "key z"])], "doc_id int, idx int, anchor string, text string, heading string")
    one = spark.createDataFrame([(1, 1, "focus", 300, "", ["key"], "list", "new", None)], "request_id int, doc_id int, mode string, budget int, goal string, needles array<string>, want string, scope string, must_keep array<string>")
    assert [b.idx for b in reading.read(units, one).first().blocks] == [0, 2]
    assert [b.idx for b in reading.read(units, one.withColumn("budget", F.lit(5))).first().blocks] == [0]
