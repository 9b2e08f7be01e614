"""Requests, units' scores and typed answers on written units."""

import pytest
from gleaner.operators import extract, gate, page_text, profile, relevance, segments
from gleaner.operators.denoise import flat_yaml
from gleaner.operators.extract import Slot
from pyspark.sql import functions as F


def frame(spark, texts, headings=None):
    return spark.createDataFrame([(1, k, f"L{k}", t, (headings or {}).get(k)) for k, t in enumerate(texts)], "doc_id long, idx long, anchor string, text string, heading string")


def test_terms_and_budgets():
    r = relevance.Request("Find the SLA of a db", ("SLA", "99.9"), ("uptime", "12-3"), "fact")
    assert r.terms() == ["sla", "99.9", "uptime", "12-3", "find", "the", "sla"]
    assert r.section_terms() == ["uptime"] and not r.asks_for_section()
    assert relevance.Request("see the appendix").asks_for_section()
    assert relevance.budget("scout") == 1800 and relevance.budget("verify", collection=True) == 20000
    assert relevance.budget("focus", given=5) == 200 and relevance.budget("focus", True, 5) == 1000


def test_scores_and_fallback(spark):
    units = frame(spark, ["nothing", "uptime was 99.9", "- a list", "Uptime"], {3: "Terms"})
    r = relevance.Request("", ("uptime",), ("99.9",), "fact")
    got = {x.idx: x.score for x in relevance.scored(units, r).collect()}
    assert got == {1: pytest.approx(6.8), 2: pytest.approx(0.4), 3: pytest.approx(2.3)}
    none = relevance.scored(frame(spark, [f"line {k}" for k in range(9)]), relevance.Request("", ("zzz",))).collect()
    assert [(x.idx, x.score) for x in sorted(none)] == [(k, 0.1) for k in range(5)]


def test_clip_and_sections(spark):
    cut = spark.createDataFrame([("  " + "x" * 50 + " ",), (" short ",)], "t string").select(relevance.clipped(F.col("t"), 40).alias("c")).collect()
    assert [r.c for r in cut] == ["x" * 20 + relevance.MARK, "short"]
    units = frame(spark, ["intro"] + [f"Roadmap item {k}" for k in range(12)])
    got = sorted(relevance.section(units, relevance.Request("", ("roadmap",)), 10_000).collect(), key=lambda r: r.idx)
    assert [r.idx for r in got] == list(range(1, 11)) and [round(r.score, 1) for r in got][:3] == [8.0, 6.6, 6.2]
    assert [r.idx for r in relevance.section(units, relevance.Request("", ("roadmap",)), 5).collect()] == [1]
    seen = relevance.overview(frame(spark, ["a", "b", "c", "d", "An overview of it"])).collect()
    assert [r.text for r in sorted(seen, key=lambda r: r.rank)] == ["An overview of it", "a", "b", "c"]


def test_needles_by_tokens(spark):
    found = frame(spark, ["The API gateway exposes typed calls"])
    r = relevance.Request("", ("gateway typed", "gateway missing", "the exact", "api GATEWAY"))
    assert {x.needle for x in relevance.unresolved(found, r).collect()} == {"gateway missing", "the exact"}


#: Slots with the units of a document and the answer.
TYPED = [
    (Slot("deploy_owner"), ["x", "Deploy Owner:  Ann   Lee "], "Ann Lee"),
    (Slot("crowning", "When was Henry crowned?", "date"), ["Henry was born on 3 May 1390. Henry was crowned on October 13, 1399."], "October 13, 1399"),
    (Slot("siege", "How long did the siege last?"), ["The siege of 1191 went on for 2 years and 11,000 men."], "2"),
    (Slot("skills", "How many skills remained after filtering?"), ["The registry held 5,705 skills; 2,999 remained after filtering."], "2,999"),
    (Slot("report", "Which file holds the report?"), ["The report is in final_report.md and old.md"], "final_report.md"),
    (Slot("surface", "Which API does the gateway expose?"), ["The gateway exposes a typed WebSocket API to apps."], "typed WebSocket API"),
    (Slot("top", "What is the second category?"), ["Top categories: Web Tools (120) and then Data Science (340)."], "Web Tools: 120"),
    (Slot("largest", "What is the largest category?"), ["The category list", "AI & LLMs (287)", "Search Tools (253)", "May (900)"], "AI & LLMs: 287"),
    (Slot("place", "Where did the king go?"), ["The king embarked for Jaffa where he rested."], "Jaffa"),
    (Slot("later", "Where did the king go after the great battle?"), ["The king went to Acre. The great battle was lost. He rested. He sailed for Cyprus."], "Cyprus"),
    (Slot("deal", "What did Saladin offer?"), ["Saladin offered to spare the town in return for gold; he left."], "to spare the town in return for gold"),
    (Slot("towns", "list the towns"), ["He took the towns of Arsuf, Jaffa and Acre."], "Arsuf, Jaffa and Acre"),
    (Slot("tool", "What tool is used?"), ["Nothing here. The tool that is used is Hammer."], "The tool that is used is Hammer."),
    (Slot("started", "When was it released in Dublin?", "date"), ["It started on 1 May 2020. It was released in Dublin on 17 April 2026, after a delay."], "17 April 2026"),
    (Slot("owner", "Who owns it? OWNER_NAME"), ["owner-name =  - Bo -", "owner"], "Bo"),
    (Slot("empty_field"), ["EMPTY FIELD:"], "EMPTY FIELD:"),
    (Slot("nothing", "zebra"), ["unrelated"], ""),
    (Slot("never", "When was the bridge signed?", "date"), ["The bridge was signed some day."], None),
]
TASK_UNITS = ["Proposed Benchmark Tasks", "Log Triage Sprint\nBrief: find it", "Table Join Audit\nBrief: join it", "Roadmap", "Late One Here\nBrief: no"]


def test_typed_answers(spark):
    rows = [(d, k, f"L{k}", t, None) for d, (_, texts, _) in enumerate(TYPED) for k, t in enumerate(texts)]
    units = spark.createDataFrame(rows, "doc_id long, idx long, anchor string, text string, heading string")
    got = {(r.doc_id, r.slot): (r.status, r.value) for r in extract.collected(units, [s for s, _, _ in TYPED]).collect()}
    assert len(got) == len(TYPED) ** 2
    for d, (slot, _, want) in enumerate(TYPED):
        status, value = got[d, slot.id]  # other slots with the same answer demote one
        assert value == (want or "") and (status in ("resolved", "partial") if want else status == ("partial" if want is None else "missing"))


def test_lists_of_sections(spark):
    plain = ["Main Tools", "Claw Hammer", "Hand Saw\nmore of it", "a line that ends.", "Hand Saw", "Comparative Table", "Late One"]
    rows = [(1, k, f"L{k}", t, None) for k, t in enumerate(TASK_UNITS)] + [(2, k, f"L{k}", t, None) for k, t in enumerate(plain)]
    units = spark.createDataFrame(rows, "doc_id long, idx long, anchor string, text string, heading string")
    asked = [Slot("tasks", "Which benchmark tasks are proposed?"), Slot("n_tasks", "How many benchmark tasks are proposed?"), Slot("tools", "list them", aliases=("main tools",)), Slot("n_tools", "number in the list", aliases=("main tools",))]
    got = {(r.doc_id, r.slot): r.value for r in extract.collected(units, asked).collect()}
    assert got[1, "tasks"] == "Log Triage Sprint; Table Join Audit" and got[1, "n_tasks"] == "2"
    assert got[2, "tools"] == "Claw Hammer; Hand Saw; Hand Saw" and got[2, "n_tools"] == "3"


def test_headings_as_expressions(spark):
    lines = ["# One", "1. First steps", "ALL CAPS HERE", "Title Case Words", "Title case words", "2024-01-02", "", "see http://x.y", "Ends With Stop.", "12345 Main 67890", "x" * 141, "4.2 The Rest", "Über Alles"]
    df = spark.createDataFrame([(x,) for x in lines], "t string")
    assert [r[0] for r in df.select(segments.reads_as_heading(F.col("t"))).collect()] == [segments.is_heading(x) for x in lines]


def test_equal_answers_are_demoted(spark):
    units = frame(spark, ["alpha beta gamma are one thing"])
    got = {r.slot: (r.status, r.confidence) for r in extract.collected(units, [Slot("alpha"), Slot("beta"), Slot("gamma"), Slot("zzz")]).collect()}
    assert got == {"alpha": ("partial", 0.6), "beta": ("partial", 0.6), "gamma": ("partial", 0.6), "zzz": ("missing", 0.0)}


def test_odd_inputs(spark):
    assert page_text.readable("<p>a</p><![foo bar]><p>b</p>")[0].split() == ["a", "b"]
    assert flat_yaml("d: 2024-13-45") == "d: 2024-13-45"
    assert profile.hinted(["a_b", "c"], ["--"]) == ["a_b", "c"]
    kinds = {r.name: r.type for r in profile.column_types(spark.createDataFrame([("+5", "", "on 2024/1/2"), ("7", None, "2024-01-02")], "a string, b string, c string")).collect()}
    assert kinds == {"a": "integer", "b": "empty", "c": "date"}
    lines = spark.createDataFrame([("INFORMATION only",), ("a warning here",), ("2024/01/02 10:00:00,5 [x] got 0xff 12345",)], "line string")
    got = [(r.l, r.g) for r in lines.select(profile.level(F.col("line")).alias("l"), profile.signature(F.col("line")).alias("g")).collect()]
    assert [x for x, _ in got] == ["", "WARN", ""] and got[2][1] == "got 0x<hex> <num>"


def test_gate_counts_kinds(spark):
    def told(*files):
        found = gate.measured(spark.createDataFrame([("c", k, n) for k, n in files], "c string, kind string, size long"), "c").withColumn("goal", F.lit("selective_read"))
        return gate.collections(found, "c").first().code

    assert told(("text", 30_000)) == "collection_goal_required"
    assert told(*[("text", 7_000)] * 4, *[("csv", 10)] * 4) == "large_text_collection_boundary"
    assert told(("csv", 10), ("json", 10)) == "collection_goal_required" and told(("csv", 10)) == "small_collection"
