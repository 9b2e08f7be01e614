"""Cards of odd objects."""

from gleaner.operators import cards


def test_log_cards(spark):
    rows = [(1, k, f"2024-01-01 00:00:0{k % 10} [x] WARNING disk {k * 1000} 0xff") for k in range(20)] + [(2, 0, None), (2, 1, "plain"), (2, 2, "plain"), (3, 0, "CRITICAL " + "y" * 400)]
    got = {r.doc_id: r for r in cards.logs(spark.createDataFrame(rows, "doc_id int, idx long, line string")).collect()}
    assert got[1].n_lines == 20 and got[1].levels == {"WARN": 20} and len(got[1].notable) == cards.LINES and got[1].notable[1].line == 2 and got[1].samples is None
    assert [(r.sign, r.n) for r in got[1].repeated] == [("WARNING disk <num> 0x<hex>", 19)]
    assert got[2].levels == {} and got[2].notable is None and got[2].samples == ["", "plain", "plain"] and [(r.sign, r.n) for r in got[2].repeated] == [("plain", 2)]
    assert got[3].notable[0].text.endswith("[clipped]...") and cards.logs(spark.createDataFrame([], "doc_id int, idx long, line string")).collect() == []


def test_text_and_collection_cards(spark):
    units = spark.createDataFrame([(1, k, f"L{k}", f"unit {k}", f"h{k % 15}" if k else None) for k in range(40)], "doc_id int, idx int, anchor string, text string, heading string")
    card = cards.texts(units).first()
    assert card.n_units == 40 and card.headings == [f"h{k}" for k in range(1, 13)] and [s.anchor for s in card.samples] == [f"L{k}" for k in range(5)]
    items = spark.createDataFrame([("c", f"f{k}", None if k == 3 else "md", None if k == 4 else k) for k in range(20)], "collection string, name string, kind string, size long")
    card = cards.collections(items).first()
    assert card.kinds == {"": 1, "md": 19} and card.n_bytes == sum(range(20)) - 4 and card.notable == [f"f{k}" for k in range(19, 7, -1)]


def test_table_cards_and_actions(spark):
    df = spark.createDataFrame([(1, "ok", None), (2, "error", ""), (3, "ok", None)], "id int, state string, note string")
    card = cards.table(df, ["id"]).first()
    assert card.n_rows == 3 and card.columns == {"id": "integer", "note": "empty", "state": "string"} and card.samples == ["1,ok,", "2,error,", "3,ok,"] and card.signals == {"state": ["error"]}
    modes = spark.createDataFrame([("native", False), ("native", True), ("force", False)], "mode string, large boolean")
    assert [r.allowed[1] for r in cards.next_actions(modes).collect()] == ["native", "read_with_goal", "read_with_goal"]
