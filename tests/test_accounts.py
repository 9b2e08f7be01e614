"""Small accounts on odd inputs."""

from gleaner.operators import accounts
from pyspark.sql import functions as F


def test_accounts(spark):
    rows = [(1.0, 0.0, 3.0, 1.0), (1.0, None, 1.0, 1.0), (None, 0.5, 1.0, 1.0), (1.0, 0.0, 0.0, 0.0), (1.0, 0.5, None, None), (None, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, j double, wa double, wj double")
    assert [r[0] for r in df.select(accounts.combined(*map(F.col, df.columns))).collect()] == [0.75, 1.0, 0.5, 0.5, 0.75, None]
    maps = spark.createDataFrame([({"a": "1", "b": "x", "c": "3"},), ({},), (None,), ({"a": "none"},)], "m map<string, string>")
    assert [r[0] for r in maps.select(accounts.mean_of(F.col("m"))).collect()] == [2.0, None, None, None]
    said = spark.createDataFrame([("5",), ("x",), (None,), ("-9",), ("999",)], "s string")
    assert [r[0] for r in said.select(accounts.bounded(F.col("s"), 7, 1, 100)).collect()] == [5, 7, 7, 1, 100]
    assert [r[0] for r in spark.createDataFrame([(10, 4), (0, 4), (4, 10)], "f int, t int").select(accounts.saved(F.col("f"), F.col("t"))).collect()] == [0.6, 0.0, 0.0]


def test_keys_and_sets(spark):
    pairs = spark.createDataFrame([(1, "a.b.c"), (1, "a.b.d"), (2, "a.b"), (2, "a.c.d"), (3, "plain"), (4, None)], "g int, key string")
    assert sorted((r.g, r.short) for r in accounts.shortened(pairs, "g", "key").collect() if r.g < 4) == [(1, "c"), (1, "d"), (2, "a.b"), (2, "a.c.d"), (3, "plain")]
    sets = spark.createDataFrame([(["b", "a"], ["b"]), (None, ["x"]), ([], None)], "need array<string>, got array<string>")
    got = [(r.pending, r.common, r.either, r.met) for r in accounts.compared(sets, "need", "got").collect()]
    assert got == [(["a"], ["b"], ["a", "b"], True), ([], [], ["x"], False), ([], [], [], False)]
