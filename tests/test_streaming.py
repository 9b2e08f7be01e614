"""The streaming forms against the batch folds, expiry by event time, and logs that a replay does not double."""

import datetime as dt

import pytest
from gleaner.streaming import episodes, ready, sinks
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def parts(df, path, n):
    """df as n files in time order, which a stream of one file a trigger reads one after the other."""
    rows = df.orderBy("ts", "event_id").collect()
    for k in range(n):
        some = df.sparkSession.createDataFrame(rows[len(rows) * k // n : len(rows) * (k + 1) // n], df.schema)
        some.coalesce(1).write.mode("append").parquet(f"{path}/{k:03d}")
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def gathered(stream, tmp):
    query = sinks.logged(stream, f"{tmp}/log", f"{tmp}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return sinks.log(stream.sparkSession, f"{tmp}/log", ", ".join(f"{n} {t}" for n, t in stream.dtypes)).drop("batch_id")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_episodes_stream_as_they_fold(rocks, tmp_path):
    events = episodes.rendered(rocks.read.parquet(f"{SF}/events.parquet")).withColumn("ts", F.col("ts").cast("timestamp"))
    got = rows_of(gathered(episodes.streamed(parts(events, str(tmp_path / "in"), 3)), tmp_path))
    want = rows_of(episodes.folded(events))
    assert got == want and len(want) == events.count()


def told(spark, *events):
    """Rows after each event (kind and what it says) of one conversation."""
    rows = [(k, START + dt.timedelta(minutes=k), kind, said) for k, (kind, said) in enumerate(events)]
    df = spark.createDataFrame([(None, i, t, kind, *[said.get(c) for c in episodes.TEXTS[2:]]) for i, t, kind, said in rows], "conversation string, event_id long, ts timestamp, kind string, " + ", ".join(f"{c} string" for c in episodes.TEXTS[2:]))
    return [(r.number, r.status) for r in episodes.folded(df).orderBy("event_id").collect()]


def test_episode_rules(spark):
    bind = lambda scope, **said: ("bind", {"scope": scope, "turn": "1", **said})
    assert told(spark, ("read", {}), bind("/a"), bind("/a/b"), bind("/ab")) == [(0, "none"), (1, "open"), (1, "open"), (2, "open")]
    ready_ = ("ready", {"scope": "/a/b", "closure": "c"})
    assert told(spark, bind("/a"), ready_, bind("/a", goal="edit_or_execute"), bind("/a", relation="switch")) == [(1, "open"), (1, "evidence_ready"), (1, "open"), (2, "open")]
    assert told(spark, bind("/a"), ready_, ("output", {}), bind("/a"), ready_) == [(1, "open"), (1, "evidence_ready"), (1, "resolved"), (2, "open"), (2, "evidence_ready")]
    assert told(spark, bind("/a"), ready_, ("output", {}), bind("/a", relation="continue"), ("final", {}), ("end", {}), bind("/a")) == [(1, "open"), (1, "evidence_ready"), (1, "resolved"), (1, "evidence_ready"), (1, "resolved"), (1, "none"), (2, "open")]
    assert told(spark, bind("/a", relation="new"), bind("/a", relation="new"), bind("/a", relation="new", turn="2")) == [(1, "open"), (1, "open"), (2, "open")]
    assert told(spark, bind("/a", code=episodes.DISCOVERY), bind("/a", turn="2"), bind("/a/x")) == [(1, "open"), (1, "open"), (2, "open")]


def test_one_long_conversation_is_one_state(spark):
    events = spark.range(60_000).select(F.lit("hot").alias("conversation"), F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), F.when(F.col("id") % 2 == 0, "bind").otherwise("ready").alias("kind"), *[F.lit("/a" if c == "scope" else "").alias(c) for c in episodes.TEXTS[2:]])
    got = episodes.folded(events).agg(F.count("*"), F.max("number"), F.count_if(F.col("status") == "evidence_ready")).first()
    assert tuple(got) == (60_000, 1, 59_999)


def cached(spark, *events):
    rows = [("c", k, START + dt.timedelta(hours=h), kind, path) for k, (h, kind, path) in enumerate(events)]
    return spark.createDataFrame(rows, "conversation string, event_id long, ts timestamp, kind string, path string")


def test_cache_rules(spark):
    df = cached(spark, (0, "put", "/a/"), (1, "ask", "/a/b"), (2, "claim", "/x"), (3, "claim", "/x"), (24, "ask", "/a"), (26, "claim", "/x"), (27, "put", "/p/q"), (27, "drop", "/p"), (27, "ask", "/p/q"), (28, None, "/a"), (28, "put", None))
    got = [(r.granted, r.answer) for r in ready.folded(df).orderBy("event_id").collect()]
    assert got == [(True, None), (None, "/a"), (True, None), (False, None), (None, None), (True, None), (True, None), (None, None), (None, None), (None, None), (None, None)]
    many = cached(spark, *[(0, "put", f"/{k}") for k in range(5)], (0, "put", "/3"), (1, "ask", "/2"), (1, "ask", "/3"))
    assert [(r.answer, r.held) for r in ready.folded(many, most=2).orderBy("event_id").collect()][-2:] == [(None, 2), ("/3", 2)]
    assert ready.folded(many.where("false")).collect() == []


def test_cache_streams_as_it_folds(rocks, tmp_path):
    events = ready.rendered(rocks.read.parquet(f"{SF}/events.parquet")).withColumn("ts", F.col("ts").cast("timestamp"))
    got = rows_of(gathered(ready.streamed(parts(events, str(tmp_path / "in"), 3), 2 * ready.DAY, 3), tmp_path))
    assert got == rows_of(ready.folded(events, 2 * ready.DAY, 3)) and len(got) == events.count()


def test_expired_entries_leave_the_state(rocks, tmp_path):
    """Time passes with another conversation's events; the entry of the first one is gone by a timer, before anybody asks."""
    first = cached(rocks, (0, "put", "/a"), (1, "ask", "/a"))
    later = first.select(F.lit("other").alias("conversation"), (F.col("event_id") + 10).alias("event_id"), (F.col("ts") + F.expr("interval 40 hours")).alias("ts"), "kind", "path")
    last = first.where("kind = 'ask'").withColumn("ts", F.col("ts") + F.expr("interval 60 hours")).withColumn("event_id", F.lit(20).cast("long"))
    stream = ready.streamed(parts(first.unionByName(later).unionByName(last), str(tmp_path / "in"), 5))
    got = {r.event_id: r.answer for r in gathered(stream, tmp_path).collect()}
    assert got == {0: None, 1: "/a", 10: None, 11: "/a", 20: None}


def test_replayed_batches_are_written_once(rocks, tmp_path):
    events = rocks.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = parts(events, str(tmp_path / "in"), 4)
    write, seen = sinks.append_once(f"{tmp_path}/log"), []

    def killed(batch, batch_id):
        write(batch, batch_id)
        seen.append(batch_id)
        if batch_id == 2 and seen.count(2) == 1:  # after the batch was written, before it is committed
            raise RuntimeError("lost")

    for _ in range(2):
        query = stream.writeStream.foreachBatch(killed).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception as lost:
            assert "lost" in str(lost)
    assert seen == [0, 1, 2, 2, 3]
    kept = sinks.log(rocks, f"{tmp_path}/log", ", ".join(f"{n} {t}" for n, t in events.dtypes))
    assert kept.count() == events.count() == kept.select("event_id").distinct().count()
    assert rows_of(sinks.session_summary(sinks.rendered(kept))) == rows_of(sinks.session_summary(sinks.rendered(events)))
