"""Accounts of events and tokens, and reading episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .profile import tokens


def trace(events: DataFrame) -> DataFrame:
    """user_id, n_events, n_errors, n_views, kinds (sorted), first_id, last_id."""
    kinds = F.array_join(F.array_sort(F.collect_set("event_type")), ",")
    one = lambda k: F.count_if(F.col("event_type") == k)
    return events.groupBy("user_id").agg(F.count("*").alias("n_events"), one("error").alias("n_errors"), one("view").alias("n_views"), kinds.alias("kinds"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


def savings(docs: DataFrame, units: DataFrame) -> DataFrame:
    """lang, source, full, evidence, n: estimated tokens of texts and of their evidence (lines with a number), with subtotals.

    units: lines of docs.  A text's lines meet in their own aggregation, so texts themselves are not shuffled."""
    evidence = units.where(F.col("line").rlike("[0-9]")).groupBy("doc_id").agg(F.sum(tokens(F.length("line").cast("long"))).alias("e"))
    each = docs.select("doc_id", "lang", "source", tokens(F.length("text").cast("long")).alias("f")).join(evidence, "doc_id", "left")
    return each.rollup("lang", "source").agg(F.sum("f").alias("full"), F.coalesce(F.sum("e"), F.lit(0)).alias("evidence"), F.count("*").alias("n"))


def by_label(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """quality, toxic, n, n_chars of labelled documents."""
    return docs.select("doc_id", F.length("text").cast("long").alias("c")).join(labels, "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.sum("c").alias("n_chars"))


def episodes(events: DataFrame) -> DataFrame:
    """user_id, episode, n_events, n_after_ready, state of each user's episodes, by windows over events in time order.

    signup opens an episode, purchase makes it ready, error reopens it; anything else counts against a ready one.  The state
    machine of reading episodes is in gleaner.streaming.episodes."""
    by = W.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.col("event_type")
    told = F.when(kind.isin("signup", "error"), "open").when(kind == "purchase", "ready")
    state = F.coalesce(F.last(told, ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0)), F.lit("open"))
    each = events.select("user_id", "ts", "event_id", "event_type", F.sum((kind == "signup").cast("int")).over(by).cast("int").alias("episode"), state.alias("state"))
    late = (F.lag("state", 1, "open").over(by) == "ready") & told.isNull()
    each = each.withColumn("late", late.cast("int"))
    return each.groupBy("user_id", "episode").agg(F.count("*").alias("n_events"), F.sum("late").alias("n_after_ready"), F.max(F.struct("ts", "event_id", "state"))["state"].alias("state"))
