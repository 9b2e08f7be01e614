"""Slots: questions with a field to look for, their answers and the state of a document's answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: At least so many slots before equal answers at one anchor count as suspicious.
DEMOTE_FROM = 3


def answers(docs: DataFrame, found: DataFrame, names: Sequence[str]) -> DataFrame:
    """doc_id, slot, value, idx, status of every document and slot: the first field line of that name.

    found: rows of units.fields(); slots are a few names of a request, so each document becomes that many rows."""
    asked = docs.select("doc_id", F.explode(F.array(*[F.lit(n) for n in names])).alias("slot"))
    first = found.where(F.col("name").isin(*names)).groupBy("doc_id", F.col("name").alias("slot")).agg(F.min(F.struct("idx", "value")).alias("a"))
    out = asked.join(first, ["doc_id", "slot"], "left").select("doc_id", "slot", F.col("a.value").alias("value"), F.col("a.idx").alias("idx"))
    return out.withColumn("status", F.when(F.col("value").isNull(), "missing").when(F.trim("value") == "", "partial").otherwise("resolved"))


def demoted(found: DataFrame) -> DataFrame:
    """Resolved answers of a document that are equal, short and no numbers become partial if they share a line."""
    plain = F.lower(F.regexp_replace("value", "[ \t]+", " "))
    may = (F.col("status") == "resolved") & ~F.col("value").rlike("^[0-9.,]+$") & (F.length("value") <= 120)
    mates = F.count(F.when(may, 1)).over(W.partitionBy("doc_id", plain, "idx"))
    many = F.count("*").over(W.partitionBy("doc_id"))
    return found.withColumn("status", F.when(may & (mates >= 2) & (many >= DEMOTE_FROM), "partial").otherwise(F.col("status")))


def status(found: DataFrame) -> DataFrame:
    """doc_id, n_resolved, n_slots, status: ready, needs_verify or needs_refine."""
    ok = F.col("status") == "resolved"
    out = found.groupBy("doc_id").agg(F.count_if(ok).alias("n_resolved"), F.count("*").alias("n_slots"), F.bool_and(ok).alias("every"), F.bool_and(ok | (F.col("status") == "partial")).alias("some"))
    return out.select("doc_id", "n_resolved", "n_slots", F.when(F.col("every"), "ready").when(F.col("some"), "needs_verify").otherwise("needs_refine").alias("status"))
