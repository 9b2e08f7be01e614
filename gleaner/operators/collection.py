"""Collections: which of their files a request is about, told from names and snippets, and whole texts of those alone.

Ranking reads metadata and snippets.  Texts are read afterwards, for the chosen keys only: a bounded set of keys goes into the
scan as a filter on the key (files, partitions and row groups without one are not read), a larger one is met by a semi-join.

Defined cases: a request without telling terms, or that no item answers, gets the first eight items by name at a low score; null
names and snippets are empty; items of equal score go by name; an item is named by its collection and name; extra columns stay
on texts; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Words that tell nothing, words of a goal that wants a digest, terms of a request, items without a hit.
STOP_WORDS = ("the", "and", "for", "with", "from", "that", "this", "into", "need", "find", "search", "email", "emails", "folder", "everything", "related", "all", "about", "create", "summary", "summarize", "report")
DIGEST = ("assess", "assessment", "analysis", "analyze", "calculate", "audit", "integrity", "consistency", "cross-reference", "bug", "bugs", "regression", "diagnose", "diagnosis", "investigate", "root cause", "cross-file", "configuration", "config", "log", "metrics", "rules")
TERMS, FIRST = 18, 8
#: Keys that go into a scan as a filter.
MOST_KEYS = 10_000


def said(goal: str = "goal", needles: str = "needles", must_keep: str = "must_keep") -> Column:
    none = F.array().cast("array<string>")
    return F.lower(F.concat_ws(" ", F.coalesce(goal, F.lit("")), F.array_join(F.coalesce(needles, none), " "), F.array_join(F.coalesce(must_keep, none), " ")))


def terms(text: Column) -> Column:
    """Telling tokens of a lowered text; plain plurals are followed by their singular."""
    told = F.filter(F.regexp_extract_all(text, F.lit("[a-z0-9_./:-]{3,}"), F.lit(0)), lambda t: ~t.isin(*STOP_WORDS))
    both = F.transform(told, lambda t: F.when(t.endswith("s") & (F.length(t) > 4), F.array(t, F.regexp_replace(t, "s$", ""))).otherwise(F.array(t)))
    return F.slice(F.flatten(both), 1, TERMS)


def wants_digest(text: Column) -> Column:
    return text.rlike("|".join(DIGEST))


def ranked(items: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """request_id, collection, name, rank, score: a request's k best items.

    items: collection, name, subject, about (what else is known of it).  asked: request_id, collection, goal, needles, must_keep."""
    wanted = asked.select("request_id", "collection", terms(said()).alias("terms"))
    met = items.select("collection", "name", F.lower(F.concat_ws("\n", "name", "subject")).alias("head"), F.lower(F.coalesce("about", F.lit(""))).alias("rest")).join(wanted, "collection")
    hit = lambda t: F.when(F.col("head").contains(t), 3.0).when(F.col("rest").contains(t), 1.5).otherwise(0.0)
    met = met.withColumn("score", F.aggregate("terms", F.lit(0.0), lambda n, t: n + hit(t)))
    of = W.partitionBy("request_id", "collection")
    none = F.max("score").over(of) <= 0
    place = F.row_number().over(of.orderBy(F.desc("score"), "name"))
    out = met.withColumn("none", none).withColumn("rank", place).where((F.col("rank") <= k) & ((F.col("score") > 0) | (F.col("none") & (F.col("rank") <= FIRST))))
    return out.select("request_id", "collection", "name", "rank", F.when(F.col("none"), 0.1).otherwise(F.col("score")).alias("score"))


def named(items: DataFrame, asked: DataFrame) -> DataFrame:
    """request_id, collection, name of items whose name a needle or kept word is or holds."""
    none = F.array().cast("array<string>")
    words = asked.select("request_id", "collection", F.explode(F.array_distinct(F.concat(F.coalesce("needles", none), F.coalesce("must_keep", none)))).alias("word")).where("trim(word) <> ''")
    met = items.where("name <> ''").select("collection", "name").join(words, "collection").where(F.col("word").contains(F.col("name")))
    return met.select("request_id", "collection", "name").distinct()


def only(df: DataFrame, key: str, chosen: DataFrame, most: int = MOST_KEYS) -> DataFrame:
    """df's rows of the chosen keys (a column of the same name): by a filter that the scan takes over, up to `most` keys."""
    keys = [r[0] for r in chosen.select(key).where(F.col(key).isNotNull()).distinct().limit(most + 1).collect()]
    return df.where(F.col(key).isin(keys)) if len(keys) <= most else df.join(chosen.select(key).distinct(), key, "left_semi")


def texts_of(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """path, text of the given files, and of no others."""
    if not paths:
        return spark.createDataFrame([], "path string, text string")
    raw = spark.read.text(list(paths), wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))
