"""Scores, ranks and budgets: which units answer a request, and which needles nothing answers.

Requests are small tables made on the driver from what a user asks; they are broadcast.  Units stay where they are:
scores and the first cut to the best per request are computed per task, before any shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .units import anchor

MOST_REQUESTS = 10_000
PASSAGE_WORDS = 5
MOST_PASSAGES = 200_000


def requests(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """request_id, needles, must_keep, want, budget."""
    if len(rows) > MOST_REQUESTS:
        raise ValueError(f"more than {MOST_REQUESTS} requests at once")
    return spark.createDataFrame(rows, "request_id string, needles array<string>, must_keep array<string>, want string, budget int")


def scores(units: DataFrame, asked: DataFrame) -> DataFrame:
    """request_id, doc_id, idx, line, budget, score (> 0): 2 for a needle found, 4 if it must be kept, 0.8 for a wanted number."""
    low = F.lower(F.col("line"))
    points = F.aggregate("needles", F.lit(0.0), lambda acc, n: acc + F.when(low.contains(F.lower(n)), F.when(F.array_contains("must_keep", n), 4.0).otherwise(2.0)).otherwise(0.0))
    bonus = F.when(F.col("want").isin("count", "fact") & F.col("line").rlike("[0-9]"), 0.8).otherwise(0.0)
    pairs = units.join(F.broadcast(asked), F.exists("needles", lambda n: low.contains(F.lower(n))))
    return pairs.select("request_id", "doc_id", "idx", "line", "budget", (points + bonus).alias("score"))


def top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each request, ties in document order."""
    by = W.partitionBy("request_id").orderBy(F.desc("score"), "doc_id", "idx")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def cards(ranked: DataFrame) -> DataFrame:
    return ranked.select("request_id", "rank", "doc_id", anchor(F.col("idx"), F.col("idx")).alias("anchor"), "score", F.length("line").cast("long").alias("n_chars"))


def picked(ranked: DataFrame, most: int = 12) -> DataFrame:
    """request_id, n_picked, used, anchors: best first, blocks that overflow the budget are passed over; the first always stays."""
    cost = F.length(anchor(F.col("idx"), F.col("idx"))) + F.length("line") + 32
    name = F.concat(F.col("doc_id").cast("string"), F.lit(":"), anchor(F.col("idx"), F.col("idx")))
    blocks = ranked.groupBy("request_id", "budget").agg(F.array_sort(F.collect_list(F.struct("rank", cost.alias("cost"), name.alias("name")))).alias("blocks"))
    start = F.struct(F.array().cast("array<string>").alias("p"), F.lit(0).alias("u"))

    def step(acc: Column, b: Column) -> Column:
        fits = (F.size(acc["p"]) < most) & (acc["u"] < F.col("budget")) & ((F.size(acc["p"]) == 0) | (acc["u"] + b["cost"] <= F.col("budget")))
        return F.struct(F.when(fits, F.concat(acc["p"], F.array(b["name"]))).otherwise(acc["p"]).alias("p"), F.when(fits, acc["u"] + b["cost"]).otherwise(acc["u"]).alias("u"))

    done = blocks.withColumn("d", F.aggregate("blocks", start, step))
    return done.select("request_id", F.size("d.p").cast("long").alias("n_picked"), F.col("d.u").cast("long").alias("used"), F.array_join("d.p", ",").alias("anchors"))


def unresolved(units: DataFrame, asked: DataFrame) -> DataFrame:
    """request_id, needle of needles that no line contains.  One flag per needle and task is all that is shuffled."""
    wanted = asked.select("request_id", F.explode("needles").alias("needle"))
    low = F.lower(F.col("line"))
    seen = units.join(F.broadcast(wanted), low.contains(F.lower("needle"))).groupBy("request_id", "needle").agg(F.lit(1).alias("n"))
    return wanted.join(seen, ["request_id", "needle"], "left_anti").distinct()


def contained(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """doc_id, item_id where the text contains the passage.

    Passages of seven words or more meet texts on their second to sixth word, which are whole words in any text that holds
    the passage; only those pairs are compared.  Shorter passages are broadcast and compared with every text."""
    words = lambda c: F.filter(F.split(c, BLANK_RUN), lambda w: w != "")
    keyed = passages.select("item_id", F.col("text").alias("passage"), words("text").alias("w")).where("passage <> ''")
    long = keyed.where(F.size("w") >= PASSAGE_WORDS + 2).select("item_id", "passage", F.xxhash64(F.array_join(F.slice("w", 2, PASSAGE_WORDS), " ")).alias("key"))
    short = keyed.where(F.size("w") < PASSAGE_WORDS + 2).select("item_id", "passage")
    n = long.count()
    keys = long.select("key").distinct()
    grams = docs.select("doc_id", words("text").alias("w")).where(F.size("w") >= PASSAGE_WORDS)
    grams = grams.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - PASSAGE_WORDS + 1), lambda i: F.xxhash64(F.array_join(F.slice("w", i, PASSAGE_WORDS), " "))))).alias("key"))
    hint = (lambda df: F.broadcast(df)) if n <= MOST_PASSAGES else (lambda df: df)
    near = grams.join(hint(keys), "key", "left_semi").join(hint(long.select("key", "item_id")), "key").select("doc_id", "item_id").distinct()
    hits = near.join(docs.select("doc_id", "text"), "doc_id").join(hint(passages.select("item_id", F.col("text").alias("passage"))), "item_id").where(F.col("text").contains(F.col("passage")))
    out = hits.select("doc_id", "item_id")
    few = short.limit(MOST_PASSAGES + 1).count()
    if few:
        if few > MOST_PASSAGES:
            raise ValueError(f"more than {MOST_PASSAGES} passages of fewer than {PASSAGE_WORDS + 2} words")
        out = out.unionByName(docs.join(F.broadcast(short), F.col("text").contains(F.col("passage"))).select("doc_id", "item_id"))
    return out


BLANK_RUN = "[ \t\r\n\f\x0b]+"
