"""Reads of tables: which columns and rows a request is about, whether it gets the whole table, and what fits its budget.

A request is known when the plan is made; the table may be of any size.  Columns are chosen from the header, so the scan reads
no others; scores are expressions; the best rows come from a top-k, and only those meet in one place for the budget.

Defined cases: a request without terms gets all columns, and the table's first rows (by the given order) when it is a scout; no
matching column means all columns; null cells are empty texts; equal rows of one anchor count once; an empty table gives no rows;
tables beyond the small size are never given whole, however they are asked for.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relevance import Request

#: Words that tell nothing, columns that give context, rows of a small table, phrases that ask for all of it.
STOP_WORDS = {"the", "and", "with", "from", "that", "this", "find", "get", "all", "for", "sheet", "sheets"}
SMALL, BLOCKS, TRIED, FIRST = 30, 8, 40, 3
WHOLE = ("all rows", "all data", "all records", "complete data", "complete records", "data rows", "remaining rows", "remaining records", "entire sheet", "full sheet", "all expense records")
CONTEXT = {"id", "name", "date", "time", "region", "category", "type", "product"}


def bare(word: str) -> str:
    return re.sub("[^a-z0-9]+", "", word.lower())


def terms(request: Request) -> list[str]:
    """Needles, kept words and the goal's first twenty tokens, lowered, without words that tell nothing."""
    every = (t.lower().strip() for t in (*request.needles, *request.must_keep, *re.findall(r"[A-Za-z0-9_./:-]{3,}", request.goal)[:20]))
    return [t for t in every if t and t not in STOP_WORDS]


def columns(header: Sequence[str], request: Request) -> list[str]:
    """Columns that a term names, or that name a term; a single one is joined by the first that gives context; all without any."""
    words = [w for w in map(bare, terms(request)) if w]
    hit = [h for h in header if bare(h) and any(w in bare(h) or bare(h) in w for w in words)]
    if len(hit) == 1:
        hit += [h for h in header if h not in hit and bare(h) in CONTEXT][:1]
    return [h for h in header if h in hit] if hit else list(header)


def asks_for_all(request: Request) -> bool:
    said = " ".join([request.goal, *request.needles]).lower()
    return any(p in said for p in WHOLE) or re.search(r"\ball\s+\d+\s+[\w\s-]{0,40}\b(?:rows|records)\b", said) is not None


def whole(df: DataFrame, request: Request, mode: str) -> bool:
    """Whether a small table is given whole.  Counts at most one row more than a small table has."""
    phrase = asks_for_all(request)
    if not (phrase or request.want in ("table", "list")) or not (mode in ("focus", "refine") or (mode == "scout" and phrase)):
        return False
    return 0 < df.limit(SMALL + 1).count() <= SMALL


def scored(df: DataFrame, request: Request, order: Sequence[str]) -> DataFrame:
    """line, text, score of rows: name=value pairs of the chosen columns, two points a term, half a point for a figure."""
    cell = lambda c: F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("")))
    text = F.concat_ws(" | ", *[cell(c) for c in columns(df.columns, request)])
    low = F.lower(F.concat_ws(" | ", *[cell(c) for c in df.columns]))
    points = reduce(lambda n, t: n + F.when(low.contains(t), 2.0).otherwise(0.0), terms(request), F.lit(0.0))
    figure = F.when(F.regexp_replace(low, "[^ |]*=", " ").rlike(r"\b[0-9]+(?:[.,][0-9]+)?\b"), 0.5).otherwise(0.0)
    return df.select(*[F.col(c).alias(f"_{k}") for k, c in enumerate(order)], text.alias("text"), points.alias("hits"), (points + figure).alias("score"))


def read(df: DataFrame, request: Request, order: Sequence[str], mode: str = "focus", budget: int = 3_500) -> DataFrame:
    """rank, text, score: the whole of a small table that is asked for, else the best rows that fit the budget, else the first ones.

    order: columns that tell rows apart and order them."""
    keys = [f"_{k}" for k in range(len(order))]
    found = scored(df, request, order)
    if whole(df, request, mode):
        rows = found.orderBy(*keys).limit(SMALL)
        gathered = rows.agg(F.array_sort(F.collect_list(F.struct(*keys, "text"))).alias("b"))
        return gathered.select(F.posexplode("b").alias("at", "x")).select((F.col("at") + 1).alias("rank"), "x.text", F.lit(1.0).alias("score"))
    best = found.where("hits > 0").orderBy(F.desc("score"), *keys).limit(TRIED)
    first = found.orderBy(*keys).limit(FIRST).withColumn("score", F.lit(0.1))
    # the first rows count only where none is hit
    tried = best.withColumn("kind", F.lit(0)).unionByName(first.withColumn("kind", F.lit(1))).select("kind", (-F.col("score")).alias("s"), *keys, "text", "score", (F.length("text") + 38).alias("cost"))
    listed = tried.agg(F.array_sort(F.collect_list(F.struct("kind", "s", *keys, "text", "score", "cost"))).alias("b"))  # TRIED + FIRST rows
    listed = listed.select(F.filter("b", lambda x: x["kind"] == F.col("b")[0]["kind"]).alias("b"))
    kind = listed.schema["b"].dataType.simpleString()

    def step(acc, x):
        again = F.exists(acc["p"], lambda p: p["text"] == x["text"])
        fits = (acc["u"] < budget) & ~again & ((F.size(acc["p"]) == 0) | (acc["u"] + x["cost"] <= budget))
        return F.struct(F.when(fits, F.concat(acc["p"], F.array(x))).otherwise(acc["p"]).alias("p"), F.when(fits, acc["u"] + x["cost"]).otherwise(acc["u"]).alias("u"))

    picked = F.slice(F.aggregate("b", F.struct(F.array().cast(kind).alias("p"), F.lit(0).alias("u")), step)["p"], 1, BLOCKS)
    return listed.select(F.posexplode(picked).alias("at", "x")).select((F.col("at") + 1).alias("rank"), "x.text", "x.score")


def next_request(request: Request, structured: bool = True) -> Request:
    """The narrower request that follows one that was not answered."""
    return Request(request.goal, request.needles[: 6 if structured else 10], request.must_keep, request.want)
