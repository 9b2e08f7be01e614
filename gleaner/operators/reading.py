"""The read: a table of requests against documents, from raw texts and raw requests to budgeted evidence and what stays open.

Each request names a document.  Texts are cleaned and cut into units, requests are parsed and repaired, and both meet on the document's
id.  A request goes one of three ways: an overview, where a scout asks for nothing; a section, where a goal asks for one and a
term finds its beginning; else the best units by score, or the first five at a low one.  Blocks are taken in order while they
fit the request's budget, and needles that the taken blocks do not answer stay open.

The rules are those of relevance.py, there for one request that is known when the plan is made; here requests are rows, so
terms are arrays and nothing of the plan grows with their number.

Defined cases: a request for a document that is not there, or has no units, gives a row without blocks and with all needles open;
a null mode is focus, a null budget that of the mode; a request's id and document name it, so both together are given once; a document's units
stand in one row while blocks are chosen, so one document is the bound; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import denoise, requests, segments
from .relevance import BUDGETS, LIST_ITEM, OVERVIEW, SECTION_GOALS, STOP_WORDS, TOKEN, clipped

#: Blocks of an overview and of other reads, characters of an overview, units of a section.
FEW, MANY, OVERVIEW_CHARS, SECTION = 4, 12, 1400, 10
ASKED = ("goal", "needles", "want", "scope", "must_keep")


def _lower(items: Column) -> Column:
    return F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.lower(x))


def with_terms(asked: DataFrame) -> DataFrame:
    """asked with its terms (terms, kept, section_terms) and its budget."""
    goal = F.regexp_extract_all(F.lower(F.coalesce("goal", F.lit(""))), F.lit(TOKEN + "{3,}"), F.lit(0))
    said = F.concat(_lower(F.col("needles")), _lower(F.col("must_keep")))
    names = F.filter(F.array_distinct(F.transform(said, lambda x: F.trim(x))), lambda x: (F.length(x) >= 4) & ~x.rlike(r"^[0-9.\s-]+$"))
    mode = F.coalesce("mode", F.lit("focus"))
    usual = F.coalesce(*[F.when(mode == m, n) for m, n in BUDGETS.items()], F.lit(BUDGETS["focus"]))
    return asked.select(
        "request_id", "doc_id", mode.alias("mode"), F.greatest(F.lit(200), F.coalesce(F.col("budget").cast("int"), usual)).alias("budget"), "want", "needles",
        F.filter(F.concat(said, F.slice(goal, 1, 8)), lambda t: t != "").alias("terms"), _lower(F.col("must_keep")).alias("kept"), F.slice(names, 1, 6).alias("section_terms"),
        ((F.coalesce("scope", F.lit("new")) == "expand") & F.lower("goal").rlike("|".join(SECTION_GOALS))).alias("wants_section"), ((mode == "scout") & (F.size(said) == 0)).alias("wants_overview"),
    )


def _score() -> Column:
    hits = F.aggregate("terms", F.lit(0.0), lambda n, t: n + F.when(F.col("hay").contains(t), F.when(F.array_contains("kept", t), 4.0).otherwise(2.0)).otherwise(0.0))
    figure = F.when(F.col("want").isin("count", "fact") & F.col("text").rlike(r"\b[0-9]+(?:[.,][0-9]+)?\b"), 0.8).otherwise(0.0)
    listed = F.when(F.col("text").rlike(LIST_ITEM) | F.col("hay").contains("suggested metrics"), 0.4).otherwise(0.0)
    return hits + figure + listed + F.when(F.coalesce("heading", F.lit("")) != "", 0.3).otherwise(0.0)


def candidates(asked: DataFrame, units: DataFrame) -> DataFrame:
    """A row for each block that a request may take: way, budget, first (its order, then idx), idx, anchor, text, score."""
    met = with_terms(asked).join(units.select("doc_id", "idx", "anchor", F.coalesce("text", F.lit("")).alias("text"), "heading"), "doc_id")
    met = met.withColumn("hay", F.lower(F.concat_ws("\n", F.coalesce("heading", F.lit("")), "text"))).withColumn("score", _score())
    of = W.partitionBy("request_id", "doc_id")
    begins = F.when(F.col("wants_section") & F.exists("section_terms", lambda t: F.col("hay").contains(t)), F.col("idx"))
    met = met.withColumn("start", F.min(begins).over(of)).withColumn("none", F.max("score").over(of) <= 0)
    way = F.when(F.col("wants_overview"), "overview").when(F.col("start").isNotNull(), "section").otherwise("scored")
    named = F.col("hay").rlike("|".join(OVERVIEW))
    offset = F.col("idx") - F.col("start")
    stays = F.when(way == "overview", named | (F.col("idx") < 3)).when(way == "section", offset.between(0, SECTION - 1)).otherwise((F.col("score") > 0) | (F.col("none") & (F.col("idx") < 5)))
    score = F.when(way == "overview", 0.2).when(way == "section", F.when(offset == 0, 8.0).otherwise(F.greatest(F.lit(1.0), 7.0 - offset * 0.4))).otherwise(F.when(F.col("none"), 0.1).otherwise(F.col("score")))
    first = F.when(way == "overview", F.when(named, 0.0).otherwise(1.0)).when(way == "section", 0.0).otherwise(-F.round("score", 6))
    text = F.when(way == "overview", clipped(F.col("text"), 360)).when((way == "scored") & F.col("none"), clipped(F.col("text"), 700)).otherwise(clipped(F.col("text"), 900))
    return met.where(stays).select("request_id", "doc_id", "budget", way.alias("way"), first.alias("first"), "idx", "anchor", text.alias("text"), F.round(score, 4).alias("score"))


def chosen(found: DataFrame) -> DataFrame:
    """request_id, doc_id, way, n_candidates, blocks (idx, anchor, text, score) in the order in which they were taken."""
    cost = (F.length("anchor") + F.length("text") + 32).alias("cost")
    gathered = found.groupBy("request_id", "doc_id", "way", "budget").agg(F.array_sort(F.collect_list(F.struct("first", "idx", "anchor", "text", "score", cost))).alias("b"))
    most = F.when(F.col("way") == "overview", F.least(F.col("budget"), F.lit(OVERVIEW_CHARS))).otherwise(F.col("budget"))
    rows = gathered.withColumn("most", most).withColumn("many", F.when(F.col("way") == "overview", FEW).otherwise(MANY))
    kind = rows.schema["b"].dataType.simpleString()
    start = F.struct(F.array().cast(kind).alias("p"), F.lit(0).alias("used"), F.lit(False).alias("over"))

    def step(acc: Column, x: Column) -> Column:
        empty = F.size(acc["p"]) == 0
        room = (acc["used"] < F.col("most")) & (F.size(acc["p"]) < F.col("many")) & ~acc["over"]
        fits = empty | (acc["used"] + x["cost"] <= F.col("most"))
        # a section ends where it overflows; other blocks are passed over
        over = acc["over"] | ((F.col("way") == "section") & ~fits)
        taken = room & fits
        return F.struct(F.when(taken, F.concat(acc["p"], F.array(x))).otherwise(acc["p"]).alias("p"), F.when(taken, acc["used"] + x["cost"]).otherwise(acc["used"]).alias("used"), over.alias("over"))

    picked = F.transform(F.aggregate("b", start, step)["p"], lambda x: F.struct(x["idx"].alias("idx"), x["anchor"].alias("anchor"), x["text"].alias("text"), x["score"].alias("score")))
    return rows.select("request_id", "doc_id", "way", F.size("b").alias("n_candidates"), picked.alias("blocks"))


def answered(needle: Column, text: Column) -> Column:
    """Whether a lowered text holds a needle, or all of its telling tokens."""
    low = F.trim(F.lower(needle))
    tokens = F.filter(F.regexp_extract_all(low, F.lit(TOKEN + "+"), F.lit(0)), lambda t: (F.length(t) >= 3) & ~t.isin(*STOP_WORDS))
    return (low == "") | text.contains(low) | ((F.size(tokens) > 0) & F.forall(tokens, lambda t: text.contains(t)))


def read(units: DataFrame, asked: DataFrame) -> DataFrame:
    """request_id, doc_id, way, n_candidates, blocks, open (needles without an answer) of each request.

    units: doc_id, idx, anchor, text, heading.  asked: request_id, doc_id, mode, budget, goal, needles, want, scope, must_keep."""
    got = chosen(candidates(asked, units))
    every = asked.select("request_id", "doc_id", "needles").join(got, ["request_id", "doc_id"], "left")
    said = F.lower(F.array_join(F.coalesce(F.col("blocks.text"), F.array().cast("array<string>")), "\n"))
    needles = F.coalesce("needles", F.array().cast("array<string>"))
    blocks = F.coalesce("blocks", F.array().cast(got.schema["blocks"].dataType.simpleString()))
    every = every.withColumn("said", said)
    open_ = F.filter(needles, lambda n: ~answered(n, F.col("said")))
    return every.select("request_id", "doc_id", F.coalesce("way", F.lit("none")).alias("way"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), blocks.alias("blocks"), open_.alias("open"))


def read_texts(docs: DataFrame, raw: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """read() of raw texts (cleaned and cut) by raw requests: request_id, doc_id, mode, budget, request (JSON)."""
    clean = denoise.denoised(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")))
    return read(segments.segments(clean), requests.parsed(raw))
