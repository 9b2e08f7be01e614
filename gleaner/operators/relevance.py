"""Requests for evidence in text units: their terms, units' scores, and what is read without a match.

A request's terms are few and known when the plan is made, so they become expressions over the units' columns: scoring, a
document's first section and its overview are one pass over units without Python.  Weights, limits and word lists are fixed values.

Units have doc_id, idx (from 0), anchor, text and heading (null or empty: none).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Words that no needle is told by, words of an overview, words of a goal that asks for a section.
STOP_WORDS = frozenset(
    """the and for with from that this into your their then than what when where which while find exact facts fact count counts number
    section header listed below about paper document tasks many does have name type how after before was were who why did""".split()
)
OVERVIEW = ("executive summary", "summary", "overview", "abstract")
SECTION_GOALS = ("section", "heading", "table", "appendix", "chapter", "roadmap")
#: Characters that a read of one object or of a collection may give, by mode.
BUDGETS = {"scout": 1800, "focus": 3500, "refine": 3500, "verify": 1200, "collect": 2800}
COLLECTION_BUDGETS = {"scout": 5000, "focus": 7000, "refine": 20000, "verify": 20000, "collect": 16000}
TOKEN = r"[A-Za-z0-9_./:-]"
LIST_ITEM = r"^\s*(?:[-*]|[0-9]+[.)])\s+\S"
MARK = "\n...[clipped]..."


@dataclass(frozen=True)
class Request:
    goal: str = ""
    needles: tuple[str, ...] = ()
    must_keep: tuple[str, ...] = ()
    want: str = ""
    must: frozenset[str] = field(init=False, default=frozenset())

    def __post_init__(self):
        object.__setattr__(self, "must", frozenset(x.lower() for x in self.must_keep if x))

    def terms(self) -> list[str]:
        """Needles, what must be kept and the goal's first eight tokens, lowered; a term that is given twice counts twice."""
        return [t.lower() for t in (*self.needles, *self.must_keep, *re.findall(TOKEN + "{3,}", self.goal)[:8]) if t]

    def section_terms(self) -> list[str]:
        """Up to six needles and kept terms of four characters or more that are no numbers."""
        said = (str(x).strip().lower() for x in (*self.needles, *self.must_keep))
        return list(dict.fromkeys(x for x in said if len(x) >= 4 and not re.fullmatch(r"[\d.\s-]+", x)))[:6]

    def asks_for_section(self) -> bool:
        return any(w in self.goal.lower() for w in SECTION_GOALS)


def budget(mode: str, collection: bool = False, given: int | None = None) -> int:
    """The characters of a mode; a given number holds instead, from a least one up."""
    return max(1000 if collection else 200, (COLLECTION_BUDGETS if collection else BUDGETS)[mode] if given is None else given)


def clipped(text: Column, most: int) -> Column:
    """Texts without outer blanks; longer ones lose all but the first most - 20 characters, and say so."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(F.length(bare) <= most, bare).otherwise(F.concat(F.regexp_replace(F.substring(bare, 1, most - 20), r"\s+$", ""), F.lit(MARK)))


def _label() -> Column:
    return F.lower(F.concat(F.coalesce("heading", F.lit("")), F.lit("\n"), F.col("text")))


def _any(hay: Column, terms: tuple[str, ...] | list[str]) -> Column:
    return reduce(lambda a, t: a | hay.contains(t), terms, F.lit(False))


def cost() -> Column:
    return F.length("anchor") + F.length("text") + 32


def scored(units: DataFrame, request: Request) -> DataFrame:
    """doc_id, idx, anchor, text, score of units that score, and the first five of a document in which none does (at 0.1)."""
    hay = F.col("hay")
    points = [F.when(hay.contains(t), 4.0 if t in request.must else 2.0).otherwise(0.0) for t in request.terms()]
    if request.want in ("count", "fact"):
        points.append(F.when(F.col("text").rlike(r"\b[0-9]+(?:[.,][0-9]+)?\b"), 0.8).otherwise(0.0))
    points.append(F.when(F.col("text").rlike(LIST_ITEM) | hay.contains("suggested metrics"), 0.4).otherwise(0.0))
    points.append(F.when(F.coalesce("heading", F.lit("")) != "", 0.3).otherwise(0.0))
    out = units.withColumn("hay", _label()).withColumn("score", reduce(lambda a, b: a + b, points, F.lit(0.0)))
    none = F.max("score").over(W.partitionBy("doc_id")) <= 0
    kept = out.withColumn("none", none).where((F.col("score") > 0) | (F.col("none") & (F.col("idx") < 5)))
    text = F.when(F.col("none"), clipped(F.col("text"), 700)).otherwise(clipped(F.col("text"), 900))
    return kept.select("doc_id", "idx", "anchor", text.alias("text"), F.when(F.col("none"), 0.1).otherwise(F.col("score")).alias("score"))


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each document with their rank, ties in the document's order."""
    by = W.partitionBy("doc_id").orderBy(F.desc("score"), "idx")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def overview(units: DataFrame, most: int = 1800) -> DataFrame:
    """doc_id, rank, anchor, text, score of a document's overview: units that speak of a summary, then its first three, each once,
    as many as min(most, 1400) characters hold (the first always), four at most."""
    first = units.withColumn("named", _any(_label(), OVERVIEW)).where("named or idx < 3")
    blocks = first.select("doc_id", (~F.col("named")).alias("later"), "idx", "anchor", clipped(F.col("text"), 360).alias("text"))
    listed = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("later", "idx", "anchor", "text", cost().alias("cost")))).alias("b"))
    return _fitted(listed, min(most, 1400), 4)


def _fitted(listed: DataFrame, budget_: int, most: int, reads: int = 12) -> DataFrame:
    """Blocks in order while they fit: one that overflows is passed over, the first always stays, a full budget ends it."""
    kind = listed.schema["b"].dataType.simpleString()
    start = F.struct(F.array().cast(kind).alias("p"), F.lit(0).alias("u"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["u"] < budget_) & ((F.size(acc["p"]) == 0) | (acc["u"] + x["cost"] <= budget_))
        return F.struct(F.when(fits, F.concat(acc["p"], F.array(x))).otherwise(acc["p"]).alias("p"), F.when(fits, acc["u"] + x["cost"]).otherwise(acc["u"]).alias("u"))

    kept = listed.withColumn("p", F.slice(F.aggregate("b", start, step)["p"], 1, min(most, reads)))
    return kept.select("doc_id", F.posexplode("p").alias("at", "x")).select("doc_id", (F.col("at") + 1).alias("rank"), "x.anchor", "x.text", F.lit(0.2).alias("score"))


def section(units: DataFrame, request: Request, most: int) -> DataFrame:
    """doc_id, idx, anchor, text, score: the first unit that holds a section term and up to nine after it, until the budget is full."""
    terms = request.section_terms()
    start = F.min(F.when(_any(_label(), terms), F.col("idx"))).over(W.partitionBy("doc_id"))
    near = units.withColumn("start", start).where(F.col("idx").between(F.col("start"), F.col("start") + 9)).withColumn("text", clipped(F.col("text"), 900))
    used = F.sum(cost()).over(W.partitionBy("doc_id").orderBy("idx"))
    offset = F.col("idx") - F.col("start")
    out = near.withColumn("used", used).where((F.col("used") <= most) | (offset == 0))
    return out.select("doc_id", "idx", "anchor", "text", F.when(offset == 0, 8.0).otherwise(F.greatest(F.lit(1.0), 7.0 - offset * 0.4)).alias("score"))


def resolved(needle: str, text: Column) -> Column:
    """Whether a lowered text answers a needle: it holds the needle, or all of its tokens of three characters or more but stop words."""
    low = needle.lower().strip()
    if not low:
        return F.lit(True)
    tokens = [t for t in re.findall(TOKEN + "+", low) if len(t) >= 3 and t not in STOP_WORDS]
    every = reduce(lambda a, t: a & text.contains(t), tokens, F.lit(bool(tokens)))
    return text.contains(low) | every


def unresolved(evidence: DataFrame, request: Request) -> DataFrame:
    """doc_id, needle of needles that the evidence of a document (rows with text) does not answer."""
    low = F.lower(F.array_join(F.collect_list("text"), "\n"))
    joined = evidence.groupBy("doc_id").agg(low.alias("low"))
    flags = [F.when(~resolved(n, F.col("low")), F.lit(n)) for n in request.needles] or [F.lit(None).cast("string")]
    return joined.select("doc_id", F.explode(F.array_compact(F.array(*flags))).alias("needle"))
