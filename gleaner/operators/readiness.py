"""Whether what is known answers a request: requested slots against the slots of a document's earlier answers.

Requests and known answers are tables; they meet by document and slot, and each request is judged by aggregates over its
slots, so nothing is gathered but a request's own few slots.

Defined cases: a document without answers is read; a request without slots is covered by any answers; null slots are not
requested; repeated slots of a request count once; of repeated answers the first by value counts; a null confidence is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The least confidence that needs no second look, and the kinds of answers whose form can be told.
SURE = 0.9
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
DATED = rf"\b(?:[0-9]{{1,2}}\s+)?(?:{MONTHS})(?:\s+[0-9]{{1,2}},?)?\s+[0-9]{{4}}\b|\b[0-9]{{4}}[-/][0-9]{{2}}[-/][0-9]{{2}}\b|\b[0-9]{{4}}\b"


def doubtful(value: Column, confidence: Column, asked: Column) -> Column:
    """An answer that deserves another look: unsure, empty, clipped, very short, or not of the form that was asked for."""
    bare, asked = F.trim(F.coalesce(value, F.lit(""))), F.lower(asked)
    unformed = asked.contains("category") & (~bare.contains(":") | ~bare.rlike("[0-9]") | bare.endswith(",") | F.split_part(bare, F.lit(":"), F.lit(1)).rlike(f"(?i)^ *(?:{MONTHS}) *$"))
    unformed |= asked.rlike("date|when") & ~bare.rlike(DATED)
    unformed |= asked.rlike("count|how many|number") & ~bare.rlike("[0-9]")
    tiny = (F.length(bare) <= 3) & ~bare.rlike("^[0-9]+$")
    return (F.coalesce(confidence, F.lit(0.0)) < SURE) | (bare == "") | bare.rlike(r"(?:\[clipped\]|\.\.\.)$") | tiny | unformed


def overall(answers: DataFrame) -> DataFrame:
    """doc_id, state of a document's answers (doc_id, slot, status): ready, needs_verify or needs_refine."""
    ok, some = F.col("status") == "resolved", F.col("status").isin("resolved", "partial")
    return answers.groupBy("doc_id").agg(F.when(F.bool_and(ok), "ready").when(F.bool_and(some), "needs_verify").otherwise("needs_refine").alias("state"))


def judged(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """request_id, doc_id, verdict, new_slots, open_slots of every request.

    requests: request_id, doc_id, mode, slots (array of structs of id and asked, what the slot expects and its question).
    answers: doc_id, slot, status, value, confidence.
    verdict: read (nothing is known), extend (slots beyond the known ones are asked for: new_slots), refine (known slots are missing),
    verify (another look is asked for and due), complete, or nearly_complete (partial answers, which a verification may mend)."""
    known = answers.groupBy("doc_id", "slot").agg(F.min(F.struct("value", "status", "confidence")).alias("k"))
    state = overall(known.select("doc_id", "slot", "k.status"))
    each = requests.select("request_id", "doc_id", "mode", F.explode_outer(F.array_distinct("slots")).alias("s")).select("request_id", "doc_id", "mode", F.col("s.id").alias("slot"), F.coalesce("s.asked", F.lit("")).alias("asked"))
    met = each.join(known, ["doc_id", "slot"], "left")
    asked, new = F.col("slot").isNotNull(), F.col("slot").isNotNull() & F.col("k").isNull()
    told = met.groupBy("request_id", "doc_id", "mode").agg(
        F.array_sort(F.collect_set(F.when(new, F.col("slot")))).alias("new_slots"),
        F.array_sort(F.collect_set(F.when(asked & (F.coalesce(F.col("k.status"), F.lit("missing")) != "resolved"), F.col("slot")))).alias("open_slots"),
        F.bool_or(asked).alias("asks"),
        F.bool_and(F.when(asked, doubtful(F.col("k.value"), F.col("k.confidence"), F.col("asked")))).alias("doubtful"),
    )
    out = told.join(state, "doc_id", "left")
    due = (F.col("mode") == "verify") & F.col("asks") & ((F.col("state") == "needs_verify") | F.col("doubtful"))
    verdict = (
        F.when(F.col("state").isNull(), "read").when(F.size("new_slots") > 0, "extend").when(F.col("state") == "needs_refine", "refine").when(F.coalesce(due, F.lit(False)), "verify").when(F.col("state") == "ready", "complete").otherwise("nearly_complete")
    )
    return out.select("request_id", "doc_id", verdict.alias("verdict"), "new_slots", "open_slots")
