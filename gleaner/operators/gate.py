"""Routing: from metadata alone, whether an object or a collection deserves selective reading.

Modes, codes and thresholds are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import STRUCTURED

GOALS = ("selective_read", "cross_file_evidence", "structured_compute", "edit_or_execute", "full_fidelity")
CODE = ("py", "sh", "toml", "ini", "cfg", "conf")
TEXT = ("text", "pdf", "html")
TABULAR = ("csv", "tsv", "xls", "xlsx")
FLOOR, TEXT_FLOOR = 1024, 4096


def goals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(g,) for g in GOALS], "goal string")


def _told(mode: str, code: str | Column, confidence: float) -> Column:
    return F.struct(F.lit(mode).alias("mode"), (F.lit(code) if isinstance(code, str) else code).alias("code"), F.lit(confidence).alias("confidence"))


def _flat(df: DataFrame, decision: Column, *keep: str) -> DataFrame:
    return df.select(*keep, decision.alias("d")).select(*keep, "d.mode", "d.code", "d.confidence")


def _given(found: DataFrame, name: str, value: object) -> Column:
    """A column of found, or what holds without it."""
    return F.coalesce(F.col(name), F.lit(value)) if name in found.columns else F.lit(value)


def shaped(goal: Column) -> Column:
    """A goal by its names: what hosts call compute_or_edit is edit_or_execute; unknown ones are unknown."""
    low = F.lower(F.trim(F.coalesce(goal, F.lit(""))))
    return F.when(low == "compute_or_edit", "edit_or_execute").when(low.isin(*GOALS), low).otherwise("unknown")


def objects(found: DataFrame, *keep: str) -> DataFrame:
    """keep..., mode, code, confidence.  found: type, ending, size and goal of single objects, and where they are given an override
    (a mode) and large (whether the size is beyond a floor that was set)."""
    size, goal, kind = F.col("size"), F.col("goal"), F.col("type")
    override = _given(found, "override", "")
    structured = kind.isin(*STRUCTURED)
    text = kind.isin(*TEXT)
    rules = F.when(~(structured | text), _told("native", "unsupported", 1.0))
    rules = rules.when(override != "", F.struct(override.alias("mode"), F.lit("override").alias("code"), F.lit(1.0).alias("confidence")))
    small = ~F.col("large") if "large" in found.columns else size < F.when(structured, FLOOR).otherwise(TEXT_FLOOR)
    rules = rules.when(small, _told("native", "below_benefit_floor", 0.95))
    rules = rules.when(F.col("ending").isin(*CODE), _told("native", "native_code_or_config", 0.95))
    rules = rules.when(goal.isin("full_fidelity", "edit_or_execute"), _told("native", F.concat(F.lit("native_"), goal), 0.95))
    rules = rules.when(text & (size < TEXT_FLOOR), _told("advisory", "document_boundary", 0.65))
    rules = rules.when(text & (goal == "selective_read"), _told("force", "long_document_selective", 0.9))
    rules = rules.when(text, _told("force", "long_document", 0.82))
    rules = rules.when(goal == "structured_compute", _told("native", "native_single_table_compute", 0.92))
    rules = rules.when(structured, _told("advisory", "structured_targeted_only", 0.7))
    return _flat(found, rules.otherwise(_told("native", "no_validated_benefit", 0.8)), *keep)


def measured(items: DataFrame, by: str) -> DataFrame:
    """by, n, n_bytes, n_text, n_structured, n_tabular, n_code, n_log, n_kinds.  items: kind and size of files."""
    one = lambda *k: F.count_if(F.col("kind").isin(*k))
    return items.groupBy(by).agg(F.count("*").alias("n"), F.sum("size").alias("n_bytes"), one(*TEXT, "md", "eml").alias("n_text"), one(*TABULAR, "json", "yaml", "xml").alias("n_structured"), one(*TABULAR).alias("n_tabular"), one("code").alias("n_code"), one("log").alias("n_log"), F.count_distinct("kind").alias("n_kinds"))


def collections(found: DataFrame, *keep: str) -> DataFrame:
    """keep..., mode, code, confidence.  found: rows of measured() with a goal, and where they are given coverage and long_pdf (whether
    a PDF of TEXT_FLOOR bytes lies below)."""
    c, goal = F.col, F.col("goal")
    pdf, wide = _given(found, "long_pdf", False), _given(found, "coverage", "unknown") == "exhaustive"
    exact = goal.isin("full_fidelity", "edit_or_execute")
    sources = c("n_text") + c("n_structured") + c("n_code") + c("n_log")
    plan = (c("n") >= 5) & (c("n_structured") >= 3) & (c("n_bytes") >= 20_000) & (c("n_text") + c("n_structured") + c("n_code") >= 4)
    edit = (goal == "edit_or_execute") & (c("n_tabular") >= 3) & (c("n_structured") * 2 > c("n")) & (c("n_log") == 0)
    only = c("n_structured") == c("n")
    mixed = c("n_kinds") > 1
    rules = F.when((c("n") == 0) & pdf & exact, _told("native", F.concat(F.lit("native_"), goal), 0.95))
    rules = rules.when((c("n") == 0) & pdf, _told("force", "collection_long_document", 0.88))
    rules = rules.when(c("n") == 0, _told("native", "empty_collection", 1.0))
    rules = rules.when(goal == "full_fidelity", _told("native", "native_full_fidelity", 0.95))
    rules = rules.when(plan & ((goal == "structured_compute") | edit), _told("force", "structured_analysis_plan", 0.88))
    rules = rules.when(goal == "edit_or_execute", _told("native", "native_edit_or_execute", 0.95))
    rules = rules.when(goal == "structured_compute", _told("native", "native_small_structured_compute", 0.9))
    rules = rules.when(pdf, _told("force", "collection_long_document", 0.88))
    rules = rules.when((goal == "cross_file_evidence") & wide & ((c("n") >= 10) | (c("n_bytes") >= 40_000)) & ~only, _told("advisory", "broad_evidence_boundary", 0.7))
    rules = rules.when((goal == "cross_file_evidence") & (c("n") >= 3) & (c("n_bytes") >= 8_192) & ~only & (sources >= 3), _told("force", "multi_file_evidence", 0.9))
    rules = rules.when(goal == "cross_file_evidence", _told("advisory", "multi_file_evidence_boundary", 0.68))
    rules = rules.when((c("n_text") >= F.greatest(F.lit(3), F.floor((c("n") + 1) / 2))) & ((c("n_bytes") >= 24_576) | (c("n") >= 8)), _told("advisory", "large_text_collection_boundary", 0.72))
    rules = rules.when(mixed | (c("n_bytes") >= 8_192) | (c("n") >= 3), _told("advisory", "collection_goal_required", 0.62))
    return _flat(found, rules.otherwise(_told("native", "small_collection", 0.9)), *keep)
