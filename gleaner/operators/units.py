"""Lines, paragraphs, headings and fields of texts, each with an anchor in its document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LIST_ITEM = r"^[ \t]*([-*]|[0-9]+[.)])[ \t]+"
HEADING = r"^#{1,6}[ \t]+"
FIELD = r"^[ \t]*([A-Z][A-Z_]*)[ \t]*[:=][ \t]*(.*)$"
ISO_DATE = "[0-9]{4}-[0-9]{2}-[0-9]{2}"
NUMBER = "[0-9][0-9,]*"
BLANKS = "[ \t\r\n\f\x0b]+"
STAMP = r"^\[?[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}\]?[ \t]*"


def lines(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, idx (from 0), line of every line; a null text has none."""
    return docs.select("doc_id", *keep, F.posexplode(F.split("text", "\n")).alias("idx", "line")).withColumn("idx", F.col("idx").cast("long"))


def anchor(first: Column, last: Column) -> Column:
    return F.concat(F.lit("L"), (first + 1).cast("string"), F.lit("-L"), (last + 1).cast("string"))


def line_units(units: DataFrame) -> DataFrame:
    return units.where(F.trim("line") != "").select("doc_id", anchor(F.col("idx"), F.col("idx")).alias("anchor"), F.length("line").cast("long").alias("n_chars"), F.col("line").rlike(LIST_ITEM).alias("is_list"), F.col("line").rlike("[0-9]").alias("has_number"))


def runs(units: DataFrame, body: Column, least: int = 3) -> DataFrame:
    """doc_id, start, run_length, body of runs of at least `least` neighbouring lines of equal, non-blank body."""
    by = W.partitionBy("doc_id").orderBy("idx")
    marked = units.select("doc_id", "idx", body.alias("body"))
    marked = marked.withColumn("new", F.when(F.lag("body").over(by).eqNullSafe(F.col("body")), 0).otherwise(1))
    marked = marked.withColumn("run", F.sum("new").over(by))
    out = marked.groupBy("doc_id", "run").agg(F.min("idx").alias("start"), F.count("*").alias("run_length"), F.first("body").alias("body"))
    return out.where((F.col("run_length") >= least) & (F.col("body") != "")).select("doc_id", "start", "run_length", "body")


def collapsed(units: DataFrame, body: Column, least: int = 3) -> DataFrame:
    """doc_id, text: the lines joined again, each run of equal bodies reduced to its first line and a count."""
    by = W.partitionBy("doc_id").orderBy("idx")
    marked = units.select("doc_id", "idx", "line", body.alias("body"))
    marked = marked.withColumn("run", F.sum(F.when(F.lag("body").over(by).eqNullSafe(F.col("body")), 0).otherwise(1)).over(by))
    size = F.count("*").over(W.partitionBy("doc_id", "run"))
    marked = marked.withColumn("n", size).withColumn("first", F.lag("run").over(by).isNull() | (F.lag("run").over(by) != F.col("run")))
    long = (F.col("n") >= least) & (F.col("body") != "")
    kept = marked.where(~long | F.col("first")).withColumn("line", F.when(long, F.concat("line", F.lit(" [repeated identical line ×"), F.col("n").cast("string"), F.lit("]"))).otherwise(F.col("line")))
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda x: x["line"]), "\n").alias("text"))


def squeezed(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, BLANKS, " "))


def paragraphs(units: DataFrame) -> DataFrame:
    """doc_id, anchor, text of stretches of non-blank lines."""
    by = W.partitionBy("doc_id").orderBy("idx")
    marked = units.withColumn("par", F.sum(F.when(F.trim("line") == "", 1).otherwise(0)).over(by)).where(F.trim("line") != "")
    out = marked.groupBy("doc_id", "par").agg(F.min("idx").alias("a"), F.max("idx").alias("b"), F.array_sort(F.collect_list(F.struct("idx", "line"))).alias("l"))
    return out.select("doc_id", anchor(F.col("a"), F.col("b")).alias("anchor"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def headings(units: DataFrame) -> DataFrame:
    """doc_id, heading, n_lines, n_items: each heading with the non-blank lines it governs."""
    by = W.partitionBy("doc_id").orderBy("idx")
    marked = units.withColumn("at", F.last(F.when(F.col("line").rlike(HEADING), F.struct("idx", F.regexp_replace("line", HEADING, "").alias("h"))), ignorenulls=True).over(by))
    body = marked.where(~F.col("line").rlike(HEADING) & (F.trim("line") != "") & F.col("at").isNotNull())
    return body.groupBy("doc_id", "at").agg(F.count("*").alias("n_lines"), F.count_if(F.col("line").rlike(LIST_ITEM)).alias("n_items")).select("doc_id", F.col("at.h").alias("heading"), "n_lines", "n_items")


def fields(units: DataFrame) -> DataFrame:
    """doc_id, idx, name, value of `KEY: value` lines."""
    return units.where(F.col("line").rlike(FIELD)).select("doc_id", "idx", F.regexp_extract("line", FIELD, 1).alias("name"), F.regexp_extract("line", FIELD, 2).alias("value"))


def context(units: DataFrame, hit: Column, before: int = 1, after: int = 2) -> DataFrame:
    """doc_id, idx, line, is_hit, gap: lines around hits; gap marks a line whose predecessor is left out."""
    by = W.partitionBy("doc_id").orderBy("idx")
    marked = units.withColumn("is_hit", hit).withColumn("near", F.max(F.col("is_hit").cast("int")).over(by.rowsBetween(-after, before)))
    kept = marked.where("near = 1")
    return kept.select("doc_id", "idx", "line", "is_hit", F.coalesce(F.col("idx") - F.lag("idx").over(by) > 1, F.lit(False)).alias("gap"))
