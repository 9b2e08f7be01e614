"""Single rules of cleaning as expressions and windows: controls, JSON's blanks, and runs of lines folded in tables of lines.

denoise.py applies all rules to a whole text, each to what the one before left; here each rule stands by itself, without
Python, for texts or lines that are in a table already.

Defined cases: a null text or line is empty; blank lines are never folded; protected lines are never folded and end a run; ids
name documents; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .denoise import CHANGING, ESCAPES, PROGRESS, TIME_PREFIX

#: Characters that are dropped, and the least lengths of runs.
DROPPED = "".join(map(chr, [*range(9), *range(11, 32), 0x200B, 0x200C, 0x200D, 0xFEFF]))
SAME, MOVING, STAMPED = 3, 4, 3
JSON_BLANKS = r'("[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\z))|[ \t\r\n]+'


def controls(text: Column) -> Column:
    """Without terminal escapes and control characters, line ends as line feeds."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), ESCAPES.pattern, ""), "\r\n?", "\n")
    return F.translate(plain, DROPPED, "")


def minified(text: Column) -> Column:
    """JSON without the blanks outside strings; numbers' spelling and equal keys stay."""
    return F.regexp_replace(text, "(?s)" + JSON_BLANKS, "$1")


def protected(lines: DataFrame) -> DataFrame:
    """lines (doc_id, idx, line) with `code`: fences and what they enclose, and lines indented by four blanks or a tab."""
    line = F.coalesce("line", F.lit(""))
    fence = line.rlike(r"^\s*(?:```|~~~)")
    n = F.sum(fence.cast("int")).over(W.partitionBy("doc_id").orderBy("idx"))
    return lines.withColumn("code", fence | line.rlike("^(?: {4}|\t)") | (n % 2 == 1))


def folded(lines: DataFrame, form: Column, least: int, mark: str, last: bool = False, shown: int = 0) -> DataFrame:
    """doc_id, idx, part, line: each run of at least `least` lines of one form as its first line (part 0), a mark (1), in which {} is
    the number of lines less those `shown`, and its last line (2), if it is to stay; other lines as they are.

    lines: doc_id, idx, line, code.  form: null for lines that belong to no run."""
    by = W.partitionBy("doc_id").orderBy("idx")
    own = lines.withColumn("line", F.coalesce("line", F.lit(""))).withColumn("form", F.when(~F.col("code") & (F.trim("line") != ""), form))
    own = own.withColumn("new", F.when(F.col("form").isNotNull() & (F.col("form") == F.lag("form").over(by)), 0).otherwise(1))
    own = own.withColumn("run", F.sum("new").over(by))
    run = W.partitionBy("doc_id", "run")
    own = own.withColumn("n", F.count("*").over(run)).withColumn("place", F.row_number().over(run.orderBy("idx")))
    bare = F.regexp_replace("line", r"\s+$", "")
    told = F.concat(F.lit(mark.split("{}")[0]), (F.col("n") - shown).cast("string"), F.lit(mark.split("{}")[1]))
    piece = lambda part, text: F.struct(F.lit(part).alias("part"), text.alias("line"))
    first, end = F.array(piece(0, bare), piece(1, told)), F.array(piece(2, bare))
    none = F.filter(end, lambda x: F.lit(False))
    pieces = F.when(F.col("n") < least, F.array(piece(0, bare))).when(F.col("place") == 1, first).when(F.lit(last) & (F.col("place") == F.col("n")), end).otherwise(none)
    return own.select("doc_id", "idx", F.explode(pieces).alias("p")).select("doc_id", "idx", "p.part", "p.line")


def squeezed(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"\s+", " "))


def same_lines(lines: DataFrame) -> DataFrame:
    return folded(lines, squeezed(F.col("line")), SAME, "[repeated identical line ×{}]")


def progress_lines(lines: DataFrame) -> DataFrame:
    """Runs of progress: lines with a share, a count or a bar that are alike but for what changes."""
    sign = squeezed(F.regexp_replace(F.lower(F.trim("line")), "(?i)" + CHANGING.pattern, "#"))
    return folded(lines, F.when(F.col("line").rlike(PROGRESS.pattern), sign), MOVING, "[collapsed {} intermediate progress updates]", last=True, shown=2)


def stamped_lines(lines: DataFrame) -> DataFrame:
    """Runs of lines that are alike behind their times."""
    body = squeezed(F.regexp_replace("line", TIME_PREFIX.pattern, ""))
    alike = F.when(F.col("line").rlike(TIME_PREFIX.pattern) & (body != ""), body)
    return folded(lines, alike, STAMPED, "[repeated line with volatile prefix ×{}]", last=True)
