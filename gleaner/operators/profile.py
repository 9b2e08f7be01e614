"""Profiles of texts, tables, logs, pages and collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .units import NUMBER, STAMP

LARGE = 4096
#: Words that make a value look like a failure.
ERROR_LIKE = "error|warn|fail|exception|timeout|rate_limited|critical|panic"


def tokens(chars: Column) -> Column:
    """The estimate of a text's tokens: a quarter of its characters, at least one."""
    return F.greatest(F.lit(1).cast("long"), F.floor(chars / 4).cast("long"))


def size_class(docs: DataFrame) -> DataFrame:
    n = F.length("text").cast("long")
    return docs.select("doc_id", n.alias("n_chars"), (n >= LARGE).alias("large"), tokens(n).alias("n_tokens"))


def numbers(docs: DataFrame) -> DataFrame:
    """doc_id, n_numbers, n_years: numbers (with commas), and how many of them are years of 1900 to 2100."""
    found = F.transform(F.regexp_extract_all("text", F.lit(NUMBER), F.lit(0)), lambda x: F.regexp_replace(x, ",", ""))
    year = lambda x: (F.length(x) == 4) & (x >= "1900") & (x <= "2100")
    return docs.select("doc_id", F.size(found).cast("long").alias("n_numbers"), F.size(F.filter(found, year)).cast("long").alias("n_years")).where("n_numbers > 0")


def melted(df: DataFrame) -> DataFrame:
    """name, value: a row for every column of every row, as strings.  One pass over the table."""
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in df.columns])
    return df.select(F.explode(cells).alias("c")).select("c.*")


#: Spellings of whole numbers and numbers; what holds a date.
WHOLE, DECIMAL, DATED = "^[-+]?[0-9]+$", "^[-+]?([0-9]+[.][0-9]+|[0-9]+)$", r"\b[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}\b"


def column_types(df: DataFrame) -> DataFrame:
    """name, type, n_rows, n_filled of every column by its values' spelling, in one pass: empty where no value is filled."""

    def told(c: str) -> Column:
        v = F.trim(F.col(c).cast("string"))
        full = v.isNotNull() & (v != "")
        every = lambda p: F.bool_and(F.when(full, v.rlike(p)))
        kind = F.when(F.count_if(full) == 0, "empty").when(every(WHOLE), "integer").when(every(DECIMAL), "number").when(every(DATED), "date").otherwise("string")
        return F.struct(F.lit(c).alias("name"), kind.alias("type"), F.count("*").alias("n_rows"), F.count_if(full).alias("n_filled"))

    return df.agg(F.array(*[told(c) for c in df.columns]).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def rare_values(df: DataFrame) -> DataFrame:
    """name, value, error_like of values that occur once in their column."""
    once = melted(df).where("value is not null").groupBy("name", "value").count().where("count = 1")
    return once.select("name", "value", F.lower("value").rlike(ERROR_LIKE).alias("error_like"))


#: A time at a line's start, a tag after it, levels as words.
CLOCK = r"^\s*[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?\s*"
TAG, LEVEL = r"^\s*\[[^\]]*\]\s*", r"(?i)\b(TRACE|DEBUG|INFO|WARN|WARNING|ERROR|CRITICAL|FATAL)\b"


def signature(line: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(line, CLOCK, ""), TAG, "")
    x = F.regexp_replace(F.regexp_replace(x, r"\b0x[0-9a-fA-F]+\b", "0x<hex>"), r"\b[0-9]{4,}\b", "<num>")
    return F.substring(F.trim(F.regexp_replace(x, r"\s+", " ")), 1, 180)


def level(line: Column) -> Column:
    """The first level that a line names as a word, in capitals; WARNING is WARN."""
    found = F.upper(F.regexp_extract(line, LEVEL, 1))
    return F.when(found == "WARNING", "WARN").otherwise(found)


def severities(log: DataFrame, k: int = 8) -> DataFrame:
    """kind, value, n: counts of levels, and of the k most frequent signatures that occur more than once."""
    levels = log.groupBy(level(F.col("line")).alias("value")).agg(F.count("*").alias("n")).where("value <> ''").select(F.lit("level").alias("kind"), "value", "n")
    signs = log.groupBy(signature(F.col("line")).alias("value")).agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "value").limit(k)
    return levels.unionByName(signs.select(F.lit("signature").alias("kind"), "value", "n"))


def json_keys(df: DataFrame, column: str) -> DataFrame:
    """key, n, n_values of the top-level keys of a JSON column."""
    pairs = df.select(F.explode(F.from_json(column, "map<string,string>")).alias("key", "value"))
    return pairs.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"))


def page_text(html: Column) -> Column:
    """A page's text by patterns: no scripts, styles or tags, blanks squeezed."""
    x = F.regexp_replace(html, "(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), "[ \t\r\n]+", " "))


def pages(df: DataFrame) -> DataFrame:
    text = page_text(F.col("html"))
    return df.select("page_id", F.length("html").cast("long").alias("n_html"), F.length(text).cast("long").alias("n_text"), F.sha2(text, 256).alias("text_sha256"))


def collections(docs: DataFrame, by: str = "source", k: int = 12) -> DataFrame:
    """source, n_files, n_bytes, n_large, notable (the k largest documents' ids, ties by id)."""
    size = F.octet_length("text").cast("long")
    sums = docs.groupBy(by).agg(F.count("*").alias("n_files"), F.sum(size).alias("n_bytes"), F.count_if(size >= LARGE).alias("n_large"))
    first = docs.select(by, "doc_id", size.alias("s")).withColumn("r", F.row_number().over(W.partitionBy(by).orderBy(F.desc("s"), "doc_id"))).where(F.col("r") <= k)
    names = first.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",").alias("notable"))
    return sums.join(names, by)


def row_match(df: DataFrame, terms: list[str], k: int = 40) -> DataFrame:
    """The k best rows: all columns, and score: 2 for each term in the row's text, half a point for a number."""
    text = F.lower(F.concat_ws(" | ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns]))
    hits = sum((F.when(text.contains(t.lower()), 2.0).otherwise(0.0) for t in terms), F.lit(0.0))
    scored = df.withColumn("score", F.when(hits > 0, hits + F.when(text.rlike("[0-9]"), 0.5).otherwise(0.0)).otherwise(0.0))
    return scored.where("score > 0").orderBy(F.desc("score"), *df.columns).limit(k)


def hinted(columns: list[str], terms: list[str]) -> list[str]:
    """Columns that a term names (either holds the other, letters and digits alone); all of them if none is named."""
    plain = lambda s: "".join(c for c in s.lower() if c.isalnum())
    named = [t for t in map(plain, terms) if t]
    found = [c for c in columns if any(t in plain(c) or plain(c) in t for t in named)]
    return found or columns
