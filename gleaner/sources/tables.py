"""Tables and texts rendered from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: File endings and the types they stand for.
TYPES = {"yml": "yaml", "md": "text", "markdown": "text", "rst": "text", "log": "text", "py": "text", "sh": "text", "toml": "text", "ini": "text", "cfg": "text", "conf": "text", "htm": "html", "tsv": "csv", "": "text"}
#: Rows of a partition of spread().
SPREAD_ROWS = 50_000
STRUCTURED = ("csv", "json", "yaml", "xml", "xlsx")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, root: str, large_structured: int = 1024, large_other: int = 4096) -> DataFrame:
    """path, type, size, large of all files below root; their contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"))
    name = F.element_at(F.split("path", "/"), -1)
    ending = F.lower(F.when(name.contains("."), F.element_at(F.split(name, r"\."), -1)).otherwise(""))
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), ending), ending)
    found = found.select("path", kind.alias("type"), "size")
    return found.withColumn("large", F.col("size") >= F.when(F.col("type").isin(*STRUCTURED), large_structured).otherwise(large_other))


def texts(spark: SparkSession, root: str) -> DataFrame:
    """path and text of every file below root, one row a file; CRLF and CR become LF."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def strings(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A CSV or TSV table, every column a string."""
    return spark.read.csv(path, header=True, sep=sep, inferSchema=False, multiLine=True, escape='"')


def calc_ready(df: DataFrame, path: str, columns: list[str]) -> None:
    """The columns as tab-separated text with a header, unquoted."""
    df.select(*columns).write.option("sep", "\t").option("header", True).option("quote", "").mode("overwrite").csv(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df in partitions (by the keys, if given) of about SPREAD_ROWS rows, so that what a task holds does not grow with the table.

    A shuffle's size says little where texts and windows follow it; left to it, a few tasks would get all rows."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // SPREAD_ROWS))
    return df.repartition(n, *keys)


def rendered_orders(orders: DataFrame) -> DataFrame:
    """doc_id, text: a document for each customer, with a heading, and a list item and fields for each order."""
    line = lambda k, v: F.concat(F.lit(f"\n{k}: "), v)
    block = F.concat(F.lit("- order "), F.col("o_orderkey").cast("string"), line("STATUS", F.col("o_orderstatus")), line("TOTAL", F.floor("o_totalprice").cast("string")), line("DATE", F.date_format("o_orderdate", "yyyy-MM-dd")), line("PRIORITY", F.col("o_orderpriority")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", block.alias("b")))), lambda x: x["b"])
    return spread(orders, "o_custkey").groupBy(F.col("o_custkey").alias("doc_id")).agg(parts.alias("p")).select("doc_id", F.concat(F.lit("# Customer "), F.col("doc_id").cast("string"), F.lit("\n\n"), F.array_join("p", "\n\n")).alias("text"))


def rendered_accounts(orders: DataFrame) -> DataFrame:
    """doc_id, text: a page of prose lines for each customer: dates, a place (not for every fifth), amounts, figures by category, towns."""
    urgent, low = (F.count_if(F.col("o_orderpriority") == p).cast("string") for p in ("1-URGENT", "5-LOW"))
    day = lambda d: F.date_format(d, "d MMMM yyyy")
    each = spread(orders, "o_custkey").groupBy(F.col("o_custkey").alias("doc_id")).agg(
        day(F.min("o_orderdate")).alias("first"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last"), F.format_number(F.sum(F.floor("o_totalprice")), 0).alias("total"), F.count("*").cast("string").alias("n"), urgent.alias("urgent"), low.alias("low")
    )
    place = F.element_at(F.array(F.lit("Jaffa"), F.lit("Acre"), F.lit("Cyprus")), (F.col("doc_id") % 3 + 1).cast("int"))
    lines = [
        F.concat(F.lit("# Account "), F.col("doc_id").cast("string")),
        F.concat(F.lit("The first order was signed on "), F.col("first"), F.lit(". The last order was shipped on "), F.col("last"), F.lit(".")),
        F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("The account holder sailed for "), place, F.lit(" where it trades."))),
        F.concat(F.lit("A total of "), F.col("total"), F.lit(" was billed; "), F.col("n"), F.lit(" orders remained after filtering.")),
        F.lit("Top categories count"),
        F.concat(F.lit("Urgent Orders "), F.col("urgent")),
        F.concat(F.lit("Low Orders "), F.col("low")),
        F.lit("It took the towns of Arsuf, Jaffa and Acre."),
    ]
    return each.select("doc_id", F.concat_ws("\n", *lines).alias("text"))


def rendered_log(events: DataFrame) -> DataFrame:
    """doc_id (the user), idx, line: log lines of every user in time order."""
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARN").otherwise("INFO")
    text = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), level, "event_type")
    place = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return events.select(F.col("user_id").alias("doc_id"), place.cast("long").alias("idx"), text.alias("line"))
