"""Cards: what a reader sees of an object before it asks: size, structure, samples and what stands out, and what may come next.

One row a text, log, collection or table.  Samples and what stands out are bounded by windows before they are gathered, so a
card's size does not grow with its object.

Defined cases: a log without levels shows its first lines; a text without units, or a collection without files, gives no card;
null lines are empty; ties go by place or name; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import profile
from .relevance import clipped

#: Levels worth a look, and how many of each kind a card shows.
NOTABLE = ("ERROR", "WARN", "FATAL", "CRITICAL")
LINES, SIGNATURES, SAMPLES, HEADINGS, FILES, ROWS, RARE, COLUMNS = 12, 8, 5, 12, 12, 5, 8, 12
LINE_CHARS, PLAIN_CHARS, UNIT_CHARS = 260, 180, 320


def _listed(rows: DataFrame, by: list[str], order: str, value: Column, out: str) -> DataFrame:
    """The values of at most some rows each, in order."""
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value.alias("v")))), lambda x: x["v"]).alias(out))


def _first(rows: DataFrame, by: list[str], order: list[Column | str], k: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)


def logs(lines: DataFrame) -> DataFrame:
    """doc_id, n_lines, levels (a map), notable (line number, level, text), samples, repeated (signature and count) of each log.

    lines: doc_id, idx (from 0), line."""
    line = F.coalesce("line", F.lit(""))
    own = lines.select("doc_id", "idx", line.alias("line"), profile.level(line).alias("level"), profile.signature(line).alias("sign"))
    counted = own.groupBy("doc_id", "level").agg(F.count("*").alias("n"))
    levels = counted.groupBy("doc_id").agg(F.sum("n").alias("n_lines"), F.map_from_entries(F.array_sort(F.filter(F.collect_list(F.struct("level", "n")), lambda x: x["level"] != ""))).alias("levels"))
    told = F.struct((F.col("idx") + 1).alias("line"), "level", clipped(F.col("line"), LINE_CHARS).alias("text"))
    notable = _listed(_first(own.where(F.col("level").isin(*NOTABLE)), ["doc_id"], ["idx"], LINES), ["doc_id"], "place", told, "notable")
    samples = _listed(own.where(F.col("idx") < SAMPLES), ["doc_id"], "idx", clipped(F.col("line"), PLAIN_CHARS), "samples")
    signs = own.where("sign <> ''").groupBy("doc_id", "sign").agg(F.count("*").alias("n")).where("n > 1")
    repeated = _listed(_first(signs, ["doc_id"], [F.desc("n"), "sign"], SIGNATURES), ["doc_id"], "place", F.struct("sign", "n"), "repeated")
    out = levels.join(notable, "doc_id", "left").join(samples, "doc_id", "left").join(repeated, "doc_id", "left")
    return out.withColumn("samples", F.when(F.col("notable").isNull(), F.col("samples")))


def texts(units: DataFrame) -> DataFrame:
    """doc_id, n_units, n_chars, headings, samples of each text.  units: doc_id, idx, anchor, text, heading."""
    whole = units.groupBy("doc_id").agg(F.count("*").alias("n_units"), F.sum(F.length("text")).alias("n_chars"))
    firsts = units.where("heading <> ''").groupBy("doc_id", "heading").agg(F.min("idx").alias("idx"))
    headings = _listed(_first(firsts, ["doc_id"], ["idx", "heading"], HEADINGS), ["doc_id"], "place", F.col("heading"), "headings")
    samples = _listed(_first(units, ["doc_id"], ["idx"], SAMPLES), ["doc_id"], "place", F.struct("anchor", clipped(F.col("text"), UNIT_CHARS).alias("text")), "samples")
    return whole.join(headings, "doc_id", "left").join(samples, "doc_id", "left")


def collections(items: DataFrame) -> DataFrame:
    """collection, n_files, n_bytes, kinds (a map), notable (the largest files' names) of each collection.  items: collection, name, kind, size."""
    kinds = items.groupBy("collection", F.coalesce("kind", F.lit("")).alias("kind")).agg(F.count("*").alias("n"), F.sum(F.coalesce("size", F.lit(0))).alias("b"))
    whole = kinds.groupBy("collection").agg(F.sum("n").alias("n_files"), F.sum("b").alias("n_bytes"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"))
    notable = _listed(_first(items, ["collection"], [F.desc("size"), "name"], FILES), ["collection"], "place", F.col("name"), "notable")
    return whole.join(notable, "collection")


def table(df: DataFrame, order: list[str]) -> DataFrame:
    """One row: n_rows, columns (name and type), samples (the first rows by `order`), signals (columns and their values that occur once and
    read like an error)."""
    types = profile.column_types(df).agg(F.max("n_rows").alias("n_rows"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "type")))).alias("columns"))
    text = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    first = df.orderBy(*order).limit(ROWS).select(F.struct(*order).alias("o"), text.alias("t")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]).alias("samples"))
    rare = profile.rare_values(df).where("error_like")
    best = _first(rare, ["name"], ["value"], RARE).groupBy("name").agg(F.array_sort(F.collect_list("value")).alias("values"))
    signals = best.orderBy("name").limit(COLUMNS).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "values")))).alias("signals"))
    one = lambda x: x.withColumn("one", F.lit(1))  # noqa: E731  # single rows
    return one(types).join(one(first), "one").join(one(signals), "one").drop("one")


def next_actions(decided: DataFrame) -> DataFrame:
    """decided (mode and large) with recommended (read or native) and allowed (what may come next, in order)."""
    pays = F.col("large") | ~F.col("mode").isin("native", "native_read")
    step = F.when(pays, "read_with_goal").otherwise("native")
    return decided.withColumns({"recommended": step, "allowed": F.array(F.lit("use_preview"), step, F.lit("raw"))})
