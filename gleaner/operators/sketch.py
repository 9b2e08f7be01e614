"""Shapes of JSON: a table's texts as a few rows by path, merged over all rows, to a depth.

Each level is opened by the variant functions and counted by path and kind before the next one is; counts are partial sums, so a
level of any width shuffles only one row a path, kind and task.  Elements of an array share a path.

Defined cases: a text that is no JSON counts as kind "invalid" at the root; a null text as "missing"; a null value as "null"; an
empty table gives no rows; what lies deeper than `depth` is counted by its outermost kind and not opened; keys with dots or brackets
are written as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread


def kind_of(v: Column) -> Column:
    """object, array, string, number, boolean or null."""
    said = F.lower(F.regexp_extract(F.schema_of_variant(v), "^[A-Za-z]+", 0))
    known = F.when(said.isin("object", "array", "string", "boolean"), said).when(said == "void", "null")
    return known.otherwise(F.when(said.isin("bigint", "decimal", "double", "int", "float"), "number").otherwise(said))


def walked(docs: DataFrame, id_col: str, json_col: str, depth: int = 6) -> list[DataFrame]:
    """A frame (id, path, v) for each level, the root first."""
    level = docs.select(id_col, F.lit("$").alias("path"), F.try_parse_json(json_col).alias("v"))
    out = [level]
    for _ in range(depth):
        opened = level.where("v is not null").lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("v").outer()))
        step = F.when(F.col("key").isNull(), F.concat("path", F.lit("[]"))).otherwise(F.concat("path", F.lit("."), "key"))
        level = opened.select(id_col, step.alias("path"), F.col("value").alias("v"))
        out.append(level)
    return out


def shapes(docs: DataFrame, json_col: str, depth: int = 6) -> DataFrame:
    """path, kind, n, least, most of all texts; least and most are of a text's length, an array's size and a number's value."""
    keyed = docs.select(F.col(json_col).alias("json"), F.lit(0).alias("id"))
    counted = []
    for k, level in enumerate(walked(keyed, "id", "json", depth)):
        kind = kind_of(F.col("v"))
        if k == 0:
            level = docs.select(F.lit("$").alias("path"), F.try_parse_json(json_col).alias("v"), F.col(json_col).alias("json"))
            kind = F.when(F.col("json").isNull(), "missing").when(F.col("v").isNull(), "invalid").otherwise(kind)
        size = F.when(kind == "string", F.length(F.try_variant_get("v", "$", "string")).cast("double")).when(kind == "array", F.size(F.try_variant_get("v", "$", "array<variant>")).cast("double")).when(kind == "number", F.try_variant_get("v", "$", "double"))
        counted.append(level.select("path", kind.alias("kind"), size.alias("size")).groupBy("path", "kind").agg(F.count("*").alias("n"), F.min("size").alias("least"), F.max("size").alias("most")))
    out = counted[0]
    for more in counted[1:]:
        out = out.unionByName(more)
    return out


def scalars(docs: DataFrame, id_col: str, json_col: str, depth: int = 6) -> DataFrame:
    """id, path, kind, value of every value that is neither object nor array."""
    level = docs.select(id_col, F.lit("$").alias("path"), F.try_parse_json(json_col).alias("v")).where("v is not null")
    for _ in range(depth):
        # one pass over the table: a level opens what it can and hands on the scalars of those above; whole containers are not carried along
        held = level.withColumn("held", F.when(~kind_of(F.col("v")).isin("object", "array"), F.col("v")))
        opened = held.lateralJoin(docs.sparkSession.tvf.variant_explode_outer(F.col("v").outer()))
        step = F.when(F.col("held").isNotNull(), F.col("path")).when(F.col("key").isNull(), F.concat("path", F.lit("[]"))).otherwise(F.concat("path", F.lit("."), "key"))
        level = opened.select(id_col, step.alias("path"), F.coalesce("held", "value").alias("v")).where("v is not null")
    kind = kind_of(F.col("v"))
    return level.where(~kind.isin("object", "array")).select(id_col, "path", kind.alias("kind"), F.try_variant_get("v", "$", "string").alias("value"))


def rendered(orders: DataFrame) -> DataFrame:
    """doc_id, json: nested JSON for each customer; every seventh is no JSON and every eleventh null."""
    order = F.struct(F.col("o_orderkey").alias("key"), F.struct(F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, F.array(F.col("o_orderpriority"), F.lit("x"))).alias("tags")).alias("about"))
    listed = F.array_sort(F.collect_list(order))
    each = spread(orders, "o_custkey").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.to_json(F.struct(F.first("o_custkey").alias("id"), (F.first("o_custkey") % 2 == 0).alias("even"), listed.alias("orders"))).alias("json"))
    return each.select("doc_id", F.when(F.col("doc_id") % 11 == 0, F.lit(None)).when(F.col("doc_id") % 7 == 0, "{no json").otherwise(F.col("json")).alias("json"))
