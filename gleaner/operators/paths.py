"""Joins of paths: equal, above or below, and the nearest root above.

A path is met through its ancestors, one row each (as many as it is deep), so all joins are on equal keys; nothing compares every
path with every other one by their beginnings.

Defined cases: paths are compared as they are written, without slashes at their end; "/" and empty paths are the root, which is
above all absolute paths; a null path has no relation; repeated paths give repeated rows; extra columns of the sides are kept
(the right side's under its own names, which must differ from the left side's).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def bare(path: Column) -> Column:
    return F.regexp_replace(path, "/+$", "")


def ancestors(path: Column) -> Column:
    """The path itself and all above it, nearest first; the root is the empty path."""
    parts = F.split(bare(path), "/")
    return F.reverse(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))


def related(left: DataFrame, right: DataFrame, left_path: str, right_path: str) -> DataFrame:
    """Rows of both sides whose paths are equal, or one above the other, with `relation` of the left one: equal, above or below."""
    a, b = left.withColumn("_key", bare(F.col(left_path))), right.withColumn("_key", bare(F.col(right_path)))
    up = b.withColumnRenamed("_key", "_own").withColumn("_key", F.explode(ancestors(F.col(right_path))))
    above = a.join(up, "_key").withColumn("relation", F.when(F.col("_key") == F.col("_own"), "equal").otherwise("above")).drop("_key", "_own")
    strict = a.withColumnRenamed("_key", "_own").withColumn("_key", F.explode(ancestors(F.col(left_path)))).where(F.col("_key") != F.col("_own")).drop("_own")
    below = strict.join(b, "_key").withColumn("relation", F.lit("below")).drop("_key")
    return above.unionByName(below)


def nearest_root(paths: DataFrame, roots: DataFrame, path: str, root: str, within: int = 4) -> DataFrame:
    """paths with the nearest of the roots at the path or among its `within` nearest ancestors, and its distance; null without any."""
    keyed = paths.withColumn("_path", bare(F.col(path)))
    up = keyed.select("_path").distinct().select("_path", F.posexplode(F.slice(ancestors(F.col("_path")), 1, within + 1)).alias("distance", "_key"))
    own = roots.select(bare(F.col(root)).alias("_key"), F.col(root)).distinct()
    best = up.join(own, "_key").groupBy("_path").agg(F.min(F.struct("distance", root)).alias("_b"))
    return keyed.join(best, "_path", "left").select(*paths.columns, F.col(f"_b.{root}").alias(root), F.col("_b.distance").alias("distance"))


def chains(paths: DataFrame, path: str) -> DataFrame:
    """Distinct paths with the length of the chain of listed paths above them (0: none is listed)."""
    own = paths.select(bare(F.col(path)).alias("p")).where("p is not null").distinct()
    up = own.select("p", F.explode(ancestors(F.col("p"))).alias("above")).where("above <> p")
    met = up.join(own.select(F.col("p").alias("above")), "above").groupBy("p").agg(F.count("*").alias("n"))
    return own.join(met, "p", "left").select(F.col("p").alias(path), F.coalesce("n", F.lit(0)).alias("above"))


def stretches(anchors: DataFrame, before: int, after: int) -> DataFrame:
    """doc_id, low, high, n_anchors: the neighbourhoods of a document's anchors (doc_id, idx), overlapping or touching ones as one."""
    by = W.partitionBy("doc_id").orderBy("idx")
    own = anchors.select("doc_id", F.col("idx").cast("long").alias("idx")).where("idx is not null").distinct()
    new = F.coalesce((F.col("idx") - F.lag("idx").over(by) > before + after + 1).cast("int"), F.lit(1))
    runs = own.withColumn("new", new).withColumn("run", F.sum("new").over(by))
    return runs.groupBy("doc_id", "run").agg((F.min("idx") - before).alias("low"), (F.max("idx") + after).alias("high"), F.count("*").alias("n_anchors")).drop("run")


def around(anchors: DataFrame, units: DataFrame, before: int = 1, after: int = 1, width: int = 64) -> DataFrame:
    """units (doc_id, idx and others) near an anchor, once each, with low, high and n_anchors of their stretch.

    Stretches and units meet in bins of `width` places, so a document of many units is dealt to many keys."""
    bins = F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))
    near = stretches(anchors, before, after).withColumn("_bin", F.explode(bins))
    placed = units.withColumn("_bin", F.floor(F.col("idx") / width))
    return placed.join(near, ["doc_id", "_bin"]).where(F.col("idx").between(F.col("low"), F.col("high"))).drop("_bin")
