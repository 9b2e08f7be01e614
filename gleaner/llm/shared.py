"""Working folders, global prefix sums and connected components for the llm operators."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that spark.checkpoint.dir names.

    Where neither that setting nor a checkpoint folder exists, one is set up on a local master; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="gleaner-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: the plan ends here, and no executor's loss undoes it."""
    spark = df.sparkSession
    path = work_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*spent: DataFrame | None) -> None:
    """Deletes what stored() wrote, once nothing that is still to run reads it."""
    for df in spent:
        if path := getattr(df, "stored_at", None):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that are no longer referenced: what the first collection finds, the second frees."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def shrink_heaps(spark: SparkSession) -> None:
    """Lets the executors collect garbage, after which their heaps give memory back to the Python workers beside them."""
    n = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def prefix_sums(df: DataFrame, group: list[str], order: Column, value: str, out: str, buckets: int = 4096) -> DataFrame:
    """Adds the sum of `value` over all earlier rows of the group, `order` being a unique long in [0, 2^63).

    Rows go to buckets by the leading digits of their place in the group's range of `order`; only sums per
    bucket (at most groups x buckets rows) are ordered in one place, the rest is ordered bucket by bucket."""
    low = df.groupBy(*group).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    keyed = df.withColumn("_o", order)
    same = [F.col(f"_l.{g}").eqNullSafe(F.col(f"_r.{g}")) for g in group]
    on = same[0] if same else F.lit(True)
    for c in same[1:]:
        on = on & c
    low = F.broadcast(low)  # one row a group
    keyed = keyed.alias("_l").join(low.alias("_r"), on, "left").select("_l.*", F.col("_r._lo").alias("_lo"), F.col("_r._hi").alias("_hi"))
    keyed = keyed.withColumn("_b", F.floor((F.col("_o") - F.col("_lo")).cast("double") / (F.col("_hi") - F.col("_lo") + 1).cast("double") * buckets).cast("int")).drop("_lo", "_hi")
    sums = keyed.groupBy(*group, "_b").agg(F.sum(value).alias("_s"))
    sums = sums.withColumn("_base", F.coalesce(F.sum("_s").over(W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    on = (F.col("_l._b") == F.col("_r._b")) if not same else on & (F.col("_l._b") == F.col("_r._b"))
    joined = keyed.alias("_l").join(F.broadcast(sums).alias("_r"), on, "left").select("_l.*", F.col("_r._base").alias("_base"))
    inner = W.partitionBy(*group, "_b").orderBy("_o", value).rowsBetween(W.unboundedPreceding, -1)
    return joined.withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop("_o", "_b", "_base")


def hung(edges: DataFrame, rounds: int | None = None, limit: int = 60) -> DataFrame:
    """Stored edges (a, b) of long ids, a > b, that connect what the given ones connect.

    Every round hangs a node's neighbours of smaller id under the smallest of them, its parent, and then replaces what each node
    hangs under by the parent of that.  A parent is a minimum (partial aggregation) and finding it a join, in which the many rows
    of a node that very many hang under can be split, as the other side has one row a node; no node's neighbours are gathered.
    Each round is written to the shared folder.  Without `rounds` it goes on until every node hangs under its component's smallest."""
    edges = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, mark = edges.distinct(), None
    if rounds is None:
        now = stored(now, "edges")
    for k in range(limit if rounds is None else rounds):
        before = now if k or rounds is None else None
        low = now.groupBy("a").agg(F.min("b").alias("p"))
        # (a, parent), and (sibling, parent) for the other smaller neighbours
        near = now.join(low, "a").select(F.when(F.col("b") == F.col("p"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("p").alias("b"))
        near = near.unionByName(low.select("a", F.col("p").alias("b")))
        up = low.select(F.col("a").alias("b"), F.col("p").alias("above"))
        now = stored(near.join(up, "b", "left").select("a", F.coalesce("above", "b").alias("b")).distinct(), "edges")
        discard(before)
        if rounds is None:
            new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if new == mark:
                return now
            mark = new
    if rounds is None:
        raise RuntimeError("the components did not settle")
    return now


def named(edges: DataFrame) -> DataFrame:
    """Rows (id, component) for every id in edges of hung(): the smallest that it hangs under, or itself."""
    up = edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("id")).distinct().join(up, "id", "left_anti")
    return up.unionByName(roots.select("id", F.col("id").alias("component")))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edges (a, b) of long ids: rows (id, component) for every id in an edge."""
    return named(hung(edges))
