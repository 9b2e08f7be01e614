"""Queries of small accounts, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accounts
from ..sources import tables
from .registry import query


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN j WHEN o_orderkey % 13 = 0 THEN a WHEN w <= 0 THEN (a + j) / 2 ELSE (a * 0.75 + j * w2) / w END AS grade, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_orderkey % 5 + 1.5) / 2 END AS mean
FROM (SELECT *, o_orderkey % 10 / 10.0::DOUBLE AS a, o_orderkey % 4 / 4.0::DOUBLE AS j, o_orderkey % 3 - 1.0::DOUBLE AS w2, 0.75 + o_orderkey % 3 - 1.0::DOUBLE AS w FROM orders)""")
def combined_grades(s, d):
    k = F.col("o_orderkey")
    a, j = F.when(k % 11 != 0, (k % 10) / 10), F.when((k % 13 != 0) | (k % 11 == 0), (k % 4) / 4)
    scores = F.when(k % 7 == 0, F.create_map(F.lit("note"), F.lit("none"))).otherwise(F.create_map(F.lit("a"), (k % 5).cast("string"), F.lit("b"), F.lit("1.5"), F.lit("c"), F.lit("good")))
    return tables.table(s, d, "orders").select("o_orderkey", accounts.combined(a, j, F.lit(0.75), (k % 3 - 1).cast("double")).alias("grade"), accounts.mean_of(scores).alias("mean"))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 0 ELSE greatest(0, p_size - p_partkey % 40)::DOUBLE / p_size END AS saved, CASE WHEN p_partkey % 3 = 0 THEN 7 ELSE least(greatest(p_partkey - 50, 1), 500) END AS bounded, 'artifact_' || substr(sha1(p_name || '|' || p_brand), 1, 12) AS artifact, 'column_' || substr(sha1(p_name), 1, 8) AS column_id FROM part""")
def bounded_numbers(s, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    said = F.when(k % 3 == 0, "many").otherwise((k - 50).cast("string"))
    full = F.when(size % 5 == 0, 0).otherwise(size)
    return tables.table(s, d, "part").select("p_partkey", accounts.saved(full, k % 40).alias("saved"), accounts.bounded(said, 7, 1, 500).alias("bounded"), accounts.named("artifact", F.col("p_name"), F.col("p_brand")).alias("artifact"), accounts.named("column", F.col("p_name")).alias("column_id"))


@query("""SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey % 2 = 0 THEN 'k' || c_custkey ELSE CASE WHEN c_custkey % 3 = 0 THEN 'x.y.k' ELSE 'x.k' END || c_custkey END AS short FROM customer WHERE c_nationkey % 2 = 0 OR c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY c_nationkey HAVING count(DISTINCT c_custkey % 3 = 0) = 2)
UNION ALL SELECT c_custkey, c_nationkey, 'k' || c_custkey FROM customer WHERE c_nationkey % 2 = 1 AND c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY c_nationkey HAVING count(DISTINCT c_custkey % 3 = 0) = 1)""")
def shortened_keys(s, d):
    key = F.when(F.col("c_nationkey") % 2 == 0, F.lit("$.a.b.k")).when(F.col("c_custkey") % 3 == 0, F.lit("x.y.k")).otherwise("x.k")
    pairs = tables.table(s, d, "customer").select("c_custkey", "c_nationkey", F.concat(key, F.col("c_custkey").cast("string")).alias("key"))
    return accounts.shortened(pairs, "c_nationkey", "key").select("c_custkey", "c_nationkey", "short")


@query("""WITH e AS (SELECT user_id, list(DISTINCT event_type) FILTER (value > 80) AS a, list(DISTINCT event_type) FILTER (value < 15) AS b FROM events GROUP BY user_id), n AS (SELECT user_id, coalesce(a, []) AS a, coalesce(b, []) AS b FROM e)
SELECT user_id, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS pending, array_to_string(list_sort(list_filter(a, lambda x: list_contains(b, x))), ',') AS common, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS either, list_has_any(a, b) AS met FROM n""")
def compared_sets(s, d):
    each = tables.table(s, d, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 80, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("value") < 15, F.col("event_type"))).alias("b"))
    got = accounts.compared(each, "a", "b")
    return got.select("user_id", *[F.array_join(c, ",").alias(c) for c in ("pending", "common", "either")], "met")
