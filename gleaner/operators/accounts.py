"""Small accounts as expressions: grades combined by weights, shares saved, bounded numbers, ids by hash, keys made shorter, and what
sets of names have in common.

Defined cases: null grades leave the other one as it is; weights that do not add up to more than nothing count half each; a full size of
0 saves nothing; what is no whole number is the default; null sets are empty; keys without a common beginning stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Digits of an id by what it names.
DIGITS = {"artifact": 12, "raw": 10, "column": 8, "episode": 10}


def combined(automated: Column, judged: Column, weight_automated: Column, weight_judged: Column) -> Column:
    """The weighted mean of two grades."""
    a, j = F.coalesce(weight_automated, F.lit(0.5)), F.coalesce(weight_judged, F.lit(0.5))
    fair = a + j > 0
    a, j = F.when(fair, a).otherwise(0.5), F.when(fair, j).otherwise(0.5)
    both = (automated * a + judged * j) / (a + j)
    return F.coalesce(both, automated, judged)


def mean_of(scores: Column) -> Column:
    """The mean of the numbers of a map of sub-scores given as text; null without any."""
    numbers = F.filter(F.transform(F.map_values(scores), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    return F.aggregate(numbers, F.lit(0.0), lambda n, x: n + x) / F.nullif(F.size(numbers), F.lit(0))


def saved(full: Column, taken: Column) -> Column:
    return F.when(full > 0, F.greatest(F.lit(0), full - taken) / full).otherwise(0.0)


def bounded(value: Column, default: int, lower: int, upper: int) -> Column:
    """A whole number between two bounds, the default where there is none."""
    return F.least(F.greatest(F.coalesce(value.try_cast("long"), F.lit(default)), F.lit(lower)), F.lit(upper))


def named(kind: str, *parts: Column) -> Column:
    """An id out of what it names: a prefix of the SHA-1 of the parts."""
    return F.concat(F.lit(f"{kind}_"), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, DIGITS[kind]))


def shortened(pairs: DataFrame, by: str, key: str) -> DataFrame:
    """pairs with `short`: dotted keys without the parent that all keys of a group share."""
    of, own = W.partitionBy(by), pairs.withColumn("_parent", F.regexp_extract(key, r"^(.*)\.[^.]+$", 1))
    same = (F.min("_parent").over(of) == F.max("_parent").over(of)) & (F.col("_parent") != "")
    return own.withColumn("short", F.when(same, F.regexp_extract(key, r"([^.]+)$", 1)).otherwise(F.col(key))).drop("_parent")


def compared(sets: DataFrame, required: str, done: str) -> DataFrame:
    """sets with pending (required and not done), common, either (all names, sorted) and met (whether any is common)."""
    none = F.array().cast("array<string>")
    a, b = F.coalesce(required, none), F.coalesce(done, none)
    return sets.withColumns({"pending": F.array_sort(F.array_except(a, b)), "common": F.array_sort(F.array_intersect(a, b)), "either": F.array_sort(F.array_union(a, b)), "met": F.arrays_overlap(a, b)})
