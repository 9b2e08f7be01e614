"""Mixing overlapping sources to target weights (operator 5).

Documents are aggregated by membership pattern (the set of sources they belong to).  A min-cost flow routes
the patterns' words to the sources' quotas: pattern p offers its words once per level of repetition, and level r
costs r per word (convex), so nothing repeats while unseen words are left.  Sources that overlap compete for the
shared patterns.  Documents are then selected: all of a pattern's documents take the full levels, and the part of
the last level goes to documents in a seeded order while they fit, and to one more, the nearest in size to what is
still lacking.  Documents are taken whole.

Defined cases: a null or empty text has size 0 and takes 0 words; a null source is a source of its own, after
all others; rows with a null or repeated id are documents of their own (the order breaks ties by content; of equal rows
it does not matter which is taken, but each is counted by itself); a long text counts like any other and is taken whole or not
at all; no documents give no rows; extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import prefix_sums, stored

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"
#: Sources and membership patterns are gathered on the driver; they are names in a mixing plan, not data.
MOST_PATTERNS = 1 << 20
#: Drawn ids that are broadcast; beyond that they are joined by a shuffle.
MOST_IDS = 2_000_000


@dataclass
class Arc:
    to: int
    room: int
    cost: int
    back: int


class Flow:
    """Successive shortest paths with potentials over integer capacities and non-negative costs."""

    def __init__(self, n: int):
        self.arcs: list[list[Arc]] = [[] for _ in range(n)]

    def add(self, a: int, b: int, room: int, cost: int) -> Arc:
        arc = Arc(b, room, cost, len(self.arcs[b]))
        self.arcs[a].append(arc)
        self.arcs[b].append(Arc(a, 0, -cost, len(self.arcs[a]) - 1))
        return arc

    def run(self, source: int, sink: int) -> int:
        n, total = len(self.arcs), 0
        high = [0] * n
        while True:
            far: list[float] = [float("inf")] * n
            via: list[tuple[int, int] | None] = [None] * n
            far[source], heap = 0, [(0, source)]
            while heap:
                d, u = heapq.heappop(heap)
                if d > far[u]:
                    continue
                for k, arc in enumerate(self.arcs[u]):
                    if arc.room > 0 and (x := d + arc.cost + high[u] - high[arc.to]) < far[arc.to]:
                        far[arc.to], via[arc.to] = x, (u, k)
                        heapq.heappush(heap, (x, arc.to))
            if via[sink] is None:
                return total
            high = [h + (int(f) if f != float("inf") else 0) for h, f in zip(high, far, strict=True)]
            room, v = None, sink
            while v != source:
                u, k = via[v]
                room = self.arcs[u][k].room if room is None else min(room, self.arcs[u][k].room)
                v = u
            v = sink
            while v != source:
                u, k = via[v]
                arc = self.arcs[u][k]
                arc.room -= room
                self.arcs[v][arc.back].room += room
                v = u
            total += room


def targets(sizes: Sequence[int], weights: Sequence[float], most: int = 3) -> list[float]:
    """Shares of sum(sizes) by weight, none above most * size: the excess goes to the others by weight."""
    out = [0.0] * len(sizes)
    open_ = [i for i in range(len(sizes)) if sizes[i] > 0]
    left = sum(sizes)
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= most * sizes[i]
        open_ = [i for i in open_ if i not in full]
    return out


def route(patterns: dict[tuple[int, ...], int], quotas: Sequence[float], most: int = 3) -> dict[tuple[int, ...], int]:
    """Words to take of every pattern (each a set of source indexes with its words)."""
    keys = sorted(patterns)
    n = len(keys)
    source, sink = n + len(quotas), n + len(quotas) + 1
    flow = Flow(sink + 1)
    levels = [[flow.add(source, i, patterns[k], r) for r in range(most)] for i, k in enumerate(keys)]
    for i, k in enumerate(keys):
        for s in k:
            flow.add(i, n + s, most * patterns[k], 0)
    for s, q in enumerate(quotas):
        flow.add(n + s, sink, int(round(q)), 0)
    flow.run(source, sink)
    return {k: sum(patterns[k] - a.room for a in levels[i]) for i, k in enumerate(keys)}


def _row_key(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> Column:
    """Names what a row takes part with: rows of one key are equal to a mix."""
    return F.xxhash64(docs[id_col], docs[text_col], docs[source_col]).alias("row_key")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (1, 2, 3), most: int = 3, seed: str = SEED) -> DataFrame:
    """Rows (id, size, source_size, target, taken, row_key).  source_col: a string, or an array of strings for documents of several
    sources; source_size and target are then sums over the document's sources.  Weights repeat over the sources by code point."""
    many = dict(docs.dtypes)[source_col].startswith("array")
    member = F.coalesce(F.array_sort(F.array_distinct(F.col("_s"))), F.array().cast("array<string>")) if many else F.array("_s")
    src = docs.select(docs[id_col].alias("id"), F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long").alias("size"), docs[source_col].alias("_s"), _row_key(docs, id_col, text_col, source_col))
    src = stored(src.select("id", "size", member.alias("sources"), "row_key"), "sizes")  # words are counted once
    sums = src.groupBy("sources").agg(F.sum("size").alias("words")).limit(MOST_PATTERNS + 1).collect()
    if len(sums) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    names = sorted({s for r in sums for s in r["sources"] or []}, key=lambda s: (s is None, s or ""))
    place = {s: i for i, s in enumerate(names)}
    patterns = {tuple(sorted(place[s] for s in r["sources"] or [])): int(r["words"] or 0) for r in sums}
    sizes = [sum(v for k, v in patterns.items() if i in k) for i in range(len(names))]
    total = sum(patterns.values())
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], most)
    scale = total / sum(wanted) if sum(wanted) > total else 1.0  # overlapping sources count shared words twice
    wanted = [w * scale for w in wanted]
    taken = route(patterns, wanted, most)
    plan = [([names[i] for i in k], sum(sizes[i] for i in k), float(sum(wanted[i] for i in k)), taken[k] // v if v else 0, taken[k] % v if v else 0) for k, v in patterns.items()]
    plan = docs.sparkSession.createDataFrame(plan, "sources array<string>, source_size long, target double, full long, rest long")
    keyed = src.withColumn("_k", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string"))), 1, 14), 16, 10).cast("long"))
    keyed = keyed.withColumn("pattern", F.to_json("sources", {"ignoreNullFields": "false"}))
    before = prefix_sums(keyed, ["pattern"], F.col("_k"), "size", "_before")
    plan = plan.withColumn("pattern", F.to_json("sources", {"ignoreNullFields": "false"})).drop("sources")
    placed = before.join(F.broadcast(plan), "pattern", "left")  # at most MOST_PATTERNS rows
    placed = placed.withColumn("fits", (F.col("_before") + F.col("size") <= F.col("rest")) & (F.col("full") < most))
    # one more document, the nearest in size, for what the pattern still lacks
    lack = placed.groupBy("pattern").agg((F.first("rest") - F.coalesce(F.max(F.when(F.col("fits"), F.col("_before") + F.col("size"))), F.lit(0))).alias("lack"))
    lack = F.broadcast(lack)
    last = placed.join(lack, "pattern").where((F.col("full") < most) & ~F.col("fits") & (F.abs(F.col("size") - F.col("lack")) < F.col("lack")))
    last = last.groupBy("pattern").agg(F.min(F.struct(F.abs(F.col("size") - F.col("lack")).alias("off"), "_k", "_before", "size", "id")).alias("last"))  # words before tell equal rows apart
    placed = placed.join(F.broadcast(last), "pattern", "left")
    chosen = F.col("fits") | F.coalesce((F.col("_k") == F.col("last._k")) & (F.col("_before") == F.col("last._before")) & F.col("id").eqNullSafe(F.col("last.id")) & (F.col("size") == F.col("last.size")), F.lit(False))
    extra = F.when(F.coalesce(chosen, F.lit(False)), F.col("size")).otherwise(F.lit(0))
    return placed.select(F.col("id").alias(id_col), "size", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), (F.col("size") * F.coalesce("full", F.lit(0)) + extra).cast("long").alias("taken"), "row_key")


def drawn(docs: DataFrame, mixed: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs, each row as often as the mix takes it (0 to `most` times).  mixed: rows of mix() of the same table.

    Rows of one key (equal id, text and source) are all taken `low` times, and `more` of them once more: these are numbered, part
    by part of the table, so that no group of equal rows meets in one task.  Rows without words are not drawn."""
    each = mixed.where("size > 0").select("row_key", F.expr("taken div size").alias("times"))
    times = each.groupBy("row_key").agg(F.min("times").alias("low"), (F.sum("times") - F.min("times") * F.count("*")).alias("more")).where("low > 0 or more > 0")
    times = stored(times, "drawn")
    uneven = not times.where("more > 0").isEmpty()
    if times.count() <= MOST_IDS:
        times = F.broadcast(times)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), _row_key(docs, id_col, text_col, source_col), F.spark_partition_id().alias("part"))
    rows = rows.join(times, "row_key")
    out = rows.where("more = 0").select("row", F.col("low").alias("times"))
    if uneven:
        some = rows.where("more > 0")
        before = some.groupBy("row_key", "part").count()
        before = before.select("row_key", "part", F.coalesce(F.sum("count").over(W.partitionBy("row_key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        placed = some.withColumn("place", F.row_number().over(W.partitionBy("row_key", "part").orderBy(F.lit(0)))).join(before, ["row_key", "part"])
        once_more = F.when(F.col("before") + F.col("place") <= F.col("more"), 1).otherwise(0)
        out = out.unionByName(placed.select("row", (F.col("low") + once_more).alias("times")))
    return out.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")
