"""Embedding near-duplicates by PCA-ordered tiled comparison (operator 3).

Directions of largest variance, found on a bounded sample, order the dimensions of all vectors (scaled to length 1).
A tree of median splits along them deals vectors to tiles, and only tiles whose bounding boxes come near enough to hold a
pair over the threshold are compared.  Neighbouring tiles make panels; a task gets the tiles of two panels and compares them
in its memory, so a vector is shuffled at most once a panel, not once a tile.  Between two tiles products are taken over the
leading dimensions first; what the other dimensions can add is at most the product of the suffix norms, so pairs that cannot reach the threshold stop
there.  Equal vectors are compared once.  A comparison gives counts and a spanning forest of its links, never pairs.

Defined cases: vectors that are null, zero or hold null or non-finite components link with nothing and give their row; vectors of
different lengths do not link, each length is compared by itself; a null id gives no row (it could name no component); repeated ids count as vectors of their own and
share one row each; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import mix
from .shared import components, stored
from .vectors import lengths, matrix, usable

SAMPLE, TILE, MOST_LEAVES = 16_384, 1_024, 1_024
#: Vectors of a panel at most, panels at least (of so many tiles), partitions of pairs of panels at most.
PANEL, PANELS, MOST_PARTS = 49_152, 12, 4_096
#: Leading dimensions; pairs that are measured at a time.
LEAD, PAIRS = 16, 65_536


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def directions(unit: np.ndarray) -> np.ndarray:
    """Orthonormal columns, of largest variance first."""
    centred = unit - unit.mean(axis=0)
    return np.linalg.eigh(centred.T @ centred)[1][:, ::-1].copy()


def splits(points: np.ndarray, leaves: int) -> list[tuple[int, float]]:
    """A complete binary tree as a heap of (dimension, value); fewer than `leaves` inner nodes."""
    depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))
    tree: list[tuple[int, float]] = []
    level = [points]
    for _ in range(depth):
        lower = []
        for p in level:
            d = int(np.argmax(p.var(axis=0))) if len(p) > 1 else 0
            v = float(np.median(p[:, d])) if len(p) else 0.0
            tree.append((d, v))
            lower += [p[p[:, d] < v], p[p[:, d] >= v]]
        level = lower
    return tree


def leaf_of(points: np.ndarray, tree: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    if not tree:
        return at
    dims, values = np.array([d for d, _ in tree]), np.array([v for _, v in tree])
    while at[0] < len(tree):
        at = 2 * at + 1 + (points[np.arange(len(points)), dims[at]] >= values[at])
    return at - len(tree)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows as they were given."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
    return np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))


def links(a: np.ndarray, b: np.ndarray, threshold: float, given: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Which rows of a and b (length 1, dimensions in order) reach the threshold, as a boolean matrix.

    Cosines too near to it for the turned vectors' rounding are decided on the vectors as given."""
    slack, lead = 1e-9, min(LEAD, a.shape[1])
    # single precision bounds every cosine from above by the leading dimensions and the norms of the others
    ahead = [np.column_stack([x[:, :lead], np.sqrt((x[:, lead:] ** 2).sum(1))]).astype(np.float32) for x in (a, b)]
    alive = ahead[0] @ ahead[1].T >= np.float32(threshold - 1e-4)
    if np.count_nonzero(alive) > alive.size // 20:
        alive = a @ b.T >= threshold - slack
    i, j = np.nonzero(alive)
    out = np.zeros((len(a), len(b)), bool)
    exact = np.concatenate([np.einsum("ij,ij->i", a[i[k : k + PAIRS]], b[j[k : k + PAIRS]]) for k in range(0, max(1, len(i)), PAIRS)])
    if given is not None and (close := np.flatnonzero(np.abs(exact - threshold) <= slack)).size:
        exact[close] = cosines(given[0][i[close]], given[1][j[close]])
    out[i, j] = exact >= threshold
    return out


def _forest(link: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> np.ndarray:
    """Edges (id, smallest id reachable within this comparison) of the linked rows."""
    big = np.iinfo(np.int64).max
    la, lb = ids_a.copy(), ids_b.copy()
    rows, cols = np.flatnonzero(link.any(1)), np.flatnonzero(link.any(0))
    if not len(rows):
        return np.zeros((0, 2), np.int64)
    sub = link[np.ix_(rows, cols)]
    la, lb = la[rows], lb[cols]
    while True:
        na = np.minimum(la, np.where(sub, lb[None, :], big).min(1))
        nb = np.minimum(lb, np.where(sub, na[:, None], big).min(0))
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    both = np.stack([np.concatenate([ids_a[rows], ids_b[cols]]), np.concatenate([la, lb])], 1)
    return np.unique(both[both[:, 0] != both[:, 1]], axis=0)


def in_cells(blocks: DataFrame, panels: int, dim: int, radius: float) -> DataFrame:
    """Tiles with the cell (a pair of panels, first * panels + second) that compares them: once for each panel that its box comes near."""
    edges = lambda f, c: F.array(*[f(F.col(c)[k]) for k in range(dim)])
    boxes = blocks.groupBy(F.col("panel").alias("other")).agg(edges(F.min, "low").alias("olow"), edges(F.max, "high").alias("ohigh"))
    gaps = F.transform(F.arrays_zip("low", "high", "olow", "ohigh"), lambda z: F.pow(F.greatest(F.lit(0.0), z["low"] - z["ohigh"], z["olow"] - z["high"]), 2))
    met = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(panels - 1).cast("long")))).join(F.broadcast(boxes), "other")
    met = met.where(F.aggregate(gaps, F.lit(0.0), lambda a, g: a + g) <= radius**2)
    cell = F.least("panel", "other") * panels + F.greatest("panel", "other")
    return met.select(cell.alias("cell"), *blocks.columns).repartition(min(MOST_PARTS, panels * (panels + 1) // 2), "cell")


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (id, n_links, component_id, kept) of every vector."""
    src = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].alias("v")).where("id is not null")
    out = src.where(~usable(F.col("v"))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    for dim in lengths(src, "v"):
        out = out.unionByName(_of_length(src.where(usable(F.col("v")) & (F.size("v") == dim)), dim, threshold))
    return out.withColumnRenamed("id", id_col)


def _of_length(vectors: DataFrame, dim: int, threshold: float) -> DataFrame:
    """near_duplicates() of usable vectors (id, v) of one length."""
    spark = vectors.sparkSession
    # equal vectors once, by their content; the smallest id stands for all
    keyed = vectors.select("id", F.md5(F.concat_ws(",", F.transform("v", lambda x: x.cast("string")))).alias("key"), "v")
    reps = keyed.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))
    reps = stored(reps, "vectors")
    n = reps.count()
    sample = reps.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").toArrow()
    x = _unit(matrix(sample.column("v"), dim)) if n else np.zeros((0, 1))
    turn = directions(x) if n else np.zeros((1, 1))
    tree = splits(x @ turn, min(MOST_LEAVES, -(-n // TILE))) if n else []
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaf = leaf_of(_unit(matrix(b.column("v"), dim)) @ turn, tree)
                sub = mix(b.column("rep").to_numpy().astype(np.uint64)).astype(np.int64) & 0x7FFFFFFF
                yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("copies"), b.column("v"), pa.array(leaf), pa.array(sub)], names=["rep", "copies", "v", "leaf", "sub"])

    kind = dict(reps.dtypes)["v"]
    dealt = reps.select("rep", "copies", "v").mapInArrow(tiles, f"rep long, copies long, v {kind}, leaf long, sub long")
    sizes = sorted((r["leaf"], r["count"]) for r in dealt.groupBy("leaf").count().collect())  # at most MOST_LEAVES rows
    before = np.cumsum([0, *[c for _, c in sizes]]).tolist()
    panels = max(1, -(-n // PANEL), min(PANELS, n // TILE))
    fine = spark.createDataFrame([(k, at, c, -(-c // TILE)) for (k, c), at in zip(sizes, before, strict=False)] or [(0, 0, 1, 1)], "leaf long, at long, size long, subs long")
    dealt = dealt.join(F.broadcast(fine), "leaf").withColumn("sub", F.col("sub") % F.col("subs")).withColumn("tile", F.concat_ws(":", "leaf", "sub"))
    # panels are neighbouring leaves' tiles, cut at equal numbers of vectors
    dealt = dealt.withColumn("panel", F.floor((F.col("at") + F.floor(F.col("sub") * F.col("size") / F.col("subs"))) * panels / max(1, n)).cast("long"))

    def block(df: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(df["v"].to_numpy())
        y = _unit(m) @ turn
        return pd.DataFrame([(int(df["panel"].iloc[0]), df["tile"].iloc[0], df["rep"].to_numpy(np.int64).tobytes(), df["copies"].to_numpy(np.int64).tobytes(), m.astype(np.float64).tobytes() if kind == "array<double>" else m.astype(np.float32).tobytes(), y.min(0).tolist(), y.max(0).tolist())], columns=["panel", "tile", "ids", "copies", "m", "low", "high"])

    blocks = stored(dealt.groupBy("tile").applyInPandas(block, "panel long, tile string, ids binary, copies binary, m binary, low array<double>, high array<double>"), "tiles")
    met = in_cells(blocks, panels, dim, radius)
    number = np.float64 if kind == "array<double>" else np.float32

    def compare(df: pd.DataFrame) -> pd.DataFrame:
        """The links within a panel, or between two; a pair of tiles is compared in one cell alone."""
        one, other = divmod(int(df["cell"].iloc[0]), panels)
        tiles_ = [(p, t, np.frombuffer(i, np.int64), np.frombuffer(c, np.int64), np.frombuffer(m, number).reshape(-1, dim), np.asarray(lo), np.asarray(hi)) for p, t, i, c, m, lo, hi in df[["panel", "tile", "ids", "copies", "m", "low", "high"]].itertuples(index=False, name=None)]
        turned = {t: _unit(m) @ turn for _, t, _, _, m, _, _ in tiles_}
        out = [np.zeros((0, 3), np.int64)]
        for p1, t1, ia, ca, ma, l1, h1 in tiles_:
            for p2, t2, ib, cb, mb, l2, h2 in tiles_:
                if (p1, p2) != (one, other) or (one == other and t1 > t2) or (np.maximum(0, np.maximum(l1 - h2, l2 - h1)) ** 2).sum() > radius**2:
                    continue
                link = links(turned[t1], turned[t2], threshold, (ma, mb))
                if t1 == t2:
                    np.fill_diagonal(link, False)
                    link |= link.T
                if not link.any():
                    continue
                na = link @ cb
                out.append(np.stack([ia[na > 0], ia[na > 0], na[na > 0]], 1))
                if t1 != t2:
                    nb = ca @ link
                    out.append(np.stack([ib[nb > 0], ib[nb > 0], nb[nb > 0]], 1))
                e = _forest(link, ia, ib)
                out.append(np.concatenate([e, np.zeros((len(e), 1), np.int64)], 1))
        return pd.DataFrame(np.concatenate(out), columns=["a", "b", "n"])

    found = stored(met.groupBy("cell").applyInPandas(compare, "a long, b long, n long"), "links")
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    comp = components(found.where("a <> b").select("a", "b")).select(F.col("id").alias("rep"), "component")
    about = reps.select("key", "rep", "copies").join(counts, "rep", "left").join(comp, "rep", "left")
    out = keyed.select("id", "key").join(about, "key")
    n_links = (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long")
    component = F.coalesce("component", "rep")
    return out.select("id", n_links.alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
