"""Hard-negative mining by a two-dimensional block matrix multiply (operator 11).

Scores are integer inner products of anchors (a stated set of rows) with all rows.  Rows are dealt to blocks and dimensions
to chunks; the piece of an anchor block and the piece of a row block for the same chunk meet at one place of the grid and give
a partial tile of 64-bit scores, and a shuffle adds the partial tiles of a pair of blocks.  Each summed tile gives its best
rows of every anchor's label; over all tiles they are the anchor's positives.  A second reading of the summed tiles
gives, for every anchor and positive, the tile's best rows of another label inside the positive's window of scores.

Anchors are taken in panels of a fixed number of blocks.  A panel's tiles are the only thing that is as large as anchors times
rows: at most PANEL * ANCHORS * 8 bytes a row of the table at once, and they go when the panel is done.  Pieces are joined
by the panel's own anchor blocks, whose size is bounded by the panel.

Defined cases: rows without an id or a label, or whose vector is null or holds a null or non-finite component, take no part;
vectors of different lengths are not compared (each length is a problem of its own; empty vectors score 0); integers beyond
integers.most() count as that; repeated ids are rows of their own, none of which is another's positive or an anchor's own
row; fewer rows than asked for are all returned; an empty table gives no rows; extra columns of any name are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .integers import integer_rows, matrix_of
from .shared import discard, stored, work_folder

#: Rows of a row block and anchors of an anchor block (three quarters of that on average), dimensions of a chunk, anchor blocks of a panel.
ROWS, ANCHORS, CHUNK, PANEL = 2_048, 64, 32, 16
LOWEST = np.iinfo(np.int64).min
ABOUT = ("uids", "ids", "labels")
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _schema(names: str) -> str:
    """Binary columns, but for those of places and sizes."""
    return ", ".join(f"{n} {'long' if n in ('dim', 'block', 'i', 'j', 'k', 'n') else 'binary'}" for n in names.split())


def _table(rows: list[tuple], names: str) -> pa.Table:
    kinds = [pa.int64() if n in ("dim", "block", "i", "j", "k", "n") else pa.binary() for n in names.split()]
    return pa.table([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=names.split())


PIECE = "dim block k n uids ids labels m"
TILE = "dim i j k a_uids a_ids a_labels b_ids b_labels tile"
SUMMED = "dim i j a_uids a_labels b_ids b_labels tile tops"


def _pieces(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """Stored pieces of blocks of at most `size` rows of one length, a piece for each chunk of dimensions; the number of buckets."""
    buckets = max(1, math.ceil(rows.count() / (0.75 * size)))

    def cut(key: tuple, t: pa.Table) -> pa.Table:
        dim, bucket = key[0].as_py(), key[1].as_py()
        t = t.sort_by([("id", "ascending"), ("uid", "ascending")])
        out = []
        for s, at in enumerate(range(0, t.num_rows, size)):
            part = t.slice(at, size)
            m = matrix_of(part.column("q"), dim)
            about = [part.column(c).to_numpy().astype(np.int64).tobytes() for c in ("uid", "id", "label")]
            for k in range(max(1, -(-dim // CHUNK))):
                piece = np.ascontiguousarray(m[:, k * CHUNK : (k + 1) * CHUNK])
                out.append((dim, bucket + s * buckets, k, len(m), *(about if k == 0 else [None] * 3), piece.tobytes()))
        return _table(out, PIECE)

    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets)))
    return stored(dealt.groupBy("dim", "bucket").applyInArrow(cut, _schema(PIECE)), name), buckets


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in exact integers: by floating point where every sum fits its 53 bits."""
    top = lambda x: int(np.abs(x).max(initial=0))
    if top(a) * top(b) * max(1, a.shape[1]) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _multiply(t: pa.Table) -> pa.Table:
    """The partial tile of the pair of pieces at one place of the grid."""
    out = []
    for r in t.to_pylist():
        a, b = (np.frombuffer(r[m], "<i4").reshape(r[n], -1) if r["dim"] else np.zeros((r[n], 0), np.int32) for m, n in (("a_m", "a_n"), ("m", "n")))
        out.append((r["dim"], r["i"], r["block"], r["k"], *(r[f"a_{c}"] for c in ABOUT), r["ids"], r["labels"], product(a, b).tobytes()))
    return _table(out, TILE)


def best(scores: np.ndarray, allowed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score of each row's n highest allowed scores; of equal scores those of smaller column come first."""
    s = np.where(allowed, scores, LOWEST)
    cut = np.partition(s, -n, axis=1)[:, -n] if s.shape[1] > n else np.full(len(s), LOWEST)
    row, col = np.nonzero(allowed & (s >= cut[:, None]))
    value = s[row, col]
    order = np.lexsort((col, -value, row))
    row, col, value = row[order], col[order], value[order]
    keep = np.arange(len(row)) - np.searchsorted(row, np.arange(len(s)))[row] < n
    return row[keep], col[keep], value[keep]


def _adder(positives: int):
    def add(t: pa.Table) -> pa.Table:
        """The tile of two blocks from its partial tiles, with each anchor's best rows of its own label."""
        rows = t.to_pylist()
        head = next(r for r in rows if r["k"] == 0)
        uids, ids, labels, b_ids, b_labels = (np.frombuffer(head[c], np.int64) for c in ("a_uids", "a_ids", "a_labels", "b_ids", "b_labels"))
        tile = np.zeros((len(ids), len(b_ids)), np.int64)
        for r in rows:
            tile += np.frombuffer(r["tile"], np.int64).reshape(tile.shape)
        row, col, value = best(tile, (labels[:, None] == b_labels) & (ids[:, None] != b_ids), positives)
        tops = np.stack([uids[row], ids[row], b_ids[col], value], 1).astype(np.int64)
        return _table([(head["dim"], head["i"], head["j"], *(head[c] for c in ("a_uids", "a_labels", "b_ids", "b_labels")), tile.tobytes(), tops.tobytes())], SUMMED)

    return add


def _ranked(found: DataFrame, group: list[str], n: int) -> DataFrame:
    w = W.partitionBy(*group).orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _panel(anchors: DataFrame, rows: DataFrame, path: str, positives: int, negatives: int, low: int, high: int) -> None:
    """Appends the results of a panel of anchor blocks to path."""
    ours = anchors.select("dim", "k", F.col("block").alias("i"), *[F.col(c).alias(f"a_{c}") for c in ("n", *ABOUT, "m")])
    grid = rows.join(F.broadcast(ours), ["dim", "k"])  # at most PANEL blocks of ANCHORS rows
    partial = grid.groupBy("dim", "i", "block", "k").applyInArrow(_multiply, _schema(TILE))
    tiles = stored(partial.groupBy("dim", "i", "j").applyInArrow(_adder(positives), _schema(SUMMED)), "tiles")

    def offers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = np.concatenate([np.zeros((0, 4), np.int64), *[np.frombuffer(x.as_py(), np.int64).reshape(-1, 4) for x in b.column("tops")]])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in each.T], names=["uid", "anchor_id", "other", "score"])

    won = _ranked(tiles.select("tops").mapInArrow(offers, "uid long, anchor_id long, other long, score long"), ["uid"], positives)
    won = won.select("uid", "anchor_id", F.col("other").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").cast("long").alias("place")).toPandas()  # `positives` rows an anchor of the panel
    won = won.sort_values(["uid", "place"])
    uids, windows = won["uid"].to_numpy(np.int64), won["positive_score"].to_numpy(np.int64)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.zeros((0, 3), np.int64)]
            for r in b.to_pylist():
                a_uids, labels, b_ids, b_labels = (np.frombuffer(r[c], np.int64) for c in ("a_uids", "a_labels", "b_ids", "b_labels"))
                tile = np.frombuffer(r["tile"], np.int64).reshape(len(a_uids), len(b_ids))
                order = np.argsort(a_uids)
                pairs = np.flatnonzero(np.isin(uids, a_uids))  # anchors and positives of this tile
                mine = order[np.searchsorted(a_uids, uids[pairs], sorter=order)]
                for at in range(0, len(pairs), ANCHORS):
                    p, s = pairs[at : at + ANCHORS], tile[mine[at : at + ANCHORS]]
                    top = windows[p][:, None]
                    inside = (labels[mine[at : at + ANCHORS]][:, None] != b_labels) & (low * top <= 100 * s) & (100 * s <= high * top)
                    row, col, value = best(s, inside, negatives)
                    out.append(np.stack([p[row], b_ids[col], value], 1))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out).T], names=["pair", "other", "score"])

    found = _ranked(tiles.select("a_uids", "a_labels", "b_ids", "b_labels", "tile").mapInArrow(search, "pair long, other long, score long"), ["pair"], negatives)
    won["pair"] = np.arange(len(won))
    about = anchors.sparkSession.createDataFrame(won[["pair", "anchor_id", "positive_id", "positive_score"]], "pair long, anchor_id long, positive_id long, positive_score long")
    out = found.join(F.broadcast(about), "pair")
    out.select("anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    discard(tiles)


def mine(vectors: DataFrame, anchors: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchors: a condition on `id`, which rows to mine for.  label: an integer column or an expression on the table's columns.
    An anchor's positives are its `positives` best other rows of its label; a pair's negatives are the `negatives` best rows of
    another label whose score lies from `low` to `high` hundredths of the positive's."""
    spark = vectors.sparkSession
    label = vectors[label] if isinstance(label, str) else label
    src = vectors.select(vectors[id_col].cast("long").alias("id"), label.cast("long").alias("label"), vectors[vector_col].alias("v"))
    rows = integer_rows(src.where("id is not null and label is not null"), ["id", "label"], "v", "integers")
    others, _ = _pieces(rows, ROWS, "row-pieces")
    ours, buckets = _pieces(rows.where(anchors), ANCHORS, "anchor-pieces")
    path = work_folder(spark, "negatives")
    for at in range(0, buckets, PANEL):
        _panel(ours.where(F.pmod("block", F.lit(buckets)).between(at, at + PANEL - 1)), others, path, positives, negatives, low, high)
    discard(rows, others, ours)
    return spark.read.schema(RESULT).parquet(path)
