"""Approximate nearest neighbours by additive quantisation (operator 10).

Each vector is the sum of one full-dimensional codeword out of each of STAGES codebooks, fitted to residuals on a bounded
sample.  A beam search over the codebooks finds a vector's codes; the index stores codes, the norm of the sum and the vector.
A query is scored against all rows by table lookups (|y|^2 - 2 q.y, with q.c tabulated for every codeword); the best of each
block of rows are measured exactly on the original vectors.

Queries are taken in blocks of bounded size, one pass over the index each.  Recall against brute force is measured in the
tests.  Defined cases: vectors that are null, zero or hold null or non-finite components take no part; vectors of different
lengths are not compared, each length has an index of its own; a null id takes no part; repeated ids are rows of their own, and
none is its own query's neighbour; of equal distances the smaller id comes first; an empty table has no answers; extra
columns of any name are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import stored
from .vectors import lengths, matrix, usable

SAMPLE, STAGES, WORDS, BEAM, ROUNDS = 8_192, 8, 256, 4, 6
BLOCK, RERANK, QUERIES = 4_096, 320, 2_048


def codebooks(x: np.ndarray, seed: int = 7) -> np.ndarray:
    """STAGES x WORDS x dimensions: k-means on what earlier stages leave."""
    rng = np.random.default_rng(seed)
    rest, out = x.astype(np.float32), []
    for _ in range(STAGES):
        c = rest[rng.choice(len(rest), WORDS, replace=len(rest) < WORDS)].copy()
        for _ in range(ROUNDS):
            k = np.argmin((c * c).sum(1)[None, :] - 2 * rest @ c.T, 1)
            count = np.bincount(k, minlength=WORDS)
            total = np.zeros_like(c)
            np.add.at(total, k, rest)
            c[count > 0] = total[count > 0] / count[count > 0, None]
        k = np.argmin((c * c).sum(1)[None, :] - 2 * rest @ c.T, 1)
        out.append(c)
        rest = rest - c[k]
    return np.stack(out)


def encode(x: np.ndarray, books: np.ndarray, chunk: int = 1_024) -> tuple[np.ndarray, np.ndarray]:
    """Codes of every row and the squared norms of their sums."""
    m, k, d = books.shape
    flat = books.reshape(m * k, d).astype(np.float32)
    gram = flat @ flat.T
    own = np.diag(gram)
    codes_out, norms = [], []
    for at in range(0, len(x), chunk):
        part = x[at : at + chunk].astype(np.float32)
        n = len(part)
        xc = part @ flat.T
        error, codes, dots = np.zeros((n, 1), np.float32), np.zeros((n, 1, 0), np.int64), np.zeros((n, 1, m * k), np.float32)
        for s in range(m):
            cols = slice(s * k, (s + 1) * k)
            # |r - c|^2 - |r|^2 for the residual r = x - (sum so far)
            score = error[:, :, None] + own[None, None, cols] - 2 * (xc[:, None, cols] - dots[:, :, cols])
            wide = score.reshape(n, -1)
            beam = min(BEAM, wide.shape[1])
            best = np.argpartition(wide, beam - 1, axis=1)[:, :beam]
            parent, word = best // k, best % k + s * k
            error = np.take_along_axis(wide, best, 1)
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None]], 2)
            if s + 1 < m:
                dots = np.take_along_axis(dots, parent[:, :, None], 1) + gram[word]
        top = codes[np.arange(n), np.argmin(error, 1)]
        total = flat[top].sum(1)
        codes_out.append((top % k).astype(np.uint8))
        norms.append((total * total).sum(1))
    return np.concatenate(codes_out) if codes_out else np.zeros((0, m), np.uint8), np.concatenate(norms) if norms else np.zeros(0, np.float32)


class Index:
    """An index over every usable vector, one for each length."""

    def __init__(self, vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding"):
        self.spark = vectors.sparkSession
        src = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v")).where("id is not null")
        self.shelves = [Shelf(src.where(usable(F.col("v")) & (F.size("v") == dim)), dim) for dim in lengths(src, "v")]

    def search(self, which: Column, k: int = 10) -> DataFrame:
        """query_id, rank, vec_id, score for the rows of the index for which `which` (of id) holds."""
        out = self.spark.createDataFrame([], "query_id long, vec_id long, score double")
        for shelf in self.shelves:
            for found in shelf.found(which, k):
                out = out.unionByName(found)
        w = W.partitionBy("query_id").orderBy("score", "vec_id")
        return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Shelf:
    """The index of vectors (id, v) of one length, stored in the shared folder in blocks of at most BLOCK different vectors."""

    def __init__(self, rows: DataFrame, dim: int):
        self.rows, self.dim = rows, dim
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
        self.books = books = codebooks(matrix(sample.column("v"), dim))

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, BLOCK):
                    part = b.slice(at, BLOCK)
                    ids, x = part.column("id").to_numpy(), matrix(part.column("v"), dim)
                    codes, norms = encode(x, books)
                    yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (ids.astype(np.int64).tobytes(), codes.tobytes(), norms.astype(np.float32).tobytes(), x.tobytes())], names=["ids", "codes", "norms", "x"])

        self.blocks = stored(rows.mapInArrow(build, "ids binary, codes binary, norms binary, x binary"), "index")

    def found(self, which: Column, k: int) -> Iterator[DataFrame]:
        """Candidates of every query, a frame for each group of queries."""
        asked = self.rows.where(which)
        n = asked.count()
        groups = max(1, math.ceil(n / QUERIES))
        for g in range(groups if n else 0):
            part = asked.where(F.pmod(F.xxhash64("id"), F.lit(groups)) == g).toArrow()  # about QUERIES rows
            yield self._near(part.column("id").to_numpy().astype(np.int64), matrix(part.column("v"), self.dim), k)

    def _near(self, qids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
        books, dim = self.books, self.dim

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tables = np.einsum("qd,mwd->qmw", q.astype(np.float32), books)
            best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(qids)
            for df in batches:
                for ids, codes, norms, x in df.itertuples(index=False, name=None):
                    ids, x = np.frombuffer(ids, np.int64), np.frombuffer(x, np.float64).reshape(-1, dim)
                    codes, norms = np.frombuffer(codes, np.uint8).reshape(-1, len(books)), np.frombuffer(norms, np.float32)
                    # of equal vectors, only the k + 1 of smallest ids can be among the k nearest
                    _, first, kind = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * dim))).ravel(), return_index=True, return_inverse=True)
                    order = np.lexsort((ids, kind))
                    held = np.split(ids[order], np.cumsum(np.bincount(kind))[:-1])
                    held = [h[: k + 1] for h in held]
                    codes, norms, x = codes[first], norms[first], x[first]
                    top = min(RERANK, len(first))
                    for at in range(0, len(qids), 256):
                        t = tables[at : at + 256]
                        score = np.broadcast_to(norms, (len(t), len(norms))).copy()
                        for m in range(codes.shape[1]):
                            score -= 2 * t[:, m, :][:, codes[:, m]]
                        near = np.argpartition(score, top - 1, axis=1)[:, :top] if top < len(first) else np.broadcast_to(np.arange(top), (len(t), top))
                        for r in range(len(t)):
                            rows = near[r]
                            far = np.sqrt(((x[rows] - q[at + r]) ** 2).sum(1))
                            keep = rows[far <= np.partition(far, min(k, top - 1))[min(k, top - 1)]]
                            cand = np.concatenate([held[i] for i in keep])
                            dist = np.repeat(np.sqrt(((x[keep] - q[at + r]) ** 2).sum(1)), [len(held[i]) for i in keep])
                            other = cand != qids[at + r]
                            d, c = np.concatenate([best[at + r][0], dist[other]]), np.concatenate([best[at + r][1], cand[other]])
                            o = np.lexsort((c, d))[:k]
                            best[at + r] = (d[o], c[o])
            size = [len(b[0]) for b in best]
            if sum(size):
                yield pd.DataFrame({"query_id": np.repeat(qids, size), "vec_id": np.concatenate([b[1] for b in best]), "score": np.concatenate([b[0] for b in best])})

        return self.blocks.mapInPandas(run, "query_id long, vec_id long, score double")
