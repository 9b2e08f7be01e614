"""Toxicity by non-negative positive-unlabelled learning (operator 6).

The learner sees confirmed toxic documents (P) and the texts of all learnable documents without their labels (U, the marginal),
never confirmed clean ones as such.  With the class prior pi, taken from the labelled rows it may learn from, the risk of a linear
score f is
    pi E_P[l(f)] + max(0, E_U[l(-f)] - pi E_P[l(-f)]),
with logistic loss l; where the corrected negative part falls below zero its gradient is reversed, so that the
learner cannot profit from over-fitting U.  Features are the words of a text and their beginnings, by hash, without case or
punctuation, with the logarithm of their count, and the length; those that P holds clearly more often than U are kept.

P is a sample by hash of the id, of at most SAMPLE_P labelled rows; it is the one bound on what is read.  U is every
document: its document frequencies are summed by tasks over the features that P's documents hold, its feature rows are written
once (equal ones as one row with their number), and each of the ROUNDS steps sums the loss and the gradient over them in tasks.
The driver holds P's feature rows and one number a feature.  Scoring reads every whole text in one pass without a shuffle.

Defined cases: null and empty texts are scored by length 0 and the intercept; a null id is never learned from and is not held
out; repeated rows count as often as they occur and give one row each; ties of features go to the smaller hash; without any
confirmed example, and so with empty tables, all scores are 0; labels that are null are no labels; a very long text is one
value; columns other than the id, the text and the label are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import chunks, stems, text_buffers
from .shared import discard, stored

SAMPLE_P, FEATURES, ROUNDS, STEP = 5_000, 2_048, 100, 0.1
THRESHOLD = 0.7
#: Sums over U are added as whole numbers of this fraction, so that the order of the tasks does not matter.
UNIT = 2.0**-24


STEMS = (5, 6, 7, 8, 10)


@dataclass
class Model:
    features: np.ndarray
    weights: np.ndarray  # one a feature and one for the length
    intercept: float
    prior: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if self.prior <= 0:
            return np.zeros(n)
        doc, k, value, length = feature_rows(self.features, data, offsets)
        f = np.bincount(doc, weights=self.weights[k] * value, minlength=n)[:n] + self.weights[-1] * length + self.intercept
        return 1 / (1 + np.exp(-np.clip(f, -60, 60)))


def counted(data: np.ndarray, offsets: np.ndarray, features: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and count of every feature (of those given) in every document, and the documents' numbers of words."""
    h, doc, n_words = stems(data, offsets, STEMS)
    if features is not None and not len(features):
        h, doc = h[:0], doc[:0]
    elif features is not None:
        keep = np.flatnonzero(features[np.minimum(np.searchsorted(features, h), len(features) - 1)] == h)
        h, doc = h[keep], doc[keep]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
    return doc[first], h[first], np.diff(np.append(first, len(h))), n_words


def feature_rows(features: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    doc, h, count, n_words = counted(data, offsets, features)
    return doc, np.searchsorted(features, h), np.log1p(count), np.log1p(n_words)


def fold(id_col: str) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def confirmed(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """doc_id and text of the confirmed documents to learn from, written, and the prior."""
    mine = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(fold("doc_id") != 1)
    prior = mine.agg(F.avg((F.col("toxic") == 1).cast("double")).alias("p")).first()["p"]
    ids = mine.where("toxic = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_P)
    return stored(docs.join(F.broadcast(ids), "doc_id"), "toxicity-confirmed"), float(prior or 0.0)  # at most SAMPLE_P ids


def frequencies(docs: DataFrame, among: np.ndarray | None = None) -> DataFrame:
    """Rows (h, n): documents that hold the feature h (of those given)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0 if among is None else len(among), np.int64)
        for b in batches:
            data, offsets = text_buffers(b.column("text"))
            for lo, hi in chunks(offsets):
                _, h, _, _ = counted(data, offsets[lo : hi + 1], among)
                if among is None:
                    names, n = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n)], names=["h", "n"])
                else:
                    total += np.bincount(np.searchsorted(among, h), minlength=len(among))
        if len(total):
            yield pa.RecordBatch.from_arrays([pa.array(among.view(np.int64)), pa.array(total)], names=["h", "n"])

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def selected(p_docs: DataFrame, u_docs: DataFrame, n_p: int, n_u: int) -> np.ndarray:
    """The FEATURES hashes, ascending, that P's documents hold most clearly more often than U's."""
    # what few confirmed examples hold says nothing; at most a fifth of the entries of SAMPLE_P documents
    held = {r["h"]: r["n"] for r in frequencies(p_docs).where("n >= 5").collect()}
    names = np.sort(np.array(list(held), np.int64).view(np.uint64))
    if not len(names):
        return names
    p = np.array([held[int(h)] for h in names.view(np.int64)], np.float64)
    u = np.zeros(len(names))
    for r in frequencies(u_docs, names).collect():  # one row a name
        u[np.searchsorted(names, np.uint64(r["h"] & 0xFFFFFFFFFFFFFFFF))] = r["n"]
    a, b, both = (p + 0.5) / (n_p + 1), (u + 0.5) / (n_u + 1), (p + u + 1) / (n_p + n_u + 2)
    z = (a - b) / np.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u))
    clear = np.flatnonzero((a > 2 * b) & (z > 5))
    best = clear[np.lexsort((names.view(np.int64)[clear], -z[clear]))][:FEATURES]
    return np.sort(names[best])


def rows_of(docs: DataFrame, features: np.ndarray) -> DataFrame:
    """Rows (n, h, times): number of words, places and counts of the features held, and how many documents have just these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_buffers(b.column("text"))
            for lo, hi in chunks(offsets):
                doc, h, count, n_words = counted(data, offsets[lo : hi + 1], features)
                cuts = np.searchsorted(doc, np.arange(hi - lo + 1))
                both = np.stack([np.searchsorted(features, h).astype("<u2"), np.minimum(count, 65535).astype("<u2")], axis=1)
                held = [both[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(n_words.astype(np.int64)), pa.array(held, pa.binary())], names=["n", "h"])

    return docs.select("text").mapInArrow(run, "n long, h binary").groupBy("n", "h").agg(F.count("*").alias("times"))


@dataclass
class Part:
    """Feature rows as arrays: row, place and value of every entry, length and number of every row."""

    row: np.ndarray
    k: np.ndarray
    value: np.ndarray
    length: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, n: np.ndarray, h: list[bytes], times: np.ndarray) -> Part:
        both = np.frombuffer(b"".join(h), "<u2").reshape(-1, 2)
        row = np.repeat(np.arange(len(h)), [len(x) // 4 for x in h])
        return cls(row, both[:, 0].astype(np.int64), np.log1p(both[:, 1].astype(np.float64)), np.log1p(n.astype(np.float64)), times.astype(np.float64))

    def score(self, w: np.ndarray) -> np.ndarray:
        """w: a weight a feature, that of the length, the intercept."""
        return np.bincount(self.row, weights=w[self.k] * self.value, minlength=len(self.length)) + w[-2] * self.length + w[-1]

    def pulled(self, g: np.ndarray, size: int) -> np.ndarray:
        """The gradient by the weights of a sum over rows, of which g is the gradient by the score."""
        return np.concatenate([np.bincount(self.k, weights=g[self.row] * self.value, minlength=size - 2), [(g * self.length).sum(), g.sum()]])


def sigma(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def over_u(rows: DataFrame, w: np.ndarray) -> np.ndarray:
    """Sums over U's documents: the gradient of l(-f) by the weights, and l(-f) itself, last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(w) + 1)
        for b in batches:
            part = Part.of(b.column("n").to_numpy(), b.column("h").to_pylist(), b.column("times").to_numpy())
            f = part.score(w)
            total[:-1] += part.pulled(part.times * sigma(f), len(w))
            total[-1] += (part.times * np.logaddexp(0, f)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(np.rint(total / UNIT).astype(np.int64))], names=["k", "s"])

    out = np.zeros(len(w) + 1)
    for r in rows.mapInArrow(run, "k int, s long").groupBy("k").agg(F.sum("s").alias("s")).collect():  # one row a weight
        out[r["k"]] = r["s"] * UNIT
    return out


def descent(p: Part, n_p: int, n_u: int, prior: float, w: np.ndarray, sums: np.ndarray) -> tuple[float, float, np.ndarray]:
    """The risk, its negative part before the correction, and the direction to descend: the gradient, or the negative part's reversed.

    sums: over_u() at w."""
    f = p.score(w)
    share = p.times / n_p
    negative = sums[-1] / n_u - prior * float((share * np.logaddexp(0, f)).sum())
    g = sums[:-1] / n_u - prior * p.pulled(share * sigma(f), len(w))
    positive = prior * float((share * np.logaddexp(0, -f)).sum())
    return positive + max(0.0, negative), negative, -g if negative < 0 else g + prior * p.pulled(share * (sigma(f) - 1), len(w))


def fit(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic.  Rows with crc32(doc_id as text) mod 3 = 1 are left out."""
    docs = docs.select("doc_id", "text").where(fold("doc_id") != 1)
    p_docs, prior = confirmed(docs, labels)
    n_p = p_docs.count()
    n_u = docs.count() if n_p else 0
    if not n_p or not n_u:
        discard(p_docs)
        return Model(np.zeros(0, np.uint64), np.zeros(1), 0.0, 0.0)
    best = selected(p_docs, docs, n_p, n_u)
    some = rows_of(p_docs, best).orderBy("n", "h").collect()  # at most SAMPLE_P rows of FEATURES places
    p = Part.of(np.array([r["n"] for r in some]), [bytes(r["h"]) for r in some], np.array([r["times"] for r in some]))
    rows = stored(rows_of(docs, best).sortWithinPartitions("n", "h"), "toxicity-rows")
    w = np.zeros(len(best) + 2)
    w[-1] = np.log(prior / (1 - prior)) if prior < 1 else 0.0
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for t in range(1, rounds + 1):
        _, _, grad = descent(p, n_p, n_u, prior, w, over_u(rows, w))
        grad[:-2] += 1e-4 * w[:-2]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        rate = STEP * min(1.0, 2 * (1 - (t - 1) / rounds))
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    discard(p_docs, rows)
    return Model(best, w[:-1], float(w[-1]), prior)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_buffers(b.column("text"))
            s = np.concatenate([model.scores(data, offsets[lo : hi + 1]) for lo, hi in chunks(offsets)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["id", "score", "predicted"])

    src = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    out = src.mapInArrow(run, "id long, score double, predicted int")
    return out.select(F.col("id").alias(id_col), F.coalesce(fold("id") == 1, F.lit(False)).alias("held_out"), "score", "predicted")
