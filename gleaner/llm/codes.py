"""Vector code compression: product codebooks by Exponion search in exact integers (operator 12).

Vectors become integers and are cut into PARTS equal parts; each part has a codebook.  An assignment starts at a part's
previous entry a, at distance u.  Whatever lies within u of the part lies within 2u of a, so only a's neighbour entries up to that
radius are scanned, in the order of their distance from a; the list is sorted once a round.  All distances are squared integers
(d2 <= 4 * u2), so the bound is exact, entries on the border are scanned as well, and ties go to the lower index.

A round reads the stored parts and codes, writes the new codes, and sums the parts by entry in every task; only those sums, one
row for each entry and task, are shuffled, and the codebooks, whose size the parameters fix, go through the driver.

Defined cases: a row without an id is encoded like any other, keeps its null id and comes last where ids name the first entries;
vectors that are null or hold null or non-finite components give no row; zero vectors are vectors; shorter vectors, and a length
that the number of parts does not divide, are filled up with zeros; integers beyond integers.most() count as that; repeated
ids are rows of their own, of which the one of smaller integers (as bytes) comes first; fewer rows than entries give fewer
entries; an empty table gives no rows; extra columns of any name are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .integers import integer_rows
from .shared import discard, stored

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Labels whose sums are broadcast; more are joined by a shuffle, the rows of a frequent label dealt by SALTS.
MOST_LABELS, SALTS = 50_000, 32


def neighbours(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry all entries by distance (ties by index), and those squared distances."""
    far = ((book[:, None, :] - book[None, :, :]) ** 2).sum(2)
    order = np.argsort(far, axis=1, kind="stable")
    return order, np.take_along_axis(far, order, 1)


def nearest(x: np.ndarray, book: np.ndarray, near: tuple[np.ndarray, np.ndarray], start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry (the lowest index on a tie) of each row of x and its squared distance, from the entries in start."""
    order, far = near
    u = ((x - book[start]) ** 2).sum(1)
    # how many of the start's neighbours lie inside the radius
    reach = np.empty(len(x), np.int64)
    by = np.argsort(start, kind="stable")
    cuts = np.searchsorted(start[by], np.arange(len(book) + 1))
    for e in np.flatnonzero(np.diff(cuts)):
        rows = by[cuts[e] : cuts[e + 1]]
        reach[rows] = np.searchsorted(far[e], 4 * u[rows], side="right")
    widest = np.argsort(-reach, kind="stable")
    longest = -reach[widest]
    code, least = start.copy(), u.copy()
    for t in range(int(reach.max(initial=0))):
        rows = widest[: np.searchsorted(longest, -t, side="left")]  # those whose list is longer than t
        entry = order[start[rows], t]
        d = ((x[rows] - book[entry]) ** 2).sum(1)
        new = (d < least[rows]) | ((d == least[rows]) & (entry < code[rows]))
        rows = rows[new]
        code[rows], least[rows] = entry[new], d[new]
    return code, least


def _parts(column: pa.Array | pa.ChunkedArray, dims: np.ndarray, width: int, parts: int) -> np.ndarray:
    """rows x parts x width, filled up with zeros."""
    out = np.zeros((len(column), parts * width), np.int64)
    for r, (x, d) in enumerate(zip(column, dims.tolist(), strict=True)):
        out[r, :d] = np.frombuffer(x.as_py(), "<i4")
    return out.reshape(len(column), parts, width)


def _assign(x: np.ndarray, books: np.ndarray, lists: list, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code, error = np.empty(x.shape[:2], np.int64), np.zeros(len(x), np.int64)
    for p in range(x.shape[1]):
        code[:, p], d = nearest(x[:, p], books[p], lists[p], start[:, p])
        error += d
    return code, error


def _assigned(rows: DataFrame, books: np.ndarray, kinds: str, keep: list[str]) -> DataFrame:
    """Stored rows with code (an entry's index for each part, a byte each) and error; earlier codes are where the search starts."""
    parts, _, width = books.shape
    held = "code" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [neighbours(b) for b in books]
        for b in batches:
            x = _parts(b.column("q"), b.column("dim").to_numpy(), width, parts)
            start = np.zeros(x.shape[:2], np.int64)
            if held and len(x):
                start = np.frombuffer(b"".join(c.as_py() for c in b.column("code")), np.uint8).reshape(start.shape).astype(np.int64)
            code, error = _assign(x, books, lists, start)
            new = pa.array([c.tobytes() for c in code.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], new, pa.array(error)], names=[*keep, "code", "error"])

    return stored(rows.mapInArrow(run, f"{kinds}, code binary, error long"), "codes")


def _means(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry as the floor of its parts' mean; unused entries stay."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width + 1), np.int64)  # the last one counts
        for b in batches:
            x = _parts(b.column("q"), b.column("dim").to_numpy(), width, parts)
            code = np.frombuffer(b"".join(c.as_py() for c in b.column("code")), np.uint8).reshape(x.shape[:2])
            for p in range(parts):
                np.add.at(sums[p], code[:, p], np.concatenate([x[:, p], np.ones((len(x), 1), np.int64)], 1))
        flat = sums.ravel()
        places = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(flat[places])], names=["place", "total"])

    got = rows.select("dim", "q", "code").mapInArrow(run, "place long, total long").groupBy("place").agg(F.sum("total").alias("total")).toArrow()
    flat = np.zeros(parts * entries * (width + 1), np.int64)
    flat[got.column("place").to_numpy()] = got.column("total").to_numpy()
    sums = flat.reshape(parts, entries, width + 1)
    used = sums[:, :, -1:] > 0
    return np.where(used, sums[:, :, :-1] // np.maximum(sums[:, :, -1:], 1), books)


def compress(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Rows (id, code, error, label_error, codebooks_sha256): code as two hexadecimal digits a part, error as the squared distance to
    the code's entries, label_error as the sum of error over the rows of equal label."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has a byte a part")
    src = vectors.select(vectors[id_col].alias("id"), vectors[label_col].alias("label"), vectors[vector_col].alias("v"))
    kind = dict(src.dtypes)
    rows = now = integer_rows(src, ["id", "label"], "v", "integers")
    width = max(1, -(-(rows.agg(F.max("dim")).first()[0] or 0) // parts))
    first = rows.orderBy(F.asc_nulls_last("id"), "q").limit(entries).select("dim", "q").toArrow()  # `entries` rows
    if not first.num_rows:
        return vectors.sparkSession.createDataFrame([], f"{id_col} {kind['id']}, code string, error long, label_error long, codebooks_sha256 string")
    books = _parts(first.column("q"), first.column("dim").to_numpy(), width, parts).transpose(1, 0, 2).copy()
    kept = ["id", "label", "dim", "q"]
    kinds = f"id {kind['id']}, label {kind['label']}"
    for _ in range(rounds):
        spent, now = now, _assigned(now, books, f"{kinds}, dim long, q binary", kept)
        discard(spent)
        books = _means(now, books)
    done = _assigned(now, books, kinds, ["id", "label"])
    discard(now)
    name = hashlib.sha256(",".join(map(str, books[:, :, :].ravel().tolist())).encode()).hexdigest()
    sums = stored(done.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    if sums.limit(MOST_LABELS + 1).count() <= MOST_LABELS:
        both = done.alias("d").join(F.broadcast(sums.alias("s")), F.col("d.label").eqNullSafe(F.col("s.label")))
    else:
        dealt = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = done.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
        both = salted.alias("d").join(dealt.alias("s"), F.col("d.label").eqNullSafe(F.col("s.label")) & (F.col("d.salt") == F.col("s.salt")))
    return both.select(F.col("d.id").alias(id_col), F.lower(F.hex("d.code")).alias("code"), F.col("d.error").alias("error"), F.col("s.label_error").alias("label_error"), F.lit(name).alias("codebooks_sha256"))
