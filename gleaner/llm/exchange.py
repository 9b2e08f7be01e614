"""Shuffling numpy arrays as compressed values.

A task turns its texts into arrays keyed by 64-bit hashes.  Sent row by row they would cost most of a job's time and disk, so
a task cuts them by shard (hash modulo the number of shards) and sends one packed value for each block of texts and shard.
Shards are dealt to tasks by shuffling on the shard number; a shard reads its values in order of `kind`, one at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import give_back, mix, pack, text_buffers, unpack

#: Bytes of text in a block: what a task holds at once, whatever the size of its partition (a longer text is a block of its own).
BLOCK_BYTES = 16 << 20


def shards(spark) -> int:
    """As many as shuffle partitions, which whoever runs the job sets by the size of the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def by_shard(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts keys into shards and, within one, in ascending order; where each shard starts."""
    shard = (keys % np.uint64(n)).astype(np.int64)
    order = np.lexsort((keys, shard))
    return order, np.searchsorted(shard[order], np.arange(n + 1))


def text_blocks(batches: Iterator[pa.RecordBatch], extra: tuple[str, ...] = (), limit: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Ids, bytes, offsets and further columns (numbers or booleans) of about `limit` bytes of texts."""
    held: list[tuple] = []
    size = 0

    def joined() -> tuple:
        data = np.concatenate([h[1] for h in held])
        offsets, at = [np.zeros(1, np.int64)], 0
        for _, d, o, _ in held:
            offsets.append(o[1:] - o[0] + at)
            at += len(d)
        return np.concatenate([h[0] for h in held]), data, np.concatenate(offsets), [np.concatenate([h[3][k] for h in held]) for k in range(len(extra))]

    for b in batches:
        if not b.num_rows:
            continue
        data, offsets = text_buffers(b.column("text"))
        ids = b.column("id").to_numpy(zero_copy_only=False)
        cols = [b.column(c).to_numpy(zero_copy_only=False) for c in extra]
        at = 0
        while at < len(ids):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit - size, side="right")) - 1)
            held.append((ids[at:to], data[offsets[at] : offsets[to]], offsets[at : to + 1], [c[at:to] for c in cols]))
            size += int(offsets[to] - offsets[at])
            at = to
            if size >= limit or at < len(ids):
                yield joined()
                held, size = [], 0
    if held:
        yield joined()
    held.clear()
    give_back()


SENT = "shard long, kind int, block long, body binary"


def sent(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    s, k, b, v = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(k, pa.int32()), pa.array(b, pa.int64()), pa.array(v, pa.binary())], names=["shard", "kind", "block", "body"])


def block_names() -> Iterator[int]:
    """Numbers that no other task gives."""
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 24
    while True:
        yield at
        at += 1


def home(block: int, n: int) -> int:
    """A shard for what belongs to a block as a whole; blocks of all tasks are spread evenly."""
    return int(mix(np.array([block], np.uint64))[0] % np.uint64(n))


def split_rows(kind: int, block: int, keys: np.ndarray, n: int, *columns: np.ndarray, first: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> list[tuple[int, int, int, bytes]]:
    """Rows to send: each shard's keys in ascending order (as `first` codes them) and the columns beside them."""
    order, cuts = by_shard(keys, n)
    keys, columns = keys[order], [c[order] for c in columns]
    return [(s, kind, block, pack(first(keys[a:b]), *[c[a:b] for c in columns])) for s, (a, b) in enumerate(pairwise(cuts.tolist())) if b > a]


def at_shards(df: DataFrame, work: Callable[[int, Iterator[tuple[int, int, list[np.ndarray]]]], Iterator[pd.DataFrame | pa.RecordBatch]], schema: str) -> DataFrame:
    """Runs work(shard, values) for every shard that was sent something, values being (kind, block, arrays) by kind and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, int, bytes]]:
            for b in batches:
                cols = [b.column(c) for c in ("shard", "kind", "block", "body")]
                for i in range(b.num_rows):
                    yield cols[0][i].as_py(), cols[1][i].as_py(), cols[2][i].as_py(), cols[3][i].as_py()

        it = rows()
        ahead = next(it, None)
        while ahead is not None:
            shard = ahead[0]

            def values(shard: int = shard) -> Iterator[tuple[int, int, list[np.ndarray]]]:
                nonlocal ahead
                while ahead is not None and ahead[0] == shard:
                    row = ahead
                    ahead = next(it, None)
                    yield row[1], row[2], unpack(row[3])

            mine = values()
            yield from work(shard, mine)
            for _ in mine:  # what the work left unread
                pass
            give_back()

    spark = df.sparkSession
    n = shards(spark)
    own = F.when(F.col("shard") < n, F.col("shard")).otherwise(F.pmod(F.xxhash64("shard"), F.lit(n)))  # a task a shard; blocks by hash
    return df.repartitionById(n, own.cast("int")).sortWithinPartitions("shard", "kind", "block").mapInArrow(run, schema)


def frame(schema: dict[str, pa.DataType], **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) for c, t in schema.items()], names=list(schema))


def source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).where(F.col("id").isNotNull())
