"""A cache of what is ready, for each conversation: entries by use and path with an age limit and a greatest number.

Events: put (evidence for a path is ready), ask (is there any for this path?), drop (a scope has changed), claim (may this path be
redirected, once?).  An entry lives for `ttl` from its last put or granted claim; of more than `most` entries of a use the oldest go
first.  An ask is answered by the nearest entry at the path or above it.  A drop removes entries at, above and below its scope.
A claim is granted where no living claim of the same path is.

As a batch this is a fold over sorted rows, in the memory of one conversation's cache.  As a stream the entries are a map in
Spark's state store, and timers on event time remove what has expired although nobody asks again; the watermark moves them.

Defined cases: a null conversation is "default"; a null path or kind does nothing and is not answered; events of equal times go by
event_id; a path is compared as it is written, without its last slash; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, MutableMapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .episodes import related

#: The greatest number of entries, and a day in microseconds.
MOST, DAY = 512, 86_400_000_000
ROW = "conversation string, event_id long, kind string, path string, granted boolean, answer string, held long"
NAMES = [f.split()[0] for f in ROW.split(", ")]
Cache = MutableMapping[tuple[str, str], tuple[int, int]]  # (use, path) -> (time, place among equal times)


def _newest(cache: Cache, use: str, most: int) -> None:
    mine = sorted((entry, key) for key, entry in cache.items() if key[0] == use)
    for _, key in mine[: max(0, len(mine) - most)]:
        del cache[key]


def step(cache: Cache, kind: str, path: str, at: int, place: int, ttl: int, most: int) -> tuple[bool | None, str | None, int]:
    """granted, answer and the number of ready entries after an event; changes the cache."""
    for key in [key for key, (put, _) in cache.items() if at - put >= ttl]:
        del cache[key]
    granted = answer = None
    if kind in ("put", "claim") and path:
        key = ("ready" if kind == "put" else "claim", path)
        granted = kind == "put" or key not in cache
        if granted:
            cache[key] = (at, place)
            _newest(cache, key[0], most)
    elif kind == "ask" and path:
        above = [p for use, p in cache if use == "ready" and (p == path or path.startswith(f"{p}/"))]
        answer = max(above, key=len, default=None)
    elif kind == "drop" and path:
        for key in [key for key in cache if key[0] == "ready" and related(key[1], path)]:
            del cache[key]
    return granted, answer, sum(use == "ready" for use, _ in cache)


def _normalised(events: DataFrame) -> DataFrame:
    path = F.regexp_replace(F.coalesce(F.col("path").cast("string"), F.lit("")), "(?<=.)/$", "")
    return events.select(F.coalesce(F.col("conversation").cast("string"), F.lit("default")).alias("conversation"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.coalesce(F.col("kind").cast("string"), F.lit("")).alias("kind"), path.alias("path"))


def folded(events: DataFrame, ttl: int = DAY, most: int = MOST) -> DataFrame:
    """The batch form: a row (ROW) for each event.  events: conversation, event_id, ts, kind, path."""
    ordered = _normalised(events).withColumn("at", F.unix_micros("ts")).repartition("conversation").sortWithinPartitions("conversation", "at", "event_id", "kind", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cache = None, {}
        for b in batches:
            out = []
            for conversation, event_id, kind, path, at in zip(*[b.column(c).to_pylist() for c in ("conversation", "event_id", "kind", "path", "at")], strict=True):
                if conversation != now:
                    now, cache = conversation, {}
                out.append((conversation, event_id, kind, path, *step(cache, kind, path, at, event_id, ttl, most)))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=NAMES)

    return ordered.mapInArrow(run, ROW)


class Caches(StatefulProcessor):
    def __init__(self, ttl: int, most: int):
        self.ttl, self.most = ttl, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "use string, path string", "at long, place long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(rows).sort_values(["at", "event_id", "kind", "path"])
        held = {tuple(k): tuple(v) for k, v in self.entries.iterator()}  # at most `most` a use
        cache = dict(held)
        out = [(key[0], r.event_id, r.kind, r.path, *step(cache, r.kind, r.path, r.at, r.event_id, self.ttl, self.most)) for r in events.itertuples()]
        for k in held.keys() - cache.keys():
            self.entries.removeKey(k)
        for k, v in cache.items():
            if held.get(k) != v:
                self.entries.updateValue(k, v)
                self.handle.registerTimer((v[0] + self.ttl) // 1000 + 1)
        frame = pd.DataFrame(out, columns=NAMES)
        yield frame.astype({"granted": "object"})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        for k, v in [(tuple(k), tuple(v)) for k, v in self.entries.iterator()]:
            if now - v[0] >= self.ttl:
                self.entries.removeKey(k)
        yield pd.DataFrame([], columns=NAMES)

    def close(self) -> None:
        pass


def streamed(events: DataFrame, ttl: int = DAY, most: int = MOST, late: str = "1 hour") -> DataFrame:
    """The streaming form: the same rows.  Events later than `late` behind the newest are dropped by the watermark."""
    at = _normalised(events).withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    return at.groupBy("conversation").transformWithStateInPandas(Caches(ttl, most), outputStructType=ROW, outputMode="Append", timeMode="EventTime")


def rendered(events: DataFrame) -> DataFrame:
    """Cache events out of the events table: a conversation a user; paths by the number in props."""
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    kind = F.when(F.col("event_type") == "view", "ask").when(F.col("event_type") == "click", "claim").when(F.col("event_type") == "purchase", "put").when(F.col("event_type") == "signup", F.when(k % 2 == 0, "ask").otherwise("put"))
    path = F.concat(F.lit("/r"), (k % 3).cast("string"), F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("/d"), (k % 5).cast("string"))))
    return events.select(F.col("user_id").cast("string").alias("conversation"), "event_id", "ts", kind.otherwise(F.when(k % 7 == 0, "drop").otherwise("ask")).alias("kind"), path.alias("path"))
