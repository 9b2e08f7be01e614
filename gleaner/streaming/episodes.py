"""Reading episodes: one at a time for each conversation, as a fold over its events.

An event binds a scope (a path that is about to be read), says that evidence is ready, that output has begun, that a final answer
was given, that a file was read, or that the conversation ended.  A bind keeps the conversation's episode as a lease or rotates to a
new one.  Every event gives one row, the episode as it stands after it.

The same step serves both forms.  As a batch, events are dealt by conversation and sorted inside their partitions, and the fold runs
over the sorted rows with one state at hand, so that a conversation of any length needs no more memory than a short one.
As a stream, the state is a typed value of Spark's state store, keyed by conversation; what one micro-batch holds of a
conversation is sorted before it is folded, and the trigger bounds that.

Defined cases: a null or empty conversation is the conversation "default"; a null turn, relation, goal, coverage, summary or
scope is empty ("unknown" says nothing either); events of equal times go by event_id; a kind that is not known changes
nothing; before the first bind, and after an end, rows have number 0 or the last number, and status "none"; extra columns
are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: A discovery of a collection, which ends when a part of it is bound.
DISCOVERY = "collection_goal_required"
TEXTS = ("conversation", "kind", "turn", "scope", "relation", "goal", "coverage", "summary", "code", "closure")
STATE = "number long, status string, turn string, scope string, goal string, coverage string, summary string, code string, closure string, late_reads long"
ROW = f"conversation string, event_id long, ts timestamp, kind string, rotated boolean, episode_id string, {STATE}"


class Episode(NamedTuple):
    number: int = 0
    status: str = "none"
    turn: str = ""
    scope: str = ""
    goal: str = ""
    coverage: str = ""
    summary: str = ""
    code: str = ""
    closure: str = ""
    late_reads: int = 0


def related(a: str, b: str) -> bool:
    """Equal paths, or one below the other."""
    return a == b or b.startswith(f"{a.rstrip('/')}/") or a.startswith(f"{b.rstrip('/')}/")


def _said(new: str, old: str) -> bool:
    return new not in ("", "unknown", old)


def _stays(e: Episode, scope: str, turn: str, relation: str) -> bool:
    """Whether a bind keeps the episode."""
    if not related(e.scope, scope) or e.status == "none":
        return False
    if e.status == "resolved":
        return relation == "continue"
    narrowed = e.status == "open" and e.code == DISCOVERY and scope != e.scope and scope.startswith(f"{e.scope.rstrip('/')}/")
    return not (relation == "switch" or (relation == "new" and turn != e.turn) or narrowed)


def step(e: Episode, kind: str, turn: str, scope: str, relation: str, goal: str, coverage: str, summary: str, code: str, closure: str) -> Episode:
    """The conversation's episode after an event."""
    if kind == "bind" and not _stays(e, scope, turn, relation):
        return Episode(e.number + 1, "open", turn, scope, goal or "unknown", coverage or "unknown", summary, code, "", e.late_reads)
    if kind == "bind":
        wakes, news = e.status == "resolved", _said(goal, e.goal) or _said(coverage, e.coverage)
        e = e._replace(turn=turn or e.turn, summary=summary if summary and (wakes or news) else e.summary)
        if news:
            return e._replace(goal=goal if _said(goal, e.goal) else e.goal, coverage=coverage if _said(coverage, e.coverage) else e.coverage, code=code, status="open", closure="")
        return e._replace(status="evidence_ready" if e.closure else "open") if wakes else e
    if e.status == "none":
        return e
    if kind == "ready":
        return e._replace(status="evidence_ready", closure=closure) if related(e.scope, scope) else e
    if kind == "read":
        return e._replace(late_reads=e.late_reads + (e.status == "evidence_ready"))
    if kind == "final" or (kind == "output" and e.status == "evidence_ready"):
        return e._replace(status="resolved")
    return Episode(e.number, late_reads=e.late_reads) if kind == "end" else e


def episode_id(conversation: str, e: Episode) -> str:
    return f"episode_{hashlib.sha1(f'{conversation}|{e.number}'.encode()).hexdigest()[:10]}" if e.number else ""


def _told(conversation: str, before: Episode, after: Episode, event_id: int, ts: object, kind: str) -> tuple:
    return (conversation, event_id, ts, kind, after.number > before.number, episode_id(conversation, after), *after)


def normalised(events: DataFrame) -> DataFrame:
    """event_id, ts and the texts of TEXTS, without nulls."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in TEXTS[1:]]
    return events.select(F.coalesce(F.nullif(F.col("conversation").cast("string"), F.lit("")), F.lit("default")).alias("conversation"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), *texts)


def folded(events: DataFrame) -> DataFrame:
    """The batch form: a row (ROW) for each event.  events: event_id, ts and the columns of TEXTS."""
    ordered = normalised(events).repartition("conversation").sortWithinPartitions("conversation", "ts", "event_id", *TEXTS[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, Episode()
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("conversation", "event_id", "kind", *TEXTS[2:])]
            out = []
            for (conversation, event_id, kind, *rest), ts in zip(zip(*columns, strict=True), b.column("ts"), strict=True):
                if conversation != now:
                    now, state = conversation, Episode()
                before, state = state, step(state, kind, *rest)
                out.append(_told(conversation, before, state, event_id, ts, kind))
            names = [f.split()[0] for f in ROW.split(", ")]
            kinds = [b.schema.field("ts").type if n == "ts" else pa.bool_() if n == "rotated" else pa.int64() if n in ("event_id", "number", "late_reads") else pa.string() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)

    return ordered.mapInArrow(run, ROW)


class Conversations(StatefulProcessor):
    """The streaming form of the fold; a conversation that ended keeps only its numbers."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("episode", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(rows).sort_values(["ts", "event_id", *TEXTS[1:]])
        state = Episode(*self.held.get()) if self.held.exists() else Episode()
        out = []
        for event_id, ts, kind, *rest in events[["event_id", "ts", "kind", *TEXTS[2:]]].itertuples(index=False, name=None):
            before, state = state, step(state, kind, *rest)
            out.append(_told(key[0], before, state, event_id, ts, kind))
        self.held.update(tuple(state))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in ROW.split(", ")])

    def close(self) -> None:
        pass


def streamed(events: DataFrame) -> DataFrame:
    """The streaming form: the same rows, micro-batch by micro-batch.  Needs the RocksDB state store."""
    grouped = normalised(events).groupBy("conversation")
    return grouped.transformWithStateInPandas(Conversations(), outputStructType=ROW, outputMode="Append", timeMode="None")


def rendered(events: DataFrame) -> DataFrame:
    """Reading events out of the events table: a conversation a user; kinds by event_type, all else by the number in props."""
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    kind = F.when(F.col("event_type").isin("view", "click"), "bind").when(F.col("event_type") == "purchase", "ready").when(F.col("event_type") == "error", pick(k, "read", "output", "read"))
    scope = F.concat(pick(k, "/r/a", "/r/b"), pick(F.floor(k / 2), "", "/x", "", "/x/y"))
    return events.select(
        F.col("user_id").cast("string").alias("conversation"), "event_id", "ts", kind.otherwise(pick(k, "final", "end", "final", "other")).alias("kind"), F.concat(F.lit("t"), F.floor(F.col("event_id") / 500).cast("string")).alias("turn"), scope.alias("scope"),
        pick(F.floor(k / 3), "continue", "unknown", "continue", "new", None, "switch", "continue").alias("relation"), pick(F.floor(k / 5), "unknown", "selective_read", None, "selective_read").alias("goal"),
        pick(F.floor(k / 7), "unknown", "targeted", "targeted").alias("coverage"), F.concat(F.lit("s"), k.cast("string")).alias("summary"), pick(k, DISCOVERY, "long_document").alias("code"), F.concat(F.lit("c"), k.cast("string")).alias("closure"),
    )
