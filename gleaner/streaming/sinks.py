"""Append-only logs of a stream: each micro-batch is written once, however often it is replayed.

A batch goes to a folder of its own, named by its id, and a replayed batch overwrites that folder; so a query that was killed
between writing and committing leaves no second copy, and one that was killed while it wrote leaves nothing that is read, as
a folder counts only when its writer finished.  What a log holds is read as one table with its batch_id.

Defined cases: an empty batch makes an empty folder; extra columns are kept as they are; a log without a batch is an
empty table of the given schema; nulls are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends to the log at path."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def logged(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer of the stream to the log at path; start it, or trigger it first."""
    return stream.writeStream.foreachBatch(append_once(path)).option("checkpointLocation", checkpoint)


def log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The log's rows with their batch_id."""
    return spark.read.schema(f"{schema}, batch_id long").option("ignoreMissingFiles", True).parquet(path)


#: Tools that write a deliverable.
WRITERS = ("write", "write_file", "edit", "edit_file", "apply_patch")
#: Usage of a model's call: the total if it is given, else what went in and came out, by the names that hosts use.
TOTALS = ("total_tokens", "totalTokens", "total")
PARTS = (("input_tokens", "prompt_tokens", "input"), ("output_tokens", "completion_tokens", "output"))


def usage_tokens(usage: str = "usage") -> Column:
    """Tokens of a usage object in JSON; the first of the names that is neither missing nor zero counts."""
    first = lambda names: F.coalesce(*[F.nullif(F.get_json_object(usage, f"$.{n}").try_cast("long"), F.lit(0)) for n in names], F.lit(0).cast("long"))
    return F.coalesce(F.nullif(first(TOTALS), F.lit(0)), first(PARTS[0]) + first(PARTS[1]))


def session_summary(events: DataFrame) -> DataFrame:
    """conversation, tokens, requests, tool_calls, truncations, previews, raws, cards, reads, written of an event log.

    events: conversation, kind (usage, native, sro_preview, sro_raw, sro_card, sro_read), phase, tool, truncated, usage (JSON)."""
    is_ = lambda k: F.col("kind") == k
    after = is_("native") & (F.col("phase") == "after")
    ours = {"previews": "sro_preview", "raws": "sro_raw", "cards": "sro_card", "reads": "sro_read"}
    out = events.groupBy(F.coalesce("conversation", F.lit("default")).alias("conversation")).agg(
        F.coalesce(F.sum(F.when(is_("usage"), usage_tokens())), F.lit(0)).alias("tokens"),
        F.count_if(is_("usage")).alias("requests"),
        F.count_if(after | F.col("kind").isin(*ours.values())).alias("tool_calls"),
        F.count_if(is_("native") & F.col("truncated")).alias("truncations"),
        *[F.count_if(is_(k)).alias(n) for n, k in ours.items()],
        F.coalesce(F.bool_or(after & F.col("tool").isin(*WRITERS)), F.lit(False)).alias("written"),
    )
    return out


def rendered(events: DataFrame) -> DataFrame:
    """A log of calls out of the events table: a conversation a user, kinds by event_type and the number in props."""
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    kind = F.when(F.col("event_type") == "purchase", "usage").when(F.col("event_type") == "error", "native").when(F.col("event_type") == "signup", "sro_card")
    usage = F.when(k % 3 == 0, F.concat(F.lit('{"total_tokens": '), k.cast("string"), F.lit("}"))).when(k % 3 == 1, F.concat(F.lit('{"prompt_tokens": '), k.cast("string"), F.lit(', "output": 7}'))).otherwise('{"total": 0, "input": 5}')
    return events.select(
        F.col("user_id").cast("string").alias("conversation"), kind.when(F.col("event_type") == "view", F.when(k % 2 == 0, "sro_preview").otherwise("sro_raw")).otherwise("sro_read").alias("kind"),
        F.when(k % 2 == 0, "after").otherwise("before").alias("phase"), F.when(k % 4 == 0, "write_file").otherwise("read_file").alias("tool"), (k % 5 == 0).alias("truncated"), usage.alias("usage"),
    )
