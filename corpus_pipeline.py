"""A training corpus from raw documents: quality, near copies, secrets, mixture, token ids.

Each stage reads what its predecessor left as Parquet in the shared folder and returns the documents that stay, as
documents; the last one returns token ids.

In every stage rows of a null or empty text, repeated rows and further columns (of any names) have the results that the stage's
operator defines, and an empty table gives an empty one: the first stage drops texts without words and rows without an id, the
second keeps one row of equal ids and texts, the third leaves texts without secrets as they are, the fourth draws equal rows alike,
the fifth gives every row its ids.  Very long texts are single values in all of them.  No stage holds state for the next one, so a lost executor costs at most the tasks it ran.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import byte_bpe, jaccard_join, kneser_ney, mixing, secrets
from gleaner.llm.shared import discard, free_shuffles, shrink_heaps, stored, work_folder

RANKS = "byte_bpe_multi_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's limit; the model learns from those labelled good."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return kneser_ney.keep_good(docs, kneser_ney.judge(docs, trusted))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (of the smallest id) of each group linked by shingles of five words at a similarity of 0.8."""
    shrink_heaps(spark)
    return jaccard_join.representatives(docs, jaccard_join.join(docs, n=5, least=80))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets replaced in their texts; n_chars is the new text's length."""
    ledger = secrets.record(docs, work_folder(spark, "secret-ledger"))
    clean = secrets.redact(docs, secrets.recorded(docs, ledger))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.drawn(docs, mixing.mix(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row; the ids are decoded again, and a row whose text they do not give back ends the job."""
    shrink_heaps(spark)
    ids = byte_bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, held=True)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("secrets", hide_secrets),
    ("mixture", mixture),
    ("token_ids", token_ids),
]
#: SQL can express neither the language model's counts by shard nor the seeded selection: tests/llm has brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, one after the other, each one's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        kept = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(docs)
        docs = kept
        free_shuffles(spark)
    return docs
