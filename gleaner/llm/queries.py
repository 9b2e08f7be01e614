"""The llm operators' registered queries, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import byte_bpe, codes, hard_negatives, jaccard_join, kneser_ney, licenses, mixing, near_vectors, nearest, oracles, secrets, substring_dedup, token_store, toxicity
from .shared import work_folder


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(documents(spark, sf_dir), n=4, least=85)


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return kneser_ney.judge(documents(spark, sf_dir), trusted)


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.95)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark, "token-store")
    token_store.write(documents(spark, sf_dir), path, _tokenizer("word_bpe_49k.json"), end_id=2)
    return token_store.digests(spark, path)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return secrets.report(secrets.recorded(docs, secrets.record(docs, work_folder(spark, "secret-ledger"))))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(documents(spark, sf_dir), size=13)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(documents(spark, sf_dir), _tokenizer("byte_bpe_multi_50k.tiktoken"), _pattern(), digest=True)


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.Index(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).search(F.col("id") % 100 == 0, k=10)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors, F.col("id") % 50 == 0, label=label, positives=5, negatives=3, low=50, high=95)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), parts=16, entries=64, rounds=2)


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(licenses.spans(documents(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_jaccard_join, op2_kneser_ney, op3_near_vectors, op4_token_store, op5_mixing, op6_toxicity, op7_secrets, op8_substring_dedup, op9_byte_bpe, op10_nearest, op11_hard_negatives, op12_vector_codes, op13_licenses)
}
ORACLE_SQL: dict[str, str] = oracles.ORACLE_SQL
