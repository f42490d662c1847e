"""The queries of this subpackage: name -> f(spark, sf_dir), and SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from . import oracles

#: Folder of the public tokenizers' files, on the driver.
TOKENIZERS = "/opt/tokenizers"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .perplexity import quality

    return quality(_table(spark, sf_dir, "documents"))


def op2_unigram_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .unigram import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import deduplicate

    return deduplicate(_table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(_table(spark, sf_dir, "pages"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_plan

    return mix_plan(_table(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=4, percent=80)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import deduplicated

    rows = deduplicated(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    rows = scan(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_licenses", F.array_join("licenses", ",").alias("licenses"), F.size("spans").cast("long").alias("n_spans"))


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shards import write_temporary

    return write_temporary(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def op11_weighted_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import digested

    return digested(_table(spark, sf_dir, "embeddings"), clusters=16, rounds=3, scale=64, width=64, seed=1)


def op12_uniform_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), lengths=(1, 1), buckets=10000, share=10, least_words=20, seed=2024)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": oracles.OP3, "op6_minhash_near_dedup": oracles.OP6, "op8_line_dedup": oracles.OP8, "op11_weighted_centroids": oracles.OP11, "op12_uniform_threshold_topk": oracles.OP12, "op13_importance_resampling": oracles.OP13}
