"""The numbered queries: each operator over its whole table, in the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary file ``name`` lies; the files are installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_count import count_tokens

    return count_tokens(_read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import assess, train

    docs = _read(spark, sf_dir, "documents")
    return assess(docs, train(docs, _read(spark, sf_dir, "labels")))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeat_digests

    return repeat_digests(_read(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import similarity_components

    return similarity_components(_read(spark, sf_dir, "documents"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cover_tree import exact_top_k

    return exact_top_k(_read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import gram_counts, identify

    docs = _read(spark, sf_dir, "documents")
    return identify(docs, gram_counts(docs))


def op8_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_bpe import encoding_digests

    return encoding_digests(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets, secret_digests, train

    docs = _read(spark, sf_dir, "documents")
    return secret_digests(find_secrets(docs, train(docs)))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .relative_parse import factor_digests

    return factor_digests(_read(spark, sf_dir, "documents"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hamming import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "embeddings"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import importance_resample

    return importance_resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dual_lloyd import centroid_clusters

    return centroid_clusters(_read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    found = (
        op1_token_counts, op2_quality_rules, op3_best_fit_packing, op4_suffix_array_dedup, op5_ngram_jaccard_join,
        op6_exact_top_k, op7_language_id, op8_bpe_encoding, op9_secret_scans, op10_substring_dedup,
        op11_embedding_dedup, op12_importance_resampling, op13_centroid_clusters,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return {
        "op5_ngram_jaccard_join": oracles.JACCARD,
        "op6_exact_top_k": oracles.TOP_K,
        "op10_substring_dedup": oracles.SUBSTRING,
        "op11_embedding_dedup": oracles.NEAR_VECTORS,
        "op12_importance_resampling": oracles.RESAMPLE,
        "op13_centroid_clusters": oracles.clusters(),
    }
