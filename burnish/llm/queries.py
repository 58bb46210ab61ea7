"""The registered queries of this subpackage, one for each operator, with
production parameters, over whole tables."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def surrogate_key(spark: SparkSession) -> str:
    """The session's secret for surrogates; where it sets none, one that is used once."""
    return spark.conf.get("spark.burnish.surrogates.key", None) or secrets.token_hex(32)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_quality_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repetition import judge

    return judge(table(spark, sf_dir, "documents")).drop("longest_repeat")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import without_repeats

    return without_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("longest_window")


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dsir import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import token_documents

    return token_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kneser_ney import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1)


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .surrogates import replaced

    return replaced(table(spark, sf_dir, "documents").select("doc_id", "text"), surrogate_key(spark), count="n_entities")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash_near_dedup, op2_quality_repetition, op3_substring_dedup, op4_decontamination, op5_importance_resampling, op6_token_store, op7_token_counts, op8_kneser_ney, op9_best_fit_packing, op10_pii_surrogates)}


def oracle_sql() -> dict[str, str]:
    from .decontam import ORACLE_SQL as decontamination
    from .repetition import ORACLE_SQL as repetition
    from .substring import ORACLE_SQL as substring

    return {"op2_quality_repetition": repetition, "op3_substring_dedup": substring, "op4_decontamination": decontamination}
