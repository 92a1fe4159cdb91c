"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact, mixing, near, phrases, prefix_bpe, quality, secret_scan, suffixes, token_files, warc
from .shared import documents


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(spark, documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_bpe.encoded_digests(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_phrases": phrases.op2_phrases,
    "op3_secrets": secret_scan.op3_secrets,
    "op4_warc": warc.op4_warc,
    "op5_mix": mixing.op5_mix,
    "op6_suffixes": suffixes.op6_suffixes,
    "op7_bpe": op7_bpe,
    "op8_near": near.op8_near,
    "op9_quality": quality.op9_quality,
    "op10_exact_dedup": exact.op10_exact_dedup,
}

ORACLE_SQL: dict[str, str] = {"op4_warc": warc.OP4_SQL, "op5_mix": mixing.OP5_SQL, "op9_quality": quality.OP9_SQL, "op10_exact_dedup": exact.OP10_SQL}
