"""The queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bisector, bpe, chunks, decontaminate, jaccard, langid, licenses, pii, quality, repair, sharding, suffixes, toxicity
from tidemark.llm.common import table


def vocabulary() -> tuple[dict[bytes, int], str]:
    """The public byte-level vocabulary that the queries use: ranks and the pattern of its matches."""
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def surrogate_key(spark: SparkSession) -> str:
    """The key of surrogates: ``spark.tidemark.surrogate.key``, or one that is no secret, for sample tables."""
    return spark.conf.get("spark.tidemark.surrogate.key", "sample tables only")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.op1(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op2(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op3(table(spark, sf_dir, "documents"), surrogate_key(spark))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.op4(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op5(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op6(table(spark, sf_dir, "documents"))


def op7_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op7(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op8(table(spark, sf_dir, "documents"), *vocabulary())


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op9(table(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.op10(table(spark, sf_dir, "documents"))


def op11_bisector_tournament(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bisector.op11(table(spark, sf_dir, "embeddings"))


def op12_weighted_cyk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.op12(table(spark, sf_dir, "conversations"))


def op13_jump_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op13(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_substring_dedup, op2_toxicity, op3_pii_surrogates, op4_ngram_jaccard_join, op5_decontamination, op6_language_id, op7_compression_bands, op8_byte_bpe, op9_license_scan, op10_suffix_array_dedup,
        op11_bisector_tournament, op12_weighted_cyk, op13_jump_hash,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_ngram_jaccard_join": jaccard.ORACLE, "op5_decontamination": decontaminate.ORACLE, "op9_license_scan": licenses.oracle(), "op11_bisector_tournament": bisector.oracle(),
        "op12_weighted_cyk": repair.oracle(), "op13_jump_hash": sharding.oracle(),
    }
