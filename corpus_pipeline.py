"""Preparation of a training corpus: stages over ``documents``, each an operator of ``tidemark.llm``.

Every stage takes what its predecessor kept and returns the columns of ``documents``; the last one adds the token ids. ``run`` writes
each stage's result to the shared folder and reads it back for the next one.

Defined results: documents with a null or empty text, or one without a letter, have no language and go at the first stage. Of linked documents the one with
the smallest doc_id stays (a null one counts as smallest), and rows of the same id and text are one document. Empty tables give an empty table with the
columns of the last stage. Extra columns pass through; ``ids``, ``n_tokens`` and ``round_trip`` are replaced. Texts are used whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, jaccard, langid, pii
from tidemark.llm.common import id_bucket, staged, table, unused
from tidemark.llm.registry import surrogate_key, vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A language prediction under this probability rejects a document.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; the column ``lang`` gets the prediction."""
    model = langid.fit(langid.learnable_rows(docs, id_bucket(F.col("doc_id"), 3) == 1))
    lang, score = unused(docs, "_lang"), unused(docs, "_score")
    said = model.apply(docs, lang_pred=lang, score=score)
    kept = said.filter((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE))
    return kept.withColumn("lang", F.col(lang)).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle sets that are similar by 0.8 or more."""
    return jaccard.first_of_each(docs, jaccard.Join(width=5, percent=80))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in their texts and their new lengths."""
    return pii.replace(docs, surrogate_key(spark), entities=None).withColumn("n_chars", F.length("text").cast("long"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids, whether these decode to the text, and their number."""
    decoded = unused(docs, "_decoded")
    out = bpe.encode(docs, *vocabulary(), decoded=decoded)
    whole = F.col(decoded) == F.coalesce("text", F.lit("")).cast("binary")
    return out.withColumn("n_tokens", F.size("ids").cast("long")).withColumn("round_trip", whole).drop(decoded)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("pii_surrogates", replace_personal_data),
    ("byte_bpe", encode_texts),
]

#: The first stage is a learned model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus after all stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
