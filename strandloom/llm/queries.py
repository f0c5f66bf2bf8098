"""The registered queries of this subpackage: one for each operator, over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import chat, langid, licenses, minhash, oracles, packing, pieces, pii, quality, spotsigs, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_likeness(_table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("spans")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(_table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.format_digests(rows.unionByName(extra))


# ---- what operators report beside the contract's columns ----


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edited text of each document, as op3 fingerprints it."""
    return spotsigs.edited_likeness(_table(spark, sf_dir, "documents")).select("doc_id", "n_chars", "edited_sha256")


def similar_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the class of its fingerprint and the number of similar classes, by length partitions."""
    return spotsigs.partners(spotsigs.fingerprints(_table(spark, sf_dir, "documents")))


def license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base places and labels of op4."""
    return licenses.scan(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and base rules of op6."""
    return quality.statistics(_table(spark, sf_dir, "documents")).drop("lang", "source", "x")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_langid": op2_langid,
        "op3_spotsigs": op3_spotsigs,
        "op4_licenses": op4_licenses,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_quality": op6_quality,
        "op7_minhash": op7_minhash,
        "op8_toxicity": op8_toxicity,
        "op9_pii": op9_pii,
        "op10_chat": op10_chat,
        "edited_texts": edited_texts,
        "similar_fingerprints": similar_fingerprints,
        "license_places": license_places,
        "quality_counts": quality_counts,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    own = {
        "op7_minhash": oracles.NEAR_DUPLICATES,
        "op9_pii": oracles.personal_data(),
        "op10_chat": oracles.CONVERSATIONS,
        "edited_texts": oracles.EDITED_TEXTS,
        "license_places": oracles.license_places(),
        "quality_counts": oracles.QUALITY_COUNTS,
    }
    return {**own, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
