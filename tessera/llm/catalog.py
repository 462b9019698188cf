"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import (
    conversation_trie,
    decontamination,
    embedding_dedup,
    license_scan,
    minhash_dedup,
    oracles,
    pii_surrogates,
    quality_classifier,
    secret_scan,
    sentencepiece_codec,
    sharding,
    token_counts,
    warc,
    whitening,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_dedup": minhash_dedup.op1_minhash_dedup,
        "op2_sentencepiece": sentencepiece_codec.op2_sentencepiece,
        "op3_warc": warc.op3_warc,
        "op4_embedding_dedup": embedding_dedup.op4_embedding_dedup,
        "op5_license_scan": license_scan.op5_license_scan,
        "op6_token_counts": token_counts.op6_token_counts,
        "op7_decontamination": decontamination.op7_decontamination,
        "op8_pii_surrogates": pii_surrogates.op8_pii_surrogates,
        "op9_quality_classifier": quality_classifier.op9_quality_classifier,
        "op10_secret_scan": secret_scan.op10_secret_scan,
        "op11_conversation_trie": conversation_trie.op11_conversation_trie,
        "op12_sharding": sharding.op12_sharding,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
