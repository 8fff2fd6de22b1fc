"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mattework.llm import bpe, ctw, dartminhash, exact, langid, lcp, packing, suffix, toxicity, warc
from mattework.llm.shared import table


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is; TOKENIZERS_DIR names another folder than the installed one."""
    if told := os.environ.get("TOKENIZERS_DIR"):
        return os.path.join(told, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.near_groups(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op4_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_texts(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.code_digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_lcp_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lcp.edit_fingerprints(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removed_bytes(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_roundtrip(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_dartminhash, op3_exact_dedup, op4_ctw_score, op5_packing, op6_langid, op7_bpe, op8_lcp_fingerprint, op9_suffix_dedup, op10_warc)}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3}


OP3 = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256 FROM t JOIN g USING (text_sha256)
"""
