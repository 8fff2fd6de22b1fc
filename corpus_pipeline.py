"""A corpus from raw documents to packed sequences: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; it is written as Parquet and read again as
the next one's docs. All but the last keep the columns of documents. No label, language or source column
decides about a document but where the language classifier learns from it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mattework.llm import dartminhash, exact, langid, packing, suffix
from mattework.llm.queries import tokenizer_path
from mattework.llm.shared import materialize, table

#: Bytes from which a string that stands elsewhere is cut: 50 words of four letters and a space, so that a passage of
#: more than 50 words is found in prose of usual words, while shorter lines stay.
REPEAT = 250
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language is below the calibrated rejection."""
    held_out = F.coalesce(langid.fold_of(4) == 2, F.lit(False))
    found = langid.identify(docs.select(*COLUMNS), ~held_out, COLUMNS)
    return found.where("not rejected").select(*COLUMNS)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the least doc_id of each group of equal texts."""
    return _kept(docs, exact.exact_groups)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the least doc_id of each group that links of similarity 0.8 join."""
    return _kept(docs, dartminhash.near_groups)


def _kept(docs: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that judge keeps of docs, each judged by its own text.

    Where ids are null or stand at several rows, rows are numbered by (doc_id, text), null ids last, and
    judged under their numbers: one row of each group stays, that of the least doc_id.
    """
    docs = docs.select(*COLUMNS)
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return docs.join(judge(docs).where("kept").select("doc_id"), "doc_id", "left_semi").select(*COLUMNS)
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.sha2(F.coalesce("text", F.lit("")), 256))
    rows = materialize(ordered.withColumn("row", F.monotonically_increasing_id()), "rows")
    keep = judge(rows.select(F.col("row").alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias("row"))
    return rows.join(keep, "row", "left_semi").select(*COLUMNS)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every string of REPEAT bytes that also stands elsewhere; n_chars is that of the text that is left."""
    cut = suffix.cut_repeats(docs, length=REPEAT, keep=["lang", "source", "n_chars"])
    left = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("rest.n_chars"))
    return cut.select("doc_id", F.col("kept_text").alias("text"), "rest.lang", "rest.source", left.alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("language", language), ("exact duplicates", exact_duplicates), ("near duplicates", near_duplicates), ("repeated strings", repeated_strings), ("packing", packed)]

#: Language identification and similarity cannot be put in SQL; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
