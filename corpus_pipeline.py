"""A training corpus from raw documents, in five stages.

Each stage takes the documents its predecessor kept, is written to the shared folder and read
again; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import bpe, decontaminate, langid, line_dedup, simhash
from nearfield.llm.common import hash_bucket, stored, table
from nearfield.sizing import broadcast_if_small

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _without(docs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents whose key and text hash are not in ``found``; a small measured ``found`` is broadcast, so that no text is shuffled."""
    hashed = docs.withColumn("__hash", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    gone = broadcast_if_small(found.select(F.col(key).alias("__key"), F.col("th").alias("__th")).distinct())
    kept = hashed.join(gone, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__hash") == F.col("__th")), "left_anti")
    return kept.select(*[f"`{c}`" for c in docs.columns])


#: Rows of an Arrow batch; a worker and its executor hold some batches of whole texts at once, which at Spark's 10 000 rows take more than the work on them.
BATCH_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """Lower the session's bound on rows in an Arrow batch; it is read when a frame runs, so it stays after the stage returns."""
    if not 0 < int(spark.conf.get(_ROWS)) <= BATCH_ROWS:
        spark.conf.set(_ROWS, BATCH_ROWS)


#: The least score of documents that the network had not seen and named rightly, times this, is the least score that stays.
LENIENCE = 0.9


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, and those for which the network is less sure of any language than for every held-out document that it names rightly.

    The network learns from two thirds of the labelled documents; the rest set the threshold. With
    no labelled document there is no network, and every document stays.
    """
    _small_batches(spark)
    held = hash_bucket(F.col("doc_id"), 3) == 1
    network = langid.learn(docs.where(~held))
    if network.languages == [langid.UNKNOWN]:
        return docs
    # what is written has no text; the documents are read again
    slim = docs.select("doc_id", "lang", "text", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("th"))
    found = stored(langid.marked(slim, network, "__lang", "__score").drop("text"), "languages")
    right = found.where(held & (F.col("__lang") == F.col("lang")) & (F.col("__lang") != langid.UNKNOWN))
    least = right.agg(F.coalesce(F.min("__score"), F.lit(0.0))).first()[0] * LENIENCE
    return _without(docs, found.where((F.col("__lang") == langid.UNKNOWN) | (F.col("__score") < least)))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines with an earlier near match; every document stays, an emptied one with an empty text."""
    return line_dedup.remove_lines(docs).withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else line_dedup.remove_lines(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    _small_batches(spark)
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of whose words a twentieth or more lies inside benchmark windows."""
    _small_batches(spark)
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), hashed=True)
    return _without(docs, stored(found.where(decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words"))).select("doc_id", "th"), "contaminated"))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text decoded from them."""
    _small_batches(spark)
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("text"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_level_bpe", byte_level_bpe),
]

#: SQL can express neither the trained language model nor the fingerprints and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
