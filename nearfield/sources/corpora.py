"""Text corpora: clean text, stored postings, build manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.text import Analyzer
from nearfield.operators.bm25 import Bm25, analyzed, block_postings, block_stats, unpacked
from nearfield.schemas import MANIFEST


def flat_text(text: Column) -> Column:
    """Tabs and line ends become blanks."""
    return F.translate(text, "\t\n", "  ")


def titled_text(title: Column, text: Column) -> Column:
    """Title and text in one line, outer whitespace removed; missing parts are empty."""
    joined = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))
    return F.regexp_replace(flat_text(joined), r"^\s+|\s+$", "")


def passage_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id STRING, text`` of an untitled passage collection."""
    return df.select(F.col(id_col).cast("string").alias("doc_id"), flat_text(F.col(text_col)).alias("text"))


def titled_corpus(df: DataFrame, id_col: str = "doc_id", title_col: str = "title", text_col: str = "text") -> DataFrame:
    """``doc_id STRING, text`` of a collection with titles."""
    return df.select(
        F.col(id_col).cast("string").alias("doc_id"), titled_text(F.col(title_col), F.col(text_col)).alias("text")
    )


def write_documents(corpus: DataFrame, path: str, analyzer: Analyzer | None = None) -> int:
    """Store the corpus, its postings and term statistics; return the number of documents.

    Postings are written in blocks by the tasks that read the documents, each file sorted by
    segment and term, so their number and size follow the stored documents. Every row with an id is
    a document, also where ids repeat.
    """
    corpus.select("doc_id", "text").write.mode("overwrite").parquet(f"{path}/documents")
    stored = corpus.sparkSession.read.parquet(f"{path}/documents")
    block_postings(analyzed(stored, analyzer)).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/postings")
    block_stats(corpus.sparkSession.read.parquet(f"{path}/postings")).write.mode("overwrite").parquet(f"{path}/terms")
    return stored.count()


def read_blocks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Stored block postings and term statistics."""
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms")


def read_postings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Stored postings as rows ``term, doc_id, tf, dl, row``, and term statistics."""
    blocks, stats = read_blocks(spark, path)
    return unpacked(blocks), stats


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A build manifest (one JSON object) as one row; object filters stay JSON text."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def manifest_settings(manifest: DataFrame) -> tuple[Bm25, Analyzer]:
    """BM25 parameters and analyzer named by a manifest row."""
    row = manifest.first().asDict(recursive=True)
    given = {k: v for k, v in (row.get("bm25") or {}).items() if v is not None}
    return Bm25(**given), Analyzer.from_manifest(row.get("analyzer"))


def manifest_violations(manifest: DataFrame, size: int, source: str | None, queries: DataFrame, truth: DataFrame) -> DataFrame:
    """Rows ``field, found, expected`` for everything that disagrees; none for a sound build.

    Fields the manifest leaves out are not checked; truth rows must always match the queries.
    """
    n_queries = F.lit(queries.agg(F.count(F.lit(1))).scalar()).cast("string")
    n_truth = F.lit(truth.agg(F.count(F.lit(1))).scalar()).cast("string")

    def check(name: str, found: Column, expected: Column) -> Column:
        return F.struct(F.lit(name).alias("field"), found.alias("found"), expected.alias("expected"))

    wanted = F.lit(str(size))
    checks = [
        check("doc_limit", F.col("doc_limit").cast("string"), wanted),
        check("indexed_doc_count", F.col("indexed_doc_count").cast("string"), wanted),
        check("query_count", F.col("query_count").cast("string"), n_queries),
        check("truth_count", n_truth, n_queries),
    ]
    if source is not None:
        checks.append(check("source_ir_dataset", F.col("source_ir_dataset"), F.lit(source)))
    return manifest.select(F.inline(F.array(*checks))).where(F.col("found").isNotNull() & (F.col("found") != F.col("expected")))
