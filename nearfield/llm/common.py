"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.session import work_dir

BLOCK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Compute a table once into the shared folder, so that a lost executor costs no recomputation."""
    path = f"{work_dir(df.sparkSession, name)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def keyed_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """Only the key and the text, under fixed names; a null text counts as empty."""
    return df.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))


def text_blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one slice holds about ``limit`` bytes of text, or a single longer row."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for row, size in enumerate(sizes):
            if row > start and held + size > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


def hash_bucket(column, parts: int):
    """crc32 of the decimal text of a key (empty for null), modulo ``parts``."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % parts
