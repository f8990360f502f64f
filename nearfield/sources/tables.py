"""Vector tables: canonical columns, shards, labels, truth, batches, storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from nearfield.functions.labels import int_truth_table, label_truth_table
from nearfield.session import work_dir
from nearfield.sizing import broadcast_if_small, settle


def shard_names(count: int, shuffled: bool = False) -> list[str]:
    """File names of a vector table stored in ``count`` shards."""
    stem = "shuffle_train" if shuffled else "train"
    return [f"{stem}.parquet"] if count <= 1 else [f"{stem}-{i:02d}-of-{count}.parquet" for i in range(count)]


def canonical(df: DataFrame, id_col: str = "id", vec_col: str = "emb", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id BIGINT, emb ARRAY<FLOAT>`` and any kept columns."""
    return df.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast(T.ArrayType(T.FloatType())).alias("emb"), *keep
    )


def read_vectors(spark: SparkSession, path: str, shards: int | None = None, shuffled: bool = False, id_col: str = "id", vec_col: str = "emb", keep: tuple[str, ...] = ()) -> DataFrame:
    """A vector table: a Parquet path, or the named shards inside a folder."""
    paths = [path] if shards is None else [f"{path.rstrip('/')}/{name}" for name in shard_names(shards, shuffled)]
    return canonical(spark.read.parquet(*paths), id_col, vec_col, keep)


def read_custom(spark: SparkSession, folder: str, files: str, columns: dict[str, str] | None = None) -> DataFrame:
    """A user's own table: comma-separated files (``.parquet`` may be left out), columns renamed to ours."""
    names = [name.strip() for name in files.split(",") if name.strip()]
    paths = [f"{folder.rstrip('/')}/{n if n.endswith('.parquet') else n + '.parquet'}" for n in names]
    df = spark.read.parquet(*paths)
    df = df.withColumnsRenamed(columns or {})
    casts = {"id": "bigint", "emb": "array<float>", "neighbors": "array<bigint>"}
    return df.select(*[F.col(c).cast(casts[c]).alias(c) if c in casts else F.col(c) for c in df.columns])


def truth_table_name(kind: str = "none", value: float | None = None, field: str = "labels") -> str:
    """Truth table of a filter: ``none``, ``int`` (removed share) or ``label`` (kept share)."""
    if kind == "none":
        return "neighbors"
    if kind == "int":
        return int_truth_table(value)
    if kind == "label":
        return label_truth_table(value, field)
    raise ValueError(f"unknown filter kind {kind!r}")


def select_truth(truth: DataFrame, name: str) -> DataFrame:
    """Long truth rows ``qid, gt_rank, id`` of one filter, from ``filter_key, qid, neighbors``."""
    return truth.where(F.col("filter_key") == name).select("qid", F.posexplode("neighbors").alias("gt_rank", "id"))


def join_labels(vectors: DataFrame, labels: DataFrame, on: str = "id") -> DataFrame:
    """Attach side-file labels; rows without one keep a null label."""
    return vectors.join(broadcast_if_small(labels), on, "left")


BUCKET_ROWS = 250_000


def dense_row_ids(df: DataFrame, order: str, size: int | None = None, well_formed: Column | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """0-based consecutive ``row_id`` by a unique numeric ``order`` column; malformed rows use no id.

    The table is cut into ranges of about ``bucket_rows`` rows, however many that makes, and
    written; each range is counted, and rows are numbered inside their range and shifted by
    the rows before it. No task sees more than a range. ``size`` keeps the first ids only.
    """
    rows = df if well_formed is None else df.where(well_formed)
    ranges = max(1, -(-rows.count() // bucket_rows))
    # Written, since a second run of the range sampling may cut elsewhere.
    marked = settle(rows.repartitionByRange(ranges, order).withColumn("_bucket", F.spark_partition_id()))
    # One count per range.
    counts = {r["_bucket"]: r["n"] for r in marked.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, before = [], 0
    for b in sorted(counts):
        if size is None or before < size:
            starts.append((b, before))
        before += counts[b]
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "_bucket INT, _start BIGINT"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(order)) - 1
    numbered = marked.withColumn("_place", place).join(offsets, "_bucket").select(*df.columns, (F.col("_start") + F.col("_place")).alias("row_id"))
    return numbered if size is None else numbered.where(F.col("row_id") < size)


def batch_ids(df: DataFrame, rows_per_batch: int = 100) -> DataFrame:
    """Fixed-size load batches over ``row_id``."""
    return df.withColumn("batch_id", F.expr(f"row_id div {int(rows_per_batch)}"))


def unique_rows(df: DataFrame, key: str = "id") -> DataFrame:
    """One row per id: of unequal ones the least, column by column, so that a rerun keeps the same. Equal ids are cut to one inside each task before the shuffle."""
    rest = [c for c in df.columns if c != key]
    if not rest:
        return df.distinct()
    return df.groupBy(key).agg(F.min(F.struct(*rest)).alias("_least")).select(*[F.col(key) if c == key else F.col(f"_least.{c}").alias(c) for c in df.columns])


def write_vectors(df: DataFrame, path: str, partition_by: str | None = None, mode: str = "overwrite", bloom: str | None = None) -> int:
    """Store ``id, emb`` (label, tenant) once per id and return the number of rows written.

    Partition values are cut into files by their measured size, so a large tenant is not one task
    and a small one not many files. ``bloom`` names a column, mostly ``id``, whose values get a Bloom
    filter in every row group: a search for one value skips the groups that do not hold it.
    """
    rows = unique_rows(df)
    seen = Observation("written")
    if partition_by:
        rows = rows.hint("rebalance", partition_by)
    writer = rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode)
    if bloom:
        # A dictionary would take the filter's place in small groups, and ids hardly repeat.
        writer = writer.option(f"parquet.bloom.filter.enabled#{bloom}", "true").option(f"parquet.enable.dictionary#{bloom}", "false")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return seen.get["rows"]


def replicate_ids(df: DataFrame, times: int, size: int) -> DataFrame:
    """``times`` copies of a table with ids shifted by the table size per copy."""
    return df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn(
        "id", (F.col("id") + F.col("rep") * F.lit(size)).cast("bigint")
    )


def load_reconcile(loaded: DataFrame, expected: DataFrame, by: str = "tenant") -> DataFrame:
    """Loaded against expected counts: ``searchable`` once at least the expected rows are there."""
    counts = loaded.groupBy(by).agg(F.count(F.lit(1)).alias("loaded"))
    both = counts.join(expected.select(by, "expected"), by, "full_outer")
    there, due = F.coalesce("loaded", F.lit(0)), F.coalesce("expected", F.lit(0))
    return both.select(
        by, there.alias("loaded"), due.alias("expected"), F.greatest(due - there, F.lit(0)).alias("missing"), (there >= due).alias("searchable")
    )


def worst_tenant(reconciled: DataFrame, by: str = "tenant") -> DataFrame:
    """One row: whether all is searchable, and the tenant that lacks most rows (lowest name on ties)."""
    return reconciled.agg(
        F.bool_and("searchable").alias("fully_searchable"),
        F.sum("missing").alias("missing"),
        F.min_by(by, F.struct(-F.col("missing"), F.col(by))).alias(by),
    )


def tenant_load_report(insert_log: DataFrame) -> DataFrame:
    """Per tenant: inserted rows, failed batches, and ``ok`` when no batch failed."""
    return insert_log.groupBy("tenant").agg(
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("rows"))), F.lit(0)).alias("inserted"),
        F.count_if(~F.col("ok")).alias("failed_batches"),
        F.bool_and("ok").alias("ok"),
    )


def raise_on_partial_load(report: DataFrame) -> None:
    """Fail with the names of all failed and finished tenants (one row per tenant, sorted); the report itself is kept in the shared folder."""
    if report.where(~F.col("ok")).isEmpty():
        return
    path = work_dir(report.sparkSession, "partial-load")
    report.write.parquet(path)
    names = {ok: [r["tenant"] for r in report.where(F.col("ok") == ok).select("tenant").orderBy("tenant").collect()] for ok in (False, True)}
    raise RuntimeError(
        f"partial load; {len(names[False])} failed tenants: {names[False]}; {len(names[True])} finished tenants: {names[True]}; report in {path}"
    )
