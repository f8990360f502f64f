"""The given tables in the roles the queries need, in DataFrame form and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def epoch_micros(ts):
    """Microseconds since 1970 of a wall-clock timestamp, whatever the session time zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """``id, emb, label`` of the whole embeddings table."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("emb"), F.col("label").cast("bigint").alias("label")
    )


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector also asks for its neighbours: ``qid, emb``."""
    return vectors(spark, sf).select(F.col("id").alias("qid"), "emb")


VECTORS = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, CAST(label AS BIGINT) AS label FROM embeddings)"
PAIRS = f"{VECTORS}, p AS (SELECT a.id AS id, a.e AS a, b.e AS b FROM v a JOIN v b ON b.id = a.id + 1)"


def vector_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector next to its successor: ``id, a, b``."""
    v = vectors(spark, sf)
    after = v.select((F.col("id") - 1).alias("id"), F.col("emb").alias("b"))
    return v.select("id", F.col("emb").alias("a")).join(after, "id")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def text_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")


# Scalar expressions both engines read alike.
REQUEST_COLUMNS = {
    "run": "'run_' || CAST(user_id % 4 AS STRING)",
    "conc": "CAST(5 * (1 + CAST(floor(user_id / 4) AS INT) % 5) AS INT)",
    "worker": "user_id",
    "seq": "event_id",
    "request": "CAST(floor(event_id / 3) AS BIGINT)",
    "attempt": "CAST(event_id % 3 AS INT)",
    "ts": "ts",
    "latency_s": "value / 997e0",
    "ok": "event_type <> 'error'",
    "event_type": "event_type",
}
REQUESTS = "r AS (SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in REQUEST_COLUMNS.items()) + " FROM events)"


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """The event table as a request log."""
    return table(spark, sf, "events").select(*[F.expr(sql).alias(name) for name, sql in REQUEST_COLUMNS.items()])


_CASE_ID = "CASE o_orderkey % 8 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 5 WHEN 3 THEN 10 WHEN 4 THEN 11 WHEN 5 THEN 200 WHEN 6 THEN 300 ELSE 400 END"
_DB_LABEL = "CASE WHEN o_custkey % 5 = 0 THEN '' ELSE CAST(o_custkey % 5 AS STRING) || 'c' END"
_VERSION = "CASE WHEN o_custkey % 3 = 0 THEN '' ELSE 'v' || CAST(o_custkey % 3 AS STRING) END"
_DB = "'db' || CAST(o_custkey % 6 AS STRING)"
_FAILS = "(o_custkey % 6 + o_orderkey % 8) % 5 = 0"
RUN_COLUMNS = {
    "ord": "o_orderkey",
    "run_id": "'run_' || CAST(o_custkey % 50 AS STRING)",
    "task_label": "CASE o_custkey % 4 WHEN 0 THEN 'standard_2025' WHEN 1 THEN 'standard_2023' WHEN 2 THEN 'standard_2025' ELSE 'custom' END",
    "db": _DB,
    "db_label": _DB_LABEL,
    "version": _VERSION,
    "note": "o_orderstatus",
    "case_id": f"CAST({_CASE_ID} AS BIGINT)",
    "case_name": f"""CASE o_orderkey % 8 WHEN 6 THEN 'Label-Filter-' || CAST(o_orderkey % 10 * 10 AS STRING) || '.0% - set_' || CAST(o_orderkey % 3 AS STRING)
      WHEN 7 THEN 'Int-Filter-' || CAST(o_orderkey % 10 * 10 AS STRING) || '.0% - set_' || CAST(o_orderkey % 3 AS STRING) ELSE 'case_' || CAST({_CASE_ID} AS STRING) END""",
    "dataset": "'set_' || CAST(o_orderkey % 3 AS STRING)",
    "filter_type": "CASE o_orderkey % 8 WHEN 6 THEN 'Label' WHEN 7 THEN 'NumGE' ELSE 'NonFilter' END",
    "filter_rate": "CASE WHEN o_orderkey % 8 >= 6 THEN (o_orderkey % 10) / 1e1 ELSE 0e0 END",
    "label": f"CASE WHEN {_FAILS} THEN CASE WHEN o_orderkey % 3 = 0 THEN '?' ELSE 'x' END WHEN o_orderkey % 11 = 0 THEN 'x' ELSE ':)' END",
    "qps": f"CASE WHEN {_FAILS} OR o_orderkey % 11 = 0 THEN 0e0 ELSE o_totalprice / 1e2 END",
    "recall": "5e-1 + (o_orderkey % 501) / 1e3",
    "ndcg": "4e-1 + (o_orderkey % 501) / 1e3",
    "load_duration": "o_totalprice / 1e1",
    "serial_latency_p99": "(o_orderkey % 97) / 1e3",
    "serial_latency_p95": "(o_orderkey % 89) / 1e3",
    "max_load_count": "CASE WHEN o_orderkey % 8 = 0 THEN o_orderkey * 1e1 ELSE 0e0 END",
    "insert_rate": "CAST(500 * (1 + o_orderkey % 2) AS BIGINT)",
}
RUNS = (
    "runs AS (SELECT *, concat_ws('-', db, nullif(db_label, ''), nullif(version, '')) AS db_name FROM (SELECT "
    + ", ".join(f"{sql} AS {name}" for name, sql in RUN_COLUMNS.items())
    + ", epoch(o_orderdate) + 852076800e0 AS timestamp, o_orderdate, o_totalprice, o_custkey FROM orders))"
)


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """The order table as flat result runs, one per order."""
    base = table(spark, sf, "orders").select(
        *[F.expr(sql).alias(name) for name, sql in RUN_COLUMNS.items()],
        (epoch_micros(F.col("o_orderdate")) / 1e6 + F.lit(852076800.0)).alias("timestamp"),
        "o_totalprice",
        "o_custkey",
    )
    return base.withColumn("db_name", F.concat_ws("-", "db", F.nullif("db_label", F.lit("")), F.nullif("version", F.lit(""))))


def with_lists(runs_df: DataFrame) -> DataFrame:
    """Add the list columns of concurrency levels and search stages."""
    price, key = F.col("o_totalprice"), F.col("ord")

    def doubles(*values):
        return F.array(*[v.cast("double") for v in values])

    def longs(*values: int):
        return F.array(*[F.lit(v).cast("bigint") for v in values])

    empty = F.expr("cast(array() as array<double>)")
    streaming = F.col("case_id") == 200
    return (
        runs_df.withColumn("conc_num_list", F.when(key % 4 == 3, longs()).otherwise(longs(1, 10, 80)))
        .withColumn("conc_qps_list", F.when(key % 4 == 3, empty).otherwise(doubles(price / 1000, price / 500, price / 400)))
        .withColumn("conc_latency_p99_list", F.when(key % 4 == 3, empty).otherwise(doubles(price / 1e6, price / 5e5)))
        .withColumn("conc_latency_p95_list", F.when(key % 4 == 3, empty).otherwise(doubles(price / 2e6)))
        .withColumn("conc_latency_avg_list", F.when(key % 4 == 3, empty).otherwise(doubles(price / 4e6, price / 3e6, price / 2e6)))
        .withColumn("st_ideal_insert_duration", F.lit(2000).cast("bigint"))
        .withColumn("st_search_stage_list", F.when(streaming & (key % 2 == 0), longs(50, 90, 100)).when(streaming, longs(50, 90, 100, 110)).otherwise(longs()))
        .withColumn("st_search_time_list", F.when(streaming, doubles(price / 100, price / 90, price / 80, price / 70)).otherwise(empty))
        .withColumn("st_max_qps_list_list", F.when(streaming, doubles(price / 1000, price / 900, price / 800, price / 700)).otherwise(empty))
        .withColumn("st_recall_list", F.when(streaming, doubles(F.col("recall") / 2, F.col("recall") * 0.9, F.col("recall"), F.col("recall"))).otherwise(empty))
        .withColumn("st_ndcg_list", F.when(streaming, doubles(F.col("ndcg") / 2, F.col("ndcg") * 0.9, F.col("ndcg"), F.col("ndcg"))).otherwise(empty))
        .withColumn("st_serial_latency_p99_list", F.when(streaming, doubles(price / 1e6, price / 9e5, price / 8e5, price / 7e5)).otherwise(empty))
        .withColumn("st_serial_latency_p95_list", F.when(streaming, doubles(price / 2e6, price / 1e6)).otherwise(empty))
        .withColumn("st_conc_num_list_list", F.when(streaming, F.array(longs(5, 10), longs(), longs(5), longs(5, 10))))
        .withColumn("st_conc_qps_list_list", F.when(streaming, F.array(doubles(price / 50, price / 40), empty, doubles(price / 30), doubles(price / 20, price / 10))))
        .withColumn("st_conc_latency_p99_list_list", F.when(streaming, F.array(doubles(price / 1e6, price / 2e6), empty, doubles(price / 3e6), doubles(price / 4e6, price / 5e6))))
        .withColumn("st_conc_latency_p95_list_list", F.when(streaming, F.array(doubles(price / 2e6, price / 3e6), empty, doubles(price / 4e6), doubles(price / 5e6, price / 6e6))))
        .withColumn("st_conc_latency_avg_list_list", F.when(streaming, F.array(doubles(price / 3e6, price / 4e6), empty, doubles(price / 5e6), doubles(price / 6e6, price / 7e6))))
    )


# The list columns in SQL: one row per (run, place in list).
STAGES = (
    "st AS (SELECT *, unnest(CASE WHEN ord % 2 = 0 THEN [1, 2, 3] ELSE [1, 2, 3, 4] END) AS i FROM runs WHERE case_id = 200), "
    "stages AS (SELECT *, CAST(([50, 90, 100, 110])[i] AS BIGINT) AS search_stage, "
    "([o_totalprice / 100, o_totalprice / 90, o_totalprice / 80, o_totalprice / 70])[i] AS search_time, "
    "([o_totalprice / 1000, o_totalprice / 900, o_totalprice / 800, o_totalprice / 700])[i] AS st_qps, "
    "([recall / 2, recall * 9e-1, recall, recall])[i] AS st_recall, ([ndcg / 2, ndcg * 9e-1, ndcg, ndcg])[i] AS st_ndcg, "
    "([o_totalprice / 1e6, o_totalprice / 9e5, o_totalprice / 8e5, o_totalprice / 7e5])[i] AS st_p99, "
    "coalesce(([o_totalprice / 2e6, o_totalprice / 1e6])[i], 0e0) AS st_p95 FROM st)"
)


def documents_json(spark: SparkSession, sf: str) -> DataFrame:
    """Each run as a result document in JSON text, with the file it would lie in: ``file, json``."""
    rows = with_lists(runs(spark, sf))
    metrics = [
        "max_load_count", "load_duration", "qps", "serial_latency_p99", "recall", "ndcg",
        "conc_num_list", "conc_qps_list", "conc_latency_p99_list", "conc_latency_avg_list",
    ]
    secret = F.when(F.col("ord") % 2 == 0, F.lit("pw")).otherwise(F.lit(""))
    config = F.struct(
        F.col("db"),
        F.create_map(
            F.lit("db_label"), F.col("db_label"), F.lit("version"), F.col("version"), F.lit("note"), F.col("note"), F.lit("Password"), secret
        ).alias("db_config"),
        F.create_map(F.lit("index"), F.lit("FLAT")).alias("db_case_config"),
        F.struct(
            F.when(F.col("ord") % 16 == 15, F.lit(7)).when(F.col("ord") % 16 == 7, F.lit(600)).otherwise(F.col("case_id")).alias("case_id"),
            F.create_map(F.lit("dataset_with_size_type"), F.concat(F.lit("MS MARCO "), F.element_at(F.array(F.lit("Small (100K)"), F.lit("Medium (1M)"), F.lit("Large (8.8M)")), (F.col("ord") % 3 + 1).cast("int")))).alias("custom_case"),
        ).alias("case_config"),
    )
    result = F.struct(F.struct(*metrics).alias("metrics"), config.alias("task_config"), F.col("label"))
    document = F.struct(
        "run_id",
        F.when(F.col("task_label") != "custom", F.col("task_label")).alias("task_label"),
        "timestamp",
        F.array(result).alias("results"),
    )
    file = F.concat(F.lit("/results/"), F.col("db"), F.lit("/result_"), F.format_string("%012d", F.col("ord")), F.lit("_a.json"))
    return rows.select(file.alias("file"), F.to_json(document).alias("json"))
