"""Stored result runs: reading, units, legacy cases, redaction, writing; price tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.labels import to_millis, to_thousands
from nearfield.schemas import METRICS, RESULT_RUN

# The label of a normal, failed and timed-out case, and the names of secret settings.
NORMAL, FAILED, TIMEOUT = ":)", "x", "?"
SECRET_FIELDS = ("api_key", "password", "token")
MASK = "**********"

# Case ids whose stored metrics are a subset.
INSERT_CASE, COLD_CASE = 600, 700
INSERT_METRICS = (
    "inserted_count",
    "insert_rows_per_second",
    "insert_completion_seconds",
    "searchable_after_insert_seconds",
    "indexed_after_searchable_seconds",
    "additional_parameters",
)
COLD_METRICS = (
    "insert_duration",
    "optimize_duration",
    "load_duration",
    "payload_profile",
    "payload_estimated_bytes_per_query",
    "cold_latency",
)

# Older integer-filter case ids, with the removed share and the dataset they stand for.
LEGACY_CASES = [
    (6, 0.01, "Large Cohere (768dim, 10M)"),
    (7, 0.01, "Medium Cohere (768dim, 1M)"),
    (8, 0.99, "Large Cohere (768dim, 10M)"),
    (9, 0.99, "Medium Cohere (768dim, 1M)"),
    (12, 0.01, "Medium OpenAI (1536dim, 500K)"),
    (13, 0.01, "Large OpenAI (1536dim, 5M)"),
    (14, 0.99, "Medium OpenAI (1536dim, 500K)"),
    (15, 0.99, "Large OpenAI (1536dim, 5M)"),
]
INT_FILTER_CASE = 400


def parse_runs(texts: DataFrame, column: str = "json", file: str = "file") -> DataFrame:
    """Result documents held as JSON text, one per row."""
    # The generator parses each text once, however many fields are read later.
    return texts.select(F.col(file).alias("file"), F.inline(F.array(F.from_json(column, RESULT_RUN))))


def read_runs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Result files ``result_*.json`` anywhere below ``path``: one JSON document per file, or per line."""
    reader = spark.read.schema(RESULT_RUN).option("recursiveFileLookup", True).option("pathGlobFilter", "result_*.json" if not lines else "*.json")
    return reader.option("multiLine", not lines).json(path).select(F.col("_metadata.file_path").alias("file"), "*")


def case_rows(runs: DataFrame, trans_unit: bool = False) -> DataFrame:
    """One row per case result: ``file, run_id, task_label, timestamp, pos, metrics, task_config, label``.

    A missing task label is the run id and a missing p95 is 0. ``trans_unit`` turns
    positive counts into thousands and positive latencies into milliseconds.
    """
    rows = runs.select(
        "file",
        "run_id",
        F.coalesce("task_label", "run_id").alias("task_label"),
        F.coalesce("timestamp", F.lit(0.0)).alias("timestamp"),
        F.posexplode("results").alias("pos", "result"),
    ).select("file", "run_id", "task_label", "timestamp", "pos", "result.*")
    m = F.col("metrics")
    if trans_unit:
        m = (
            m.withField("max_load_count", to_thousands(m["max_load_count"]))
            .withField("serial_latency_p99", to_millis(m["serial_latency_p99"]))
            .withField("serial_latency_p95", to_millis(m["serial_latency_p95"]))
        )
    else:
        m = m.withField("serial_latency_p95", F.coalesce(m["serial_latency_p95"], F.lit(0.0)))
    return rows.withColumn("metrics", m).withColumn("label", F.coalesce("label", F.lit(NORMAL)))


def map_legacy_cases(rows: DataFrame) -> DataFrame:
    """Older integer-filter case ids become the general case with its rate and dataset."""
    config, case = F.col("task_config"), F.col("task_config.case_config")
    rates = F.create_map(*[F.lit(x) for number, rate, _ in LEGACY_CASES for x in (number, str(rate))])
    names = F.create_map(*[F.lit(x) for number, _, dataset in LEGACY_CASES for x in (number, dataset)])
    number = case["case_id"].cast("int")
    known = F.coalesce(case["custom_case"], F.create_map().cast("map<string,string>"))
    kept = F.map_filter(known, lambda key, _: ~key.isin("filter_rate", "dataset_with_size_type"))
    added = F.create_map(F.lit("filter_rate"), F.element_at(rates, number), F.lit("dataset_with_size_type"), F.element_at(names, number))
    old = number.isin([number for number, _, _ in LEGACY_CASES])
    new_case = F.struct(
        F.when(old, F.lit(INT_FILTER_CASE).cast("bigint")).otherwise(case["case_id"]).alias("case_id"),
        F.when(old, F.map_concat(kept, added)).otherwise(case["custom_case"]).alias("custom_case"),
        case["k"].alias("k"),
    )
    changed = F.struct(config["db"].alias("db"), config["db_config"].alias("db_config"), config["db_case_config"].alias("db_case_config"), new_case.alias("case_config"))
    return rows.withColumn("task_config", changed)


def redact(config: Column) -> Column:
    """Mask non-empty secret settings of a string map; names are matched without case."""
    secret = F.array(*[F.lit(name) for name in SECRET_FIELDS])
    return F.transform_values(
        config,
        lambda key, value: F.when(F.array_contains(secret, F.lower(key)) & (F.coalesce(value, F.lit("")) != ""), F.lit(MASK)).otherwise(value),
    )


def output_metrics(metrics: Column, case_id: Column) -> Column:
    """The stored metrics of a case: insert and cold cases keep their own fields, others all."""
    fields = []
    for name in METRICS.fieldNames():
        keep = (
            F.when(case_id == INSERT_CASE, F.lit(name in INSERT_METRICS))
            .when(case_id == COLD_CASE, F.lit(name in COLD_METRICS))
            .otherwise(F.lit(True))
        )
        fields.append(F.when(keep, metrics[name]).alias(name))
    return F.struct(*fields)


def output_documents(rows: DataFrame) -> DataFrame:
    """Case rows as result documents, ``db, json``, subset per case type and with secrets masked."""
    config = F.col("task_config")
    case_id = config["case_config"]["case_id"]
    short = case_id.isin(INSERT_CASE, COLD_CASE)
    case = config["case_config"].withField("k", F.when(~F.coalesce(short, F.lit(False)), config["case_config"]["k"]))
    clean = (
        config.withField("db_config", redact(config["db_config"]))
        .withField("db_case_config", redact(config["db_case_config"]))
        .withField("case_config", case)
    )
    result = F.struct(
        output_metrics(F.col("metrics"), case_id).alias("metrics"), clean.alias("task_config"), F.col("label")
    )
    document = F.struct("run_id", "task_label", "timestamp", F.array(result).alias("results"))
    return rows.select(config["db"].alias("db"), F.to_json(document).alias("json"))


def write_runs(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store case rows as JSON lines in one folder per db; ``read_runs(lines=True)`` reads them back."""
    output_documents(rows).select("db", F.col("json").alias("value")).write.mode(mode).partitionBy("db").option("compression", "none").format("text").save(path)


def read_written_runs(spark: SparkSession, path: str) -> DataFrame:
    """Documents stored by ``write_runs``."""
    texts = spark.read.text(path, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("json"))
    return parse_runs(texts)


def scan_prices(texts: DataFrame, column: str = "json") -> DataFrame:
    """Price map ``{db: {label: $/hour}}`` as rows ``db, db_label, price``."""
    parsed = texts.select(F.from_json(column, "MAP<STRING, MAP<STRING, DOUBLE>>").alias("m"))
    return parsed.select(F.explode("m").alias("db", "labels")).select("db", F.explode("labels").alias("db_label", "price"))
