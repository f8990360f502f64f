"""Price/performance, leaderboards and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.labels import db_name
from nearfield.sizing import broadcast_if_small
from nearfield.sources.results import FAILED, NORMAL, TIMEOUT

# Label codes, the two price scalings, the latency offset of the score in ms,
# the stage that stands for streaming, capacity case ids and the earliest month shown.
LABEL_CODES = {FAILED: -1, TIMEOUT: -2, NORMAL: 1}
PER_HOUR_THOUSANDS, PER_HOUR = 3.6, 3600.0
LATENCY_OFFSET_MS = 10.0
STREAMING_STAGE = 90
CAPACITY_CASES = (1, 2)
STREAMING_CASES = (200, 201)
FIRST_MONTH = "2023-08-01"


def queries_per_dollar(runs: DataFrame, prices: DataFrame) -> DataFrame:
    """``qp_dollar`` in thousands for the price page; runs without qps or price are left out."""
    priced = runs.join(broadcast_if_small(prices), ["db", "db_label"])
    return priced.where((F.col("price") > 0) & (F.col("qps") > 0)).withColumn(
        "qp_dollar", F.col("qps") / F.col("price") * F.lit(PER_HOUR_THOUSANDS)
    )


def board_qp_dollar(runs: DataFrame, prices: DataFrame) -> DataFrame:
    """``qp_dollar`` per dollar for the board; 0 without a price."""
    price = F.coalesce("price", F.lit(0.0))
    return (
        runs.join(broadcast_if_small(prices), ["db", "db_label"], "left")
        .withColumn("qp_dollar", F.when(price > 0, F.col("qps") / price * F.lit(PER_HOUR)).otherwise(F.lit(0.0)))
        .drop("price")
    )


def test_month(timestamp_s: Column) -> Column:
    """``yyyy-MM`` of epoch seconds, not before August 2023 (session time zone)."""
    return F.date_format(F.greatest(F.timestamp_seconds(timestamp_s), F.to_timestamp(F.lit(FIRST_MONTH))), "yyyy-MM")


def label_code(label: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, code in LABEL_CODES.items():
        out = F.when(label == name, F.lit(code)).otherwise(out)
    return out


def leaderboard_v1(runs: DataFrame, prices: DataFrame, late_db: str | None = None, late_from: str = "2024-01-01") -> DataFrame:
    """Rows of task labels containing ``standard`` without capacity cases.

    ``late_db`` names one system of which only results since ``late_from`` count.
    """
    rows = runs.where(F.col("task_label").contains("standard") & ~F.col("case_id").isin(*CAPACITY_CASES))
    if late_db is not None:
        rows = rows.where((F.col("db") != late_db) | (F.timestamp_seconds("timestamp") >= F.to_timestamp(F.lit(late_from))))
    board = rows.select(
        "db",
        "db_label",
        "db_name",
        F.col("case_name").alias("case"),
        "qps",
        F.col("serial_latency_p99").alias("latency"),
        "recall",
        label_code(F.col("label")).alias("label"),
        "note",
        "version",
        test_month(F.col("timestamp")).alias("test_time"),
    )
    return board_qp_dollar(board, prices)


def leaderboard_v2(runs: DataFrame, task_label: str = "standard_2025") -> DataFrame:
    """Rounded non-streaming rows of one task label."""
    return runs.where((F.col("task_label") == task_label) & ~F.col("case_id").isin(*STREAMING_CASES)).select(
        "dataset",
        "db",
        F.col("db_label").alias("label"),
        db_name(F.col("db"), F.col("db_label")).alias("db_name"),
        F.round("qps", 4).alias("qps"),
        F.round("serial_latency_p99", 4).alias("latency"),
        F.round("recall", 4).alias("recall"),
        F.round("filter_rate", 3).alias("filter_ratio"),
    )


def leaderboard_streaming(runs: DataFrame, task_label: str = "standard_2025", stage: int = STREAMING_STAGE) -> DataFrame:
    """qps and p99 at the 90 % stage of the streaming runs of one task label; a run without that stage is an error."""
    at = F.coalesce(F.array_position("st_search_stage_list", F.lit(stage).cast("bigint")).cast("int"), F.lit(0))
    missing = F.raise_error(F.concat(F.lit(f"no {stage} % stage in a streaming run of "), F.col("db")))
    rows = runs.where((F.col("task_label") == task_label) & F.col("case_id").isin(*STREAMING_CASES)).withColumn("at", F.when(at > 0, at).otherwise(missing))
    return rows.select(
        "dataset",
        "db",
        F.col("db_label").alias("label"),
        db_name(F.col("db"), F.col("db_label")).alias("db_name"),
        "insert_rate",
        F.round(F.element_at("st_max_qps_list_list", F.col("at")), 4).alias("streaming_qps"),
        F.round(F.element_at("st_serial_latency_p99_list", F.col("at")), 4).alias("streaming_latency"),
    )


def score(results: DataFrame, lower_is_better: bool = False) -> DataFrame:
    """Overall score of every system: the geometric mean of its relative scores over all cases.

    ``results`` is ``db_name, case_name, value`` with a null or zero value for a failure; a
    system without a row for a case failed it. Larger-is-better values score against the
    case's best; latencies (ms) get 10 ms added on both sides. A failure counts as twice as
    bad as the worst result of the case. Cases nobody passed are left out.

    The mean is ``sum over passed (ln s - ln s_fail) + sum over cases ln s_fail``, so the
    grid of systems and cases is never built.
    """
    passed = results.where(F.col("value") > 0)

    def relative(value: Column) -> Column:
        if lower_is_better:
            return (F.col("base") + LATENCY_OFFSET_MS) / (value + LATENCY_OFFSET_MS) * 100
        return value / F.col("base") * 100

    worst = F.max("value") * 2 if lower_is_better else F.min("value") / 2
    base = F.min("value") if lower_is_better else F.max("value")
    cases = passed.groupBy("case_name").agg(base.alias("base"), worst.alias("fail"))
    cases = cases.withColumn("ln_fail", F.log(relative(F.col("fail"))))
    gains = (
        passed.join(broadcast_if_small(cases), "case_name")
        .groupBy("db_name")
        .agg(F.sum(F.log(relative(F.col("value"))) - F.col("ln_fail")).alias("gain"), F.count(F.lit(1)).alias("passed"))
    )
    n = F.lit(cases.agg(F.count(F.lit(1))).scalar())
    floor = F.lit(cases.agg(F.sum("ln_fail")).scalar())
    systems = results.select("db_name").distinct().join(gains, "db_name", "left")
    return systems.select(
        "db_name",
        F.coalesce("passed", F.lit(0)).alias("passed"),
        F.exp((F.coalesce("gain", F.lit(0.0)) + floor) / n).alias("score"),
    )
