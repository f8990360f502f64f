"""Statistics of request, insert and status logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.operators.quantiles import grouped_percentiles

# Latencies are capped at 60 s and recorded in microseconds; one request is
# tried at most six times; elapsed time has a floor of 1 ms.
LATENCY_CAP_S = 60.0
MICROS = 1_000_000
MAX_ATTEMPTS = 6
ELAPSED_FLOOR_S = 0.001


def _seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(float(MICROS))


def latency_stats(log: DataFrame, by: list[str]) -> DataFrame:
    """Exact mean, p95 and p99 (linear interpolation) of ``latency_s``, rounded to 4 decimals."""
    grouped = grouped_percentiles(
        log, by, "latency_s", [0.95, 0.99], [F.count("latency_s").alias("n"), F.avg("latency_s").alias("avg")]
    )
    return grouped.select(
        *by,
        "n",
        F.round("avg", 4).alias("latency_avg"),
        F.round(F.col("p")[0], 4).alias("latency_p95"),
        F.round(F.col("p")[1], 4).alias("latency_p99"),
    )


def latency_micros(latency_s: Column) -> Column:
    """Whole microseconds, capped at 60 s; null stays null, which ``least`` alone would make 60 s."""
    micros = (latency_s * MICROS).cast("bigint")
    return F.when(micros.isNotNull(), F.least(micros, F.lit(int(LATENCY_CAP_S * MICROS))))


def latency_sketch(log: DataFrame, by: list[str], k: int = 800) -> DataFrame:
    """One mergeable quantile sketch per group: bounded memory however long the log is."""
    return log.groupBy(*by).agg(
        F.kll_sketch_agg_bigint(latency_micros(F.col("latency_s")), k).alias("sketch"),
        F.count("latency_s").alias("n"),
        F.sum(latency_micros(F.col("latency_s"))).alias("total_us"),
    )


def sketch_stats(sketches: DataFrame, by: list[str], k: int = 800) -> DataFrame:
    """Merge sketches to coarser groups and read mean, p95 and p99 in seconds."""
    merged = sketches.groupBy(*by).agg(
        F.kll_merge_agg_bigint("sketch", k).alias("sketch"), F.sum("n").alias("n"), F.sum("total_us").alias("total_us")
    )
    return merged.select(
        *by,
        "n",
        (F.col("total_us") / F.col("n") / MICROS).alias("latency_avg"),
        (F.kll_sketch_get_quantile_bigint("sketch", F.lit(0.95)) / MICROS).alias("latency_p95"),
        (F.kll_sketch_get_quantile_bigint("sketch", F.lit(0.99)) / MICROS).alias("latency_p99"),
    )


def worker_stats(log: DataFrame, by: list[str], worker: str = "worker") -> DataFrame:
    """Count, mean, p95 and p99 per worker of successful requests."""
    keys = [*by, worker]
    grouped = grouped_percentiles(
        log.where("ok"), keys, "latency_s", [0.95, 0.99], [F.count("latency_s").alias("n"), F.avg("latency_s").alias("avg")]
    )
    return grouped.select(*by, worker, "n", "avg", F.col("p")[0].alias("p95"), F.col("p")[1].alias("p99"))


def worker_merge(stats: DataFrame, by: list[str]) -> DataFrame:
    """Largest percentile over workers, count-weighted mean; idle workers ignored, none at all gives 0."""
    live = F.col("n") > 0
    zero = F.lit(0.0)
    return stats.groupBy(*by).agg(
        F.coalesce(F.max(F.when(live, F.col("p99"))), zero).alias("latency_p99"),
        F.coalesce(F.max(F.when(live, F.col("p95"))), zero).alias("latency_p95"),
        F.coalesce(F.sum(F.when(live, F.col("avg") * F.col("n"))) / F.sum(F.when(live, F.col("n"))), zero).alias("latency_avg"),
    )


def qps_by_concurrency(log: DataFrame, by: list[str]) -> DataFrame:
    """Successes over the wall time of each level (first start to last end), 4 decimals.

    The mean, p95 and p99 are those of the successful requests.
    """
    start = _seconds(F.col("ts"))
    taken = log.withColumn("taken", F.when(F.col("ok"), F.col("latency_s")))
    grouped = grouped_percentiles(
        taken,
        by,
        "taken",
        [0.95, 0.99],
        [
            F.count_if("ok").alias("ok_count"),
            F.count_if(~F.col("ok")).alias("failed_count"),
            (F.max(start + F.col("latency_s")) - F.min(start)).alias("wall_s"),
            F.avg("taken").alias("latency_avg"),
        ],
    )
    return grouped.select(
        *by,
        "ok_count",
        "failed_count",
        F.when(F.col("wall_s") > 0, F.round(F.col("ok_count") / F.col("wall_s"), 4)).otherwise(F.lit(0.0)).alias("qps"),
        "latency_avg",
        F.col("p")[0].alias("latency_p95"),
        F.col("p")[1].alias("latency_p99"),
    )


def max_qps(levels: DataFrame, run: str = "run", conc: str = "conc") -> DataFrame:
    """Best level of each run and the per-level lists in level order.

    Only a strictly greater value replaces the best, so the lowest level wins ties; a run
    that never gets above 0 has no best level.
    """
    level = F.struct(conc, "qps", "latency_p99", "latency_p95", "latency_avg")
    lists = levels.groupBy(run).agg(F.array_sort(F.collect_list(level)).alias("levels"))
    best = F.aggregate(
        "levels",
        F.struct(F.lit(0.0).alias("qps"), F.lit(None).cast("int").alias("conc")),
        lambda acc, x: F.when(
            x["qps"] > acc["qps"], F.struct(x["qps"].alias("qps"), x[conc].cast("int").alias("conc"))
        ).otherwise(acc),
    )
    out = lists.withColumn("best", best)
    return out.select(
        run,
        F.col("best.qps").alias("max_qps"),
        F.col("best.conc").alias("best_conc"),
        F.transform("levels", lambda x: x[conc]).alias("conc_num_list"),
        F.transform("levels", lambda x: x["qps"]).alias("conc_qps_list"),
        F.transform("levels", lambda x: x["latency_p99"]).alias("conc_latency_p99_list"),
        F.transform("levels", lambda x: x["latency_p95"]).alias("conc_latency_p95_list"),
        F.transform("levels", lambda x: x["latency_avg"]).alias("conc_latency_avg_list"),
    )


def failed_rate(log: DataFrame, run: str = "run", conc: str = "conc") -> DataFrame:
    """Failed share of each level, and that of the run's last level (what the run reports)."""
    levels = log.groupBy(run, conc).agg(
        (F.count_if(~F.col("ok")) / F.count(F.lit(1))).alias("failed_rate"), F.max("ts").alias("last_ts")
    )
    last = Window.partitionBy(run).orderBy("last_ts", conc).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return levels.select(run, conc, "failed_rate", F.last("failed_rate").over(last).alias("reported_rate"))


def retry_fold(attempts: DataFrame, request: list[str], max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """One row per request: latency over all attempts, ok if the last allowed attempt succeeded."""
    allowed = attempts.where(F.col("attempt") < max_attempts)
    return allowed.groupBy(*request).agg(
        F.sum("latency_s").alias("latency_s"),
        F.count(F.lit(1)).alias("attempts"),
        F.max_by("ok", "attempt").alias("ok"),
        F.min("ts").alias("ts"),
    )


def cold_warm(log: DataFrame, by: list[str], phase: str = "pass") -> DataFrame:
    """First, p99, p95 and mean latency of the cold and the warm pass, and their ratios.

    Statistics are rounded to 4 decimals before the ratio, and a zero denominator gives 0.
    """
    each = grouped_percentiles(
        log,
        [*by, phase],
        "latency_s",
        [0.99, 0.95],
        [F.min_by("latency_s", "seq").alias("first_query"), F.avg("latency_s").alias("avg")],
    ).select(*by, phase, "first_query", F.col("p")[0].alias("p99"), F.col("p")[1].alias("p95"), "avg")
    names = ["first_query", "p99", "p95", "avg"]
    stats = each.groupBy(*by).agg(
        *[
            F.round(F.max(F.when(F.col(phase) == which, F.col(name))), 4).alias(f"{which}_{name}")
            for which in ("cold", "warm")
            for name in names
        ]
    )

    def ratio(name: str) -> Column:
        below = F.col(f"warm_{name}")
        return F.when(below != 0, F.round(F.col(f"cold_{name}") / below, 4)).otherwise(F.lit(0.0)).alias(f"{name}_ratio")

    return stats.select("*", *[ratio(name) for name in names])


def insert_throughput(log: DataFrame, by: str = "run") -> DataFrame:
    """Inserted rows, rows per second and seconds from first to last batch; failed batches add no rows."""
    elapsed = _seconds(F.max("ts")) - _seconds(F.min("ts"))
    counted = log.groupBy(by).agg(
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("rows"))), F.lit(0)).alias("inserted_count"), elapsed.alias("elapsed")
    )
    return counted.select(
        by,
        "inserted_count",
        F.round(F.col("inserted_count") / F.greatest("elapsed", F.lit(ELAPSED_FLOOR_S)), 4).alias("insert_rows_per_second"),
        F.round("elapsed", 4).alias("insert_completion_seconds"),
    )


def load_duration(insert_s: Column, optimize_s: Column) -> Column:
    return F.round(insert_s + optimize_s, 4)


def readiness_delays(status: DataFrame, insert_end: DataFrame, by: str = "run", timeout_s: float | None = None) -> DataFrame:
    """Seconds from the end of insertion to searchable, then to indexed; 4 decimals.

    ``insert_end`` is ``run, end_ts``. A stage never reached, or reached past the timeout,
    leaves its delay null and sets ``timed_out``.
    """
    seen = status.join(insert_end, by).where(F.col("ts") >= F.col("end_ts"))
    first = seen.groupBy(by).agg(
        F.min("end_ts").alias("end_ts"),
        F.min(F.when(F.col("searchable"), F.col("ts"))).alias("s_ts"),
        F.min(F.when(F.col("searchable") & F.col("indexed"), F.col("ts"))).alias("i_ts"),
    )
    s_wait = _seconds(F.col("s_ts")) - _seconds(F.col("end_ts"))
    i_wait = _seconds(F.col("i_ts")) - _seconds(F.col("s_ts"))
    limit = F.lit(timeout_s).cast("double")
    s_ok = F.col("s_ts").isNotNull() & (limit.isNull() | (s_wait <= limit))
    i_ok = s_ok & F.col("i_ts").isNotNull() & (limit.isNull() | (s_wait + i_wait <= limit))
    return first.select(
        by,
        F.when(s_ok, F.round(s_wait, 4)).alias("searchable_after_insert_seconds"),
        F.when(i_ok, F.round(i_wait, 4)).alias("indexed_after_searchable_seconds"),
        (~i_ok).alias("timed_out"),
    )


def max_load_count(log: DataFrame, run: str = "run") -> DataFrame:
    """Rows of the complete passes before the first failed batch.

    ``log`` is ``run, load_pass, batch_id, rows, ok``. A pass that contains the failure is
    not counted. Passes are summed per run, so a long run is not sorted in one task.
    """
    passes = log.groupBy(run, "load_pass").agg(F.sum("rows").alias("rows"), F.bool_and("ok").alias("ok"))
    first_bad = passes.groupBy(run).agg(F.min(F.when(~F.col("ok"), F.col("load_pass"))).alias("bad"))
    kept = F.col("bad").isNull() | (F.col("load_pass") < F.col("bad"))
    return (
        passes.join(first_bad, run)
        .groupBy(run)
        .agg(F.coalesce(F.sum(F.when(kept, F.col("rows"))), F.lit(0)).alias("max_load_count"))
    )
