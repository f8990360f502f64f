"""Live results: top-k kept up to date while rows arrive, request windows, insert outcomes."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.vector import lower_is_nearer
from nearfield.operators.kernels import DECIMALS
from nearfield.operators.nearest import QuerySet, nearest_partial, prepare_queries, top_k
from nearfield.operators.requests import latency_micros
from nearfield.schemas import HITS


class IncrementalTopK:
    """``foreachBatch`` sink that keeps the exact k nearest rows per query.

    Only the new rows are searched, and only those within the k-th score of their query at the last
    merge are written, as one version per batch. Versions are merged with the state once they hold as many
    rows as it does: as a row is kept the less often the more have come, that is at batch numbers that double.
    A repeated batch replaces its own version. What is there is found in the folder, so a restarted
    stream goes on from it; what no repeated batch can ask for is dropped.
    """

    def __init__(self, spark: SparkSession, out: str, queries: DataFrame, k: int, metric: str = "cos"):
        self.spark, self.out, self.queries, self.k, self.metric = spark, out, prepare_queries(queries), k, metric
        self.limits: tuple[int, QuerySet] | None = None
        self.sizes: dict[int, int] = {}  # rows of the versions since the last merge

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.out, *names]))

    def _complete(self, kind: str) -> list[int]:
        """Numbers of the complete folders of a kind, lowest first."""
        fs = self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getParent().getName() for s in fs.globStatus(self._path(f"{kind}*", "_SUCCESS")) or []]
        return sorted(int(n[1:]) for n in names if n[1:].isdigit())

    def versions(self) -> list[int]:
        """Numbers of the complete versions, oldest first."""
        return self._complete("v")

    def _drop(self, kind: str, numbers: list[int]) -> None:
        fs = self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())
        for number in numbers:
            fs.delete(self._path(f"{kind}{number}"), True)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        states, before = self._complete("s"), [v for v in self.versions() if v < batch_id]
        self._drop("s", [s for s in states if s >= batch_id])
        states = [s for s in states if s < batch_id]
        found, seen = nearest_partial(batch, self._within(states[-1] if states else None), self.k, self.metric), Observation()
        found.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{self.out}/v{batch_id}")
        # What makes the version before this batch stays, for a repetition.
        self._drop("s", states[:-1])
        self._drop("v", [v for v in before if states and v <= states[-1]])
        waiting = [*(v for v in before if not states or v > states[-1]), batch_id]
        self.sizes = {v: self.sizes[v] for v in waiting if v in self.sizes} | {batch_id: seen.get["rows"]}
        self.sizes |= {v: self._read("v", [v]).count() for v in waiting if v not in self.sizes}
        if sum(self.sizes.values()) >= self.queries.rows * self.k:
            self.hits(batch_id).write.mode("overwrite").parquet(f"{self.out}/s{batch_id}")

    def _within(self, state: int | None) -> QuerySet:
        """The queries with the k-th score of a state as their limit; a little more, as scores are held as they are shown."""
        if state is None or self.queries.shared is None:
            return self.queries
        if self.limits is None or self.limits[0] != state:
            score = F.col("score") if lower_is_nearer(self.metric) else -F.col("score")
            last = self._read("s", [state]).where(F.col("rank") == self.k - 1).select("qid", (score + F.lit(10.0**-DECIMALS)).alias("limit")).toArrow()
            names = self.queries.shared.value[0]
            limits = np.full(len(names), np.inf)
            limits[np.searchsorted(names, last["qid"].to_numpy())] = last["limit"].to_numpy()
            self.limits = state, replace(self.queries, limits=self.spark.sparkContext.broadcast(limits))
        return self.limits[1]

    def _read(self, kind: str, numbers: list[int]) -> DataFrame:
        if not numbers:
            return self.spark.createDataFrame([], HITS)
        return self.spark.read.schema(HITS).parquet(*[f"{self.out}/{kind}{n}" for n in numbers])

    def hits(self, version: int | None = None) -> DataFrame:
        """Hits as of a version, the last one by default."""
        there = self.versions()
        if version is None:
            version = max(there + self._complete("s"), default=-1)
        states = [s for s in self._complete("s") if s <= version][-1:]
        later = [v for v in there if (not states or v > states[0]) and v <= version]
        if not later:
            return self._read("s", states)
        nearer = lower_is_nearer(self.metric)
        found = self._read("s", states).unionByName(self._read("v", later))
        # An id that arrives again with another vector counts as the nearest of them, in whatever order they come.
        best = found.groupBy("qid", "id").agg((F.min if nearer else F.max)("score").alias("score"))
        merged = top_k(best, self.k, ascending=nearer)
        return merged.select("qid", F.col("rank").cast("int").alias("rank"), "id", "score")


def request_windows(log: DataFrame, by: list[str], width: str = "30 seconds", slide: str | None = None, lateness: str | None = None, exact: bool = False) -> DataFrame:
    """Requests, failures, qps and latency percentiles per time window of a request log.

    On a stream give ``lateness``: a window closes, and its state is freed, once the
    watermark has passed it, and later rows are dropped. Percentiles come from a mergeable
    sketch of bounded size unless ``exact`` is set (state then grows with the window).
    """
    rows = log if lateness is None else log.withWatermark("ts", lateness)
    frame = F.window("ts", width, slide) if slide else F.window("ts", width)
    taken = F.when(F.col("ok"), F.col("latency_s"))
    if exact:
        stats = F.percentile(taken, F.array(F.lit(0.95), F.lit(0.99)))
    else:
        stats = F.kll_sketch_agg_bigint(latency_micros(taken))
    grouped = rows.groupBy(frame.alias("w"), *by).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(~F.col("ok")).alias("failed"), stats.alias("stats")
    )
    seconds = (F.unix_micros(F.col("w.end").cast("timestamp")) - F.unix_micros(F.col("w.start").cast("timestamp"))) / F.lit(1e6)
    ok = F.col("requests") - F.col("failed")

    def at(i: int, p: float):
        value = F.col("stats")[i] if exact else F.kll_sketch_get_quantile_bigint("stats", F.lit(p)) / 1_000_000
        return F.when(ok > 0, value)

    return grouped.select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        *by,
        "requests",
        "failed",
        (ok / seconds).alias("qps"),
        (F.col("failed") / F.col("requests")).alias("failed_rate"),
        at(0, 0.95).alias("latency_p95"),
        at(1, 0.99).alias("latency_p99"),
    )


def insert_outcomes(insert_log: DataFrame, by: str = "run") -> DataFrame:
    """Done, pending and failed batches of each run; any failure ends it.

    ``ok`` is null while a batch is pending. Works on a stream (complete or update mode).
    """
    failed = F.coalesce(~F.col("ok"), F.lit(False))
    return insert_log.groupBy(by).agg(
        F.count_if(F.coalesce("ok", F.lit(False))).alias("done"),
        F.count_if(F.col("ok").isNull()).alias("pending"),
        F.count_if(failed).alias("failed"),
        F.bool_or(failed).alias("ended"),
        F.sum(F.when(F.col("ok"), F.col("rows")).otherwise(F.lit(0))).alias("rows_done"),
    )
