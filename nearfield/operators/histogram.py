"""Latency histograms with bins of bounded relative width, as tables that add up.

A bin holds the microsecond values that agree in their leading ``bits + 1`` binary digits, so it
is never wider than ``2**-bits`` of its values, and values below ``2**(bits + 1)`` are exact.
With 10 bits a percentile is at most a thousandth too high. Latencies end at 60 s, which bounds
the bins of a group at some 17 000 however long the log is; a histogram is rows of
``bin, n, total_us``, and histograms of workers, windows or days add up by summing them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.operators.requests import MICROS, latency_micros

BITS = 10


def _micros(latency_s: Column) -> Column:
    return F.greatest(latency_micros(latency_s), F.lit(0).cast("bigint"))


def bin_of(micros: Column, bits: int = BITS) -> Column:
    """Number of the bin of a whole, non-negative number; bins are in the order of their values."""
    dropped = F.greatest(F.length(F.bin(micros)) - F.lit(bits + 1), F.lit(0))
    leading = F.call_function("div", micros, F.call_function("shiftleft", F.lit(1).cast("bigint"), dropped))
    return dropped.cast("bigint") * F.lit(1 << bits) + leading


def top_of(number: Column, bits: int = BITS) -> Column:
    """The greatest value of a bin."""
    dropped = F.greatest(F.call_function("div", number, F.lit(1 << bits)) - 1, F.lit(0).cast("bigint")).cast("int")
    leading = number - dropped.cast("bigint") * F.lit(1 << bits)
    return (leading + 1) * F.call_function("shiftleft", F.lit(1).cast("bigint"), dropped) - 1


def histogram(log: DataFrame, by: list[str], bits: int = BITS) -> DataFrame:
    """``by, bin, n, total_us`` of the log's latencies; null latencies are left out, negative ones count as 0."""
    taken = log.where(F.col("latency_s").isNotNull()).select(*by, _micros(F.col("latency_s")).alias("us"))
    return taken.groupBy(*by, bin_of(F.col("us"), bits).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("us").alias("total_us"))


def merged(histograms: DataFrame, by: list[str]) -> DataFrame:
    """Histograms added up to coarser groups."""
    return histograms.groupBy(*by, "bin").agg(F.sum("n").alias("n"), F.sum("total_us").alias("total_us"))


def stats(histograms: DataFrame, by: list[str], parts: dict[str, float], bits: int = BITS) -> DataFrame:
    """Count, exact mean and percentiles in seconds of every group.

    A percentile is the top of the bin that holds the value of rank ``ceil(p n)``. A group has
    no more rows here than there are bins, so the running count stays small.
    """
    whole = Window.partitionBy(*by)
    placed = merged(histograms, by).withColumns(
        {"upto": F.sum("n").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(whole)}
    )
    reached = {name: F.min(F.when(F.col("upto") >= F.greatest(F.ceil(F.lit(p) * F.col("all")), F.lit(1)), F.col("bin"))) for name, p in parts.items()}
    cut = placed.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("total_us") / F.sum("n") / MICROS).alias("latency_avg"), *[bin_.alias(name) for name, bin_ in reached.items()])
    return cut.select(*by, "n", "latency_avg", *[(top_of(F.col(name), bits) / MICROS).alias(name) for name in parts])
