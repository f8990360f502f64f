"""Exact percentiles with linear interpolation, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.sizing import broadcast_if_small

GROUP_ROWS = 4_000_000
_CUT_ROWS = 1_000_000


def groups_fit(df: DataFrame, by: list[str], limit: int = GROUP_ROWS) -> bool:
    """Whether the largest group is small enough for one task's value map."""
    largest = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (largest or 0) <= limit


def grouped_percentiles(df: DataFrame, by: list[str], value: str, fractions: list[float], aggs: list[Column] | None = None, limit: int = GROUP_ROWS) -> DataFrame:
    """``by`` columns, ``aggs`` and ``p`` (one value per fraction; nulls are left out).

    Measured small groups use the built-in aggregate. Otherwise each group is cut at
    approximate quantiles, the rank of every cut is counted, and only the cuts that hold a
    wanted rank are sorted.
    """
    aggs = aggs or []
    if groups_fit(df, by, limit):
        p = F.percentile(value, F.array(*[F.lit(f) for f in fractions])).alias("p")
        return df.groupBy(*by).agg(*aggs, p)
    found = _by_cuts(df.where(F.col(value).isNotNull()), by, value, fractions)
    groups = df.groupBy(*by).agg(*aggs) if aggs else df.select(*by).distinct()
    return _join(groups, found, by, "left")


def _join(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, a null key being equal to a null key."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & left[c].eqNullSafe(renamed[f"_r_{c}"])
    return left.join(renamed, same, how).drop(*[f"_r_{c}" for c in by])


def _by_cuts(df: DataFrame, by: list[str], value: str, fractions: list[float]) -> DataFrame:
    largest = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    edges_n = min(8192, max(64, 2 * -(-largest // _CUT_ROWS)))
    steps = F.array(*[F.lit(i / edges_n) for i in range(1, edges_n)])
    edges = df.groupBy(*by).agg(
        F.percentile_approx(value, steps, F.lit(10_000)).alias("_edges"), F.count(F.lit(1)).alias("_n")
    )
    cut = F.size(F.filter("_edges", lambda e: e < F.col(value)))
    counts = (
        _join(df, broadcast_if_small(edges), by)
        .select(*by, F.col(value).alias("_v"), "_n", cut.alias("_cut"))
        .groupBy(*by, "_cut", "_v", "_n")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    before = Window.partitionBy(*by).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        counts.groupBy(*by, "_cut", "_n")
        .agg(F.sum("_c").alias("_rows"))
        .withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    )
    last = F.col("_n") - 1
    places = [(F.floor(last * F.lit(f)), F.ceil(last * F.lit(f)), f) for f in fractions]
    holds = F.lit(False)
    for low, high, _ in places:
        for r in (low, high):
            holds = holds | ((r >= F.col("_start")) & (r < F.col("_start") + F.col("_rows")))
    wanted = broadcast_if_small(starts.where(holds).select(*by, "_cut", "_start"))
    inside = Window.partitionBy(*by, "_cut").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = _join(counts, wanted, [*by, "_cut"]).withColumn("_to", F.col("_start") + F.sum("_c").over(inside))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_to") - F.col("_c")) & (rank < F.col("_to")), F.col("_v")))

    picks = []
    for i, (low, high, f) in enumerate(places):
        picks += [at(low).alias(f"_lo{i}"), at(high).alias(f"_hi{i}"), F.max(last * F.lit(f) - low).alias(f"_w{i}")]
    lines = [
        F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}") for i in range(len(fractions))
    ]
    return ranked.groupBy(*by).agg(*picks).select(*by, F.array(*lines).alias("p"))
