"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every linked node but the roots; a root is the least node of its component.

    ``links`` has two columns ``a`` and ``b`` of one type. Rounds of large-star and small-star
    point every node at ever smaller ones until nothing changes; the links never leave the
    cluster and each round is written to the shared folder.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        edges, before = stored(small, "small-star"), mark
        mark = _mark(edges)
        if mark == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    """Number of links and two sums of their hashes: equal for equal tables."""
    one, two = (F.sum(F.xxhash64("u", "v", F.lit(seed)).cast("decimal(38,0)")) for seed in (1, 2))
    return tuple(edges.agg(F.count(F.lit(1)), one, two).first())
