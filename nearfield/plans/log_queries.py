"""Queries over request, insert and status logs derived from the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearfield.operators import histogram as H
from nearfield.operators import requests as Q
from nearfield.plans.inputs import REQUESTS, requests, table
from nearfield.plans.registry import query


def rounded(df, **digits):
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


def _cont(p, value="latency_s"):
    return f"quantile_cont({value}, {p}::DOUBLE)"


@query(
    "latency_stats",
    f"WITH {REQUESTS} SELECT run, conc, count(*) AS n, round(avg(latency_s), 4) AS latency_avg, round({_cont(.95)}, 4) AS latency_p95, round({_cont(.99)}, 4) AS latency_p99 FROM r GROUP BY 1, 2",
)
def latency_stats(spark, sf):
    return Q.latency_stats(requests(spark, sf), ["run", "conc"])


@query("latency_sketch")
def latency_sketch(spark, sf):
    """Approximate by nature: checked for rank error in the tests."""
    per_worker = Q.latency_sketch(requests(spark, sf), ["run", "conc", "worker"])
    return rounded(Q.sketch_stats(per_worker, ["run", "conc"]), latency_avg=6)


@query(
    "latency_sketch_bounds",
    f"""WITH {REQUESTS} SELECT run, conc, count(latency_s) AS n, round(sum(least(CAST(trunc(latency_s * 1000000) AS BIGINT), 60000000)) / count(latency_s) / 1000000, 6) AS latency_avg,
    true AS p95_within, true AS p99_within FROM r GROUP BY 1, 2""",
)
def latency_sketch_bounds(spark, sf):
    """What is exact about the sketch: count and mean, and that its percentiles lie within two hundredths of their rank."""
    log = requests(spark, sf)
    sketched = Q.sketch_stats(Q.latency_sketch(log, ["run", "conc", "worker"]), ["run", "conc"])
    ranks = F.percentile(Q.latency_micros(F.col("latency_s")) / 1e6, F.array(*map(F.lit, (0.93, 0.97, 1.0)))).alias("at")
    both = sketched.join(log.groupBy("run", "conc").agg(ranks), ["run", "conc"])
    return both.select(
        "run", "conc", "n", F.round("latency_avg", 6).alias("latency_avg"),
        F.col("latency_p95").between(F.col("at")[0], F.col("at")[1]).alias("p95_within"),
        F.col("latency_p99").between(F.col("at")[1], F.col("at")[2]).alias("p99_within"),
    )


@query(
    "latency_histogram",
    # The values of rank ceil(p n), each raised to the last one that shares its leading 11 binary digits.
    f"""WITH {REQUESTS}, h AS (SELECT run, conc, greatest(least(CAST(trunc(latency_s * 1000000) AS BIGINT), 60000000), 0) AS us FROM r WHERE latency_s IS NOT NULL),
    o AS (SELECT run, conc, count(*) AS n, avg(us) / 1e6 AS latency_avg, list_sort(list(us)) AS us FROM h GROUP BY 1, 2),
    q AS (SELECT run, conc, n, latency_avg, us[CAST(ceil(0.95::DOUBLE * n) AS BIGINT)] AS a, us[CAST(ceil(0.99::DOUBLE * n) AS BIGINT)] AS b FROM o),
    w AS (SELECT *, CAST(pow(2, greatest(length(bin(a)) - 11, 0)) AS BIGINT) AS wa, CAST(pow(2, greatest(length(bin(b)) - 11, 0)) AS BIGINT) AS wb FROM q)
    SELECT run, conc, n, round(latency_avg, 6) AS latency_avg, round(((a // wa + 1) * wa - 1) / 1e6, 6) AS latency_p95, round(((b // wb + 1) * wb - 1) / 1e6, 6) AS latency_p99 FROM w""",
)
def latency_histogram(spark, sf):
    """Histograms per worker, added up per run and level; the SQL takes the ranked values themselves."""
    per_worker = H.histogram(requests(spark, sf), ["run", "conc", "worker"])
    found = H.stats(per_worker, ["run", "conc"], {"latency_p95": 0.95, "latency_p99": 0.99})
    return rounded(found, latency_avg=6, latency_p95=6, latency_p99=6)


_WORKERS = f"w AS (SELECT run, conc, worker, count(*) AS n, avg(latency_s) AS avg, {_cont(.95)} AS p95, {_cont(.99)} AS p99 FROM r WHERE ok GROUP BY 1, 2, 3)"


@query(
    "worker_merge",
    f"WITH {REQUESTS}, {_WORKERS} SELECT run, conc, round(max(p99), 6) AS latency_p99, round(max(p95), 6) AS latency_p95, round(sum(avg * n) / sum(n), 6) AS latency_avg FROM w GROUP BY 1, 2",
)
def worker_merge(spark, sf):
    merged = Q.worker_merge(Q.worker_stats(requests(spark, sf), ["run", "conc"]), ["run", "conc"])
    return rounded(merged, latency_p99=6, latency_p95=6, latency_avg=6)


LEVELS = f"""l AS (SELECT run, conc, count(CASE WHEN ok THEN 1 END) AS ok_count, count(CASE WHEN NOT ok THEN 1 END) AS failed_count,
round(count(CASE WHEN ok THEN 1 END) / (max(epoch_us(ts) / 1e6 + latency_s) - min(epoch_us(ts) / 1e6)), 4) AS qps, avg(CASE WHEN ok THEN latency_s END) AS latency_avg,
{_cont(.95, 'CASE WHEN ok THEN latency_s END')} AS latency_p95, {_cont(.99, 'CASE WHEN ok THEN latency_s END')} AS latency_p99 FROM r GROUP BY 1, 2)"""


def levels(spark, sf):
    return Q.qps_by_concurrency(requests(spark, sf), ["run", "conc"])


@query(
    "qps_by_concurrency",
    f"WITH {REQUESTS}, {LEVELS} SELECT run, conc, ok_count, failed_count, qps, round(latency_avg, 6) AS latency_avg, round(latency_p95, 6) AS latency_p95, round(latency_p99, 6) AS latency_p99 FROM l",
)
def qps_by_concurrency(spark, sf):
    return rounded(levels(spark, sf), latency_avg=6, latency_p95=6, latency_p99=6)


@query(
    "max_qps",
    f"""WITH {REQUESTS}, {LEVELS} SELECT run, max(qps) AS max_qps, (SELECT min(conc) FROM l b WHERE b.run = l.run AND b.qps = max(l.qps)) AS best_conc,
    string_agg(CAST(conc AS VARCHAR), ',' ORDER BY conc) AS conc_list, round(sum(qps * conc), 4) AS weighted FROM l GROUP BY run""".replace(
        "(SELECT min(conc) FROM l b WHERE b.run = l.run AND b.qps = max(l.qps))", "CASE WHEN max(qps) > 0 THEN arg_max(conc, qps * 1e6 - conc / 1e3) END"
    ),
)
def max_qps(spark, sf):
    best = Q.max_qps(levels(spark, sf))
    weighted = F.aggregate(F.zip_with("conc_num_list", "conc_qps_list", lambda c, q: c * q), F.lit(0.0), lambda acc, x: acc + x)
    return best.select(
        "run", "max_qps", "best_conc", F.array_join(F.transform("conc_num_list", lambda c: c.cast("string")), ",").alias("conc_list"), F.round(weighted, 4).alias("weighted")
    )


@query(
    "failed_rate",
    f"""WITH {REQUESTS}, g AS (SELECT run, conc, count(CASE WHEN NOT ok THEN 1 END) / CAST(count(*) AS DOUBLE) AS rate, max(ts) AS last_ts FROM r GROUP BY 1, 2)
    SELECT g.run, g.conc, round(rate, 6) AS failed_rate, round(last, 6) AS reported_rate FROM g JOIN (SELECT run, arg_max(rate, last_ts) AS last FROM g GROUP BY 1) x ON x.run = g.run""",
)
def failed_rate(spark, sf):
    return rounded(Q.failed_rate(requests(spark, sf)), failed_rate=6, reported_rate=6)


@query(
    "retry_fold",
    f"WITH {REQUESTS} SELECT request, round(sum(latency_s), 6) AS latency_s, count(*) AS attempts, arg_max(ok, attempt) AS ok FROM r WHERE attempt < 6 GROUP BY 1",
)
def retry_fold(spark, sf):
    folded = Q.retry_fold(requests(spark, sf), ["request"])
    return folded.select("request", F.round("latency_s", 6).alias("latency_s"), "attempts", "ok")


_PASS = "s AS (SELECT *, CASE WHEN seq % 2 = 0 THEN 'cold' ELSE 'warm' END AS pass FROM r)"


def _pass_stats(which):
    v = f"CASE WHEN pass = '{which}' THEN latency_s END"
    return (
        f"round(arg_min(latency_s, CASE WHEN pass = '{which}' THEN seq END), 4) AS {which}_first_query, round({_cont(.99, v)}, 4) AS {which}_p99, "
        f"round({_cont(.95, v)}, 4) AS {which}_p95, round(avg({v}), 4) AS {which}_avg"
    )


@query(
    "cold_warm",
    f"WITH {REQUESTS}, {_PASS}, c AS (SELECT run, {_pass_stats('cold')}, {_pass_stats('warm')} FROM s GROUP BY 1) SELECT *, "
    + ", ".join(f"CASE WHEN warm_{n} <> 0 THEN round(cold_{n} / warm_{n}, 4) ELSE 0e0 END AS {n}_ratio" for n in ("first_query", "p99", "p95", "avg"))
    + " FROM c",
)
def cold_warm(spark, sf):
    log = requests(spark, sf).withColumn("pass", F.when(F.col("seq") % 2 == 0, F.lit("cold")).otherwise(F.lit("warm")))
    return Q.cold_warm(log, ["run"])


@query(
    "insert_throughput",
    """SELECT run, CAST(coalesce(sum(CASE WHEN ok THEN n END), 0) AS BIGINT) AS inserted_count,
    round(coalesce(sum(CASE WHEN ok THEN n END), 0) / greatest(max(t) - min(t), 0.001::DOUBLE), 4) AS insert_rows_per_second, round(max(t) - min(t), 4) AS insert_completion_seconds
    FROM (SELECT 'run_' || CAST(user_id AS VARCHAR) AS run, event_id % 100 + 1 AS n, event_type <> 'error' AS ok, epoch_us(ts) / 1e6 AS t FROM events) GROUP BY 1""",
)
def insert_throughput(spark, sf):
    log = table(spark, sf, "events").select(
        F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run"), (F.col("event_id") % 100 + 1).alias("rows"), (F.col("event_type") != "error").alias("ok"), "ts"
    )
    return Q.insert_throughput(log)


_DELAYS = """e AS (SELECT user_id AS run, epoch_us(ts) / 1e6 AS t, event_type FROM events), x AS (SELECT run, max(CASE WHEN event_type = 'signup' THEN NULL ELSE NULL END) AS z, min(CASE WHEN event_type = 'signup' THEN t END) AS end_t FROM e GROUP BY 1),
f AS (SELECT e.run, min(end_t) AS end_t, min(CASE WHEN event_type IN ('purchase', 'error') THEN t END) AS s_t, min(CASE WHEN event_type = 'error' THEN t END) AS i_t FROM e JOIN x ON x.run = e.run WHERE t >= end_t GROUP BY 1)"""


@query(
    "readiness_delays",
    f"""WITH {_DELAYS}, w AS (SELECT run, s_t - end_t AS s, i_t - s_t AS i FROM f)
    SELECT run, CASE WHEN s <= 200000 THEN round(s, 4) END AS searchable_after_insert_seconds, CASE WHEN s <= 200000 AND s + i <= 200000 THEN round(i, 4) END AS indexed_after_searchable_seconds,
    NOT coalesce(s <= 200000 AND s + i <= 200000, false) AS timed_out FROM w""",
)
def readiness_delays(spark, sf):
    events = table(spark, sf, "events").withColumnRenamed("user_id", "run")
    end = events.where(F.col("event_type") == "signup").groupBy("run").agg(F.min("ts").alias("end_ts"))
    status = events.select(
        "run", "ts", F.col("event_type").isin("purchase", "error").alias("searchable"), (F.col("event_type") == "error").alias("indexed")
    )
    return Q.readiness_delays(status, end, timeout_s=200000)


@query(
    "max_load_count",
    """WITH b AS (SELECT user_id AS run, event_id // 500 AS p, event_id % 100 + 1 AS n, NOT (event_type = 'error' AND value > 40) AS ok FROM events),
    p AS (SELECT run, p, sum(n) AS n, bool_and(ok) AS ok FROM b GROUP BY 1, 2), f AS (SELECT run, min(CASE WHEN NOT ok THEN p END) AS bad FROM p GROUP BY 1)
    SELECT p.run, CAST(coalesce(sum(CASE WHEN bad IS NULL OR p.p < bad THEN n END), 0) AS BIGINT) AS max_load_count FROM p JOIN f ON f.run = p.run GROUP BY 1""",
)
def max_load_count(spark, sf):
    log = table(spark, sf, "events").select(
        F.col("user_id").alias("run"), F.floor(F.col("event_id") / 500).alias("load_pass"), (F.col("event_id") % 100 + 1).alias("rows"),
        (~((F.col("event_type") == "error") & (F.col("value") > 40))).alias("ok"),
    )
    return Q.max_load_count(log)
