"""Queries that run Structured Streaming jobs to completion, and their batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearfield.operators.nearest import nearest
from nearfield.operators.requests import latency_micros
from nearfield.plans.inputs import REQUEST_COLUMNS, RUNS, STAGES, VECTORS, epoch_micros, requests, runs, table, vector_queries, vectors, with_lists
from nearfield.plans.registry import query
from nearfield.plans.report import explode_stages
from nearfield.plans.search_queries import all_pairs, exact_sql, ranked, shown
from nearfield.session import work_dir
from nearfield.sources.tables import dense_row_ids
from nearfield.streaming import ingest as I
from nearfield.streaming import live as L
from nearfield.streaming import stages as S

K = 10
RATE = 100


def numbered(spark, sf):
    return dense_row_ids(vectors(spark, sf), "id")


@query("paced_ingest", "SELECT vec_id AS id, CAST(label AS BIGINT) AS label, CAST(floor((row_number() OVER (ORDER BY vec_id) - 1) / 100) AS BIGINT) AS tick FROM embeddings")
def paced_ingest(spark, sf):
    root = work_dir(spark, "ingest")
    rows = I.add_ticks(numbered(spark, sf), I.effective_rate(150, 100))
    schema = I.write_ticks(rows, f"{root}/source")
    I.append_stream(I.read_ticks(spark, f"{root}/source", schema, 2), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return I.read_appended(spark, f"{root}/out", schema).select("id", "label", "tick")


_PROGRESS = """t AS (SELECT event_id // 100 AS tick, min(event_id // 250) AS event FROM events GROUP BY 1),
c AS (SELECT event, sum(n) OVER (ORDER BY event) AS done FROM (SELECT event, count(*) AS n FROM t GROUP BY 1)),
g AS (SELECT CAST(s AS INTEGER) AS stage, CAST(floor(ceil((SELECT count(*) FROM events) / 100.0::DOUBLE) * s / 100) AS BIGINT) AS target FROM (SELECT unnest([50, 80, 100]) AS s))"""


@query(
    "stage_progress",
    f"WITH {_PROGRESS} SELECT CAST(stage AS BIGINT) AS stage, target, min(CASE WHEN done >= target THEN event END) IS NOT NULL AS reached, CAST(min(CASE WHEN done >= target THEN event END) AS BIGINT) AS at_event FROM g, c GROUP BY 1, 2",
)
def stage_progress(spark, sf):
    events = table(spark, sf, "events")
    ticks = events.select(F.floor(F.col("event_id") / 250).alias("event"), F.floor(F.col("event_id") / 100).alias("tick"))
    targets = S.stage_targets(events.count(), 100, [0.5, 0.8, 1.0])
    return S.stage_progress(ticks, targets).withColumn("stage", F.col("stage").cast("bigint"))


_STAGED = f"""{VECTORS}, b AS (SELECT *, floor((row_number() OVER (ORDER BY id) - 1) / {RATE}) AS tick FROM v), z AS (SELECT ceil(count(*) / {RATE}e0) AS total FROM v),
g AS (SELECT stage, floor(total * least(stage, 100) / 100) AS target FROM z, (SELECT unnest({{stages}}) AS stage)),
{all_pairs('cos', base='b', extra=', b.tick')}, {ranked('s', 't')}, sg AS (SELECT stage, qid, id, d FROM s, g WHERE tick < target), {ranked('sg', unit='stage, qid')},
hit AS (SELECT h.stage, h.qid, t.rank AS rank FROM h JOIN t ON t.qid = h.qid AND t.id = h.id),
o AS (SELECT stage, round(count(*) / {K}e0 / (SELECT count(*) FROM v), 4) AS recall, round(sum(1 / log2(rank + 2)) / (SELECT sum(1 / log2(i + 2)) FROM (SELECT unnest(range(0, {K})) AS i)) / (SELECT count(*) FROM v), 4) AS ndcg FROM hit GROUP BY 1)
SELECT CAST(stage AS BIGINT) AS stage, recall, ndcg, round(recall / least(stage, 100) * 100, 4) AS adjusted_recall, round(ndcg / least(stage, 100) * 100, 4) AS adjusted_ndcg FROM o"""


def _truth(spark, sf):
    hits = nearest(vectors(spark, sf), vector_queries(spark, sf), K, "cos")
    return hits.select("qid", F.col("rank").alias("gt_rank"), "id")


@query("stage_recall", "WITH " + _STAGED.format(stages="[50, 80, 100]"))
def stage_recall(spark, sf):
    rows = I.add_ticks(numbered(spark, sf), RATE)
    targets = S.stage_targets(rows.count(), RATE, [0.5, 0.8, 1.0])
    asked = vector_queries(spark, sf)
    hits = S.stage_hits(rows, asked, targets, K, "cos")
    scored = S.stage_recall(hits, _truth(spark, sf), asked, [stage for stage, _ in targets], K)
    return scored.withColumn("stage", F.col("stage").cast("bigint"))


@query("stage_recall_stream", "WITH " + _STAGED.format(stages="[50, 80, 100, 110]"))
def stage_recall_stream(spark, sf):
    """The same stages evaluated while the load streams in, and once more after a rewrite."""
    root = work_dir(spark, "stages")
    rows = I.add_ticks(numbered(spark, sf), RATE).select("id", "emb", "tick")
    schema = I.write_ticks(rows, f"{root}/source")
    sink = S.StagedLoad(
        spark, root, vector_queries(spark, sf), _truth(spark, sf), S.stage_targets(rows.count(), RATE, [0.5, 0.8]), K
    )
    stream = I.read_ticks(spark, f"{root}/source", schema, 2)
    stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    sink.finish()
    return sink.results().withColumn("stage", F.col("stage").cast("bigint"))


@query(
    "adjusted_recall",
    f"WITH {RUNS}, {STAGES} SELECT ord, search_stage, round(st_recall / least(search_stage, 100) * 100, 4) AS adjusted_recall, round(st_ndcg / least(search_stage, 100) * 100, 4) AS adjusted_ndcg, round(st_p99 * 1000, 2) AS latency_p99, round(st_p95 * 1000, 2) AS latency_p95 FROM stages",
)
def adjusted_recall(spark, sf):
    return explode_stages(with_lists(runs(spark, sf)), ["ord"]).select(
        "ord", "search_stage", "adjusted_recall", "adjusted_ndcg", "latency_p99", "latency_p95"
    )


@query(
    "ideal_duration",
    f"WITH {RUNS} SELECT ord, CAST(ceil(ord * 1000e0 / insert_rate) AS BIGINT) AS ideal_s, round(load_duration - ceil(ord * 1000e0 / insert_rate), 6) AS overrun_s FROM runs",
)
def ideal_duration(spark, sf):
    size = F.col("ord") * 1000
    return runs(spark, sf).select(
        "ord", F.ceil(size / F.col("insert_rate")).alias("ideal_s"), F.round(I.overrun_seconds(size, F.col("insert_rate"), F.col("load_duration")), 6).alias("overrun_s")
    )


@query("incremental_topk", exact_sql("cos"))
def incremental_topk(spark, sf):
    root = work_dir(spark, "incremental")
    rows = I.add_ticks(numbered(spark, sf), 250).select("id", "emb", "tick")
    schema = I.write_ticks(rows, f"{root}/source")
    sink = L.IncrementalTopK(spark, f"{root}/hits", vector_queries(spark, sf), K)
    stream = I.read_ticks(spark, f"{root}/source", schema, 1)
    stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    return shown(sink.hits())


_WINDOWS = """SELECT run, epoch_us(w) AS start_us, requests, failed, round((requests - failed) / 21600e0, 6) AS qps, round(failed / CAST(requests AS DOUBLE), 6) AS failed_rate, round(p95, 6) AS latency_p95, round(p99, 6) AS latency_p99
FROM (SELECT run, time_bucket(INTERVAL '6 hours', ts) AS w, count(*) AS requests, count(CASE WHEN NOT ok THEN 1 END) AS failed, quantile_cont(CASE WHEN ok THEN latency_s END, 0.95::DOUBLE) AS p95, quantile_cont(CASE WHEN ok THEN latency_s END, 0.99::DOUBLE) AS p99
FROM (SELECT 'run_' || CAST(user_id % 4 AS VARCHAR) AS run, ts, value / 997e0 AS latency_s, event_type <> 'error' AS ok FROM events) GROUP BY 1, 2)"""


def _window_rows(df):
    return df.select(
        "run", epoch_micros(F.col("window_start")).alias("start_us"), "requests", "failed", F.round("qps", 6).alias("qps"),
        F.round("failed_rate", 6).alias("failed_rate"), F.round("latency_p95", 6).alias("latency_p95"), F.round("latency_p99", 6).alias("latency_p99"),
    )


@query("request_windows", _WINDOWS)
def request_windows(spark, sf):
    return _window_rows(L.request_windows(requests(spark, sf), ["run"], "6 hours", exact=True))


@query("request_windows_stream", _WINDOWS + " WHERE epoch_us(w) + 21600000000 <= (SELECT max(epoch_us(ts)) - 3600000000 FROM events)")
def request_windows_stream(spark, sf):
    """Windows the watermark has closed, as appended by the stream."""
    root = work_dir(spark, "windows")
    given = table(spark, sf, "events")
    stream = spark.readStream.schema(given.schema).option("pathGlobFilter", "events*.parquet").parquet(sf)
    log = stream.select(
        F.concat(F.lit("run_"), (F.col("user_id") % 4).cast("string")).alias("run"), F.col("ts").cast("timestamp").alias("ts"),
        (F.col("value") / F.lit(997.0)).alias("latency_s"), (F.col("event_type") != "error").alias("ok"),
    )
    closed = L.request_windows(log, ["run"], "6 hours", lateness="1 hour", exact=True)
    closed.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return _window_rows(spark.read.schema(closed.schema).parquet(f"{root}/out"))


_SLIDES = """SELECT run, epoch_us(w) AS start_us, count(*) AS requests, count(CASE WHEN NOT ok THEN 1 END) AS failed, round(count(CASE WHEN ok THEN 1 END) / 21600e0, 6) AS qps, true AS p95_within, true AS p99_within
FROM (SELECT run, ok, unnest([time_bucket(INTERVAL '2 hours', ts), time_bucket(INTERVAL '2 hours', ts) - INTERVAL '2 hours', time_bucket(INTERVAL '2 hours', ts) - INTERVAL '4 hours']) AS w
      FROM (SELECT 'run_' || CAST(user_id % 4 AS VARCHAR) AS run, ts, event_type <> 'error' AS ok FROM events))
WHERE epoch_us(w) + 21600000000 <= (SELECT max(epoch_us(ts)) - 3600000000 FROM events) GROUP BY 1, 2"""


@query("request_windows_bounded", _SLIDES)
def request_windows_bounded(spark, sf):
    """Sliding windows whose stream state is one sketch each: exact counts, and percentiles within three hundredths of their rank."""
    root = work_dir(spark, "sliding")
    given = table(spark, sf, "events")
    stream = spark.readStream.schema(given.schema).option("pathGlobFilter", "events*.parquet").parquet(sf)
    columns = [F.expr(REQUEST_COLUMNS[c]).alias(c) for c in ("run", "latency_s", "ok")]
    log = stream.select(*columns, F.col("ts").cast("timestamp").alias("ts"))
    closed = L.request_windows(log, ["run"], "6 hours", "2 hours", lateness="1 hour")
    closed.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    sketched = spark.read.schema(closed.schema).parquet(f"{root}/out")
    frame = F.window("ts", "6 hours", "2 hours")
    taken = given.select(*columns, F.col("ts").cast("timestamp").alias("ts")).where("ok").select("run", frame["start"].alias("window_start"), latency_micros(F.col("latency_s")).alias("us"))
    counts = []
    for name in ("latency_p95", "latency_p99"):
        value = F.round(F.col(name) * 1_000_000).cast("bigint")
        counts += [F.count_if(F.col("us") < value).alias(f"{name}_below"), F.count_if(F.col("us") <= value).alias(f"{name}_upto")]
    with_ranks = sketched.join(taken, ["run", "window_start"]).groupBy("run", "window_start").agg(F.count(F.lit(1)).alias("n"), *counts)
    both = sketched.join(with_ranks, ["run", "window_start"], "left")

    def within(name: str, p: float):
        """The ranks that the value takes come within three hundredths of the one asked for."""
        near = (F.col(f"{name}_below") <= (p + 0.03) * F.col("n")) & (F.col(f"{name}_upto") >= (p - 0.03) * F.col("n"))
        return F.when(F.col("n").isNull(), F.col(name).isNull()).otherwise(F.coalesce(near, F.lit(False)))

    return both.select(
        "run", epoch_micros(F.col("window_start")).alias("start_us"), "requests", "failed", F.round("qps", 6).alias("qps"),
        within("latency_p95", 0.95).alias("p95_within"), within("latency_p99", 0.99).alias("p99_within"),
    )


@query(
    "insert_outcomes",
    """SELECT run, count(CASE WHEN ok THEN 1 END) AS done, count(CASE WHEN ok IS NULL THEN 1 END) AS pending, count(CASE WHEN NOT ok THEN 1 END) AS failed, coalesce(bool_or(NOT ok), false) AS ended, CAST(coalesce(sum(CASE WHEN ok THEN n END), 0) AS BIGINT) AS rows_done
    FROM (SELECT user_id AS run, event_id % 100 + 1 AS n, CASE WHEN event_type = 'signup' THEN NULL ELSE NOT (event_type = 'error' AND user_id % 2 = 0) END AS ok FROM events) GROUP BY 1""",
)
def insert_outcomes(spark, sf):
    root = work_dir(spark, "outcomes")
    given = table(spark, sf, "events")
    stream = spark.readStream.schema(given.schema).option("pathGlobFilter", "events*.parquet").parquet(sf)
    failed = (F.col("event_type") == "error") & (F.col("user_id") % 2 == 0)
    log = stream.select(
        F.col("user_id").alias("run"), (F.col("event_id") % 100 + 1).alias("rows"), F.when(F.col("event_type") != "signup", ~failed).alias("ok")
    )
    last = {}

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{root}/v{batch_id}")
        last["version"] = batch_id

    counts = L.insert_outcomes(log)
    counts.writeStream.option("checkpointLocation", f"{root}/checkpoint").outputMode("complete").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{root}/v{last['version']}")
