"""Queries over stored results, reports and leaderboards; each order is one result run."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearfield.plans import leaderboard as B
from nearfield.plans import report as G
from nearfield.plans.inputs import RUNS, STAGES, documents_json, runs, table, with_lists
from nearfield.plans.registry import query
from nearfield.sources import results as R

NORMAL = "label = ':)'"


def docs(spark, sf):
    return R.parse_runs(documents_json(spark, sf))


def rnd(df, *columns, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


_CASE = "CASE WHEN ord % 16 = 15 THEN 400 WHEN ord % 16 = 7 THEN 600 ELSE case_id END"
# The dataset that a result document names.
_SET = "CASE ord % 3 WHEN 0 THEN 'MS MARCO Small (100K)' WHEN 1 THEN 'MS MARCO Medium (1M)' ELSE 'MS MARCO Large (8.8M)' END"
_FILE = "'/results/' || db || '/result_' || lpad(CAST(ord AS VARCHAR), 12, '0') || '_a.json'"


@query(
    "flatten_results",
    f"""WITH {RUNS} SELECT {_FILE} AS file, db, db_label, db_name, CAST({_CASE} AS BIGINT) AS case_id,
    CASE {_CASE} WHEN 1 THEN 'Capacity Test (128 Dim Repeated)' WHEN 4 THEN 'Search Performance Test (10M Dataset, 768 Dim)' WHEN 5 THEN 'Search Performance Test (1M Dataset, 768 Dim)' WHEN 10 THEN 'Search Performance Test (500K Dataset, 1536 Dim)'
      WHEN 11 THEN 'Search Performance Test (5M Dataset, 1536 Dim)' WHEN 200 THEN 'Streaming-Perf - ' || {_SET} || ', 500 rows/s'
      WHEN 300 THEN 'Label-Filter-100.0% - ' || {_SET} WHEN 400 THEN 'Int-Filter-1.0% - Medium Cohere (768dim, 1M)' WHEN 600 THEN 'Cloud Insert - batch ' END AS case_name,
    CASE WHEN ord % 16 = 15 THEN 0.01::DOUBLE ELSE 0e0 END AS filter_rate, round(qps, 6) AS qps, round(recall, 6) AS recall, round(load_duration, 6) AS load_duration FROM runs WHERE {NORMAL}""",
)
def flatten_results(spark, sf):
    flat = G.flatten_results(R.map_legacy_cases(R.case_rows(docs(spark, sf))))
    return rnd(flat.select("file", "db", "db_label", "db_name", "case_id", "case_name", "filter_rate", "qps", "recall", "load_duration"), "qps", "recall", "load_duration")


@query("group_results", f"WITH {RUNS}, f AS (SELECT *, {_FILE} AS file, CASE WHEN task_label = 'custom' THEN run_id ELSE task_label END AS tl FROM runs) SELECT run_id AS group_key, arg_min(run_id, file) AS run_id, arg_min(tl, file) AS task_label, round(arg_min(timestamp, file), 3) AS timestamp, count(*) AS results FROM f GROUP BY f.run_id")
def group_results(spark, sf):
    grouped = G.group_results(docs(spark, sf), "run_id")
    return grouped.groupBy("group_key", "run_id", "task_label", F.round("timestamp", 3).alias("timestamp")).agg(F.sum(F.size("results")).alias("results"))


@query("merge_by_db", f"WITH {RUNS} SELECT db, 'fts_standard_' || lower(db) AS run_id, count(*) AS cases FROM runs GROUP BY 1")
def merge_by_db(spark, sf):
    return G.merge_listing(docs(spark, sf))


_PICK_DB = "db_name IN (SELECT db_name FROM runs GROUP BY 1 HAVING count(*) % 2 = 0)"
_PICK_CASE = "case_name IN ('case_4', 'case_5', 'Label-Filter-40.0% - set_1')"


@query("filter_tasks", f"WITH {RUNS} SELECT ord, db_name, case_name FROM runs WHERE {_PICK_DB} AND {_PICK_CASE}")
def filter_tasks(spark, sf):
    r = runs(spark, sf)
    chosen = r.groupBy("db_name").count().where(F.col("count") % 2 == 0).select("db_name")
    return G.filter_tasks(r, chosen, ["case_4", "case_5", "Label-Filter-40.0% - set_1"]).select("ord", "db_name", "case_name")


BEST = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY db_name, case_name ORDER BY qps DESC, ord DESC) AS n FROM runs) WHERE n = 1)"
MERGED = f"""{BEST}, lab AS (SELECT db_name, case_name, CASE WHEN bool_or({NORMAL}) THEN ':)' ELSE arg_max(label, ord) END AS label FROM runs GROUP BY 1, 2),
m AS (SELECT best.* FROM best JOIN lab ON lab.db_name = best.db_name AND lab.case_name = best.case_name AND lab.label = ':)')"""


@query("best_run", f"WITH {RUNS}, {BEST} SELECT db_name, case_name, ord, round(qps, 6) AS qps, round(recall, 6) AS recall, label FROM best")
def best_run(spark, sf):
    return rnd(G.best_run(runs(spark, sf)).select("db_name", "case_name", "ord", "qps", "recall", "label"), "qps", "recall")


@query("label_merge", f"WITH {RUNS}, {MERGED} SELECT * FROM lab")
def label_merge(spark, sf):
    return G.label_merge(runs(spark, sf))


@query("merged_runs", f"WITH {RUNS}, {MERGED} SELECT db_name, case_name, ord, round(qps, 6) AS qps FROM m")
def merged_runs(spark, sf):
    return rnd(G.merged_runs(runs(spark, sf)).select("db_name", "case_name", "ord", "qps"), "qps")


@query("failed_tasks", f"WITH {RUNS}, {MERGED} SELECT case_name, db_name, label, CASE label WHEN 'x' THEN 'failed' ELSE 'timeout' END AS kind FROM lab WHERE label <> ':)'")
def failed_tasks(spark, sf):
    return G.failed_tasks(runs(spark, sf))


_DBS = [f"db{i}" for i in range(6)]


@query(
    "failed_matrix",
    f"WITH {RUNS}, l AS (SELECT db, case_name, CASE WHEN bool_or({NORMAL}) THEN ':)' ELSE arg_max(label, ord) END AS label FROM runs GROUP BY 1, 2) SELECT case_name, "
    + ", ".join(f"max(CASE WHEN db = '{d}' THEN label END) AS {d}" for d in _DBS)
    + " FROM l WHERE label <> ':)' GROUP BY 1",
)
def failed_matrix(spark, sf):
    return G.failed_matrix(runs(spark, sf).withColumn("db_name", F.col("db")), _DBS)


@query("unmerged_runs", f"WITH {RUNS} SELECT ord, db_name, case_name, dataset, round(filter_rate, 6) AS filter_rate, round(qps, 6) AS qps FROM runs WHERE {NORMAL}")
def unmerged_runs(spark, sf):
    return rnd(G.unmerged_runs(runs(spark, sf)).select("ord", "db_name", "case_name", "dataset", "filter_rate", "qps"), "filter_rate", "qps")


def _better(name, fn):
    return f"round(coalesce({fn}(CASE WHEN {name} >= 1e-7 THEN {name} END), arg_max({name}, ord)), 6) AS {name}"


@query(
    "better_metric",
    f"WITH {RUNS} SELECT db_name, case_name, {_better('qps', 'max')}, {_better('load_duration', 'min')}, {_better('serial_latency_p99', 'min')}, {_better('max_load_count', 'max')} FROM runs GROUP BY 1, 2",
)
def better_metric(spark, sf):
    names = ("qps", "load_duration", "serial_latency_p99", "max_load_count")
    return rnd(G.better_metric(runs(spark, sf), ["db_name", "case_name"], names), *names)


_METRICS = ["qps", "recall", "load_duration", "serial_latency_p99", "serial_latency_p95", "max_load_count"]


@query(
    "metric_rank",
    f"WITH {RUNS}, {MERGED}, u AS ("
    + " UNION ALL ".join(f"SELECT case_name, db_name, '{m}' AS metric, {m} AS value FROM m" for m in _METRICS)
    + ") SELECT case_name, db_name, metric, round(value, 6) AS value, rank() OVER (PARTITION BY case_name, metric ORDER BY CASE WHEN metric IN ('load_duration', 'serial_latency_p99', 'serial_latency_p95') THEN value ELSE -value END) AS rank FROM u WHERE value > 1e-7",
)
def metric_rank(spark, sf):
    ranked = G.metric_rank(G.merged_runs(runs(spark, sf)))
    return rnd(ranked.withColumn("rank", F.col("rank").cast("bigint")), "value")


_PRICES = "pr AS (SELECT 'db' || CAST(p_partkey % 5 AS VARCHAR) AS db, CASE WHEN p_size % 4 = 0 THEN '' ELSE CAST(p_size % 4 AS VARCHAR) || 'c' END AS db_label, CASE WHEN p_partkey % 5 = 4 THEN 0e0 ELSE min(p_retailprice) END AS price FROM part GROUP BY p_partkey % 5, p_size % 4)"


def prices(spark, sf):
    part = table(spark, sf, "part").withColumn("d", F.col("p_partkey") % 5).withColumn("s", F.col("p_size") % 4)
    grouped = part.groupBy("d", "s").agg(F.min("p_retailprice").alias("low"))
    return grouped.select(
        F.concat(F.lit("db"), F.col("d").cast("string")).alias("db"),
        F.when(F.col("s") == 0, F.lit("")).otherwise(F.concat(F.col("s").cast("string"), F.lit("c"))).alias("db_label"),
        F.when(F.col("d") == 4, F.lit(0.0)).otherwise(F.col("low")).alias("price"),
    )


@query("qp_dollar", f"WITH {RUNS}, {_PRICES} SELECT ord, round(qps / price * 3.6::DOUBLE, 6) AS qp_dollar FROM runs JOIN pr ON pr.db = runs.db AND pr.db_label = runs.db_label WHERE price > 0 AND qps > 0")
def qp_dollar(spark, sf):
    return B.queries_per_dollar(runs(spark, sf), prices(spark, sf)).select("ord", F.round("qp_dollar", 6).alias("qp_dollar"))


@query(
    "leaderboard_v1",
    f"""WITH {RUNS}, {_PRICES} SELECT ord, runs.db, runs.db_label, db_name, case_name AS "case", round(qps, 6) AS qps, round(serial_latency_p99, 6) AS latency, round(recall, 6) AS recall,
    CAST(CASE label WHEN ':)' THEN 1 WHEN 'x' THEN -1 ELSE -2 END AS BIGINT) AS label, note, version, strftime(greatest(o_orderdate + to_seconds(852076800), TIMESTAMP '2023-08-01'), '%Y-%m') AS test_time,
    round(CASE WHEN coalesce(price, 0) > 0 THEN qps / price * 3600 ELSE 0 END, 4) AS qp_dollar
    FROM runs LEFT JOIN pr ON pr.db = runs.db AND pr.db_label = runs.db_label WHERE task_label LIKE '%standard%' AND case_id NOT IN (1, 2) AND (runs.db <> 'db3' OR timestamp >= 1704067200)""".replace("SELECT ord, ", "SELECT ", 1),
)
def leaderboard_v1(spark, sf):
    board = B.leaderboard_v1(runs(spark, sf), prices(spark, sf), late_db="db3")
    board = board.withColumn("label", F.col("label").cast("bigint"))
    return rnd(rnd(board, "qps", "latency", "recall"), "qp_dollar", digits=4)


@query(
    "leaderboard_v2",
    f"WITH {RUNS} SELECT dataset, db, db_label AS label, concat_ws('-', db, nullif(db_label, '')) AS db_name, round(qps, 4) AS qps, round(serial_latency_p99, 4) AS latency, round(recall, 4) AS recall, round(filter_rate, 3) AS filter_ratio FROM runs WHERE task_label = 'standard_2025' AND case_id <> 200",
)
def leaderboard_v2(spark, sf):
    return B.leaderboard_v2(runs(spark, sf))


@query(
    "leaderboard_streaming",
    f"WITH {RUNS} SELECT dataset, db, db_label AS label, concat_ws('-', db, nullif(db_label, '')) AS db_name, insert_rate, round(o_totalprice / 900, 4) AS streaming_qps, round(o_totalprice / 9e5, 4) AS streaming_latency FROM runs WHERE task_label = 'standard_2025' AND case_id = 200",
)
def leaderboard_streaming(spark, sf):
    return B.leaderboard_streaming(with_lists(runs(spark, sf)))


def _score_sql(value, lower):
    base, worst = ("min", "2 * max(x)") if lower else ("max", "min(x) / 2e0")
    rel = "(base + 10) / (y + 10) * 100" if lower else "y / base * 100"
    return f"""WITH {RUNS}, {MERGED}, val AS (SELECT db_name, case_name, {value} AS x FROM m WHERE {value} > 0),
    c AS (SELECT case_name, {base}(x) AS base, {worst} AS fail FROM val GROUP BY 1), sys AS (SELECT DISTINCT db_name FROM runs),
    grid AS (SELECT sys.db_name, c.case_name, base, coalesce(x, fail) AS y, x IS NOT NULL AS ok FROM sys CROSS JOIN c LEFT JOIN val ON val.db_name = sys.db_name AND val.case_name = c.case_name)
    SELECT db_name, count(CASE WHEN ok THEN 1 END) AS passed, round(exp(avg(ln({rel}))), 6) AS score FROM grid GROUP BY 1"""


def _scored(spark, sf, value, lower):
    r = runs(spark, sf)
    best = G.merged_runs(r).select("db_name", "case_name", value.alias("value"))
    missing = r.select("db_name").distinct().select("db_name", F.lit(None).cast("string").alias("case_name"), F.lit(None).cast("double").alias("value"))
    return B.score(best.unionByName(missing), lower).select("db_name", "passed", F.round("score", 6).alias("score"))


@query("score_qps", _score_sql("qps", False))
def score_qps(spark, sf):
    return _scored(spark, sf, F.col("qps"), False)


@query("score_latency", _score_sql("serial_latency_p99 * 1000", True))
def score_latency(spark, sf):
    return _scored(spark, sf, F.col("serial_latency_p99") * 1000, True)


@query(
    "qps_recall_frontier",
    f"WITH {RUNS} SELECT ord, db_name, round(recall, 6) AS recall, round(qps, 6) AS qps, max(qps) OVER (PARTITION BY db_name ORDER BY recall DESC, ord DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = qps AS on_frontier FROM runs WHERE {NORMAL}",
)
def qps_recall_frontier(spark, sf):
    points = G.unmerged_runs(runs(spark, sf)).select("ord", "db_name", "recall", "qps")
    return rnd(G.qps_recall_frontier(points), "recall", "qps")


@query(
    "explode_concurrency",
    f"""WITH {RUNS}, x AS (SELECT *, unnest([1, 2, 3]) AS i FROM runs WHERE ord % 4 <> 3) SELECT ord, CAST(([1, 10, 80])[i] AS BIGINT) AS conc_num,
    round(([o_totalprice / 1000, o_totalprice / 500, o_totalprice / 400])[i], 8) AS qps, round(coalesce(([o_totalprice / 1e6, o_totalprice / 5e5])[i], 0) * 1000, 8) AS latency_p99,
    round(coalesce(([o_totalprice / 2e6])[i], 0) * 1000, 8) AS latency_p95, round(([o_totalprice / 4e6, o_totalprice / 3e6, o_totalprice / 2e6])[i] * 1000, 8) AS latency_avg FROM x""",
)
def explode_concurrency(spark, sf):
    return rnd(G.explode_concurrency(with_lists(runs(spark, sf)), ["ord"]), "qps", "latency_p99", "latency_p95", "latency_avg", digits=8)


@query(
    "explode_stages",
    f"""WITH {RUNS}, {STAGES} SELECT ord, search_stage, round(search_time, 8) AS search_time, round(st_qps, 8) AS qps, round(st_recall, 8) AS recall, i <> 2 AS has_levels FROM stages""",
)
def explode_stages(spark, sf):
    rows = G.explode_stages(with_lists(runs(spark, sf)), ["ord"]).select("ord", "search_stage", "search_time", "qps", "recall", "has_levels")
    return rnd(rows, "search_time", "qps", "recall", digits=8)


@query(
    "explode_stage_levels",
    f"""WITH {RUNS}, {STAGES}, lv AS (SELECT ord, o_totalprice AS p, search_stage, i, unnest(CASE i WHEN 1 THEN [1, 2] WHEN 2 THEN [0] WHEN 3 THEN [1] ELSE [1, 2] END) AS j FROM stages)
    SELECT ord, search_stage, CASE WHEN i <> 2 THEN CAST(([5, 10])[j] AS BIGINT) END AS conc_num,
    round(CASE i WHEN 1 THEN ([p / 50, p / 40])[j] WHEN 3 THEN ([p / 30])[j] WHEN 4 THEN ([p / 20, p / 10])[j] END, 8) AS qps,
    round(CASE i WHEN 1 THEN ([p / 1e6, p / 2e6])[j] WHEN 3 THEN ([p / 3e6])[j] WHEN 4 THEN ([p / 4e6, p / 5e6])[j] END * 1000, 8) AS latency_p99 FROM lv""",
)
def explode_stage_levels(spark, sf):
    rows = G.explode_stage_levels(with_lists(runs(spark, sf)), ["ord"]).select("ord", "search_stage", "conc_num", "qps", "latency_p99")
    return rnd(rows, "qps", "latency_p99", digits=8)


@query("stage_split", f"WITH {RUNS}, {STAGES} SELECT ord, search_stage, search_stage <= 100 AS normal, ord % 2 <> 0 AND i >= 3 AS final_pair FROM stages")
def stage_split(spark, sf):
    stages = G.explode_stages(with_lists(runs(spark, sf)), ["ord"]).select("ord", "search_stage")
    return G.stage_split(stages, ["ord"])


@query("latest_per_backend", f"WITH {RUNS} SELECT db AS backend_dir, max({_FILE}) AS file FROM runs GROUP BY 1")
def latest_per_backend(spark, sf):
    return G.latest_per_backend(docs(spark, sf)).select("backend_dir", "file")


FTS = f"""ft AS (SELECT ord, CASE WHEN db = 'db0' THEN 'zero' ELSE db END AS backend, (['Small', 'Medium', 'Large'])[ord % 3 + 1] AS dataset_size, (['100K', '1M', '8.8M'])[ord % 3 + 1] AS dataset_doc_count,
CASE WHEN task_label = 'custom' THEN 'result_' || lpad(CAST(ord AS VARCHAR), 12, '0') || '_a' ELSE task_label END AS task_label, load_duration AS load_s, qps, recall FROM runs WHERE db <> 'db5')"""


def fts(spark, sf):
    return G.fts_rows(docs(spark, sf), rename={"db0": "zero"}, drop=("db5",))


@query(
    "fts_rows",
    f"WITH {RUNS}, {FTS} SELECT backend, 'MS MARCO' AS dataset_family, dataset_size, 'MS MARCO ' || dataset_size AS dataset, dataset_doc_count, 'ids_only' AS payload, 'Recorded' AS context, task_label, round(load_s, 6) AS load_s, round(qps, 6) AS qps, round(recall, 6) AS recall FROM ft",
)
def fts_rows(spark, sf):
    rows = fts(spark, sf).select("backend", "dataset_family", "dataset_size", "dataset", "dataset_doc_count", "payload", "context", "task_label", "load_s", "qps", "recall")
    return rnd(rows, "load_s", "qps", "recall")


@query(
    "backend_order",
    f"WITH {RUNS}, {FTS}, s AS (SELECT backend, avg(qps) AS score FROM ft GROUP BY 1), b AS (SELECT backend, score FROM s UNION ALL SELECT 'other', NULL) SELECT row_number() OVER (ORDER BY score DESC NULLS LAST) AS position, backend, round(score, 6) AS score FROM b",
)
def backend_order(spark, sf):
    ordered = G.backend_order(fts(spark, sf).where(F.col("payload") == "ids_only"), "qps", False, ["other", "zero", "db1", "db2", "db3", "db4"])
    return ordered.select(F.col("position").cast("bigint").alias("position"), "backend", F.round("score", 6).alias("score"))


@query("explode_concurrency_strict", f"WITH {RUNS}, x AS (SELECT *, unnest([1, 2, 3]) AS i FROM runs WHERE ord % 4 <> 3 AND db <> 'db5') SELECT CASE WHEN db = 'db0' THEN 'zero' ELSE db END AS backend, CAST(([1, 10, 80])[i] AS BIGINT) AS concurrency, count(*) AS n, round(avg(([o_totalprice / 1000, o_totalprice / 500, o_totalprice / 400])[i]), 4) AS qps FROM x GROUP BY 1, 2")
def explode_concurrency_strict(spark, sf):
    rows = G.explode_concurrency_strict(fts(spark, sf), ["backend"])
    return rows.groupBy("backend", "concurrency").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("qps"), 4).alias("qps"))


@query("filter_curves", f"WITH {RUNS}, {MERGED} SELECT dataset, db_name, round(filter_rate, 6) AS filter_rate, round(qps, 6) AS qps, round(recall, 6) AS recall FROM m WHERE filter_type = 'NumGE'")
def filter_curves(spark, sf):
    return rnd(G.filter_curves(G.merged_runs(runs(spark, sf)), "NumGE"), "filter_rate", "qps", "recall")


@query(
    "api_rows",
    f"""WITH {RUNS} SELECT CAST(floor(timestamp) AS BIGINT) AS timestamp, db, db_label, version, note, CAST(CASE WHEN ord % 16 IN (7, 15) THEN 0 WHEN case_id IN (4, 5) THEN 768 WHEN case_id IN (10, 11) THEN 1536 ELSE 0 END AS BIGINT) AS dim, CAST(100 AS BIGINT) AS k, CAST(max_load_count AS BIGINT) AS max_load_count, round(qps, 6) AS qps,
    CASE WHEN ord % 4 = 3 THEN NULL ELSE round(o_totalprice / 1000, 6) END AS first_qps FROM runs WHERE task_label = 'standard_2025' AND case_id <> 1""",
)
def api_rows(spark, sf):
    flat = G.flatten_results(R.case_rows(docs(spark, sf)), normal_only=False)
    rows = G.api_rows(flat, "standard_2025")
    return rows.select("timestamp", "db", "db_label", "version", "note", "dim", "k", "max_load_count", F.round("qps", 6).alias("qps"), F.get("conc_qps_list", F.lit(0)).alias("first_qps"))


@query("summary_table", f"WITH {RUNS} SELECT db, db_label, case_name, round(load_duration, 6) AS load_duration, round(qps, 6) AS qps, round(serial_latency_p99, 6) AS serial_latency_p99, round(recall, 6) AS recall, round(max_load_count, 6) AS max_load_count, label FROM runs WHERE db NOT IN ('db1', 'db2')")
def summary_table(spark, sf):
    return rnd(G.summary_table(runs(spark, sf), ["db1", "db2"]), "load_duration", "qps", "serial_latency_p99", "recall", "max_load_count")


_CARRY = """x AS (SELECT run_id, ord, CASE WHEN ord % 7 = 0 THEN NULL ELSE db END AS key, ord % 3 = 0 AS loads, CASE WHEN ord % 9 = 0 THEN NULL ELSE load_duration END AS dur FROM runs),
y AS (SELECT *, max(CASE WHEN loads AND key IS NOT NULL THEN ord END) OVER (PARTITION BY run_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS at FROM x)"""


@query(
    "carry_load_duration",
    f"WITH {RUNS}, {_CARRY} SELECT y.ord, round(CASE WHEN NOT y.loads AND y.key = l.key THEN coalesce(l.dur, 0) ELSE y.dur END, 6) AS load_duration FROM y LEFT JOIN x l ON l.ord = y.at",
)
def carry_load_duration(spark, sf):
    cases = runs(spark, sf).select(
        "run_id", F.col("ord").alias("idx"), "ord", F.when(F.col("ord") % 7 != 0, F.col("db")).alias("reuse_key"), (F.col("ord") % 3 == 0).alias("loads"),
        F.when(F.col("ord") % 9 != 0, F.col("load_duration")).alias("load_duration"),
    )
    return G.carry_load_duration(cases, chunk=500).select("ord", F.round("load_duration", 6).alias("load_duration"))


@query("filters_by_type", f"WITH {RUNS} SELECT ord, db_name, case_name FROM runs WHERE filter_type = 'Label' UNION ALL SELECT ord, db_name, case_name FROM runs WHERE case_id = 200 AND ord % 4 <> 3")
def filters_by_type(spark, sf):
    rows = with_lists(runs(spark, sf))
    live = G.concurrency_only(G.streaming_only(rows))
    return G.filters_by_type(rows, "Label").select("ord", "db_name", "case_name").unionByName(live.select("ord", "db_name", "case_name"))
