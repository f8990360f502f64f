"""Report tables over case results: best runs, failures, rankings, curves, stage and level rows.

A *run row* is flat: ``ord`` (file order), ``db, db_label, version, db_name, case_name,
dataset, filter_type, filter_rate, label`` and the metric columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.functions.labels import db_name
from nearfield.sizing import broadcast_if_small
from nearfield.sources.results import FAILED, NORMAL, TIMEOUT

# Metrics where less is better, the order of report metrics, and the smallest value shown.
LOWER_IS_BETTER = ("load_duration", "serial_latency_p99", "serial_latency_p95")
METRIC_ORDER = ("qps", "recall", "load_duration", "serial_latency_p99", "serial_latency_p95", "max_load_count")
SHOWN_ABOVE = 1e-7

# Case id, name, dataset, filter kind, removed share, kind of case. A name may take settings of the case.
CASES = [
    (1, "Capacity Test (128 Dim Repeated)", "SIFT", "NonFilter", 0.0, "load"),
    (2, "Capacity Test (960 Dim Repeated)", "GIST", "NonFilter", 0.0, "load"),
    (3, "Search Performance Test (100M Dataset, 768 Dim)", "LAION", "NonFilter", 0.0, "performance"),
    (4, "Search Performance Test (10M Dataset, 768 Dim)", "Cohere", "NonFilter", 0.0, "performance"),
    (5, "Search Performance Test (1M Dataset, 768 Dim)", "Cohere", "NonFilter", 0.0, "performance"),
    (10, "Search Performance Test (500K Dataset, 1536 Dim)", "OpenAI", "NonFilter", 0.0, "performance"),
    (11, "Search Performance Test (5M Dataset, 1536 Dim)", "OpenAI", "NonFilter", 0.0, "performance"),
    (17, "Search Performance Test (1M Dataset, 1024 Dim)", "Bioasq", "NonFilter", 0.0, "performance"),
    (20, "Search Performance Test (10M Dataset, 1024 Dim)", "Bioasq", "NonFilter", 0.0, "performance"),
    (50, "Search Performance Test (50K Dataset, 1536 Dim)", "OpenAI", "NonFilter", 0.0, "performance"),
    (100, "Custom", None, "NonFilter", 0.0, "performance"),
    (101, "Performance With Custom Dataset", None, "NonFilter", 0.0, "performance"),
    (200, "Streaming-Perf - {dataset}, {insert_rate} rows/s", None, "NonFilter", 0.0, "streaming"),
    (201, "Streaming-Perf - Custom - {name}, {insert_rate} rows/s", None, "NonFilter", 0.0, "streaming"),
    (300, "Label-Filter-{kept}% - {dataset}", None, "Label", None, "performance"),
    (400, "Int-Filter-{removed}% - {dataset}", None, "NumGE", None, "performance"),
    (500, "Cloud Payload Search - {payload_profile} - {dataset}", "LAION 100M (768dim)", "NonFilter", 0.0, "performance"),
    (503, "FTS BM25 Performance - {dataset}", None, "NonFilter", 0.0, "full_text"),
    (600, "Cloud Insert - batch {batch_size}", "LAION 100M (768dim)", "NonFilter", 0.0, "insert"),
    (700, "Cloud Cold Latency - {payload_profile} - {dataset}", "LAION 100M (768dim)", "NonFilter", 0.0, "performance"),
    (800, "Cloud Multi-Tenant Search - {dataset}, {tenant_count} tenants", None, "NonFilter", 0.0, "performance"),
]
# Settings that a name takes where the case does not give them.
CASE_SETTINGS = {"insert_rate": "500", "payload_profile": "ids_only", "tenant_count": "1000", "name": "", "batch_size": ""}
_CASES_DDL = "case_id BIGINT, case_name STRING, case_dataset STRING, filter_type STRING, case_rate DOUBLE, case_kind STRING"


def flatten_results(rows: DataFrame, cases: DataFrame | None = None, normal_only: bool = True) -> DataFrame:
    """Case rows as run rows with every metric as a column.

    Names come from ``cases`` (``case_id, case_name, case_dataset, filter_type, case_rate,
    case_kind``); a custom case brings its own dataset and rate.
    """
    catalogue = cases if cases is not None else rows.sparkSession.createDataFrame(CASES, _CASES_DDL)
    c, case = F.col("task_config"), F.col("task_config.case_config")
    custom = case["custom_case"]
    flat = rows.where(F.col("label") == NORMAL) if normal_only else rows
    flat = flat.select(
        "file",
        "pos",
        "run_id",
        "task_label",
        "timestamp",
        c["db"].alias("db"),
        F.coalesce(c["db_config"]["db_label"], F.lit("")).alias("db_label"),
        F.coalesce(c["db_config"]["version"], F.lit("")).alias("version"),
        F.coalesce(c["db_config"]["note"], F.lit("")).alias("note"),
        c["db_case_config"].alias("params"),
        F.coalesce(case["k"], F.lit(100)).alias("k"),
        case["case_id"].alias("case_id"),
        custom.alias("custom_case"),
        "label",
        "metrics.*",
    )
    named = flat.join(broadcast_if_small(catalogue), "case_id", "left")
    share = F.lit(1.0) - F.col("custom_case")["label_percentage"].cast("double")
    return (
        named.withColumn("db_name", db_name(F.col("db"), F.col("db_label"), F.col("version")))
        .withColumn("dataset", F.coalesce(F.col("custom_case")["dataset_with_size_type"], "case_dataset"))
        .withColumn("filter_rate", F.coalesce(F.col("custom_case")["filter_rate"].cast("double"), share, "case_rate", F.lit(0.0)))
        .withColumn("case_name", _full_name())
        .withColumn("dim", dimensions(F.coalesce("dataset", F.lit("")), F.coalesce("case_name", F.lit(""))))
        .drop("case_dataset", "case_rate")
    )


def _full_name() -> Column:
    """The name of a case with its dataset, rate and other settings filled in."""
    rate = F.col("filter_rate")
    settings = {"dataset": F.coalesce("dataset", F.lit("")), "removed": F.format_string("%.1f", rate * 100), "kept": F.format_string("%.1f", (F.lit(1.0) - rate) * 100)}
    settings |= {key: F.coalesce(F.col("custom_case")[key], F.lit(usual)) for key, usual in CASE_SETTINGS.items()}
    name = F.col("case_name")
    for key, value in settings.items():
        name = F.replace(name, F.lit("{" + key + "}"), value)
    return name


def dimensions(dataset: Column, case_name: Column) -> Column:
    """The number of dimensions that the name of a dataset, or else of a case, speaks of; 0 if neither does."""
    found = [F.nullif(F.regexp_extract(F.lower(text), r"([0-9]+) ?dim", 1), F.lit("")) for text in (dataset, case_name)]
    return F.coalesce(*found, F.lit("0")).cast("bigint")


def group_results(runs: DataFrame, group_by: str = "run_id") -> DataFrame:
    """Give each run document its group and the run id, label and time of the group's first file.

    Groups are the run id, or the db of the first result (the run id if there is none).
    Results stay separate rows, so a large group is never one value.
    """
    if group_by not in ("run_id", "db"):
        raise ValueError(f"unsupported grouping: {group_by}")
    first_db = F.get("results", F.lit(0))["task_config"]["db"]
    key = F.col("run_id") if group_by == "run_id" else F.coalesce(first_db, F.col("run_id"))
    keyed = runs.withColumn("group_key", key)
    heads = keyed.groupBy("group_key").agg(
        F.min_by(F.struct("run_id", F.coalesce("task_label", "run_id").alias("task_label"), "timestamp"), "file").alias("head")
    )
    return keyed.drop("run_id", "task_label", "timestamp").join(broadcast_if_small(heads), "group_key").select(
        "group_key", "head.run_id", "head.task_label", "head.timestamp", "file", "results"
    )


def merge_by_db(runs: DataFrame, task_label: str = "fts_standard") -> DataFrame:
    """Documents of one db under the new run id ``<label>_<db>``; empty groups are left out."""
    grouped = group_results(runs, "db")
    kept = grouped.where(F.size("results") > 0)
    return kept.select(
        "file",
        F.concat(F.lit(f"{task_label}_"), F.lower("group_key")).alias("run_id"),
        F.lit(task_label).alias("task_label"),
        "timestamp",
        "results",
        F.col("group_key").alias("db"),
    )


def merge_listing(runs: DataFrame, task_label: str = "fts_standard") -> DataFrame:
    """What a merge would write: ``db, run_id, cases``."""
    return merge_by_db(runs, task_label).groupBy("db", "run_id").agg(F.sum(F.size("results")).cast("bigint").alias("cases"))


def filter_tasks(runs: DataFrame, dbs: DataFrame | list[str], cases: DataFrame | list[str]) -> DataFrame:
    """Runs of the chosen systems and cases; choices are lists or one-column tables."""
    out = runs
    for column, chosen in (("db_name", dbs), ("case_name", cases)):
        if isinstance(chosen, DataFrame):
            out = out.join(broadcast_if_small(chosen.select(column).distinct()), column, "left_semi")
        else:
            out = out.where(F.col(column).isin(list(chosen)))
    return out


def best_run(runs: DataFrame) -> DataFrame:
    """The whole row with the highest qps of each system and case; the later one on ties.

    A plain aggregate: rows are reduced inside each task, however many a group has.
    """
    key = F.struct(F.coalesce("qps", F.lit(0.0)), F.col("ord"))
    return runs.groupBy("db_name", "case_name").agg(
        F.max_by(F.struct(*[c for c in runs.columns if c not in ("db_name", "case_name")]), key).alias("best")
    ).select("db_name", "case_name", "best.*")


def label_merge(runs: DataFrame) -> DataFrame:
    """Normal if any run is normal, else the label of the last run."""
    return runs.groupBy("db_name", "case_name").agg(
        F.when(F.bool_or(F.col("label") == NORMAL), F.lit(NORMAL)).otherwise(F.max_by("label", "ord")).alias("label")
    )


def merged_runs(runs: DataFrame) -> DataFrame:
    """Best run of every system and case whose merged label is normal."""
    labels = label_merge(runs).where(F.col("label") == NORMAL).select("db_name", "case_name")
    return best_run(runs).drop("label").join(labels, ["db_name", "case_name"])


def failed_tasks(runs: DataFrame) -> DataFrame:
    """Systems and cases without a normal run: ``case_name, db_name, label, kind``."""
    kind = F.when(F.col("label") == FAILED, F.lit("failed")).when(F.col("label") == TIMEOUT, F.lit("timeout"))
    return label_merge(runs).where(F.col("label") != NORMAL).select("case_name", "db_name", "label", kind.alias("kind"))


def failed_matrix(runs: DataFrame, dbs: list[str]) -> DataFrame:
    """Case by system matrix of the labels in ``failed_tasks``; other cells are null."""
    return failed_tasks(runs).groupBy("case_name").pivot("db_name", dbs).agg(F.first("label"))


def unmerged_runs(runs: DataFrame) -> DataFrame:
    """Every normal run, for curves."""
    return runs.where(F.col("label") == NORMAL)


def better_metric(runs: DataFrame, by: list[str], metrics: tuple[str, ...]) -> DataFrame:
    """Best value of each metric over the runs, ignoring values below 1e-7 (the last value if all are)."""
    out = []
    for name in metrics:
        real = F.when(F.col(name) >= SHOWN_ABOVE, F.col(name))
        best = F.min(real) if name in LOWER_IS_BETTER else F.max(real)
        out.append(F.coalesce(best, F.max_by(name, "ord")).alias(name))
    return runs.groupBy(*by).agg(*out)


def metric_rank(merged: DataFrame, metrics: tuple[str, ...] = METRIC_ORDER) -> DataFrame:
    """Rank of each system per case and metric: ``case_name, metric, db_name, value, rank``.

    Values up to 1e-7 are left out; less is better where listed.
    """
    long = merged.unpivot(["case_name", "db_name"], [c for c in metrics if c in merged.columns], "metric", "value").where(
        F.col("value") > SHOWN_ABOVE
    )
    signed = F.when(F.col("metric").isin(*LOWER_IS_BETTER), F.col("value")).otherwise(-F.col("value"))
    order = Window.partitionBy("case_name", "metric").orderBy("signed")
    return long.withColumn("signed", signed).withColumn("rank", F.rank().over(order)).drop("signed")


def qps_recall_frontier(points: DataFrame, by: str = "db_name") -> DataFrame:
    """Adds ``on_frontier``: no later point in (recall, ord) order has a higher qps.

    The best qps at every higher recall is found over the distinct recalls of a group, so
    only points that could be on the frontier are compared one by one.
    """
    levels = points.groupBy(by, "recall").agg(F.max("qps").alias("top"))
    above = Window.partitionBy(by).orderBy(F.col("recall").desc()).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.withColumn("higher", F.max("top").over(above)).drop("top")
    beaten = F.col("higher").isNotNull() & (F.col("higher") > F.col("qps"))
    # Beaten points need no order, so they are spread instead of following their recall.
    place = F.when(F.col("beaten"), F.pmod(F.xxhash64("ord"), F.lit(255)) + 1).otherwise(F.lit(0))
    joined = points.join(levels, [by, "recall"]).withColumn("beaten", beaten).withColumn("place", place)
    later = Window.partitionBy(by, "recall", "place").orderBy(F.col("ord").desc()).rowsBetween(Window.unboundedPreceding, 0)
    on_frontier = ~F.col("beaten") & (F.max("qps").over(later) == F.col("qps"))
    return joined.withColumn("on_frontier", on_frontier).drop("higher", "beaten", "place")


def _at(array: str, i: Column, scale: float = 1.0) -> Column:
    return F.coalesce(F.get(F.col(array), i) * F.lit(scale), F.lit(0.0))


def explode_concurrency(runs: DataFrame, keep: list[str]) -> DataFrame:
    """One row per concurrency level; latencies in ms, 0 where a list is shorter."""
    levels = runs.select("*", F.posexplode("conc_num_list").alias("i", "conc_num"))
    i = F.col("i")
    return levels.select(
        *keep,
        "conc_num",
        _at("conc_qps_list", i).alias("qps"),
        _at("conc_latency_p99_list", i, 1000.0).alias("latency_p99"),
        _at("conc_latency_p95_list", i, 1000.0).alias("latency_p95"),
        _at("conc_latency_avg_list", i, 1000.0).alias("latency_avg"),
    )


def explode_concurrency_strict(runs: DataFrame, keep: list[str], levels: str = "concurrency", qps: str = "concurrent_qps") -> DataFrame:
    """Level and qps pairs; lists of different length are an error."""
    same = F.size(levels) == F.size(qps)
    pairs = F.when(same, F.arrays_zip(F.col(levels).alias("concurrency"), F.col(qps).alias("qps"))).otherwise(
        F.raise_error(F.lit("concurrency and qps lists differ in length"))
    )
    return runs.select(*keep, F.inline(pairs).alias("concurrency", "qps"))


def explode_stages(runs: DataFrame, keep: list[str]) -> DataFrame:
    """One row per search stage with recall and nDCG adjusted to the loaded share.

    ``adjusted = value / min(stage, 100) * 100`` to 4 decimals; latencies in ms to 2
    decimals; a missing p95 is 0. ``has_levels`` tells whether concurrent tests ran.
    """
    rows = runs.select("*", F.posexplode("st_search_stage_list").alias("i", "search_stage"))
    i, loaded = F.col("i"), F.least("search_stage", F.lit(100))

    def value(name: str) -> Column:
        return F.get(F.col(name), i)

    return rows.select(
        *keep,
        "search_stage",
        value("st_search_time_list").alias("search_time"),
        value("st_max_qps_list_list").alias("qps"),
        value("st_recall_list").alias("recall"),
        value("st_ndcg_list").alias("ndcg"),
        F.round(value("st_recall_list") / loaded * 100, 4).alias("adjusted_recall"),
        F.round(value("st_ndcg_list") / loaded * 100, 4).alias("adjusted_ndcg"),
        F.round(value("st_serial_latency_p99_list") * 1000, 2).alias("latency_p99"),
        F.round(F.coalesce(value("st_serial_latency_p95_list"), F.lit(0.0)) * 1000, 2).alias("latency_p95"),
        (F.coalesce(F.size(value("st_conc_qps_list_list")), F.lit(0)) > 0).alias("has_levels"),
    )


def explode_stage_levels(runs: DataFrame, keep: list[str]) -> DataFrame:
    """One row per stage and concurrency level; a stage without levels keeps one row of nulls."""
    lists = ["num", "qps", "latency_p99", "latency_p95", "latency_avg"]
    stages = runs.select("*", F.posexplode("st_search_stage_list").alias("i", "search_stage")).select(
        *keep, "search_stage", *[F.get(F.col(f"st_conc_{n}_list_list"), F.col("i")).alias(f"_{n}") for n in lists]
    )
    rows = stages.select("*", F.posexplode_outer("_num").alias("j", "conc_num"))
    return rows.select(
        *keep,
        "search_stage",
        "conc_num",
        F.get("_qps", F.col("j")).alias("qps"),
        *[(F.get(f"_{n}", F.col("j")) * 1000).alias(n) for n in lists[2:]],
    )


def stage_split(stages: DataFrame, by: list[str]) -> DataFrame:
    """Marks each stage ``normal`` (up to 100) and ``final_pair`` (the last two, if the last is past 100).

    The two highest stages are taken from a bounded aggregate, not a sort of the group.
    """
    ends = stages.groupBy(*by).agg(F.max("search_stage").alias("last"), F.count(F.lit(1)).alias("n"))
    joined = stages.join(broadcast_if_small(ends), by)
    second = (
        joined.where(F.col("search_stage") < F.col("last")).groupBy(*by).agg(F.max("search_stage").alias("second"))
    )
    marked = joined.join(broadcast_if_small(second), by, "left")
    optimized = (F.col("last") > 100) & (F.col("n") >= 2)
    pair = optimized & ((F.col("search_stage") == F.col("last")) | (F.col("search_stage") == F.coalesce("second", "last")))
    return marked.select(*stages.columns, (F.col("search_stage") <= 100).alias("normal"), pair.alias("final_pair"))


def latest_per_backend(runs: DataFrame) -> DataFrame:
    """Documents of the last result file (by name) in each backend folder."""
    folder = F.element_at(F.split("file", "/"), -2)
    placed = runs.withColumn("backend_dir", folder)
    last = placed.groupBy("backend_dir").agg(F.max("file").alias("file"))
    return placed.join(broadcast_if_small(last), ["backend_dir", "file"], "left_semi")


# Text collection families and sizes, in report order.
FAMILIES = ("MS MARCO", "HotpotQA")
SIZES = ("Small", "Medium", "Large")


def dataset_parts(label: Column) -> tuple[Column, Column, Column, Column]:
    """Family, size, ``family size`` and document count of a dataset label such as ``MS MARCO Small (100K)``."""
    family = F.split(label, " ")[0]
    for name in reversed(FAMILIES):
        family = F.when(label.startswith(name), F.lit(name)).otherwise(family)
    size = F.lit("")
    for name in reversed(SIZES):
        size = F.when(label.contains(name), F.lit(name)).otherwise(size)
    return family, size, F.trim(F.concat_ws(" ", family, size)), F.regexp_extract(label, r"\(([^)]+)\)", 1)


def fts_rows(runs: DataFrame, rename: dict[str, str] | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """Full-text report rows of the given documents (usually ``latest_per_backend``).

    Backends are renamed and dropped as told; a document without a db name takes the name
    of its folder.
    """
    flat = runs.select("file", "task_label", F.explode("results").alias("r"))
    c, m = F.col("r.task_config"), F.col("r.metrics")
    custom = c["case_config"]["custom_case"]
    label = F.coalesce(custom["dataset_with_size_type"], F.lit(""))
    family, size, name, count = dataset_parts(label)
    backend = F.coalesce(F.nullif(c["db"], F.lit("")), F.element_at(F.split("file", "/"), -2))
    for old, new in (rename or {}).items():
        backend = F.when(backend == old, F.lit(new)).otherwise(backend)
    stem = F.regexp_extract("file", r"([^/]+?)(?:\.json)?$", 1)
    task = F.coalesce(F.nullif("task_label", F.lit("")), stem)
    empty = F.lit("")
    out = flat.select(
        backend.alias("backend"),
        family.alias("dataset_family"),
        size.alias("dataset_size"),
        name.alias("dataset"),
        count.alias("dataset_doc_count"),
        F.coalesce(F.nullif(m["payload_profile"], empty), F.nullif(custom["payload_profile"], empty), F.lit("ids_only")).alias("payload"),
        F.when(task.contains("mathgt"), F.lit("Math GT")).otherwise(F.lit("Recorded")).alias("context"),
        task.alias("task_label"),
        F.coalesce(m["load_duration"], F.lit(0.0)).alias("load_s"),
        F.coalesce(m["qps"], F.lit(0.0)).alias("qps"),
        F.coalesce(m["recall"], F.lit(0.0)).alias("recall"),
        F.coalesce(m["serial_latency_p95"], F.lit(0.0)).alias("p95_s"),
        F.coalesce(m["serial_latency_p99"], F.lit(0.0)).alias("p99_s"),
        m["conc_num_list"].alias("concurrency"),
        m["conc_qps_list"].alias("concurrent_qps"),
    )
    return out.where(~F.col("backend").isin(*drop)) if drop else out


def custom_order(value: Column, names: tuple[str, ...] | list[str]) -> Column:
    """Sort key following a list; other values come last."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]), value)
    return F.when(place > 0, place).otherwise(F.lit(len(names) + 1))


def backend_order(rows: DataFrame, metric: str, ascending: bool, backends: list[str]) -> DataFrame:
    """``position, backend, score``: backends by mean metric, those without values last in list order."""
    means = rows.where(F.col(metric).isNotNull()).groupBy("backend").agg(F.avg(metric).alias("score"))
    listed = rows.sparkSession.createDataFrame([(i, b) for i, b in enumerate(backends)], "listed INT, backend STRING")
    both = means.join(listed, "backend", "full_outer")
    score = F.col("score").asc_nulls_last() if ascending else F.col("score").desc_nulls_last()
    # One row per backend: a handful.
    order = Window.orderBy(score, F.col("listed").asc_nulls_last(), "backend")
    return both.select(F.row_number().over(order).alias("position"), "backend", "score")


def filter_curves(merged: DataFrame, filter_type: str) -> DataFrame:
    """Points of the qps and recall curves over the filter rate, ordered for drawing."""
    return (
        merged.where(F.col("filter_type") == filter_type)
        .select("dataset", "db_name", "filter_rate", "qps", "recall")
        .orderBy("dataset", "db_name", "filter_rate")
    )


def api_rows(flat: DataFrame, task_label: str) -> DataFrame:
    """Flat records of one task label; load cases are left out and list values cut to 6 decimals."""
    lists = ("conc_qps_list", "conc_latency_p99_list", "conc_latency_p95_list", "conc_latency_avg_list")

    def rounded(name: str) -> Column:
        return F.transform(F.coalesce(name, F.expr("cast(array() as array<double>)")), lambda x: F.round(x, 6)).alias(name)

    return flat.where((F.col("task_label") == task_label) & (F.coalesce("case_kind", F.lit("")) != "load")).select(
        "task_label",
        F.col("timestamp").cast("bigint").alias("timestamp"),
        "db",
        "db_label",
        "version",
        "note",
        "params",
        "case_name",
        "dataset",
        "filter_type",
        "filter_rate",
        "dim",
        "k",
        F.coalesce("max_load_count", F.lit(0.0)).cast("bigint").alias("max_load_count"),
        *[F.coalesce(n, F.lit(0.0)).alias(n) for n in ("load_duration", "qps", "serial_latency_p99", "serial_latency_p95", "recall", "ndcg")],
        F.coalesce("conc_num_list", F.expr("cast(array() as array<bigint>)")).alias("conc_num_list"),
        *[rounded(n) for n in lists],
    )


def summary_table(runs: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """Result summary, last names first, *without* the listed dbs."""
    rows = runs.where(~F.col("db").isin(*excluded)) if excluded else runs
    return rows.select("db", "db_label", "case_name", "load_duration", "qps", "serial_latency_p99", "recall", "max_load_count", "label").orderBy(
        F.col("db").desc(), F.col("db_label").desc(), F.col("case_name").desc()
    )


def carry_load_duration(cases: DataFrame, run: str = "run_id", idx: str = "idx", chunk: int = 100_000) -> DataFrame:
    """Give cases that reuse the latest load its duration.

    ``cases`` has ``reuse_key`` (null if never reused), ``loads`` and ``load_duration``. A
    case that does not load and whose key is that of the latest load takes that load's
    duration, 0 if none was stored; any other keeps its own. The latest load is carried over
    chunks of ``idx``, so one long run is sorted in several tasks.
    """
    load = F.when(F.col("loads") & F.col("reuse_key").isNotNull(), F.struct(F.col("reuse_key").alias("key"), F.col("load_duration").alias("dur")))
    marked = cases.withColumn("_load", load).withColumn("_chunk", F.floor(F.col(idx) / F.lit(chunk)))
    ends = marked.groupBy(run, "_chunk").agg(F.max_by("_load", F.when(F.col("_load").isNotNull(), F.col(idx))).alias("_end"))
    before = Window.partitionBy(run).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    inside = Window.partitionBy(run, "_chunk").orderBy(idx).rowsBetween(Window.unboundedPreceding, -1)
    joined = marked.withColumn("_prev", F.last("_load", ignorenulls=True).over(inside)).join(ends, [run, "_chunk"])
    latest = F.coalesce("_prev", "_carried")
    reused = ~F.col("loads") & F.col("reuse_key").isNotNull() & (latest["key"] == F.col("reuse_key"))
    carried = F.when(reused, F.coalesce(latest["dur"], F.lit(0.0))).otherwise(F.col("load_duration"))
    return joined.withColumn("load_duration", carried).select(*cases.columns)


def filters_by_type(runs: DataFrame, filter_type: str) -> DataFrame:
    """Runs whose case has the given filter kind."""
    return runs.where(F.col("filter_type") == filter_type)


def streaming_only(runs: DataFrame) -> DataFrame:
    """Runs with search stages."""
    return runs.where(F.size("st_search_stage_list") > 0)


def concurrency_only(runs: DataFrame) -> DataFrame:
    """Runs with concurrency levels."""
    return runs.where(F.size("conc_num_list") > 0)
