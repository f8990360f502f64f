import json

import pytest
from pyspark.sql import functions as F

from nearfield.plans import report as G
from nearfield.session import checkpoint_root, work_dir
from nearfield.sizing import broadcast_bounded, is_small, settle
from nearfield.sources import results as R
from nearfield.sources import tables as S


def result(db, case_id, qps, label=":)", custom=None, **metrics):
    return {
        "metrics": {"qps": qps, "serial_latency_p99": 0.05, **metrics},
        "task_config": {
            "db": db,
            "db_config": {"db_label": "2c8g", "version": "v1", "password": "pw", "Token": ""},
            "db_case_config": {"index": "FLAT", "search_list": 100},
            "case_config": {"case_id": case_id, "custom_case": custom, "k": 100},
        },
        "label": label,
    }


@pytest.fixture()
def tree(tmp_path):
    def put(folder, name, document):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(json.dumps(document, indent=2))

    put("A", "result_20240101_x_a.json", {"run_id": "r1", "results": [result("A", 5, 10.0), result("A", 7, 20.0, custom={})]})
    put("A", "result_20240201_x_a.json", {"run_id": "r2", "task_label": "t", "timestamp": 5.0, "results": [result("A", 1, 0.0, max_load_count=5000, serial_latency_p95=0.04)]})
    put("B", "result_20240101_x_b.json", {"run_id": "r1", "task_label": "u", "results": [result("B", 700, 0.0, "x", cold_latency={"a": 1}, insert_duration=3.0, recall=0.5)]})
    put("B", "notes.json", {"run_id": "no"})
    return str(tmp_path)


def test_read_units_and_legacy_cases(spark, tree):
    rows = R.map_legacy_cases(R.case_rows(R.read_runs(spark, tree), trans_unit=True))
    got = {(r.run_id, r.task_config.db, r.task_config.case_config.case_id): r for r in rows.collect()}
    assert len(got) == 4
    legacy = got[("r1", "A", 400)]
    assert legacy.task_label == "r1" and legacy.task_config.case_config.custom_case == {"filter_rate": "0.01", "dataset_with_size_type": "Medium Cohere (768dim, 1M)"}
    load = got[("r2", "A", 1)]
    assert (load.metrics.max_load_count, load.metrics.serial_latency_p99, load.metrics.serial_latency_p95) == (5.0, 50.0, 40.0)
    assert legacy.metrics.serial_latency_p95 == 0.0 and legacy.task_config.db_case_config["search_list"] == "100"


def test_grouping_and_merging(spark, tree):
    runs = R.read_runs(spark, tree)
    by_run = {r.group_key: r for r in G.group_results(runs).groupBy("group_key", "task_label").agg(F.sum(F.size("results")).alias("n")).collect()}
    assert {k: (r.task_label, r.n) for k, r in by_run.items()} == {"r1": ("r1", 3), "r2": ("t", 1)}
    assert sorted((r.db, r.run_id, r.cases) for r in G.merge_listing(runs, "fts").collect()) == [("A", "fts_a", 3), ("B", "fts_b", 1)]
    assert sorted(r.file.rsplit("/", 1)[1] for r in G.latest_per_backend(runs).collect()) == ["result_20240101_x_b.json", "result_20240201_x_a.json"]
    with pytest.raises(ValueError):
        G.group_results(runs, "case")


def test_written_documents_are_masked_subsets(spark, tree, tmp_path):
    out = str(tmp_path / "out")
    R.write_runs(R.case_rows(R.read_runs(spark, tree)), out)
    docs = [json.loads(r.value) for r in spark.read.text(out, recursiveFileLookup=True).collect()]
    assert len(docs) == 4
    cold = next(d for d in docs if d["results"][0]["task_config"]["db"] == "B")["results"][0]
    assert "qps" not in cold["metrics"] and "recall" not in cold["metrics"] and cold["metrics"]["insert_duration"] == 3.0
    assert cold["task_config"]["db_config"]["password"] == R.MASK and cold["task_config"]["db_config"]["Token"] == ""
    assert "k" not in cold["task_config"]["case_config"]
    assert R.case_rows(R.read_written_runs(spark, out)).count() == 4


def test_flatten_and_api_rows(spark, tree):
    flat = G.flatten_results(R.map_legacy_cases(R.case_rows(R.read_runs(spark, tree))), normal_only=False)
    names = {(r.run_id, r.case_id): (r.db_name, r.case_name, r.filter_rate) for r in flat.where("db = 'A'").collect()}
    assert names[("r1", 400)] == ("A-2c8g-v1", "Int-Filter-1.0% - " + next(d for n, _, d in R.LEGACY_CASES if n == 7), 0.01)
    assert names[("r2", 1)][1] == "Capacity Test (128 Dim Repeated)"
    assert [r.qps for r in G.api_rows(flat, "r1").orderBy("qps").collect()] == [10.0, 20.0]
    assert G.api_rows(flat, "t").count() == 0  # a load case


def test_prices(spark):
    texts = spark.createDataFrame([('{"A": {}, "B": {"x": 0.5, "y": 2}}',)], "json STRING")
    assert sorted(tuple(r) for r in R.scan_prices(texts).collect()) == [("B", "x", 0.5), ("B", "y", 2.0)]


def test_dense_ids(spark):
    rows = spark.createDataFrame([(i * 7 % 1009 - 500, i % 4) for i in range(1009)], "doc_id BIGINT, kind INT").repartition(5)
    good = F.col("kind") != 2
    want = [r.doc_id for r in rows.where(good).orderBy("doc_id").collect()]
    for size in (None, 100, 5000):
        got = S.dense_row_ids(rows, "doc_id", size, good, bucket_rows=50).orderBy("row_id").collect()
        assert [(r.row_id, r.doc_id) for r in got] == list(enumerate(want[:size]))
    assert S.dense_row_ids(rows.where("false"), "doc_id").count() == 0


def test_stored_vectors_are_unique(spark, tmp_path):
    v = spark.createDataFrame([(i % 50, [float(i % 50)], "t0" if i % 3 else "t1") for i in range(100)], "id BIGINT, emb ARRAY<FLOAT>, tenant STRING")
    assert S.write_vectors(v, str(tmp_path / "v"), partition_by="tenant") == 50
    assert spark.read.parquet(str(tmp_path / "v")).select("id").distinct().count() == 50


def test_unequal_rows_of_an_id_leave_the_least(spark):
    rows = [(1, [2.0], None), (1, [1.0], "b"), (1, [1.0], "a"), (2, None, "c"), (2, [0.0], "d"), (None, [5.0], "e")]
    for parts in (1, 4):
        v = spark.createDataFrame(rows, "id BIGINT, emb ARRAY<FLOAT>, tenant STRING").repartition(parts)
        got = S.unique_rows(v)
        assert got.columns == v.columns
        assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, [1.0], "a"), (2, None, "c"), (None, [5.0], "e")], key=str)
    assert S.unique_rows(spark.createDataFrame([(1,), (1,)], "id BIGINT")).count() == 1


def test_stored_tenants_are_pruned(spark, tmp_path):
    v = spark.range(4000).select("id", F.array(F.col("id").cast("float")).alias("emb"), F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 10)).alias("tenant"))
    path = str(tmp_path / "v")
    assert S.write_vectors(v, path, partition_by="tenant") == 4000
    one = spark.read.parquet(path).where("tenant = 't8'")
    assert one.count() == 400 and "PartitionFilters: [isnotnull(tenant" in one._jdf.queryExecution().toString()
    asked = F.broadcast(spark.createDataFrame([("t7", 3), ("hot", 1)], "tenant STRING, level INT").where("level > 2"))
    some = spark.read.parquet(path).join(asked, "tenant", "left_semi")
    assert some.count() == 400 and "dynamicpruning" in some._jdf.queryExecution().toString().lower()


def test_files_without_an_id_are_skipped(spark, tmp_path):
    v = spark.range(20_000).select(F.xxhash64("id").alias("id"), F.array(F.col("id").cast("float")).alias("emb"))
    wanted = v.where("id < 0").limit(1).first()["id"]
    read = {}
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 500)
    try:
        assert S.write_vectors(v, str(tmp_path / "bloom"), bloom="id") == 20_000
        v.repartition(4).write.option("parquet.enable.dictionary#id", "false").parquet(str(tmp_path / "plain"))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    for name in ("plain", "bloom"):
        found = spark.read.parquet(str(tmp_path / name)).where(F.col("id") == wanted).select("id")
        plan = found._jdf.queryExecution().executedPlan()
        assert len(plan.executeCollect()) == 1
        read[name] = plan.collectLeaves().head().metrics().apply("numOutputRows").value()
    assert read["plain"] == 20_000 and 0 < read["bloom"] <= 2_500


def test_custom_tables_and_shards(spark, tmp_path):
    for name in S.shard_names(2):
        spark.createDataFrame([(1, [1.0])], "key INT, v ARRAY<DOUBLE>").write.parquet(str(tmp_path / name))
    custom = S.read_custom(spark, str(tmp_path), "train-00-of-2, train-01-of-2.parquet", {"key": "id", "v": "emb"})
    assert custom.dtypes == [("id", "bigint"), ("emb", "array<float>")] and custom.count() == 2
    assert S.read_vectors(spark, str(tmp_path), 2, id_col="key", vec_col="v").count() == 2


def test_load_checks(spark):
    loaded = spark.createDataFrame([("a",), ("a",), ("b",)], "tenant STRING")
    expected = spark.createDataFrame([("a", 2), ("b", 3), ("c", 2)], "tenant STRING, expected BIGINT")
    row = S.worst_tenant(S.load_reconcile(loaded, expected)).first()
    assert tuple(row) == (False, 4, "b")
    log = spark.createDataFrame([("a", 5, True), ("a", 5, False), ("b", 5, True)], "tenant STRING, rows BIGINT, ok BOOLEAN")
    report = S.tenant_load_report(log)
    assert sorted(tuple(r) for r in report.collect()) == [("a", 5, 1, False), ("b", 5, 0, True)]
    with pytest.raises(RuntimeError, match="1 failed tenants: \\['a'\\]; 1 finished tenants: \\['b'\\]"):
        S.raise_on_partial_load(report)


def test_sizes_decide_broadcasts(spark):
    df = spark.range(1000).withColumn("text", F.repeat(F.lit("x"), 100))
    assert is_small(df) and not is_small(df, max_rows=999) and not is_small(df, max_bytes=100_000)
    hinted = broadcast_bounded(df, 1000)._jdf.queryExecution().toString()
    plain = broadcast_bounded(df, 10**9)._jdf.queryExecution().toString()
    assert "ResolvedHint" in hinted and "ResolvedHint" not in plain
    assert settle(df).count() == 1000
    assert work_dir(spark, "x").startswith(checkpoint_root(spark)) and work_dir(spark, "x") != work_dir(spark, "x")
