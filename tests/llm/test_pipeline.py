"""The stages one after the other on small documents, and each against its own rule."""

import pytest
from conftest import ROWS

import corpus_pipeline as P
from nearfield.llm.common import stored

EXTRA = [
    (20, "--- 123 !!!"),
    (21, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"),
    (22, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho tau"),
    (23, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sf"))
    docs = [(i, t, "en", "src", len(t or "")) for i, t in ROWS + EXTRA]
    spark.createDataFrame(docs, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen")], "item_id BIGINT, text STRING").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in P.STAGES:
        docs = stored(stage(spark, docs, folder), name)
        seen[name] = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id or 0, r.text or ""))
        assert name == P.STAGES[-1][0] or docs.columns == columns
    kept = [r.doc_id for r in seen["language_id"]]
    assert not {4, 6, 8, 20} & set(kept) and {1, 2, 3, 5, 7, 21, 22, 23} <= set(kept)
    texts = {r.doc_id: r.text for r in seen["line_dedup"] if r.doc_id}
    assert texts[2] == "" and texts[22] == "" and texts[21] and len(seen["line_dedup"]) == len(seen["language_id"])
    assert [r.doc_id for r in seen["simhash_near_dedup"]].count(3) == 1
    assert sum(r.text == "" for r in seen["simhash_near_dedup"]) == 1
    assert 23 not in [r.doc_id for r in seen["benchmark_decontamination"]]
    assert [(r.doc_id, r.text) for r in seen["byte_level_bpe"]] == [(r.doc_id, r.text) for r in seen["benchmark_decontamination"]]


def test_run_gives_the_last_stage(spark, folder):
    rows = P.run(spark, folder)
    assert rows.columns == ["doc_id", "n_tokens", "ids", "text"] and rows.count() > 0


def test_entry_points_with_the_corpus_queries():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {"pipeline"} | {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names}
    assert set(entry.oracle_sql()) <= names


def plain_folder(spark, root, docs):
    spark.createDataFrame(docs, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen")], "item_id BIGINT, text STRING").write.parquet(f"{root}/benchmark.parquet")


def test_documents_without_a_language_label_stay(spark, tmp_path):
    docs = [(i, f"plain english text number {i} about a river", None, "s", 10) for i in range(20)] + [(None, None, None, None, None)]
    plain_folder(spark, str(tmp_path), docs)
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert P.language_id(spark, table, str(tmp_path)).count() == 21
    known = table.selectExpr("doc_id", "text", "'en' AS lang", "source", "n_chars")
    assert P.language_id(spark, known, str(tmp_path)).count() == 20


def test_a_text_in_no_learned_language_goes(spark, tmp_path):
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(10**9 + i, "".join(chr(0x30A2 + (7 * i + j) % 60) + chr(33 + (i + 3 * j) % 14) for j in range(80)), None, "s", 160) for i in range(5)], base.schema)
    kept = P.language_id(spark, base.union(odd), str(tmp_path))
    lettered = base.where("text RLIKE '\\\\p{L}'")
    gone = lettered.join(kept, "doc_id", "left_anti").count()
    assert gone <= 0.005 * lettered.count() and kept.columns == base.columns


def test_empty_tables_and_clashing_columns(spark, messy, nothing, folder):
    for docs in (messy, nothing):
        docs = docs.withColumn("source", docs["doc_id"].cast("string")).withColumn("lang", docs["text"].substr(1, 1))
        columns, n = docs.columns, docs.count()
        for name, stage in P.STAGES[:-1]:
            docs = stored(stage(spark, docs, folder), name)
            assert docs.columns == columns and docs.count() <= n
        assert P.byte_level_bpe(spark, docs, folder).count() == docs.count()


def test_no_stage_writes_or_shuffles_all_texts_between_its_jobs(spark, folder, monkeypatch):
    seen = []
    keep = P.stored
    monkeypatch.setattr(P, "stored", lambda df, name: seen.append(df.columns) or keep(df, name))
    docs = P.table(spark, folder, "documents")
    P.language_id(spark, docs, folder)
    assert seen and not any("text" in columns for columns in seen)
    plan = P.simhash.keep_one(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_stages_hand_small_batches_to_python(spark, folder):
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = P.table(spark, folder, "documents")

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    for stage in (P.language_id, P.simhash_near_dedup, P.benchmark_decontamination, P.byte_level_bpe):
        spark.conf.unset(rows)
        stage(spark, docs, folder)
        assert max(r.n for r in spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n BIGINT").collect()) <= 1000
    spark.conf.set(rows, 7)
    P.byte_level_bpe(spark, docs, folder)
    assert spark.conf.get(rows) == "7"
    spark.conf.unset(rows)
