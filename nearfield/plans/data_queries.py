"""Queries over sources, sinks and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearfield.functions import labels as L
from nearfield.functions import vector as V
from nearfield.operators.quantize import ScalarCodec, reduce_precision
from nearfield.plans.inputs import (
    PAIRS,
    RUNS,
    VECTORS,
    corpus,
    documents_json,
    runs,
    table,
    vector_pairs,
    vectors,
)
from nearfield.plans.registry import query
from nearfield.session import work_dir
from nearfield.sizing import broadcast_bounded
from nearfield.sources import corpora as C
from nearfield.sources import results as R
from nearfield.sources import tables as S


def total(v):
    return F.round(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double")), 6) + F.lit(0.0)


@query("scan_vectors", f"WITH {VECTORS} SELECT id, label, CAST(len(e) AS BIGINT) AS dim, round(list_sum(e), 6) + 0e0 AS total FROM v")
def scan_vectors(spark, sf):
    v = S.read_vectors(spark, f"{sf}/embeddings.parquet", id_col="vec_id", vec_col="embedding", keep=("label",))
    return v.select("id", F.col("label").cast("bigint").alias("label"), F.size("emb").cast("bigint").alias("dim"), total(F.col("emb")).alias("total"))


@query("scan_custom", f"WITH {VECTORS} SELECT id, label AS labels, round(sqrt(list_inner_product(e, e)), 6) AS length FROM v")
def scan_custom(spark, sf):
    v = S.read_custom(spark, sf, "embeddings", {"vec_id": "id", "embedding": "emb", "label": "labels"})
    return v.select("id", F.col("labels").cast("bigint").alias("labels"), F.round(V.norm("emb"), 6).alias("length"))


@query(
    "join_labels",
    "SELECT d.doc_id AS id, d.lang, CAST(l.quality AS BIGINT) AS quality, CAST(l.toxic AS BIGINT) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
)
def join_labels(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    side = table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").cast("bigint").alias("quality"), F.col("toxic").cast("bigint").alias("toxic")
    )
    return S.join_labels(docs, side)


@query(
    "scan_corpus",
    r"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(flat) AS plain_md5, md5(regexp_replace(source || ' ' || flat, '^\s+|\s+$', '', 'g')) AS titled_md5
    FROM (SELECT doc_id, source, replace(replace(text, chr(9), ' '), chr(10), ' ') AS flat FROM documents)""",
)
def scan_corpus(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", F.col("source").alias("title"))
    plain = C.passage_corpus(docs).select("doc_id", F.md5("text").alias("plain_md5"))
    titled = C.titled_corpus(docs).select("doc_id", F.md5("text").alias("titled_md5"))
    return plain.join(titled, "doc_id")


@query("dense_row_ids", "SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS row_id FROM documents WHERE lang <> 'es'")
def dense_row_ids(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return S.dense_row_ids(docs, "doc_id", well_formed=F.col("lang") != "es").select("doc_id", "row_id")


@query(
    "batch_ids",
    "SELECT CAST(floor(i / 100) AS BIGINT) AS batch_id, count(*) AS n, min(event_id) AS lo, max(event_id) AS hi FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) GROUP BY 1",
)
def batch_ids(spark, sf):
    rows = S.batch_ids(S.dense_row_ids(table(spark, sf, "events").select("event_id"), "event_id"), 100)
    return rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))


@query(
    "write_vectors",
    f"WITH {VECTORS} SELECT 'tenant_' || lpad(CAST(id % 7 AS VARCHAR), 4, '0') AS tenant, count(*) AS n, sum(id) AS id_sum, (SELECT count(*) FROM v) AS inserted FROM v GROUP BY 1",
)
def write_vectors(spark, sf):
    v = vectors(spark, sf).withColumn("tenant", L.tenant_for_id(F.col("id"), 7))
    path = work_dir(spark, "vectors")
    inserted = S.write_vectors(v.unionByName(v), path, partition_by="tenant")
    stored = spark.read.parquet(path)
    return stored.groupBy("tenant").agg(
        F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum"), F.max(F.lit(inserted).cast("bigint")).alias("inserted")
    )


@query(
    "stored_tenant",
    f"WITH {VECTORS} SELECT id, label, 'tenant_' || lpad(CAST(id % 7 AS VARCHAR), 4, '0') AS tenant FROM v WHERE id % 7 = 3 AND label < 5",
)
def stored_tenant(spark, sf):
    """One tenant of a table stored by tenant: only its folder is read."""
    path = work_dir(spark, "by-tenant")
    S.write_vectors(vectors(spark, sf).withColumn("tenant", L.tenant_for_id(F.col("id"), 7)), path, partition_by="tenant")
    return spark.read.parquet(path).where(L.tenant_equals(F.col("tenant"), "tenant_0003", F.col("label") < 5)).select("id", "label", "tenant")


@query(
    "stored_tenants_joined",
    f"WITH {VECTORS} SELECT 'tenant_' || lpad(CAST(id % 7 AS VARCHAR), 4, '0') AS tenant, count(*) AS n, sum(id) AS id_sum FROM v WHERE id % 7 IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1",
)
def stored_tenants_joined(spark, sf):
    """Tenants chosen by another table: their folders are found while the query runs."""
    path = work_dir(spark, "by-tenant")
    S.write_vectors(vectors(spark, sf).withColumn("tenant", L.tenant_for_id(F.col("id"), 7)), path, partition_by="tenant")
    asked = table(spark, sf, "supplier").where("s_acctbal > 0 AND s_suppkey < 7").select(L.tenant_for_id(F.col("s_suppkey"), 7).alias("tenant")).distinct()
    found = spark.read.parquet(path).join(broadcast_bounded(asked, 7), "tenant", "left_semi")
    return found.groupBy("tenant").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum"))


@query("stored_id_search", f"WITH {VECTORS} SELECT id, label FROM v WHERE id = (SELECT CAST(floor(max(id) / 2) AS BIGINT) FROM v)")
def stored_id_search(spark, sf):
    """One id of a table whose files are not in the order of ids: row groups without it are skipped by their Bloom filters."""
    path = work_dir(spark, "by-id")
    S.write_vectors(vectors(spark, sf), path, bloom="id")
    wanted = vectors(spark, sf).agg(F.floor(F.max("id") / 2).alias("id")).first()["id"]
    return spark.read.parquet(path).where(F.col("id") == wanted).select("id", "label")


TOKENS = r"t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents)"


@query(
    "write_documents",
    f"WITH {TOKENS} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS occurrences, (SELECT count(*) FROM documents) AS n_docs FROM t GROUP BY term",
)
def write_documents(spark, sf):
    path = work_dir(spark, "documents")
    n = C.write_documents(corpus(spark, sf), path)
    stored, _ = C.read_postings(spark, path)
    return stored.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences"), F.max(F.lit(n).cast("bigint")).alias("n_docs")
    )


@query("replicate_ids", f"WITH {VECTORS} SELECT id + r * (SELECT count(*) FROM v) AS id, label FROM v, (SELECT unnest([0, 1, 2]) AS r)")
def replicate_ids(spark, sf):
    v = vectors(spark, sf)
    return S.replicate_ids(v, 3, v.count()).select("id", "label")


@query(
    "manifest_check",
    """SELECT 'indexed_doc_count' AS field, CAST(count(*) + 1 AS VARCHAR) AS found, CAST(count(*) AS VARCHAR) AS expected FROM documents
    UNION ALL SELECT 'truth_count', CAST((SELECT count(*) FROM labels) AS VARCHAR), CAST(count(*) AS VARCHAR) FROM benchmark HAVING count(*) <> (SELECT count(*) FROM labels)
    UNION ALL SELECT 'source_ir_dataset', 'set_a', 'set_b'""",
)
def manifest_check(spark, sf):
    docs, asked = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    built = docs.agg(
        F.lit("set_a").alias("source_ir_dataset"),
        F.count(F.lit(1)).alias("doc_limit"),
        (F.count(F.lit(1)) + 1).alias("indexed_doc_count"),
        F.lit(None).cast("bigint").alias("query_count"),
    )
    return C.manifest_violations(built, docs.count(), "set_b", asked, table(spark, sf, "labels"))


_DOC_ROWS = f"""WITH {RUNS} SELECT '/results/' || db || '/result_' || lpad(CAST(ord AS VARCHAR), 12, '0') || '_a.json' AS file, run_id,
 CASE WHEN task_label = 'custom' THEN run_id ELSE task_label END AS task_label, db, label,
 CASE WHEN ord % 16 = 15 THEN 400 WHEN ord % 16 = 7 THEN 600 ELSE case_id END AS case_id,
 CASE WHEN ord % 16 = 15 THEN 'Medium Cohere (768dim, 1M)' ELSE 'MS MARCO ' || (['Small (100K)', 'Medium (1M)', 'Large (8.8M)'])[ord % 3 + 1] END AS dataset,
 CASE WHEN ord % 16 = 15 THEN '0.01' END AS rate,
 round(CASE WHEN max_load_count > 0 THEN max_load_count / 1000 ELSE max_load_count END, 6) AS load_k,
 round(CASE WHEN serial_latency_p99 > 0 THEN serial_latency_p99 * 1000 ELSE 0 END, 6) AS p99_ms, 0e0 AS p95_ms, round(qps, 6) AS qps FROM runs"""


@query("scan_results", _DOC_ROWS)
def scan_results(spark, sf):
    rows = R.map_legacy_cases(R.case_rows(R.parse_runs(documents_json(spark, sf)), trans_unit=True))
    case = F.col("task_config.case_config")
    return rows.select(
        "file", "run_id", "task_label", F.col("task_config.db").alias("db"), "label", case["case_id"].alias("case_id"),
        case["custom_case"]["dataset_with_size_type"].alias("dataset"), case["custom_case"]["filter_rate"].alias("rate"),
        F.round("metrics.max_load_count", 6).alias("load_k"), F.round("metrics.serial_latency_p99", 6).alias("p99_ms"),
        F.round("metrics.serial_latency_p95", 6).alias("p95_ms"), F.round("metrics.qps", 6).alias("qps"),
    )


@query(
    "write_results",
    f"""WITH {RUNS} SELECT db, CASE WHEN ord % 16 = 7 THEN 600 WHEN ord % 16 = 15 THEN 7 ELSE case_id END AS case_id, count(*) AS n,
    round(sum(CASE WHEN ord % 16 <> 7 THEN qps END), 2) AS qps, count(CASE WHEN ord % 16 <> 7 THEN recall END) AS with_recall,
    count(CASE WHEN ord % 2 = 0 THEN 1 END) AS masked FROM runs GROUP BY 1, 2""",
)
def write_results(spark, sf):
    path = work_dir(spark, "results")
    R.write_runs(R.case_rows(R.parse_runs(documents_json(spark, sf))), path)
    back = R.case_rows(R.read_written_runs(spark, path))
    config = F.col("task_config")
    return back.groupBy(config["db"].alias("db"), config["case_config"]["case_id"].alias("case_id")).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("metrics.qps"), 2).alias("qps"),
        F.count("metrics.recall").alias("with_recall"),
        F.count_if(config["db_config"]["Password"] == R.MASK).alias("masked"),
    )


@query(
    "redact",
    "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '**********' END AS token, CASE WHEN c_name <> '' THEN '**********' ELSE c_name END AS api_key, c_mktsegment AS plain FROM customer",
)
def redact(spark, sf):
    config = F.create_map(
        F.lit("Token"), F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.lit("secret")),
        F.lit("API_KEY"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"),
    )
    masked = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), R.redact(config).alias("m"))
    return masked.select("id", F.col("m")["Token"].alias("token"), F.col("m")["API_KEY"].alias("api_key"), F.col("m")["segment"].alias("plain"))


@query("scan_prices", "SELECT p_brand AS db, p_type AS db_label, round(max(p_retailprice), 6) AS price FROM part GROUP BY 1, 2")
def scan_prices(spark, sf):
    best = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.max("p_retailprice").alias("price"))
    texts = best.select(F.to_json(F.create_map("p_brand", F.create_map("p_type", "price"))).alias("json"))
    return R.scan_prices(texts).select("db", "db_label", F.round("price", 6).alias("price"))


_RECON = """l AS (SELECT 'tenant_' || lpad(CAST(user_id % 20 AS VARCHAR), 4, '0') AS tenant, count(*) AS loaded FROM events GROUP BY 1),
x AS (SELECT 'tenant_' || lpad(CAST(o_custkey % 23 AS VARCHAR), 4, '0') AS tenant, count(*) AS expected FROM orders GROUP BY 1),
j AS (SELECT tenant, coalesce(loaded, 0) AS loaded, coalesce(expected, 0) AS expected FROM l FULL JOIN x USING (tenant))"""


def _reconciled(spark, sf):
    loaded = table(spark, sf, "events").select(L.tenant_for_id(F.col("user_id"), 20).alias("tenant"))
    expected = table(spark, sf, "orders").groupBy(L.tenant_for_id(F.col("o_custkey"), 23).alias("tenant")).agg(F.count(F.lit(1)).alias("expected"))
    return S.load_reconcile(loaded, expected)


@query("load_reconcile", f"WITH {_RECON} SELECT tenant, loaded, expected, greatest(expected - loaded, 0) AS missing, loaded >= expected AS searchable FROM j")
def load_reconcile(spark, sf):
    return _reconciled(spark, sf)


@query(
    "load_readiness",
    f"""WITH {_RECON}, g AS (SELECT *, greatest(expected - loaded, 0) AS missing FROM j) SELECT bool_and(loaded >= expected) AS fully_searchable, CAST(sum(missing) AS BIGINT) AS missing,
    (SELECT tenant FROM g ORDER BY missing DESC, tenant LIMIT 1) AS tenant FROM g""",
)
def load_readiness(spark, sf):
    return S.worst_tenant(_reconciled(spark, sf))


@query(
    "tenant_load_report",
    """SELECT 'tenant_' || lpad(CAST(user_id % 20 AS VARCHAR), 4, '0') AS tenant, CAST(coalesce(sum(CASE WHEN ok THEN n END), 0) AS BIGINT) AS inserted,
    count(CASE WHEN NOT ok THEN 1 END) AS failed_batches, bool_and(ok) AS ok
    FROM (SELECT user_id, event_id % 100 + 1 AS n, NOT (event_type = 'error' AND user_id % 4 = 0) AS ok FROM events) GROUP BY 1""",
)
def tenant_load_report(spark, sf):
    log = table(spark, sf, "events").select(
        L.tenant_for_id(F.col("user_id"), 20).alias("tenant"),
        (F.col("event_id") % 100 + 1).alias("rows"),
        (~((F.col("event_type") == "error") & (F.col("user_id") % 4 == 0))).alias("ok"),
    )
    return S.tenant_load_report(log)


# --- scalar functions -----------------------------------------------------------------


@query(
    "l2_normalize",
    f"WITH {VECTORS}, s AS (SELECT id, list_transform(e, lambda x: x * 3e0) AS e FROM v) SELECT id, round(list_sum(e) / sqrt(list_inner_product(e, e)), 6) + 0e0 AS total, 1e0 AS length FROM s",
)
def l2_normalize(spark, sf):
    scaled = vectors(spark, sf).select("id", V.l2_normalize(F.transform("emb", lambda x: x.cast("double") * 3.0)).alias("u"))
    return scaled.select("id", total(F.col("u")).alias("total"), F.round(V.norm("u"), 6).alias("length"))


def _pair_query(name, sql, expr):
    @query(name, f"WITH {PAIRS} SELECT id, {sql} AS value FROM p")
    def run(spark, sf):
        return vector_pairs(spark, sf).select("id", expr(F.col("a"), F.col("b")).alias("value"))

    return run


_AB = "list_transform(list_zip(a, b), lambda x: CASE WHEN {} THEN 1 ELSE 0 END)"
_DIFF = "CAST(list_sum(" + _AB.format("(x[1] > 0) <> (x[2] > 0)") + ") AS BIGINT)"
_BOTH = "list_sum(" + _AB.format("x[1] > 0 AND x[2] > 0") + ")"
_EITHER = "list_sum(" + _AB.format("x[1] > 0 OR x[2] > 0") + ")"

_pair_query("inner_product", "round(list_inner_product(a, b), 6) + 0e0", lambda a, b: F.round(V.inner_product(a, b), 6) + F.lit(0.0))
_pair_query("l2_distance", "round(list_distance(a, b), 6)", lambda a, b: F.round(V.l2_distance(a, b), 6))
_pair_query("cosine_distance", "round(list_cosine_distance(a, b), 6)", lambda a, b: F.round(V.cosine_distance(a, b), 6))
_pair_query("hamming_distance", _DIFF, lambda a, b: V.hamming_distance(V.binary_quantize(a), V.binary_quantize(b)))
_pair_query(
    "jaccard_distance",
    f"round(1 - CAST({_BOTH} AS DOUBLE) / CAST({_EITHER} AS DOUBLE), 6)",
    lambda a, b: F.round(V.jaccard_distance(V.binary_quantize(a), V.binary_quantize(b)), 6),
)


def _word(n):
    return f"CAST(list_sum(list_transform(range(0, 32), lambda i: CASE WHEN e[i + 1 + {32 * n}] > 0 THEN CAST(pow(2, i) AS BIGINT) ELSE 0 END)) AS BIGINT)"


@query("binary_quantize", f"WITH {VECTORS} SELECT id, {_word(0)} AS w0, {_word(1)} AS w1 FROM v")
def binary_quantize(spark, sf):
    bits = vectors(spark, sf).select("id", V.binary_quantize("emb").alias("w"))
    return bits.select("id", F.col("w")[0].alias("w0"), F.col("w")[1].alias("w1"))


SQ = f"""{VECTORS}, f AS (SELECT id, unnest(e) AS x, unnest(range(0, len(e))) AS dim FROM v),
d AS (SELECT dim, min(x) AS lo, max(x) AS hi FROM f GROUP BY dim)"""


def _sq_sql(steps, uniform=False):
    ranges = "(SELECT dim, (SELECT min(lo) FROM d) AS lo, (SELECT max(hi) FROM d) AS hi FROM d)" if uniform else "d"
    return f"""c AS (SELECT f.id, f.x, f.dim, r.lo, r.hi, least(greatest(floor((f.x - r.lo) / (r.hi - r.lo) * {steps} + 5e-1), 0), {steps}) AS code
    FROM f JOIN {ranges} r ON r.dim = f.dim)"""


def _scalar_query(name, kind, steps):
    @query(
        name,
        f"WITH {SQ}, {_sq_sql(steps, kind == 'SQ4U')} SELECT id, CAST(sum(code) AS BIGINT) AS codes, round(sum(lo + code * (hi - lo) / {steps}), 6) + 0e0 AS decoded FROM c GROUP BY id",
    )
    def run(spark, sf):
        v = vectors(spark, sf)
        codec = ScalarCodec.fit(v, kind)
        coded = v.select("id", codec.encode(F.col("emb")).alias("code"))
        return coded.select(
            "id", F.aggregate("code", F.expr("0L"), lambda acc, x: acc + x).alias("codes"), total(codec.decode(F.col("code"))).alias("decoded")
        )

    return run


_scalar_query("scalar_quantize", "SQ8", 255)
_scalar_query("scalar_quantize_sq6", "SQ6", 63)
_scalar_query("scalar_quantize_sq4u", "SQ4U", 15)

_HALF = "CASE WHEN x = 0 THEN 0e0 ELSE round_even(x / pow(2, greatest(floor(log2(abs(x))), -14) - 10), 0) * pow(2, greatest(floor(log2(abs(x))), -14) - 10) END"
_BRAIN = "CASE WHEN x = 0 THEN 0e0 ELSE trunc(x / pow(2, floor(log2(abs(x))) - 7)) * pow(2, floor(log2(abs(x))) - 7) END"


@query(
    "reduce_precision",
    f"WITH {VECTORS}, f AS (SELECT id, unnest(e) AS x FROM v) SELECT id, round(sum({_HALF}), 6) + 0e0 AS fp16, round(sum({_BRAIN}), 6) + 0e0 AS bf16 FROM f GROUP BY id",
)
def reduced(spark, sf):
    v = vectors(spark, sf)
    return v.select("id", total(reduce_precision(F.col("emb"), "FP16")).alias("fp16"), total(reduce_precision(F.col("emb"), "BF16")).alias("bf16"))


@query("tenant_for_id", "SELECT c_custkey AS id, 'acct_' || CASE WHEN c_custkey % 137 < 10 THEN '0' ELSE '' END || CAST(c_custkey % 137 AS VARCHAR) AS tenant FROM customer")
def tenant_for_id(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), L.tenant_for_id(F.col("c_custkey"), 137, "acct_", 2).alias("tenant"))


@query(
    "label_value",
    "SELECT p_partkey AS id, CASE WHEN s * 100 >= 1 THEN 'label_' || CAST(CAST(trunc(s * 100) AS BIGINT) AS VARCHAR) || 'p' ELSE 'label_' || printf('%.1f', s * 100) || 'p' END AS value FROM (SELECT p_partkey, p_size / 1e3 AS s FROM part)",
)
def label_value(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), L.label_value(F.col("p_size") / F.lit(1e3)).alias("value"))


_RATE = "CASE WHEN s * 100 BETWEEN 1 AND 99 THEN 'int_' || CAST(CAST(trunc(s * 100) AS BIGINT) AS VARCHAR) || 'p' ELSE 'int_' || printf('%.1f', s * 100) || 'p' END"


@query(
    "int_rate",
    f"""SELECT p_partkey AS id, {_RATE} AS rate, 'neighbors_' || {_RATE} AS truth, CASE WHEN s = 0.01::DOUBLE THEN 'neighbors_head_1p' WHEN s = 0.99::DOUBLE THEN 'neighbors_tail_1p' END AS legacy
    FROM (SELECT p_partkey, CASE WHEN p_size > 40 THEN (1000 - p_size + 40) / 1e3 ELSE p_size / 1e3 END AS s FROM part)""",
)
def int_rate(spark, sf):
    s = F.when(F.col("p_size") > 40, (F.lit(1040) - F.col("p_size")) / F.lit(1e3)).otherwise(F.col("p_size") / F.lit(1e3))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), L.int_rate(s).alias("rate"), L.int_truth_name(s).alias("truth"), L.legacy_int_truth_name(s).alias("legacy")
    )


@query(
    "payload_bytes",
    """SELECT l_orderkey, l_linenumber, profile, CAST(sum(CASE profile WHEN 'ids_only' THEN k * 20 WHEN 'vector' THEN k * (20 + dim * 4) WHEN 'scalar_label' THEN k * 36 ELSE k * 532 END) AS BIGINT) AS bytes
    FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, (['ids_only', 'vector', 'scalar_label', 'text'])[l_linenumber % 4 + 1] AS profile, CAST(l_quantity AS BIGINT) AS k, l_partkey % 1536 AS dim FROM lineitem) GROUP BY 1, 2, 3""",
)
def payload_bytes(spark, sf):
    kinds = F.array(*[F.lit(p) for p in ("ids_only", "vector", "scalar_label", "text")])
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), F.element_at(kinds, F.col("l_linenumber") % 4 + 1).alias("profile"),
        F.col("l_quantity").cast("bigint").alias("k"), (F.col("l_partkey") % 1536).alias("dim"),
    )
    return rows.groupBy("l_orderkey", "l_linenumber", "profile").agg(F.sum(L.payload_bytes(F.col("profile"), F.col("k"), F.col("dim"))).alias("bytes"))


@query(
    "unit_convert",
    f"WITH {RUNS} SELECT ord, round(CASE WHEN max_load_count > 0 THEN max_load_count / 1000 ELSE max_load_count END, 6) AS load_k, round(CASE WHEN serial_latency_p99 > 0 THEN serial_latency_p99 * 1000 ELSE serial_latency_p99 END, 6) AS p99_ms FROM runs",
)
def unit_convert(spark, sf):
    return runs(spark, sf).select("ord", F.round(L.to_thousands(F.col("max_load_count")), 6).alias("load_k"), F.round(L.to_millis(F.col("serial_latency_p99")), 6).alias("p99_ms"))


@query("db_name", f"WITH {RUNS} SELECT ord, db_name AS full_name, concat_ws('-', db, nullif(db_label, '')) AS short_name FROM runs")
def db_name(spark, sf):
    r = runs(spark, sf)
    return r.select("ord", L.db_name(F.col("db"), F.col("db_label"), F.col("version")).alias("full_name"), L.db_name(F.col("db"), F.col("db_label")).alias("short_name"))


@query("predicate_int_ge", f"WITH {VECTORS} SELECT id, label FROM v WHERE id >= CAST(floor((SELECT count(*) FROM v) * 0.9::DOUBLE) AS BIGINT)")
def predicate_int_ge(spark, sf):
    v = vectors(spark, sf)
    return v.where(L.int_at_least(F.col("id"), v.count(), 0.9)).select("id", "label")


@query("predicate_label_eq", f"WITH {VECTORS} SELECT id, label FROM v WHERE label = 3")
def predicate_label_eq(spark, sf):
    return vectors(spark, sf).where(L.label_equals(F.col("label"), 3)).select("id", "label")


@query("predicate_tenant", "SELECT user_id, event_id FROM events WHERE user_id % 10 = 4 AND event_type = 'view'")
def predicate_tenant(spark, sf):
    rows = table(spark, sf, "events").withColumn("tenant", L.tenant_for_id(F.col("user_id"), 10))
    return rows.where(L.tenant_equals(F.col("tenant"), "tenant_0004", F.col("event_type") == "view")).select("user_id", "event_id")


@query("predicate_id_and_range", "SELECT l_orderkey, l_partkey, round(l_quantity, 6) AS l_quantity FROM lineitem WHERE l_suppkey = 7 AND l_quantity >= 25")
def predicate_id_and_range(spark, sf):
    rows = table(spark, sf, "lineitem")
    kept = rows.where(L.id_and_range({"id": 7, "metadata": 25}, F.col("l_suppkey"), F.col("l_quantity")))
    return kept.select("l_orderkey", "l_partkey", F.round("l_quantity", 6).alias("l_quantity"))
