"""Canonical table layouts."""

from __future__ import annotations

from pyspark.sql import types as T

VECTORS = T.StructType([T.StructField("id", T.LongType()), T.StructField("emb", T.ArrayType(T.FloatType()))])

HITS = "qid BIGINT, rank INT, id BIGINT, score DOUBLE"

REQUEST_LOG = (
    "run STRING, conc INT, worker INT, seq BIGINT, attempt INT, ts TIMESTAMP, latency_s DOUBLE, ok BOOLEAN"
)
INSERT_LOG = "run STRING, batch_id BIGINT, tenant STRING, rows BIGINT, ts TIMESTAMP, ok BOOLEAN"
STATUS_LOG = "run STRING, ts TIMESTAMP, searchable BOOLEAN, indexed BOOLEAN"

MANIFEST = (
    "source_ir_dataset STRING, doc_limit BIGINT, indexed_doc_count BIGINT, query_count BIGINT, "
    "bm25 STRUCT<k1: DOUBLE, b: DOUBLE, avgdl: DOUBLE>, "
    "analyzer STRUCT<tokenizer: STRING, filter: ARRAY<STRING>>"
)

_LONG, _DOUBLE, _TEXT = T.LongType(), T.DoubleType(), T.StringType()
_LONGS, _DOUBLES, _MAP = T.ArrayType(_LONG), T.ArrayType(_DOUBLE), T.MapType(_TEXT, _TEXT)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


METRICS = _struct(
    max_load_count=_DOUBLE,
    insert_duration=_DOUBLE,
    optimize_duration=_DOUBLE,
    load_duration=_DOUBLE,
    qps=_DOUBLE,
    serial_latency_p99=_DOUBLE,
    serial_latency_p95=_DOUBLE,
    recall=_DOUBLE,
    ndcg=_DOUBLE,
    conc_num_list=_LONGS,
    conc_qps_list=_DOUBLES,
    conc_latency_p99_list=_DOUBLES,
    conc_latency_p95_list=_DOUBLES,
    conc_latency_avg_list=_DOUBLES,
    payload_profile=_TEXT,
    payload_estimated_bytes_per_query=_LONG,
    inserted_count=_LONG,
    insert_rows_per_second=_DOUBLE,
    insert_completion_seconds=_DOUBLE,
    searchable_after_insert_seconds=_DOUBLE,
    indexed_after_searchable_seconds=_DOUBLE,
    additional_parameters=_MAP,
    cold_latency=_TEXT,
    st_ideal_insert_duration=_LONG,
    st_search_stage_list=_LONGS,
    st_search_time_list=_DOUBLES,
    st_max_qps_list_list=_DOUBLES,
    st_recall_list=_DOUBLES,
    st_ndcg_list=_DOUBLES,
    st_serial_latency_p99_list=_DOUBLES,
    st_serial_latency_p95_list=_DOUBLES,
    st_conc_failed_rate_list=_DOUBLES,
    st_conc_num_list_list=T.ArrayType(_LONGS),
    st_conc_qps_list_list=T.ArrayType(_DOUBLES),
    st_conc_latency_p99_list_list=T.ArrayType(_DOUBLES),
    st_conc_latency_p95_list_list=T.ArrayType(_DOUBLES),
    st_conc_latency_avg_list_list=T.ArrayType(_DOUBLES),
)

CASE_CONFIG = _struct(case_id=_LONG, custom_case=_MAP, k=_LONG)
TASK_CONFIG = _struct(db=_TEXT, db_config=_MAP, db_case_config=_MAP, case_config=CASE_CONFIG)
CASE_RESULT = _struct(metrics=METRICS, task_config=TASK_CONFIG, label=_TEXT)
RESULT_RUN = _struct(run_id=_TEXT, task_label=_TEXT, timestamp=_DOUBLE, results=T.ArrayType(CASE_RESULT))
