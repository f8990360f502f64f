"""Queries over nearest-neighbour searches and their evaluation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from nearfield.functions.labels import int_at_least, label_equals, payload_bytes, tenant_for_id
from nearfield.functions.vector import register_metric
from nearfield.operators import ann as A
from nearfield.operators import evaluate as E
from nearfield.operators import truth as T
from nearfield.operators.fetch import attach
from nearfield.operators.index import probes_for, search_index, write_index
from nearfield.operators.lloyd import train_codes
from nearfield.operators.nearest import nearest
from nearfield.operators.quantize import ProductCodec, ScalarCodec, first_vectors, train_centroids
from nearfield.plans.data_queries import SQ, _sq_sql
from nearfield.plans.inputs import VECTORS, vector_queries, vectors
from nearfield.plans.registry import ORACLES, query
from nearfield.session import work_dir
from nearfield.sizing import settle

K = 10
N_LISTS, N_PROBE = 16, 4
PARTS = 8

DISTANCE = {
    "l2": "round(list_distance({q}, {b}), 9)",
    "cos": "round(list_cosine_distance({q}, {b}), 9)",
    "ip": "round(-list_inner_product({q}, {b}), 9)",
}


def ranked(source: str, name: str = "h", k: int = K, distance: str = "d", unit: str = "qid") -> str:
    """CTE that ranks (qid, id, d) rows and keeps k."""
    return f"{name} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {unit} ORDER BY {distance}, id) - 1 AS BIGINT) AS rank FROM {source}) WHERE rank < {k})"


def all_pairs(metric: str, where: str = "true", base: str = "v", queries: str = "v", name: str = "s", extra: str = "") -> str:
    d = DISTANCE[metric].format(q="q.e", b="b.e")
    return f"{name} AS (SELECT q.id AS qid, b.id AS id, {d} AS d{extra} FROM {queries} q, {base} b WHERE {where})"


def exact_sql(metric: str, where: str = "true", base: str = "v", queries: str = "v") -> str:
    sign = "-" if metric == "ip" else ""
    return f"WITH {VECTORS}, {all_pairs(metric, where, base, queries)}, {ranked('s')} SELECT qid, rank, id, round({sign}d, 6) + 0e0 AS score FROM h"


def shown(hits):
    """Six decimals of the binary number, as SQL engines round it; ``round`` would round its shortest decimal form."""
    six = F.signum("score") * F.floor(F.abs("score") * 1e6 + 0.5) / 1e6
    return hits.select("qid", F.col("rank").cast("bigint").alias("rank"), "id", (six + F.lit(0.0)).alias("score"))


def _exact(metric):
    @query(f"knn_exact_{metric}", exact_sql(metric))
    def run(spark, sf):
        return shown(nearest(vectors(spark, sf), vector_queries(spark, sf), K, metric))


for _metric in ("l2", "cos", "ip"):
    _exact(_metric)


def _canberra(a, b):
    """Canberra distance as a column; places where both vectors are 0 add nothing."""

    def share(x, y):
        x, y = x.cast("double"), y.cast("double")
        size = F.abs(x) + F.abs(y)
        return F.when(size > 0, F.abs(x - y) / size).otherwise(F.lit(0.0))

    return F.aggregate(F.zip_with(a, b, share), F.lit(0.0), lambda total, x: total + x)


def _canberra_block(a, b):
    gap, size = a - b, np.abs(a) + np.abs(b)
    np.abs(gap, out=gap)
    gap /= np.maximum(size, np.finfo(size.dtype).smallest_subnormal, out=size)
    return np.einsum("...k->...", gap)


_CANBERRA = (
    f"WITH {VECTORS}, s AS (SELECT q.id AS qid, b.id AS id, round(list_sum(list_transform(list_zip(q.e, b.e), lambda p: "
    f"CASE WHEN abs(p[1]) + abs(p[2]) > 0 THEN abs(p[1] - p[2]) / (abs(p[1]) + abs(p[2])) ELSE 0e0 END)), 9) AS d FROM v q, v b), {ranked('s')} SELECT qid, rank, id, round(d, 6) + 0e0 AS score FROM h"
)


@query("knn_custom_metric", _CANBERRA)
def knn_custom_metric(spark, sf):
    """A search by a measure that the caller brings."""
    register_metric("canberra", _canberra, block=_canberra_block, single=1e-5)
    return shown(nearest(vectors(spark, sf), vector_queries(spark, sf), K, "canberra"))


@query("knn_exact_blocks", exact_sql("cos"))
def knn_exact_blocks(spark, sf):
    """The path for query tables beyond the broadcast budget."""
    return shown(nearest(vectors(spark, sf), vector_queries(spark, sf), K, "cos", query_bytes=0))


@query("knn_int_filter", exact_sql("cos", "b.id >= CAST(floor((SELECT count(*) FROM v) * 0.5::DOUBLE) AS BIGINT)"))
def knn_int_filter(spark, sf):
    v = vectors(spark, sf)
    return shown(nearest(v.where(int_at_least(F.col("id"), v.count(), 0.5)), vector_queries(spark, sf), K, "cos"))


@query("knn_label_filter", exact_sql("cos", "b.label = 3"))
def knn_label_filter(spark, sf):
    v = vectors(spark, sf)
    return shown(nearest(v.where(label_equals(F.col("label"), 3)), vector_queries(spark, sf), K, "cos"))


N_TENANTS = 7


def query_tenant(qid):
    """Tenant of a query: a fixed scramble of its id, so that both engines agree."""
    return tenant_for_id(F.pmod(qid * F.lit(1103515245) + F.lit(12345), F.lit(2147483648)), N_TENANTS)


def tenant_base(spark, sf):
    return vectors(spark, sf).withColumn("tenant", tenant_for_id(F.col("id"), N_TENANTS))


def tenant_queries(spark, sf):
    return vector_queries(spark, sf).withColumn("tenant", query_tenant(F.col("qid")))


_SAME_TENANT = f"b.id % {N_TENANTS} = ((q.id * 1103515245 + 12345) % 2147483648) % {N_TENANTS}"


@query("knn_tenant", exact_sql("cos", _SAME_TENANT))
def knn_tenant(spark, sf):
    return shown(nearest(tenant_base(spark, sf), tenant_queries(spark, sf), K, "cos", key="tenant"))


@query("knn_tenant_filter", exact_sql("cos", f"{_SAME_TENANT} AND b.label >= 5"))
def knn_tenant_filter(spark, sf):
    return shown(nearest(tenant_base(spark, sf).where("label >= 5"), tenant_queries(spark, sf), K, "cos", key="tenant"))


@query(
    "knn_payload",
    f"WITH {VECTORS}, {all_pairs('cos')}, {ranked('s')} SELECT h.qid, h.rank, h.id, v.label, round(list_sum(v.e), 6) + 0e0 AS total, CAST({K} * (20 + 64 * 4) AS BIGINT) AS bytes FROM h JOIN v ON v.id = h.id",
)
def knn_payload(spark, sf):
    v, q = vectors(spark, sf), vector_queries(spark, sf)
    wide = attach(v, nearest(v, q, K, "cos"), q.count() * K)
    sums = F.round(F.aggregate("emb", F.lit(0.0), lambda acc, x: acc + x.cast("double")), 6) + F.lit(0.0)
    return wide.select(
        "qid", F.col("rank").cast("bigint").alias("rank"), "id", "label", sums.alias("total"),
        payload_bytes(F.lit("vector"), F.lit(K), F.size("emb")).alias("bytes"),
    )


# --- clustered and quantised searches, with the first vectors as given centroids ---------

LISTS = f"""cent AS (SELECT id AS c, e FROM v ORDER BY id LIMIT {N_LISTS}),
a AS (SELECT id, e, label, c AS list_id FROM (SELECT v.*, cent.c, row_number() OVER (PARTITION BY v.id ORDER BY round(list_distance(v.e, cent.e), 9), cent.c) AS n FROM v, cent) WHERE n = 1),
pr AS (SELECT id, e, c AS list_id, n - 1 AS probe FROM (SELECT v.id, v.e, cent.c, row_number() OVER (PARTITION BY v.id ORDER BY round(list_distance(v.e, cent.e), 9), cent.c) AS n FROM v, cent) WHERE n <= {{probe}})"""
IVF = f"{VECTORS}, {LISTS.format(probe=N_PROBE)}"


def centroids(base):
    return first_vectors(base, N_LISTS)


@query(
    "knn_ivf_flat",
    f"WITH {IVF}, {all_pairs('l2', 'b.list_id = q.list_id', 'a', 'pr')}, {ranked('s')} SELECT qid, rank, id, round(d, 6) + 0e0 AS score FROM h",
)
def knn_ivf_flat(spark, sf):
    v = vectors(spark, sf)
    return shown(A.knn_ivf_flat(v, vector_queries(spark, sf), K, centroids(v), N_PROBE))


@query(
    "knn_ivf_sq8",
    f"""WITH {SQ}, {LISTS.format(probe=N_PROBE)}, {_sq_sql(255)}, dec AS (SELECT id, list(lo + code * (hi - lo) / 255 ORDER BY dim) AS e FROM c GROUP BY id),
    b AS (SELECT a.id, a.list_id, dec.e FROM a JOIN dec ON dec.id = a.id), {all_pairs('l2', 'b.list_id = q.list_id', 'b', 'pr')}, {ranked('s')} SELECT qid, rank, id, round(d, 6) + 0e0 AS score FROM h""",
)
def knn_ivf_sq8(spark, sf):
    v = vectors(spark, sf)
    return shown(A.knn_ivf_sq8(v, vector_queries(spark, sf), K, centroids(v), N_PROBE, ScalarCodec.fit(v)))


_W = 64 // PARTS
_PQ = f"""parts AS (SELECT unnest(range(0, {PARTS})) AS m),
pv AS (SELECT v.id, m, list_slice(v.e, m * {_W} + 1, m * {_W} + {_W}) AS s FROM v, parts),
book AS (SELECT id AS code, m, s FROM pv WHERE id IN (SELECT c FROM cent)),
lut AS (SELECT pv.id, pv.m, book.code, list_distance(pv.s, book.s) * list_distance(pv.s, book.s) AS d2 FROM pv JOIN book ON book.m = pv.m),
codes AS (SELECT id, m, code FROM (SELECT *, row_number() OVER (PARTITION BY id, m ORDER BY round(sqrt(d2), 9), code) AS n FROM lut) WHERE n = 1),
near AS (SELECT pr.id AS qid, a.id AS id FROM pr JOIN a ON a.list_id = pr.list_id),
s AS (SELECT near.qid, near.id, round(sum(lut.d2), 9) AS d FROM near JOIN codes ON codes.id = near.id JOIN lut ON lut.id = near.qid AND lut.m = codes.m AND lut.code = codes.code GROUP BY 1, 2)"""


@query("knn_ivf_pq", f"WITH {IVF}, {_PQ}, {ranked('s')} SELECT qid, rank, id, round(d, 6) + 0e0 AS score FROM h")
def knn_ivf_pq(spark, sf):
    v = vectors(spark, sf)
    cent = centroids(v)
    return shown(A.knn_ivf_pq(v, vector_queries(spark, sf), K, cent, N_PROBE, ProductCodec.given(cent, PARTS)))


_BIT = "list_sum(list_transform(list_zip(q.e, b.e), lambda x: CASE WHEN (x[1] > 0) <> (x[2] > 0) THEN 1 ELSE 0 END))"
_JAC = "round(1 - list_sum(list_transform(list_zip(q.e, b.e), lambda x: CASE WHEN x[1] > 0 AND x[2] > 0 THEN 1 ELSE 0 END)) / CAST(list_sum(list_transform(list_zip(q.e, b.e), lambda x: CASE WHEN x[1] > 0 OR x[2] > 0 THEN 1 ELSE 0 END)) AS DOUBLE), 9)"


def bit_pairs(where="true", base="v", queries="v", name="s", distance=_BIT):
    return f"{name} AS (SELECT q.id AS qid, b.id AS id, CAST({distance} AS DOUBLE) AS d, q.e AS qe, b.e AS be FROM {queries} q, {base} b WHERE {where})"


@query("knn_binary", f"WITH {VECTORS}, {bit_pairs()}, {ranked('s')} SELECT qid, rank, id, d AS score FROM h")
def knn_binary(spark, sf):
    return shown(A.knn_binary(vectors(spark, sf), vector_queries(spark, sf), K))


@query("knn_binary_jaccard", f"WITH {VECTORS}, {bit_pairs(distance=_JAC)}, {ranked('s')} SELECT qid, rank, id, round(d, 6) + 0e0 AS score FROM h")
def knn_binary_jaccard(spark, sf):
    return shown(A.knn_binary(vectors(spark, sf), vector_queries(spark, sf), K, "jaccard"))


OVERSAMPLE = 4
_REFINED = {m: f"r AS (SELECT qid, id, {DISTANCE[m].format(q='qe', b='be')} AS d FROM h)" for m in ("cos", "l2")}


@query(
    "knn_rerank",
    f"WITH {VECTORS}, {bit_pairs()}, {ranked('s', k=K * OVERSAMPLE)}, {_REFINED['cos']}, {ranked('r', 'f')} SELECT qid, rank, id, round(d, 6) + 0e0 AS score FROM f",
)
def knn_rerank(spark, sf):
    return shown(A.knn_rerank(vectors(spark, sf), vector_queries(spark, sf), K, OVERSAMPLE))


@query(
    "knn_ivf_bq",
    f"WITH {IVF}, {bit_pairs('b.list_id = q.list_id', 'a', 'pr')}, {ranked('s', k=K * 2)}, {_REFINED['l2']}, {ranked('r', 'f')} SELECT qid, rank, id, round(d, 6) + 0e0 AS score FROM f",
)
def knn_ivf_bq(spark, sf):
    v = vectors(spark, sf)
    return shown(A.knn_ivf_bq(v, vector_queries(spark, sf), K, centroids(v), N_PROBE, 2))


# --- a stored index, built in one job and searched in another -------------------------------


def stored_index(spark, sf, cent, metric="l2", **codecs):
    return write_index(vectors(spark, sf), work_dir(spark, "index"), cent, metric, **codecs)


@query("stored_ivf_flat", ORACLES["knn_ivf_flat"])
def stored_ivf_flat(spark, sf):
    index = stored_index(spark, sf, centroids(vectors(spark, sf)))
    return shown(search_index(index, vector_queries(spark, sf), K, N_PROBE))


@query("stored_ivf_sq8", ORACLES["knn_ivf_sq8"])
def stored_ivf_sq8(spark, sf):
    v = vectors(spark, sf)
    index = stored_index(spark, sf, centroids(v), scalar=ScalarCodec.fit(v))
    return shown(search_index(index, vector_queries(spark, sf), K, N_PROBE, "sq"))


@query("stored_ivf_pq", ORACLES["knn_ivf_pq"])
def stored_ivf_pq(spark, sf):
    cent = centroids(vectors(spark, sf))
    index = stored_index(spark, sf, cent, product=ProductCodec.given(cent, PARTS))
    return shown(search_index(index, vector_queries(spark, sf), K, N_PROBE, "pq"))


@query("stored_ivf_bq", ORACLES["knn_ivf_bq"])
def stored_ivf_bq(spark, sf):
    index = stored_index(spark, sf, centroids(vectors(spark, sf)))
    return shown(search_index(index, vector_queries(spark, sf), K, N_PROBE, "bits", refine=2))


@query("trained_ivf_all_lists", exact_sql("cos"))
def trained_ivf_all_lists(spark, sf):
    """Trained centres, as many as the table calls for, probed by cosine; with every list probed the answer is exact."""
    v = vectors(spark, sf)
    n_lists = max(1, round(4 * v.count() ** 0.5))
    index = stored_index(spark, sf, train_centroids(v, n_lists), "cos")
    return shown(search_index(index, vector_queries(spark, sf), K, n_lists))


KINDS = {"flat": 0, "sq": 2, "pq": 12}  # candidates per neighbour that are measured again
TUNED = 0.97  # of the true neighbours of the tuning queries lie in the probed lists
ENOUGH = 0.9


@query(
    "trained_index_recall",
    f"SELECT kind, CAST({K} AS BIGINT) AS k, (SELECT count(*) FROM embeddings) AS queries, true AS fewer_lists, true AS recall_reached FROM (VALUES ('flat'), ('sq'), ('pq')) t(kind)",
)
def trained_index_recall(spark, sf):
    """Centres and product codes trained on the table, as many lists as its size calls for, probes tuned on a tenth of the queries; recall of all queries is measured."""
    v, q = vectors(spark, sf), vector_queries(spark, sf)
    n = v.count()
    truth = settle(nearest(v, q, K, "l2").select("qid", F.col("rank").alias("gt_rank"), "id"))
    product = ProductCodec.train(v, 16, bits=max(1, min(8, int(n / 8).bit_length() - 1)))
    index = stored_index(spark, sf, train_codes(v, 1, max(2, round(n**0.5)))[0], scalar=ScalarCodec.fit(v), product=product)
    tuning = F.pmod(F.xxhash64("qid"), F.lit(10)) == 0
    nprobe = probes_for(index, q.where(tuning), truth.where(tuning), TUNED)
    scored = None
    for kind, refine in KINDS.items():
        per_query = E.score_hits(search_index(index, q, K, nprobe, kind, refine), truth, K, q).select(F.lit(kind).alias("kind"), "recall")
        scored = per_query if scored is None else scored.unionByName(per_query)
    return scored.groupBy("kind").agg(
        F.lit(K).cast("bigint").alias("k"),
        F.count(F.lit(1)).alias("queries"),
        F.lit(nprobe < len(index.centroids)).alias("fewer_lists"),
        (F.avg("recall") >= ENOUGH).alias("recall_reached"),
    )


# --- ground truth -----------------------------------------------------------------------

_HALF_ID = "b.id >= CAST(floor((SELECT count(*) FROM v) * 0.5::DOUBLE) AS BIGINT)"
TRUTH = f"""{VECTORS}, {all_pairs('cos', name='s0')}, {ranked('s0', 'h0')}, {all_pairs('cos', _HALF_ID, name='s1')}, {ranked('s1', 'h1')},
{all_pairs('cos', 'b.label = 1', name='s2')}, {ranked('s2', 'h2')},
g AS (SELECT 'neighbors' AS filter_key, qid, rank AS gt_rank, id FROM h0 UNION ALL SELECT 'neighbors_int_50p', qid, rank, id FROM h1
UNION ALL SELECT 'neighbors_labels_label_10p', qid, rank, id FROM h2)"""


def all_truth(spark, sf):
    v = vectors(spark, sf)
    filters = T.truth_filters(v.count(), [0.5], {0.1: label_equals(F.col("label"), 1)})
    return T.build_ground_truth(v, vector_queries(spark, sf), K, filters).withColumn("gt_rank", F.col("gt_rank").cast("bigint"))


@query("build_ground_truth", f"WITH {TRUTH} SELECT * FROM g")
def build_ground_truth(spark, sf):
    return all_truth(spark, sf)


@query("scan_truth", f"WITH {TRUTH} SELECT qid, gt_rank, id FROM g WHERE filter_key = 'neighbors_int_50p'")
def scan_truth(spark, sf):
    from nearfield.sources.tables import select_truth, truth_table_name

    path = work_dir(spark, "truth")
    T.write_ground_truth(all_truth(spark, sf), path)
    return select_truth(spark.read.parquet(path), truth_table_name("int", 0.5)).withColumn("gt_rank", F.col("gt_rank").cast("bigint"))


_SWEEP = f"""{VECTORS}, {LISTS.format(probe=N_LISTS)}, {all_pairs('l2', 'b.list_id = q.list_id', 'a', 'pr', extra=', q.probe')},
grid AS (SELECT unnest([1, 4, 16]) AS nprobe), cut AS (SELECT nprobe, qid, id, d FROM s, grid WHERE probe < nprobe),
{ranked('cut', unit='nprobe, qid')}, {ranked('s', 't')}"""


@query(
    "ann_sweep",
    f"""WITH {_SWEEP}, hit AS (SELECT nprobe, h.qid, count(t.id) / {K}e0 AS recall FROM h LEFT JOIN t ON t.qid = h.qid AND t.id = h.id GROUP BY 1, 2),
    cost AS (SELECT nprobe, count(*) AS rows_scanned FROM cut GROUP BY 1)
    SELECT CAST(hit.nprobe AS BIGINT) AS nprobe, round(sum(recall) / (SELECT count(*) FROM v), 4) AS recall, max(rows_scanned) AS rows_scanned FROM hit JOIN cost ON cost.nprobe = hit.nprobe GROUP BY 1""",
)
def ann_sweep(spark, sf):
    v, q = vectors(spark, sf), vector_queries(spark, sf)
    cent, grid = centroids(v), [1, 4, 16]
    listed = A.assign_lists(v, cent)
    hits = A.sweep_nprobe(listed, q, K, cent, grid)
    exact = nearest(v, q, K, "l2").select("qid", "id", F.col("rank").alias("gt_rank"))
    units = F.struct("nprobe", "qid")
    steps = F.explode(F.array(*[F.lit(p) for p in grid])).alias("nprobe")
    truth = exact.select("*", steps).withColumn("qid", units)
    scores = E.score_hits(hits.withColumn("qid", units), truth, K)
    cost = A.scan_cost(listed, A.probe_lists(q, cent, max(grid)), grid)
    mean = scores.groupBy(F.col("qid.nprobe").alias("nprobe")).agg(F.round(F.avg("recall"), 4).alias("recall"))
    return mean.join(cost, "nprobe").select(F.col("nprobe").cast("bigint").alias("nprobe"), "recall", "rows_scanned")


GRID_PROBES, GRID_OVERSAMPLES = [2, 8, 16], [1, 4, 12]
_GRID = f"""{VECTORS}, {LISTS.format(probe=N_LISTS)}, {bit_pairs('b.list_id = q.list_id', 'a', 'pr').replace('AS d,', 'AS d, q.probe,')},
np AS (SELECT unnest({GRID_PROBES}) AS nprobe), os AS (SELECT unnest({GRID_OVERSAMPLES}) AS oversample),
cut AS (SELECT nprobe, qid, id, d, qe, be FROM s, np WHERE probe < nprobe),
place AS (SELECT *, row_number() OVER (PARTITION BY nprobe, qid ORDER BY d, id) AS n FROM cut),
fine AS (SELECT nprobe, oversample, qid, id, {DISTANCE['l2'].format(q='qe', b='be')} AS d FROM place, os WHERE n <= {K} * oversample),
{ranked('fine', unit='nprobe, oversample, qid')}, {all_pairs('l2', name='every')}, {ranked('every', 't')}"""


@query(
    "ann_grid",
    f"""WITH {_GRID}, hit AS (SELECT nprobe, oversample, count(*) AS n FROM h JOIN t ON t.qid = h.qid AND t.id = h.id GROUP BY 1, 2),
    scan AS (SELECT nprobe, count(*) AS rows_scanned FROM cut GROUP BY 1), more AS (SELECT nprobe, oversample, count(*) AS rows_refined FROM fine GROUP BY 1, 2)
    SELECT CAST(more.nprobe AS BIGINT) AS nprobe, CAST(more.oversample AS BIGINT) AS oversample, round(hit.n / {K}e0 / (SELECT count(*) FROM v), 4) AS recall, rows_scanned, rows_refined
    FROM more JOIN scan ON scan.nprobe = more.nprobe JOIN hit ON hit.nprobe = more.nprobe AND hit.oversample = more.oversample""",
)
def ann_grid(spark, sf):
    """Recall against rows scanned and refined for every pair of probes and oversampling, from one search."""
    v, q = vectors(spark, sf), vector_queries(spark, sf)
    cent = centroids(v)
    listed = A.assign_lists(v, cent)
    hits = A.sweep_grid(listed, q, K, cent, GRID_PROBES, GRID_OVERSAMPLES)
    truth = nearest(v, q, K, "l2").select("qid", "id")
    n = q.count()
    recall = hits.join(truth, ["qid", "id"]).groupBy("nprobe", "oversample").agg(F.round(F.count(F.lit(1)) / K / n, 4).alias("recall"))
    cost = A.grid_cost(listed, A.probe_lists(q, cent, max(GRID_PROBES)), GRID_PROBES, GRID_OVERSAMPLES, K)
    both = recall.join(cost, ["nprobe", "oversample"])
    return both.select(F.col("nprobe").cast("bigint").alias("nprobe"), F.col("oversample").cast("bigint").alias("oversample"), "recall", "rows_scanned", "rows_refined")


# --- evaluation of the sign-bit search against exact truth ------------------------------

_EVAL = f"{VECTORS}, {all_pairs('cos', name='s0')}, {ranked('s0', 't')}, {bit_pairs()}, {ranked('s')}"
_IDEAL = "(SELECT sum(1 / log2(i + 2)) FROM (SELECT unnest(range(0, 10)) AS i))"
_SCORES = f"""sc AS (SELECT v.id AS qid, count(t.id) / {K}e0 AS recall, coalesce(sum(1 / log2(t.rank + 2)), 0e0) / {_IDEAL} AS ndcg
FROM v LEFT JOIN h ON h.qid = v.id LEFT JOIN t ON t.qid = h.qid AND t.id = h.id GROUP BY 1)"""


def scores(spark, sf):
    v, q = vectors(spark, sf), vector_queries(spark, sf)
    truth = nearest(v, q, K, "cos").select("qid", F.col("rank").alias("gt_rank"), "id")
    return E.score_hits(A.knn_binary(v, q, K), truth, K, q)


@query("recall_at_k", f"WITH {_EVAL}, {_SCORES} SELECT qid, round(recall, 6) AS recall FROM sc")
def recall_at_k(spark, sf):
    return scores(spark, sf).select("qid", F.round("recall", 6).alias("recall"))


@query("ndcg_at_k", f"WITH {_EVAL}, {_SCORES} SELECT qid, round(ndcg, 6) AS ndcg FROM sc")
def ndcg_at_k(spark, sf):
    return scores(spark, sf).select("qid", F.round("ndcg", 6).alias("ndcg"))


@query(
    "eval_rollup",
    f"WITH {_EVAL}, {_SCORES} SELECT 'run_' || CAST(qid % 5 AS VARCHAR) AS run, count(*) AS queries, round(avg(recall), 4) AS avg_recall, round(avg(ndcg), 4) AS avg_ndcg, round(sum(qid / 1e3), 4) AS cost_s FROM sc GROUP BY 1",
)
def eval_rollup(spark, sf):
    rows = scores(spark, sf).select(
        F.concat(F.lit("run_"), (F.col("qid") % 5).cast("string")).alias("run"), "recall", "ndcg", (F.col("qid") / 1e3).alias("latency_s")
    )
    return E.rollup(rows)


@query(
    "rerank_recall",
    f"""WITH {VECTORS}, {all_pairs('cos', name='s0')}, {ranked('s0', 't')}, {bit_pairs()}, {ranked('s', k=K * OVERSAMPLE)}, {_REFINED['cos']}, {ranked('r', 'f')}
    SELECT 'binary_rerank' AS run, CAST({K} AS BIGINT) AS k, (SELECT count(*) FROM v) AS queries, round(count(*) / {K}e0 / (SELECT count(*) FROM v), 4) AS avg_recall FROM f JOIN t ON t.qid = f.qid AND t.id = f.id""",
)
def rerank_recall(spark, sf):
    """Flagship: mean recall of sign bits with re-ranking against exact truth."""
    v, q = vectors(spark, sf), vector_queries(spark, sf)
    truth = nearest(v, q, K, "cos").select("qid", F.col("rank").alias("gt_rank"), "id")
    per_query = E.score_hits(A.knn_rerank(v, q, K, OVERSAMPLE), truth, K, q).withColumn("run", F.lit("binary_rerank"))
    return E.rollup(per_query).select("run", F.lit(K).cast("bigint").alias("k"), "queries", "avg_recall")
