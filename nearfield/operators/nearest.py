"""Exact nearest-neighbour join: the k nearest base rows of every query row.

Queries whose measured size fits the broadcast budget are sent to the executors once.
Each task streams its base partition through Arrow, keeps only the running k best per
query, and the shuffle carries ``partitions x queries x k`` rows. With ``key`` columns a
query meets only the base rows that share one of its keys (tenant routing, probed lists).
No row is ever moved by key, so a key that holds a large share of the table is spread
over as many tasks as its partitions.

A query table beyond the budget, or one that would make too many rows of partial results, is dealt
out instead: a task owns a bounded group of queries, and all base rows that may concern them stream
past it, so that it keeps only its queries and their k best, which are final. With many keys the
groups are made by key, hot keys are cut on either side, and the results of the cells are merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from nearfield.functions.vector import block_metric, block_single, lower_is_nearer
from nearfield.operators.kernels import DECIMALS, BitKernel, DenseKernel, FunctionKernel, ProductKernel, RunningTopK, scan_block
from nearfield.sizing import broadcast_bounded, broadcast_if_small, settle

QUERY_BYTES = 256 * 1024 * 1024
PARTIAL_HITS = 500_000  # of one task, above which queries are dealt out
SLAB_ROWS = 1_000_000  # queries that a task owns at most
SLAB_BYTES = 96 * 1024 * 1024  # of queries and results that a task owns at most
LEAST_ROWS = 64  # queries that are not worth another task
KEYED_ROWS, PLAIN_ROWS = 1 << 16, 1 << 13  # base rows that are measured together
ISIN_KEYS = 500
FEW_KEYS = 64
_OUT_ROWS = 1 << 16


def pair_distance(metric: str, a: Column, b: Column) -> Column:
    """Distance of two vectors in one row, as the searches measure it; null if undirected."""

    @F.arrow_udf("double")
    def measured(left: pa.Array, right: pa.Array) -> pa.Array:
        kernel = DenseKernel(metric, matrix(left))
        d = kernel.exact(np.arange(len(left)), kernel.prepare(matrix(right))) if len(left) else np.empty(0)
        return pa.array(kernel.settled(d) if len(left) else d, mask=np.isnan(d))

    # Marked so that a filter on the result does not measure twice.
    return measured.asNondeterministic()(a, b)


def shown(score: Column) -> Column:
    """A score with the decimals that are shown."""
    return F.rint(score * 10.0**DECIMALS) / 10.0**DECIMALS + F.lit(0.0)


def kernel_for(metric: str) -> Callable:
    """The block kernel of a metric name."""
    if metric in ("hamming", "jaccard"):
        return lambda queries: BitKernel(metric, queries)
    if metric in ("l2", "cos", "ip", "dp"):
        return lambda queries: DenseKernel(metric, queries)
    block, sign = block_metric(metric), 1 if lower_is_nearer(metric) else -1
    single = block_single(metric)
    return lambda queries: FunctionKernel(block, sign, queries, single)


def matrix(column: pa.Array | pa.ChunkedArray, ids: pa.Array | pa.ChunkedArray | None = None, width: int | None = None) -> np.ndarray:
    """A list column of equal-length, non-null vectors as a 2-D array; another length is an error that names the row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(lengths) and (odd := np.flatnonzero(lengths != (lengths[0] if width is None else width))).size:
        row = int(odd[0])
        name = f"id {ids[row].as_py()}" if ids is not None else f"row {row}"
        raise ValueError(f"vector of {name} has {lengths[row]} components, others have {lengths[0] if width is None else width}")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def top_k(scored: DataFrame, k: int, group: str = "qid", score: str = "score", tie: str = "id", ascending: bool = True) -> DataFrame:
    """Keep the k best rows of each group with a 0-based ``rank``; ties go to the lower id.

    Spark cuts each task's rows to k per group before the shuffle, so a group that holds
    most of the table does not travel whole.
    """
    by = F.col(score).asc() if ascending else F.col(score).desc()
    order = Window.partitionBy(group).orderBy(by, F.col(tie).asc())
    ranked = scored.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k)
    return ranked.withColumn("rank", F.col("_place") - 1).drop("_place")


def nearest(
    base: DataFrame,
    queries: DataFrame | QuerySet,
    k: int,
    metric: str = "l2",
    key: str | None = None,
    kernel: Callable | None = None,
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """The k nearest base rows of every query: ``qid, rank, id, score``.

    ``base`` has ``id, emb`` and ``queries`` has ``qid, emb`` (and ``key`` on both sides
    when given; a query may appear once per key, or carry an array of its keys). Filters belong on ``base`` before the
    call, where they reach the scan. Ties (equal to 14 digits) are ordered by id; scores are
    shown with 9 decimals. Rows with a null or undirected (zero, for cosine) vector are never
    ranked. A query id that stands for several vectors is one query, with the least of them.
    Ids are whole numbers; other types, and vectors of unequal length, are errors. ``metric`` is a
    built-in name or one given to ``register_metric`` with its block form.
    """
    hits = _search(base, queries, k, kernel or kernel_for(metric), key, query_bytes, None)
    score = shown(F.col("score") if lower_is_nearer(metric) else -F.col("score"))
    return hits.select("qid", F.coalesce("rank", F.lit(0)).cast("int").alias("rank"), "id", score.alias("score"))


def nearest_partial(base: DataFrame, queries: QuerySet, k: int, metric: str = "l2") -> DataFrame:
    """The k nearest of the rows that each task reads, not merged yet: ``qid, id, score``. ``nearest`` are the k best of them."""
    hits = _search(base, queries, k, kernel_for(metric), None, 0, None, merged=False)
    return hits.select("qid", "id", shown(F.col("score") if lower_is_nearer(metric) else -F.col("score")).alias("score"))


def nearest_refined(
    base: DataFrame,
    queries: DataFrame,
    k: int,
    cuts: list[int],
    metric: str,
    key: str | None = None,
    kernel: Callable | None = None,
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """Rows fetched by a code and measured by their vectors, in one scan: ``cut, qid, rank, id, score``.

    Both sides carry the vector ``full`` beside the code ``emb``, which ``kernel`` compares (sign bits
    by default). Of the first ``cut`` rows in the order of the codes the k nearest by a built-in
    ``metric`` are kept, for each cut. A row that the search holds is measured where it is read, so no
    vector is fetched by id; ids that stand for several rows count as that many.
    """
    fine = Fine(metric, k, tuple(sorted(set(cuts))))
    hits = _search(base, queries, fine.cuts[-1], kernel or kernel_for("hamming"), key, query_bytes, fine)
    score = shown(F.col("score") if lower_is_nearer(metric) else -F.col("score"))
    return hits.select("cut", "qid", F.coalesce("rank", F.lit(0)).cast("int").alias("rank"), "id", score.alias("score"))


@dataclass(frozen=True)
class Fine:
    """A second measure by which ``keep`` rows are kept out of the first ``cuts`` of the others."""

    metric: str
    keep: int
    cuts: tuple[int, ...]


def _search(base: DataFrame, queries: DataFrame | QuerySet, k: int, make: Callable, key: str | None, query_bytes: int, fine: Fine | None, merged: bool = True) -> DataFrame:
    """``qid, rank, id, score`` with scores that are nearer if lower, and ``cut`` with a second measure."""
    _whole(base, "id")
    extra = ["full"] if fine else []
    asked = queries if isinstance(queries, QuerySet) else prepare_queries(queries, key, query_bytes, PARTIAL_HITS // max(1, k), extra)
    rows = base.where(F.col("emb").isNotNull() & F.col("id").isNotNull()).select(
        F.col("id").cast("bigint").alias("id"), "emb", *extra, *([F.col(key).alias("key")] if key else [])
    )
    if asked.shared is not None:
        partial = _scan_broadcast(rows, asked, k, make, key is not None, fine)
        return _merged(partial, k, fine) if merged else partial
    return _scan_owned(rows, asked, k, make, key is not None, fine)


def _merged(partial: DataFrame, k: int, fine: Fine | None) -> DataFrame:
    hits = top_k(partial, k)
    if not fine:
        return hits
    cuts = F.filter(F.array(*[F.lit(c) for c in fine.cuts]), lambda c: c > F.col("rank"))
    each = hits.where(~F.isnan("fine")).select("qid", "id", F.col("fine").alias("score"), F.explode(cuts).alias("cut"))
    if len(fine.cuts) == 1:
        return top_k(each, fine.keep)
    return top_k(each.withColumn("_unit", F.struct("cut", "qid")), fine.keep, group="_unit").drop("_unit")


def _whole(df: DataFrame, column: str) -> None:
    kind = df.schema[column].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{column} is {kind}; searches take whole-number ids")


@dataclass(frozen=True)
class QuerySet:
    """A query table (``qid, emb``, other vectors, ``keys``) ready to be searched with, any number of times.

    ``shared`` holds (query ids, vectors, other vectors, queries per key) on the executors, or is None
    for a table beyond the budget. ``rows`` and ``width`` are its measured rows and bytes a row.
    ``limits`` holds a distance for each query id, beyond which no rows are asked for.
    """

    table: DataFrame
    keys: list
    shared: Broadcast | None
    rows: int
    width: int
    limits: Broadcast | None = None


def prepare_queries(queries: DataFrame, key: str | None = None, query_bytes: int = QUERY_BYTES, most: int | None = None, extra: list[str] | None = None) -> QuerySet:
    """Measure a query table and broadcast it if it fits the budget, and ``most`` rows. One vector per query id, the least, on either path."""
    _whole(queries, "qid")
    vectors = ["emb", *(extra or [])]
    rows = queries.where(F.col("emb").isNotNull() & F.col("qid").isNotNull()).select(
        F.col("qid").cast("bigint").alias("qid"), *vectors, *([F.col(key).alias("key")] if key else [])
    )
    least = F.min(F.struct(*vectors)).alias("least")
    if key:
        many = isinstance(rows.schema["key"].dataType, T.ArrayType)
        names = F.array_distinct(F.array_compact(F.flatten(F.collect_list("key")))) if many else F.collect_set("key")
        rows = rows.groupBy("qid").agg(least, names.alias("keys"))
    else:
        rows = rows.groupBy("qid").agg(least)
    rows = rows.select("qid", *[F.col("least")[c].alias(c) for c in vectors], *(["keys"] if key else []))
    width = sum((F.size(c) * 8 for c in [*vectors, *(["keys"] if key else [])]), F.lit(64))
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    if size > query_bytes or most is not None and n > most:
        return QuerySet(rows, [], None, n, -(-size // max(n, 1)))
    table = rows.toArrow()
    table = table.take(pa.array(np.argsort(table["qid"].to_numpy(), kind="stable"))).combine_chunks()
    groups = _members(table["keys"]) if key else None
    points = [matrix(table[c], table["qid"]) for c in vectors]
    shared = queries.sparkSession.sparkContext.broadcast((table["qid"].to_numpy(), *points[:1], points[1] if extra else None, groups))
    return QuerySet(rows, list(groups or {}), shared, n, -(-size // max(n, 1)))


def _members(keys: pa.ChunkedArray | pa.Array) -> dict:
    """Places of the rows that name each key, in order."""
    keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
    owner = np.repeat(np.arange(len(keys), dtype=np.int32), keys.value_lengths().to_numpy(zero_copy_only=False))
    return {name: owner[mine] for name, mine in _by_key(keys.flatten())}


def _by_key(keys: pa.ChunkedArray | pa.Array) -> Iterator[tuple]:
    """Each key and the places of its rows, in order."""
    coded = (keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    ends = np.cumsum(np.bincount(codes, minlength=len(coded.dictionary))) if len(codes) else []
    at = 0
    for name, end in zip(coded.dictionary.to_pylist(), ends):
        yield name, order[at:end]
        at = end


class _Task:
    """Queries that a task holds, and the best of the base rows that have passed."""

    def __init__(self, names: np.ndarray, points: np.ndarray, full: np.ndarray | None, members: dict | None, k: int, make: Callable, fine: Fine | None, limits: np.ndarray | None = None):
        self.names, self.members, self.every, self.fine = names, members, np.arange(len(names)), fine
        self.kernel, self.state = make(points), RunningTopK(len(names), k, fine is not None, limits)
        self.second = DenseKernel(fine.metric, full) if fine else None
        # Product codes are shorter than the vectors asked.
        self.width = points.shape[1] if type(self.kernel) in (DenseKernel, BitKernel, FunctionKernel) else None
        self.waiting: list[pa.RecordBatch] = []
        self.rows = 0

    def take(self, batch: pa.RecordBatch) -> None:
        """Base rows ``id, emb`` and, where there are such, ``full, key``."""
        if batch.num_rows and len(self.names):
            self.waiting.append(batch)
            self.rows += batch.num_rows
            if self.rows >= (PLAIN_ROWS if self.members is None else KEYED_ROWS):
                self.measure()

    def measure(self) -> None:
        if not self.rows:
            return
        table = pa.Table.from_batches(self.waiting).combine_chunks()
        self.waiting, self.rows = [], 0
        ids, rows = table["id"].to_numpy(), matrix(table["emb"], table["id"], self.width)
        full = matrix(table["full"], table["id"], self.second.raw.shape[1]) if self.fine else None
        for q, mine in [(self.every, slice(None))] if self.members is None else ((self.members.get(name), mine) for name, mine in _by_key(table["key"])):
            if q is not None:
                scan_block(self.kernel, self.state, q, ids[mine], rows[mine], (self.second, full[mine]) if self.fine else None)

    def partial(self) -> Iterator[pa.RecordBatch]:
        self.measure()
        state = self.state
        columns = {"qid": self.names[state.q], "id": state.ids, "score": state.d}
        yield from _batches(columns | ({"fine": state.fine} if self.fine else {}))

    def final(self) -> Iterator[pa.RecordBatch]:
        """The held rows with their places, where no other task has rows for these queries."""
        self.measure()
        state = self.state
        if not self.fine:
            q = state.q
            yield from _batches({"qid": self.names[q], "rank": _ranks(q), "id": state.ids, "score": state.d})
            return
        for cut in self.fine.cuts:
            q, ids, d = state.refined(cut, self.fine.keep)
            yield from _batches({"cut": np.full(len(q), cut, np.int32), "qid": self.names[q], "rank": _ranks(q), "id": ids, "score": d})


def _ranks(q: np.ndarray) -> np.ndarray:
    starts = np.searchsorted(q, q, side="left")
    return (np.arange(len(q)) - starts).astype(np.int32)


def _batches(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size."""
    table = pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))
    for at in range(0, table.num_rows, _OUT_ROWS):
        yield table.slice(at, _OUT_ROWS)


def _ddl(fine: Fine | None, final: bool) -> str:
    if final:
        return ("cut INT, " if fine else "") + "qid BIGINT, rank INT, id BIGINT, score DOUBLE"
    return "qid BIGINT, id BIGINT, score DOUBLE" + (", fine DOUBLE" if fine else "")


def _scan_broadcast(base: DataFrame, asked: QuerySet, k: int, make: Callable, keyed: bool, fine: Fine | None) -> DataFrame:
    shared, limits = asked.shared, asked.limits

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Task(*shared.value, k, make, fine, limits.value if limits else None)
        for batch in batches:
            task.take(batch)
        yield from task.partial()

    if keyed:
        base = _only_keys(base, asked.table.select(F.explode("keys").alias("key")).distinct(), asked.keys)
    return base.mapInArrow(scan, _ddl(fine, False))


def _only_keys(base: DataFrame, wanted: DataFrame, keys: list) -> DataFrame:
    """Leave out base rows nobody asks for, by a filter that reaches the scan or a semi join."""
    if len(keys) <= ISIN_KEYS:
        return base.where(F.col("key").isin(keys))
    return base.join(broadcast_bounded(wanted, len(keys), 64), "key", "left_semi").select(*base.columns)


def _scan_owned(base: DataFrame, asked: QuerySet, k: int, make: Callable, keyed: bool, fine: Fine | None) -> DataFrame:
    cores = base.sparkSession.sparkContext.defaultParallelism
    held = max(1, min(SLAB_ROWS, SLAB_BYTES // (asked.width + 24 * k)))
    groups = max(-(-asked.rows // held), min(cores, -(-asked.rows // LEAST_ROWS)), 1)
    groups = -(-groups // cores) * cores if groups > cores else groups
    queries, plan = asked.table, None
    if keyed:
        queries = settle(queries)
        wanted = queries.select(F.explode("keys").alias("key")).distinct()
        names = [r["key"] for r in wanted.limit(ISIN_KEYS + 1).collect()]
        if FEW_KEYS < len(names) and queries.where(F.size("keys") > 1).isEmpty():
            plan = _cells(base, queries, groups)
        else:
            base = _only_keys(base, wanted, names) if len(names) <= ISIN_KEYS else base.join(broadcast_if_small(wanted), "key", "left_semi").select(*base.columns)
    if plan is not None:
        cell = F.pmod(F.xxhash64("key") + F.col("_i") * F.col("base_cuts") + F.col("_j"), F.lit(groups)).cast("int")
        queries = queries.withColumn("key", F.element_at("keys", 1)).join(plan, "key").withColumn("_i", F.pmod(F.xxhash64("qid"), F.col("query_cuts")))
        queries = queries.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("base_cuts") - 1))).withColumn("task", cell)
        base = base.join(plan, "key").withColumn("_j", F.pmod(F.xxhash64("id"), F.col("base_cuts")))
        base = base.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("query_cuts") - 1))).withColumn("task", cell)
    else:
        queries = queries.withColumn("task", F.pmod(F.xxhash64("qid"), F.lit(groups)).cast("int"))
        base = base.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    extra, key = (["full"] if fine else []), (["key"] if keyed else [])
    lists = ["keys"] if keyed else []

    def empty(df: DataFrame, column: str, name: str) -> Column:
        return F.lit(None).cast(df.schema[column].dataType).alias(name)

    asking = queries.select("task", F.lit(0).alias("side"), F.col("qid").alias("id"), empty(base, "emb", "emb"), *extra, *[empty(base, c, c) for c in key], F.col("emb").alias("asked"), *lists)
    passing = base.select("task", F.lit(1).alias("side"), "id", "emb", *extra, *key, empty(queries, "emb", "asked"), *[empty(queries, c, c) for c in lists])
    met = asking.unionByName(passing).repartitionById(groups, F.col("task")).sortWithinPartitions("task", "side", *key)
    partial = plan is not None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, asking, task = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            mark = batch.column(0).to_numpy().astype(np.int64) * 2 + batch.column(1).to_numpy()
            starts = np.flatnonzero(np.r_[True, mark[1:] != mark[:-1]])
            for lo, hi in zip(starts, np.r_[starts[1:], len(mark)]):
                part = batch.slice(lo, hi - lo)
                if mark[lo] // 2 != number:
                    if task is not None:
                        yield from task.partial() if partial else task.final()
                    number, asking, task = mark[lo] // 2, [], None
                if mark[lo] % 2 == 0:
                    asking.append(part)
                elif asking or task is not None:
                    if task is None:
                        task, asking = start(asking), []
                    task.take(part.select(["id", "emb", *extra, *key]))
        if task is not None:
            yield from task.partial() if partial else task.final()

    def start(asking: list[pa.RecordBatch]) -> _Task:
        table = pa.Table.from_batches(asking).combine_chunks()
        full = matrix(table["full"], table["id"]) if fine else None
        return _Task(table["id"].to_numpy(), matrix(table["asked"], table["id"]), full, _members(table["keys"]) if keyed else None, k, make, fine)

    found = met.mapInArrow(scan, _ddl(fine, not partial))
    return _merged(found, k, fine) if partial else found


def _cells(base: DataFrame, queries: DataFrame, groups: int) -> DataFrame:
    """Into how many parts the queries and the base rows of each key are cut, by their share: ``key, query_cuts, base_cuts``."""
    asks = queries.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("asks"))
    both = settle(base.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).join(asks, "key"))
    all_asks, all_rows = both.agg(F.coalesce(F.sum("asks"), F.lit(1)), F.coalesce(F.sum("rows"), F.lit(1))).first()
    cuts = both.select("key", F.ceil(F.col("asks") * F.lit(groups) / F.lit(all_asks)).alias("query_cuts"), F.ceil(F.col("rows") * F.lit(groups) / F.lit(all_rows)).alias("base_cuts"))
    return broadcast_if_small(cuts)
