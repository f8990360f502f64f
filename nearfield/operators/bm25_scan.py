"""Numpy helpers of the BM25 scan: count and score query terms inside Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from nearfield.operators.kernels import DECIMALS, RunningTopK

_CELLS = 1 << 22
WHOLE_NO = -1
STATS_DDL = "term_no INT, df BIGINT, total_dl BIGINT"
PARTIAL_DDL = "qid BIGINT, doc_id BIGINT, score DOUBLE"


@dataclass(frozen=True)
class QueryTerms:
    """Query terms grouped by term: the queries of term ``t`` lie at ``starts[t]:starts[t + 1]``."""

    vocabulary: pa.Array
    qids: np.ndarray
    starts: np.ndarray
    query: np.ndarray
    weight: np.ndarray

    @classmethod
    def build(cls, asked: pa.Table) -> QueryTerms:
        coded = asked["term"].combine_chunks().dictionary_encode()
        term = coded.indices.to_numpy(zero_copy_only=False)
        qids, query = np.unique(asked["qid"].to_numpy(), return_inverse=True)
        order = np.lexsort((query, term))
        starts = np.r_[0, np.cumsum(np.bincount(term, minlength=len(coded.dictionary)))]
        return cls(coded.dictionary, qids, starts, query[order], asked["qtf"].to_numpy()[order].astype(np.float64))

    def parts(self) -> tuple:
        """Plain values to broadcast; ``QueryTerms(*parts)`` restores them."""
        return self.vocabulary, self.qids, self.starts, self.query, self.weight

    def weighted(self, idf: np.ndarray) -> QueryTerms:
        """With each count multiplied by the idf of its term."""
        return QueryTerms(self.vocabulary, self.qids, self.starts, self.query, self.weight * np.repeat(idf, np.diff(self.starts)))


def _counts(tokens: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term number and frequency of every query term in a batch of token lists."""
    number = pc.fill_null(pc.index_in(tokens.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(tokens)), tokens.value_lengths().to_numpy(zero_copy_only=False))
    known = number >= 0
    cells, tf = np.unique(row[known] * np.int64(len(vocabulary)) + number[known], return_counts=True)
    return cells // len(vocabulary), cells % len(vocabulary), tf


def count_terms(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``dl, tokens`` batches to one partial row per term of the task, and one for all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = QueryTerms(*shared.value)
        df, docs, length = np.zeros(len(terms.vocabulary), dtype=np.int64), 0, 0
        for batch in batches:
            _, number, _ = _counts(batch.column(1), terms.vocabulary)
            df += np.bincount(number, minlength=len(df))
            docs, length = docs + batch.num_rows, length + int(batch.column(0).to_numpy().sum())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.r_[seen, WHOLE_NO].astype(np.int32)),
                pa.array(np.r_[df[seen], docs].astype(np.int64)),
                pa.array(np.r_[np.zeros(len(seen)), length].astype(np.int64)),
            ],
            names=["term_no", "df", "total_dl"],
        )

    return run


def score_documents(shared, k: int, k1: float, b: float, avgdl: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``doc_id, dl, tokens`` batches to the k best documents of each query in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = QueryTerms(*shared.value)
        best = RunningTopK(len(terms.qids), k)
        step = max(1, _CELLS // max(1, len(terms.qids)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                row, number, tf = _counts(part.column(2), terms.vocabulary)
                dl = part.column(1).to_numpy().astype(np.float64)[row]
                value = tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl / avgdl))
                _offer(best, terms, part.column(0).to_numpy(), row, number, value)
        if len(best.q):
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms.qids[best.q]), pa.array(best.ids), pa.array(-best.d + 0.0)], names=["qid", "doc_id", "score"]
            )

    return run


def _offer(best: RunningTopK, terms: QueryTerms, ids: np.ndarray, row: np.ndarray, number: np.ndarray, value: np.ndarray) -> None:
    """Add up the query sums of a block of documents and offer them."""
    n = len(ids)
    total = np.zeros(len(terms.qids) * n)
    fan = np.diff(terms.starts)[number]
    ends = np.cumsum(fan)
    lo = 0
    while lo < len(row):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + _CELLS, side="right")))
        each = fan[lo:hi]
        within = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        place = np.repeat(terms.starts[number[lo:hi]], each) + within
        cell = terms.query[place] * n + np.repeat(row[lo:hi], each)
        total += np.bincount(cell, weights=terms.weight[place] * np.repeat(value[lo:hi], each), minlength=len(total))
        lo = hi
    score = -(np.round(total.reshape(-1, n), DECIMALS) + 0.0)
    cut = best.bound
    if n > best.k:
        cut = np.minimum(cut, np.partition(score, best.k - 1, axis=1)[:, best.k - 1])
    q, r = np.nonzero((score <= cut[:, None]) & (total.reshape(-1, n) > 0))
    best.offer(q, score[q, r], ids[r])
