"""Numpy helpers of block postings: invert documents where they are read, and rank from the blocks.

A segment is a run of documents of one task, numbered from 0. It is stored as one row for the
empty term, with the ids and lengths of its documents, and rows of at most ``BLOCK`` postings of a
term: document numbers as differences and term frequencies as base-128 numbers, next to the
greatest frequency and the least document length. These two bound what the block can add to a
score under any parameters, which is what the ranking leaves blocks out by.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

from nearfield.operators.bm25_scan import QueryTerms
from nearfield.operators.kernels import DECIMALS

BLOCK = 1024
SEGMENT_DOCS = 1 << 16
SEGMENT_BYTES = 8 << 20  # of tokens; a worker holds some 12 times as much while it inverts them
WHOLE = ""  # no token is empty, so this term stands for the documents of the segment
_SLACK = 2.0 * 10.0**-DECIMALS  # scores are compared after rounding


def pack_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative numbers in base 128, low digit first, a set high bit where another follows; and the bytes of each."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for shift in range(7, 63, 7):
        more = values >= np.uint64(1) << np.uint64(shift)
        if not more.any():
            break
        sizes += more
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for digit in range(int(sizes.max(initial=0))):
        has = np.flatnonzero(sizes > digit)
        low = (values[has] >> np.uint64(7 * digit)) & np.uint64(127)
        out[(ends - sizes)[has] + digit] = low | (sizes[has] > digit + 1).astype(np.uint64) << np.uint64(7)
    return out, sizes


def unpack_numbers(raw: bytes) -> np.ndarray:
    """The numbers that ``pack_numbers`` wrote."""
    digits = np.frombuffer(raw, np.uint8)
    if not len(digits):
        return np.empty(0, np.int64)
    starts = np.r_[0, np.flatnonzero(digits < 128)[:-1] + 1]
    place = np.arange(len(digits)) - np.repeat(starts, np.diff(np.r_[starts, len(digits)]))
    return np.add.reduceat((digits & 127).astype(np.int64) << 7 * place, starts)


def block_schema(ids: pa.DataType) -> pa.Schema:
    whole = [("segment", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("max_tf", pa.int64()), ("min_dl", pa.int64()), ("total_dl", pa.int64())]
    return pa.schema([*whole, ("data", pa.binary()), ("ids", pa.list_(ids))])


def _binaries(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.r_[0, ends].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def _invert(segment: int, ids: pa.Array, tokens: pa.Array, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of one segment, in the order of their terms."""
    n, dl = len(ids), tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    lengths, _ = pack_numbers(dl)
    head = [[segment], [WHOLE], [n], [0], [n - 1], [0], [int(dl.min())], [int(dl.sum())], [lengths.tobytes()]]
    everyone = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids)
    yield pa.RecordBatch.from_arrays([*[pa.array(v, f.type) for v, f in zip(head, schema)], everyone], schema=schema)
    coded = tokens.flatten().dictionary_encode()
    if not len(coded.dictionary):
        return
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    cells = rank[coded.indices.to_numpy()]
    cells *= n
    cells += np.repeat(np.arange(n, dtype=np.int32), dl)
    cells.sort()
    new = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    tf, cells = np.diff(np.r_[new, len(cells)]), cells[new]
    term, doc = cells // n, cells % n
    first_of_term = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    within = np.arange(len(term)) - np.repeat(first_of_term, np.diff(np.r_[first_of_term, len(term)]))
    starts = np.flatnonzero(within % BLOCK == 0)
    step = np.diff(doc, prepend=0)
    step[starts] = doc[starts]
    flat, sizes = pack_numbers(np.column_stack((step, tf)).ravel())
    stops = np.r_[starts[1:], len(term)]
    byte_ends = np.cumsum(sizes)[2 * stops - 1]
    columns = [
        np.full(len(starts), segment), None, stops - starts, doc[starts].astype(np.int32), doc[stops - 1].astype(np.int32),
        np.maximum.reduceat(tf, starts), np.minimum.reduceat(dl[doc], starts), np.add.reduceat(dl[doc], starts),
    ]
    arrays = [pa.array(c) if c is not None else coded.dictionary.take(order).take(pa.array(term[starts])) for c in columns]
    arrays += [_binaries(flat, byte_ends), pa.nulls(len(starts), schema.field("ids").type)]
    yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)


def write_blocks(ids: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``doc_id, tokens`` batches to the rows of segments of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, number = block_schema(ids), TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        docs = size = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                more = pc.sum(pc.binary_length(part.column(1).flatten())).as_py() or 0
                if held and (docs + part.num_rows > SEGMENT_DOCS or size + more > SEGMENT_BYTES):
                    yield from _whole(number, held, schema)
                    number, held, docs, size = number + 1, [], 0, 0
                held.append(part)
                docs, size = docs + part.num_rows, size + more
        if held:
            yield from _whole(number, held, schema)

    return run


def _whole(number: int, held: list[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(held)
    yield from _invert(number, *(table.column(c).combine_chunks() for c in (0, 1)), schema)


def read_block(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Document numbers and term frequencies of a block."""
    pairs = unpack_numbers(data).reshape(-1, 2)
    return np.cumsum(pairs[:, 0]), pairs[:, 1]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[dict]]]:
    """The row of the documents and the rows of the blocks of each segment, from rows sorted by segment and term."""
    head, rows = None, []
    for batch in batches:
        for start in range(0, batch.num_rows, 4096):
            part = batch.slice(start, 4096)
            ids = part.column(part.schema.get_field_index("ids"))
            names = [name for name in part.schema.names if name != "ids"]
            for at, row in enumerate(part.select(names).to_pylist()):
                if row["term"] == WHOLE:
                    if head is not None:
                        yield head, rows
                    head, rows = row | {"ids": ids[at].values}, []
                else:
                    rows.append(row)
    if head is not None:
        yield head, rows


def postings_rows(ids: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of segments to ``term, doc_id, tf, dl, row``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, rows in _segments(batches):
            dl = unpack_numbers(head["data"])
            for row in rows:
                doc, tf = read_block(row["data"])
                names = pa.array([row["term"]] * len(doc), pa.string())
                yield pa.RecordBatch.from_arrays([names, head["ids"].take(pa.array(doc)), pa.array(tf), pa.array(dl[doc]), pa.array((head["segment"] << 16) + doc)], names=["term", "doc_id", "tf", "dl", "row"])

    return run


class _Term:
    """The blocks of one term in a segment, read when they are needed."""

    def __init__(self, impact: Callable, dl: np.ndarray):
        self.impact, self.dl, self.blocks, self.bound = impact, dl, [], 0.0
        self.read: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, row: dict) -> None:
        self.blocks.append(row)
        self.bound = max(self.bound, float(self.impact(row["max_tf"], row["min_dl"])))

    def part(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        if at not in self.read:
            doc, tf = read_block(self.blocks[at]["data"])
            self.read[at] = doc, self.impact(tf, self.dl[doc])
        return self.read[at]

    def near(self, docs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The blocks whose range holds one of the sorted documents."""
        for at, row in enumerate(self.blocks):
            if np.searchsorted(docs, row["first"]) < np.searchsorted(docs, row["last"], side="right"):
                yield self.part(at)

    def every(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        return (self.part(at) for at in range(len(self.blocks)))


def rank_segment(terms: list[tuple[float, _Term]], total: np.ndarray, floor: float) -> np.ndarray:
    """Documents that may score ``floor`` or more; their full scores are left in ``total``, which is zero elsewhere.

    Terms are taken by what they can add, most first. Once those that are left cannot reach the
    floor together, no further document comes in, and blocks without a document that still can are
    not read.
    """
    terms = sorted(terms, key=lambda t: -t[0] * t[1].bound)
    left = np.r_[np.cumsum([w * t.bound for w, t in terms][::-1])[::-1], 0.0]
    docs = np.empty(0, np.int64)
    for at, (weight, term) in enumerate(terms):
        if left[at] >= floor:
            for doc, value in term.every():
                total[doc] += weight * value
            if at + 1 == len(terms) or left[at + 1] < floor:
                docs = np.flatnonzero(total)
            continue
        if not len(docs):
            break
        keep = total[docs] + left[at] >= floor
        total[docs[~keep]] = 0.0
        docs = docs[keep]
        for doc, value in term.near(docs):
            mine = total[doc] > 0.0
            total[doc[mine]] += weight * value[mine]
    return docs


class _Best:
    """The k best rows of one query: score first, then the lower id."""

    def __init__(self, k: int):
        self.k, self.score, self.ids = k, np.empty(0), None

    def floor(self) -> float:
        return self.score[-1] if len(self.score) == self.k else -np.inf

    def offer(self, score: np.ndarray, ids: np.ndarray) -> None:
        if self.ids is not None:
            score, ids = np.concatenate((self.score, score)), np.concatenate((self.ids, ids))
        order = np.argsort(ids, kind="stable")
        order = order[np.argsort(-score[order], kind="stable")][: self.k]
        self.score, self.ids = score[order], ids[order]


def rank_blocks(shared, k: int, k1: float, b: float, avgdl: float, kinds: tuple[pa.DataType, pa.DataType]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of segments, sorted by segment and term, to the k best documents of each query in the task."""

    def impact(tf, dl):
        return tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl / avgdl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, qids = QueryTerms(*shared.value[:5]), shared.value[5]
        number = {t: i for i, t in enumerate(asked.vocabulary.to_pylist())}
        best = [_Best(k) for _ in range(len(qids))]
        for head, rows in _segments(batches):
            dl, ids = unpack_numbers(head["data"]), head["ids"].to_numpy(zero_copy_only=False)
            terms: dict[int, _Term] = {}
            for row in rows:
                terms.setdefault(number[row["term"]], _Term(impact, dl)).add(row)
            wanted: dict[int, list[tuple[float, _Term]]] = {}
            for at, term in terms.items():
                span = slice(asked.starts[at], asked.starts[at + 1])
                for q, weight in zip(asked.query[span].tolist(), asked.weight[span].tolist()):
                    wanted.setdefault(q, []).append((weight, term))
            total = np.zeros(len(dl))
            for q, mine in wanted.items():
                docs = rank_segment(mine, total, best[q].floor() - _SLACK)
                if len(docs):
                    score = np.round(total[docs], DECIMALS)
                    total[docs] = 0.0
                    if len(docs) > k:
                        keep = score >= np.partition(score, len(score) - k)[len(score) - k]
                        docs, score = docs[keep], score[keep]
                    best[q].offer(score, ids[docs])
        found = [(q, x) for q, x in enumerate(best) if x.ids is not None]
        if found:
            columns = [
                qids.take(pa.array(np.repeat([q for q, _ in found], [len(x.ids) for _, x in found]))),
                pa.concat_arrays([pa.array(x.ids, kinds[1]) for _, x in found]),
                pa.array(np.concatenate([x.score for _, x in found])),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["qid", "doc_id", "score"])

    return run
