"""Best-two-fit packing of tokenised documents into sequences of bounded length.

A sequence is filled greedily, longest piece first. When nothing more fits, its smallest piece
gives way to the two unpacked pieces that fill the room so gained most tightly, if they fill it
better. How pieces go together depends on nothing but their lengths, of which there are at most
``capacity``, so the sequences are laid out on a table of counts: a layout is repeated as often as
the counts leave every decision as it was. The number of layouts has a bound that is free of the
number of documents, and every piece finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.llm.common import keyed_text, stored, text_blocks

CAPACITY = 2048
END = 0  # the id after each document
KNOWN_BYTES = 32 << 20
TOGETHER = 64  # new chunks to one call of the tokenizer
RUN_BYTES = 4 << 20
_BLANK = re.compile(rb"[ \t\n\r\x0b\x0c]")
_RANK_BITS = 44  # of a look-up key, below the length


class ChunkTokenizer:
    """Token ids of texts by the ``tokenizers`` library, each blank-separated chunk once.

    A tokenizer that drops white space before it splits never joins two chunks, so the ids of a
    text are those of its chunks in order. Strings of special tokens are read as the library reads
    them by default.
    """

    def __init__(self, definition: str, end: int = END):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread for each Spark task
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_str(definition), end
        self._forget()

    def _forget(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.number[b""]  # stands for the end of a document
        self.ids, self.bounds, self.held = np.array([self.end], np.uint32), np.array([0, 1]), 0

    def _learn(self) -> None:
        """The ids of the new chunks: they are encoded some at a time, and each token goes to the chunk in which it starts."""
        new = [w.decode() for w in islice(self.number, len(self.bounds) - 1, None)]
        flat, counts = [], []
        for start in range(0, len(new), 64 * TOGETHER):
            groups = [new[i : i + TOGETHER] for i in range(start, min(start + 64 * TOGETHER, len(new)), TOGETHER)]
            for group, found in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
                ends = np.cumsum(np.fromiter(map(len, group), np.int64, len(group)) + 1)
                begins = np.fromiter((at for at, _ in found.offsets), np.int64, len(found.ids))
                flat.append(np.array(found.ids, np.uint32))
                counts.append(np.bincount(np.searchsorted(ends, begins, side="right"), minlength=len(group)))
        if new:
            self.ids = np.concatenate((self.ids, *flat))
            self.bounds = np.concatenate((self.bounds, self.bounds[-1] + np.cumsum(np.concatenate(counts))))
            self.held += sum(map(len, new)) + 4 * sum(map(len, flat))

    def _numbers(self, raw: bytes) -> np.ndarray:
        """Chunk numbers of a text, a long one in runs that end at a blank, and the end of the document."""
        parts, start = [], 0
        while start < len(raw):
            cut = _BLANK.search(raw, start + RUN_BYTES) if len(raw) - start > RUN_BYTES else None
            stop = cut.start() if cut else len(raw)
            parts.append(np.fromiter(map(self.number.__getitem__, raw[start:stop].split()), np.int64))
            start = stop
        return np.concatenate([*parts, [0]]).astype(np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has, the end included."""
        if self.held > KNOWN_BYTES:
            self._forget()
        chunks = [self._numbers(t.encode()) for t in texts]
        self._learn()
        numbers = np.concatenate(chunks) if chunks else np.empty(0, np.int64)
        counts = np.diff(self.bounds)[numbers]
        ends = np.cumsum(counts)
        places = np.arange(len(counts) and ends[-1]) + np.repeat(self.bounds[numbers] - (ends - counts), counts)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        return self.ids[places], np.add.reduceat(counts, np.cumsum(sizes) - sizes) if len(sizes) else np.empty(0, np.int64)


def _nth(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """How many pieces of the same length came before each; ``seen`` is carried on."""
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[starts, len(ordered)])
    out = np.empty(len(lengths), np.int64)
    out[order] = np.arange(len(ordered)) - np.repeat(starts, sizes) + seen[ordered]
    seen[ordered[starts]] += sizes
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """``key, piece, start, length, ids_crc32, part, nth`` of every document, with ``ids`` also the ids of the piece.

    Only a document of more than ``capacity`` tokens is cut. ``nth`` numbers the pieces of one
    length within the task ``part`` that made them.
    """
    with open(tokenizer, encoding="utf-8") as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, seen, part = ChunkTokenizer(definition.value, end), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for block in text_blocks(batches):
            flat, sizes = coder.encode(block.column("text").to_pylist())
            cuts = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), cuts)
            number = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            start = number * capacity
            length = np.minimum(sizes[row] - start, capacity)
            at = (np.cumsum(sizes) - sizes)[row] + start
            little = flat.astype("<u4")
            sums = np.fromiter((zlib.crc32(little[a : a + n]) for a, n in zip(at.tolist(), length.tolist())), np.int64, len(row))
            columns = [block.column("key").take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums), pa.array(np.full(len(row), part, np.int32)), pa.array(_nth(length, seen))]
            names = ["key", "piece", "start", "length", "ids_crc32", "part", "nth"]
            if ids:  # the pieces of a document lie one after the other
                columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)].astype(np.int32)), pa.array(flat.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = keyed_text(docs, key, text)
    kind = rows.schema["key"].dataType.simpleString()
    more = ", ids ARRAY<INT>" if ids else ""
    return rows.mapInArrow(run, f"key {kind}, piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT, part INT, nth BIGINT{more}")


@dataclass(frozen=True)
class Layout:
    """Runs of places for pieces of one length: from rank ``first`` on, ``each`` to a sequence, from ``sequence`` and ``offset`` on."""

    length: np.ndarray
    first: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int
    steps: int

    def parts(self) -> tuple:
        """Plain values to broadcast."""
        return self.length << _RANK_BITS | self.first, self.first, self.each, self.sequence, self.offset


def _fill(left: np.ndarray, room: int) -> tuple[dict[int, int], int]:
    """Longest first, as many as fit and are there: pieces by length, and the room that stays. ``left`` is lowered."""
    taken: dict[int, int] = {}
    there = np.flatnonzero(left)
    at = int(np.searchsorted(there, room, side="right"))
    while at:
        length = int(there[at - 1])
        n = min(room // length, int(left[length]))
        taken[length] = n
        left[length] -= n
        room -= n * length
        at = int(np.searchsorted(there[: at - 1], room, side="right"))
    return taken, room


def _best_two(left: np.ndarray, room: int) -> tuple[int, int]:
    """The two unpacked lengths with the greatest sum of at most ``room``, the longer one first and as long as may be."""
    there = np.flatnonzero(left[: room + 1])
    if not len(there):
        return 0, 0
    at = np.searchsorted(there, np.minimum(room - there, there), side="right") - 1
    lone = (at >= 0) & (there[at] == there) & (left[there] < 2)
    at = np.where(lone, at - 1, at)
    sums = np.where(at >= 0, there + there[at], 0)
    best = len(sums) - 1 - int(sums[::-1].argmax())
    return (int(there[best]), int(there[at[best]])) if sums[best] else (0, 0)


def layout(counts: np.ndarray, capacity: int = CAPACITY) -> Layout:
    """Where pieces go, from the number of pieces of each length (``counts[0]`` is not used)."""
    if capacity >= 1 << 62 - _RANK_BITS:
        raise ValueError(f"a sequence of {capacity} tokens is too long")
    left, used = np.asarray(counts, np.int64).copy(), np.zeros(len(counts), np.int64)
    left[0] = 0
    rows: list[tuple[int, int, int, int, int]] = []
    sequences = steps = 0
    while left.any():
        after = left.copy()
        filled, room = _fill(after, capacity)
        final = dict(filled)
        smallest = min(filled)
        if room:
            longer, shorter = _best_two(after, room + smallest)
            if longer and longer + shorter > smallest:
                for length, n in ((smallest, -1), (longer, 1), (shorter, 1)):
                    final[length] = final.get(length, 0) + n
        # Decisions stay the same while every length that is used up can still be filled with and leaves two for a pair.
        spare = min((int(left[length]) - filled.get(length, 0) - 2) // n for length, n in final.items() if n)
        repeats = 1 + max(spare, 0)
        offset = 0
        for length in sorted(final, reverse=True):
            if n := final[length]:
                rows.append((length, int(used[length]), n, sequences, offset))
                offset += n * length
                used[length] += n * repeats
                left[length] -= n * repeats
        sequences += repeats
        steps += 1
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Layout(*table.T.copy(), sequences, steps)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """``key, piece, start, length, ids_crc32, sequence_id, offset``: the place of every piece of every document.

    A document is its ids and ``end``; a null or empty text is ``end`` alone, so each input row,
    repeated rows and null keys included, has at least one piece. A text of any length is cut into
    as many pieces as it takes. Which of several pieces of one length takes which place does not
    matter to the packing; it follows from the order in which they are read. An empty table gives
    an empty one. Other columns are left out, so no name can clash. With ``ids`` the ids come too.

    The driver sees one count for each length, never a piece.
    """
    cut = stored(pieces(docs, tokenizer, capacity, end, key, text, ids), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = stored(counts.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))), "ahead")
    total = np.zeros(capacity + 1, np.int64)
    for row in ahead.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        total[row["length"]] = row["n"]
    shared = docs.sparkSession.sparkContext.broadcast(layout(total, capacity).parts())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, each, sequence, offset = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length << _RANK_BITS | rank, side="right") - 1
            within = rank - first[at]
            spots = [pa.array(sequence[at] + within // each[at]), pa.array(offset[at] + within % each[at] * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *spots], [*batch.schema.names[:-1], "sequence_id", "offset"])

    ranked = cut.join(ahead.drop("n"), ["part", "length"]).withColumn("rank", F.col("ahead") + F.col("nth"))
    kept = ranked.select("key", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else []), "rank")
    kind = kept.schema["key"].dataType.simpleString()
    more = ", ids ARRAY<INT>" if ids else ""
    return kept.mapInArrow(place, f"key {kind}, piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT{more}, sequence_id BIGINT, offset BIGINT").withColumnRenamed("key", key)


def sequences(placed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` of pieces packed with their ids; a group holds no more than one sequence."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(ordered["ids"]).alias("ids"))
