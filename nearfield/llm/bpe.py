"""Byte-level BPE: whole blocks of texts are encoded by replaying the merges in rank order.

A task cuts its texts into pieces and keeps each distinct piece once. An inverted index
leads from a merge rank to the places of all pieces where that pair stands; the ranks are
taken in order, every place of a rank is merged at once, and only the pairs left and right
of a merged place are looked up again. Nothing is shuffled; a task holds one block of text
and a bounded table of known pieces.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from nearfield.llm.common import keyed_text, text_blocks

NO_PAIR = np.int32(1 << 30)
KNOWN_PIECES = 200_000


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank, from a file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines) if token)
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"ranks in {path} are not 0..n-1")
    return [token for _, token in pairs]


@dataclass(frozen=True)
class Vocabulary:
    """Tokens by rank, and every pair of tokens that merges into one, sorted by pair."""

    tokens: list[bytes]
    pair_keys: np.ndarray
    pair_ranks: np.ndarray

    @classmethod
    def build(cls, tokens: list[bytes]) -> Vocabulary:
        rank = {token: i for i, token in enumerate(tokens)}
        missing = [b for b in range(256) if bytes([b]) not in rank]
        if missing:
            raise ValueError(f"no token for the bytes {missing[:5]}")
        keys, ranks = [], []
        for token, r in rank.items():
            for cut in range(1, len(token)):
                left, right = rank.get(token[:cut]), rank.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    ranks.append(r)
        order = np.argsort(np.array(keys, np.int64))
        return cls(tokens, np.array(keys, np.int64)[order], np.array(ranks, np.int32)[order])


class Replay:
    """Merge replay over lists of pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self.rank = {token: i for i, token in enumerate(vocabulary.tokens)}
        self.keys = np.r_[vocabulary.pair_keys, np.int64(-1)]
        self.ranks = np.r_[vocabulary.pair_ranks, NO_PAIR].astype(np.int32)
        self.count = len(vocabulary.pair_keys)
        self.bytes = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys[: self.count], key)
        return np.where(self.keys[at] == key, self.ranks[at], NO_PAIR)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces in a row, and how many each piece has."""
        whole = np.array([self.rank.get(p, -1) for p in pieces], np.int64)
        sizes = np.array([len(p) for p in pieces], np.int64)
        open_ = np.flatnonzero((whole < 0) & (sizes > 0))
        token, alive, odd = self._merge([pieces[i] for i in open_])
        counts = (whole >= 0).astype(np.int64)
        spans = np.r_[0, np.cumsum(sizes[open_])]
        if len(open_):
            counts[open_] = np.add.reduceat(alive, spans[:-1])
        ids = np.empty(counts.sum(), np.int32)
        ends = np.cumsum(counts)
        single = whole >= 0
        ids[ends[single] - 1] = whole[single]
        inside = np.ones(len(ids), bool)
        inside[ends[single] - 1] = False
        ids[inside] = token[alive]
        if len(odd):
            parts = np.split(ids, ends[:-1])
            for i in open_[odd]:
                parts[i] = np.array(self.one(pieces[i]), np.int32)
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, counts

    def _merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Final token at each byte, whether a token starts there, and pieces whose order of merges was broken."""
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(raw)
        if not n:
            return np.empty(0, np.int32), np.empty(0, bool), np.empty(0, np.int64)
        sizes = np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(sizes) - 1
        token = np.r_[self.bytes[raw], np.int32(-1)]
        after = np.r_[np.arange(1, n + 1), n].astype(np.int32)
        before = np.r_[n, np.arange(n)].astype(np.int32)
        after[ends] = n
        before[np.r_[0, ends[:-1] + 1]] = n
        alive = np.ones(n + 1, bool)
        rank = self.pair(token, token[after])
        rank[n] = NO_PAIR
        odd: list[np.ndarray] = []
        waiting: dict[int, list[np.ndarray]] = defaultdict(list)
        heap: list[int] = []

        def wait(places: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            starts = [0, *cuts.tolist(), len(ranks)]
            for a, b in zip(starts[:-1], starts[1:]):
                r = int(ranks[a])
                if r not in waiting:
                    heapq.heappush(heap, r)
                waiting[r].append(places[a:b])

        first = np.flatnonzero(rank < NO_PAIR)
        if len(first):
            wait(first, rank[first])
        while heap:
            r = heapq.heappop(heap)
            lists = waiting.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[rank[at] == r]
            if len(at) > 1:
                chained = after[at[:-1]] == at[1:]
                if chained.any():  # in a run of overlapping pairs every second one is merged, from the left
                    place = np.arange(len(at))
                    run = np.maximum.accumulate(np.where(np.r_[True, ~chained], place, 0))
                    at = at[(place - run) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            follows = after[gone]
            token[at] = r
            alive[gone] = False
            rank[gone] = NO_PAIR
            after[at] = follows
            before[follows] = at
            left = before[at]
            touched = np.concatenate((at, left[left < n]))
            if len(touched) > 2:
                touched = np.unique(touched)
            new = self.pair(token[touched], token[after[touched]])
            rank[touched] = new
            if (new < r).any():
                odd.append(touched[new < r])
            fresh = new < NO_PAIR
            if fresh.any():
                wait(touched[fresh], new[fresh])
        broken = np.unique(np.searchsorted(ends, np.concatenate(odd))) if odd else np.empty(0, np.int64)
        return token[:n], alive[:n], broken

    def one(self, piece: bytes) -> list[int]:
        """The lowest rank first, leftmost first: for the rare piece where a merge opens a pair of lower rank."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            r, i = min((self.rank.get(parts[i] + parts[i + 1], NO_PAIR), i) for i in range(len(parts) - 1))
            if r == NO_PAIR:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]


class BlockEncoder:
    """Encodes blocks of texts, remembering the pieces seen so far up to a bound."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.replay = Replay(vocabulary)
        self.find = regex.compile(pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.index: defaultdict[str, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        self.ids = np.empty(0, np.int32)
        self.counts = np.empty(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts in a row, and how many each text has."""
        if len(self.index) > KNOWN_PIECES:
            self._forget()
        known = len(self.index)
        place = self.index.__getitem__
        found = [np.fromiter(map(place, self.find(text)), np.int64) for text in texts]
        if len(self.index) > known:
            ids, counts = self.replay.encode([p.encode() for p in islice(self.index, known, None)])
            self.ids, self.counts = np.concatenate((self.ids, ids)), np.concatenate((self.counts, counts))
        pieces = np.concatenate(found) if found else np.empty(0, np.int64)
        sizes = self.counts[pieces]
        starts = (np.cumsum(self.counts) - self.counts)[pieces]
        ids = gathered(self.ids, starts, sizes)
        ends = np.cumsum([len(f) for f in found])
        total = np.r_[0, np.cumsum(sizes)][np.r_[0, ends].astype(np.int64)]
        return ids, np.diff(total)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers ``start .. start + size - 1`` of every range in a row."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """The values in every range in a row, some ranges at a time: the places of a whole block take many times its bytes."""
    return np.concatenate([values[:0], *(values[ranges(starts[i : i + step], sizes[i : i + step])] for i in range(0, len(starts), step))])


class BlockDecoder:
    """Token ids back to bytes."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes)):
            raise ValueError("a token id lies outside the vocabulary")
        sizes = self.sizes[ids]
        raw = gathered(self.blob, self.starts[ids], sizes)
        ends = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(counts)].astype(np.int64)]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """Token ids of every text: ``key, ids``, and with ``decoded`` also the bytes decoded from those ids.

    One row per input row, repeated rows and null keys included; other columns are left out,
    so no name can clash. A null or empty text has no ids and decodes to no bytes.
    """
    vocabulary = Vocabulary.build(read_ranks(ranks_path))
    # plain values, which workers can read without this package
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary.tokens, vocabulary.pair_keys, vocabulary.pair_ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = BlockEncoder(Vocabulary(*shared.value), pattern), BlockDecoder(shared.value[0])
        for block in text_blocks(batches):
            ids, counts = encoder.encode(block.column("text").to_pylist())
            offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
            columns = [block.column("key"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))]
            if decoded:
                columns.append(decoder.decode(ids, counts))
            yield pa.RecordBatch.from_arrays(columns, ["key", "ids", "decoded"][: len(columns)])

    rows = keyed_text(docs, key, text)
    schema = f"key {rows.schema['key'].dataType.simpleString()}, ids ARRAY<INT>" + (", decoded BINARY" if decoded else "")
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def decode(coded: DataFrame, ranks_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Bytes of every list of token ids: ``key, decoded``. A null list or id counts as absent; an unknown id is an error."""
    shared = coded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = BlockDecoder(shared.value)
        for batch in batches:
            lists = batch.column("ids")
            raw = decoder.decode(lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column("key"), raw], ["key", "decoded"])

    rows = coded.selectExpr(f"`{key}` AS key", f"coalesce(filter(`{ids}`, x -> x IS NOT NULL), cast(array() AS array<int>)) AS ids")
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, decoded BINARY").withColumnRenamed("key", key)
