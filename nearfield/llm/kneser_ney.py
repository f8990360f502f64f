"""Interpolated modified Kneser-Ney bigram model, counted in Spark and read by workers from memory-mapped arrays.

The vocabulary is a sorted array of 64-bit word hashes, cut into range parts; a word's number
is its place in it. Bigrams are sorted arrays of ``first << 32 | second``, sharded by the
first word, and by both words where one first word is so frequent that it would fill a shard.
Training reads the corpus twice (words, then bigrams); scoring reads it once. All arrays are
files in the shared folder, so a lost executor loses none of them, and a worker maps them
instead of loading them.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import keyed_text, stored, text_blocks
from nearfield.llm.wordhash import WordHashes, row_bounds, space_words
from nearfield.session import work_dir

HASH_SEED = 42
PART_WORDS = 4_000_000
SHARD_BIGRAMS = 4_000_000
CHUNK = 2_000_000
END = b""  # no word is empty
OPEN_FILES = 256


@dataclass
class Files:
    """Arrays in a shared folder that all executors see under the same path."""

    root: str
    open: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, spark: SparkSession) -> Files:
        url = urlparse(work_dir(spark, "kneser-ney"))
        if url.scheme not in ("", "file"):
            raise ValueError(f"memory-mapped arrays need a mounted shared folder, not {url.scheme}://; set spark.checkpoint.dir to one")
        return cls(url.path)

    def write(self, name: str, values: np.ndarray) -> None:
        """Written aside and renamed, so that no reader and no second attempt sees half a file."""
        os.makedirs(self.root, exist_ok=True)
        aside = f"{self.root}/.{uuid.uuid4().hex}"
        with open(aside, "wb") as out:
            np.save(out, values)
        os.rename(aside, f"{self.root}/{name}.npy")

    def map(self, name: str) -> np.ndarray:
        if name not in self.open:
            if len(self.open) >= OPEN_FILES:
                self.open.clear()
            self.open[name] = np.load(f"{self.root}/{name}.npy", mmap_mode="r")
        return self.open[name]


@dataclass(frozen=True)
class Words:
    """The parts of the vocabulary by their least hash, and the number of their first word."""

    names: list[str]
    least: np.ndarray
    first: np.ndarray
    size: int

    def numbers(self, files: Files, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash in the vocabulary, -1 if it is not there."""
        order = np.argsort(hashes)
        asked = hashes[order]
        out = np.full(len(hashes), -1, np.int64)
        cuts = np.r_[np.searchsorted(asked, self.least), len(asked)]
        for part, name in enumerate(self.names):
            a, b = cuts[part], cuts[part + 1]
            if a < b:
                known = files.map(f"{name}-hash")
                at = np.minimum(np.searchsorted(known, asked[a:b]), len(known) - 1)
                out[order[a:b]] = np.where(known[at] == asked[a:b], self.first[part] + at, -1)
        return out

    def take(self, files: Files, what: str, numbers: np.ndarray) -> np.ndarray:
        """A column of the vocabulary at the given places."""
        out = np.zeros(len(numbers))
        part = np.searchsorted(self.first, numbers, side="right") - 1
        for p in np.unique(part[numbers >= 0]):
            rows = (part == p) & (numbers >= 0)
            out[rows] = files.map(f"{self.names[p]}-{what}")[numbers[rows] - self.first[p]]
        return out


@dataclass(frozen=True)
class Sharding:
    count: int
    hot: np.ndarray

    def of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hot, first), max(0, len(self.hot) - 1))
        spread = (self.hot[at] == first) if len(self.hot) else np.zeros(len(first), bool)
        return ((first + np.where(spread, second * 31, 0)) % self.count).astype(np.int32)


@dataclass(frozen=True)
class Model:
    files: Files
    words: Words
    tokens: int
    sharding: Sharding
    shards: dict[int, str]
    discounts: tuple[float, float, float]
    types: int
    share: float  # of the uniform distribution in the word distribution
    word_discounts: tuple[float, float, float]
    start: tuple[float, float]  # count and discounted mass of the begin of a text


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of entries seen 1, 2, 3 and 4 times; each lies between 0 and its count."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    return tuple(min(float(i), max(0.0, i - (i + 1) * y * more / have)) if have else y for i, have, more in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _discount(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)]


class _Numbers(dict):
    """Numbers of words, remembered up to a bound."""

    def __init__(self, words: Words, files: Files):
        super().__init__()
        self.words, self.files = words, files
        self.hashes = WordHashes(HASH_SEED)

    def of(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        new = list({w for words in texts for w in words if w not in self} | ({END} - self.keys()))
        if len(self) > 400_000:
            self.clear()
            new = list({w for words in texts for w in words} | {END})
        self.update(zip(new, self.words.numbers(self.files, self.hashes.of(new)).tolist()))
        return [np.fromiter(map(self.__getitem__, words), np.int64, len(words)) for words in texts]


def _words_of(block: pa.RecordBatch) -> list[list[bytes]]:
    return [[*space_words(text), END] for text in block.column("text").to_pylist()]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes(HASH_SEED)
    held: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        hashes, counts = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts.astype(np.int64))], ["h", "c"])

    for block in text_blocks(batches):
        held.extend(known.of(words) for words in _words_of(block))
        if sum(map(len, held)) >= CHUNK:
            yield flush()
    if held:
        yield flush()


def _write_words(files: Files):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [pa.table({"h": b.column("h"), "c": b.column("c")}) for b in batches]
        rows = pa.concat_tables(tables) if tables else None
        if rows is not None and len(rows):
            hashes = rows["h"].to_numpy().view(np.uint64)
            order = np.argsort(hashes)
            name = f"words-{uuid.uuid4().hex}"
            files.write(f"{name}-hash", hashes[order])
            files.write(f"{name}-count", rows["c"].to_numpy()[order])
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([int(hashes[order[0]])], pa.uint64()).cast(pa.decimal128(20)), pa.array([len(order)])], ["name", "least", "size"])

    return run


def _vocabulary(train: DataFrame, files: Files) -> tuple[Words, int, list]:
    """The vocabulary's files, the number of tokens, and the words that fill a quarter of a shard (at most four per shard)."""
    counted = stored(train.mapInArrow(_count_words, "h BIGINT, c BIGINT").groupBy("h").agg(F.sum("c").alias("c")), "word-counts")
    size, tokens = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    if size >= 1 << 32:
        raise ValueError("more than 2**32 distinct words")
    # unsigned order of the hashes
    ranged = counted.repartitionByRange(max(1, -(-size // PART_WORDS)), F.col("h").bitwiseXOR(F.lit(-(1 << 63))))
    parts = sorted(ranged.mapInArrow(_write_words(files), "name STRING, least DECIMAL(20,0), size BIGINT").collect(), key=lambda r: r.least)
    sizes = np.array([r["size"] for r in parts], np.int64)
    words = Words([r.name for r in parts], np.array([int(r.least) for r in parts], np.uint64), np.cumsum(sizes) - sizes, size)
    hot = [r.h for r in counted.where(F.col("c") * 4 >= SHARD_BIGRAMS).select("h").collect()]
    return words, tokens, hot


def _bigrams(texts: list[np.ndarray], begin: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second word of all bigrams; a text starts after ``begin``."""
    second = np.concatenate(texts)
    first = np.r_[begin, second[:-1]]
    first[row_bounds([len(t) for t in texts])[:-1]] = begin
    return first, second


def _count_bigrams(words: Words, files: Files, sharding: Sharding):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers(words, files)
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            shard = sharding.of(keys >> 32, keys & 0xFFFFFFFF)
            order = np.argsort(shard, kind="stable")
            which, starts = np.unique(shard[order], return_index=True)
            rows = [order[a:b] for a, b in zip(starts, [*starts[1:], len(order)])]
            # within a shard the keys are sorted: first words as runs, second words and counts as they are
            runs = [np.unique(keys[r] >> 32, return_counts=True) for r in rows]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(which),
                    pa.array([first.astype("<u4").tobytes() for first, _ in runs], pa.binary()),
                    pa.array([size.astype("<u4").tobytes() for _, size in runs], pa.binary()),
                    pa.array([(keys[r] & 0xFFFFFFFF).astype("<u4").tobytes() for r in rows], pa.binary()),
                    pa.array([counts[r].astype("<u4").tobytes() for r in rows], pa.binary()),
                ],
                ["shard", "first", "runs", "second", "counts"],
            )

        for block in text_blocks(batches):
            first, second = _bigrams(numbers.of(_words_of(block)), words.size)
            held.append(first << 32 | second)
            if sum(map(len, held)) >= CHUNK:
                yield flush()
        if held:
            yield flush()

    return run


_SHARD_OUT = "id BIGINT, nc BIGINT, n1 BIGINT, n2 BIGINT, n3 BIGINT, shard INT, name STRING, k ARRAY<BIGINT>"


def _merge_shard(files: Files):
    """One shard's bigrams to a file; numbers of types by first and second word; and how many bigrams occur 1, 2, 3 and 4 times."""

    def run(group: pa.Table) -> pa.Table:
        def ints(name: str) -> np.ndarray:
            return np.frombuffer(b"".join(group[name].to_pylist()), "<u4")

        keys = np.repeat(ints("first"), ints("runs")).astype(np.int64) << 32 | ints("second")
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        counts = np.add.reduceat(ints("counts").astype(np.int64)[order], starts)
        keys = keys[starts]
        name = f"bigrams-{uuid.uuid4().hex}"
        files.write(f"{name}-key", keys)
        files.write(f"{name}-count", np.minimum(counts, 255).astype(np.uint8))
        big = counts >= 255
        files.write(f"{name}-bigkey", keys[big])
        files.write(f"{name}-bigcount", counts[big])
        second, types = np.unique(keys & 0xFFFFFFFF, return_counts=True)
        heads, at = np.unique(keys >> 32, return_index=True)
        by = [np.add.reduceat((np.minimum(counts, 3) == i).astype(np.int64), at) for i in (1, 2, 3)]
        zero, none = np.zeros(len(second), np.int64), np.zeros(len(heads), np.int64)
        rows = len(second) + len(heads)
        last = pa.table(
            {"id": pa.array([None], pa.int64()), **{c: pa.array([0], pa.int64()) for c in ("nc", "n1", "n2", "n3")}}
            | {"shard": group["shard"].slice(0, 1), "name": pa.array([name]), "k": pa.array([[int((counts == i).sum()) for i in (1, 2, 3, 4)] + [len(keys)]], pa.list_(pa.int64()))}
        )
        body = pa.table(
            {"id": np.r_[second, heads], "nc": np.r_[types, none], **{f"n{i + 1}": np.r_[zero, by[i]] for i in range(3)}}
            | {"shard": pa.nulls(rows, pa.int32()), "name": pa.nulls(rows, pa.string()), "k": pa.nulls(rows, pa.list_(pa.int64()))}
        )
        return pa.concat_tables([body, last])

    return run


def _write_stats(words: Words, files: Files, d: tuple[float, float, float]):
    """Columns of one part of the vocabulary: preceding types, and the discounted mass after the word."""

    def run(group: pa.Table) -> pa.Table:
        part = group["part"][0].as_py()
        name = words.names[part]
        size = len(files.map(f"{name}-hash"))
        at = group["id"].to_numpy() - words.first[part]
        before, mass = np.zeros(size, np.int64), np.zeros(size)
        before[at] = group["nc"].to_numpy()
        mass[at] = sum(group[f"n{i + 1}"].to_numpy() * d[i] for i in range(3))
        files.write(f"{name}-before", before)
        files.write(f"{name}-mass", mass)
        return pa.table({"part": pa.array([part], pa.int32())})

    return run


def train(docs: DataFrame, text: str = "text") -> Model:
    """Count the words and bigrams of all texts; every text ends with one end token. Null texts count as empty, repeated rows each count."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    files = Files.fresh(spark)
    words, tokens, hot = _vocabulary(rows, files)
    hot_numbers = words.numbers(files, np.array(hot, np.int64).view(np.uint64))
    begins = words.take(files, "count", words.numbers(files, WordHashes(HASH_SEED).of([END])))[0]
    sharding = Sharding(max(1, -(-tokens // SHARD_BIGRAMS)), np.sort(np.r_[hot_numbers, [words.size] if begins * 4 >= SHARD_BIGRAMS else []]).astype(np.int64))
    chunks = rows.mapInArrow(_count_bigrams(words, files, sharding), "shard INT, first BINARY, runs BINARY, second BINARY, counts BINARY")
    merged = stored(chunks.groupBy("shard").applyInArrow(_merge_shard(files), _SHARD_OUT), "bigram-types")
    shards = merged.where("name IS NOT NULL").select("shard", "name", "k").collect()  # one row per shard
    seen = np.sum([r.k for r in shards], axis=0) if shards else np.zeros(5, np.int64)
    d = discounts(seen[:4].tolist())
    stats = merged.where("id IS NOT NULL").groupBy("id").agg(*[F.sum(c).alias(c) for c in ("nc", "n1", "n2", "n3")])
    stats = stored(stats, "word-types")
    bound = stats.where(f"id < {words.size}")
    of = bound.agg(*[F.count_if(F.col("nc") == i) for i in (1, 2, 3, 4)], F.count_if(F.col("nc") >= 3)).first()
    part = F.lit(-1)
    for first in words.first.tolist():
        part = part + (F.col("id") >= first).cast("int")
    bound.withColumn("part", part).groupBy("part").applyInArrow(_write_stats(words, files, d), "part INT").collect()
    begin = stats.where(f"id = {words.size}").first()
    mass = sum(begin[f"n{i + 1}"] * d[i] for i in range(3)) if begin else 0.0
    dw = discounts(list(of[:4]))
    types = int(seen[4])
    share = (of[0] * dw[0] + of[1] * dw[1] + of[4] * dw[2]) / types if types else 1.0
    return Model(files, words, tokens, sharding, {r.shard: r.name for r in shards}, d, types, share, dw, (float(begins), mass))


class Scorer:
    def __init__(self, model: Model):
        self.m = model
        self.numbers = _Numbers(model.words, model.files)

    def _counts(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        out = np.zeros(len(first), np.int64)
        rows = np.flatnonzero((first >= 0) & (second >= 0))
        keys = first[rows] << 32 | second[rows]
        shard = self.m.sharding.of(first[rows], second[rows])
        order = np.lexsort((keys, shard))
        rows, keys, shard = rows[order], keys[order], shard[order]
        which, starts = np.unique(shard, return_index=True)
        for s, a, b in zip(which.tolist(), starts, [*starts[1:], len(shard)]):
            name = self.m.shards.get(s)
            if name is None:
                continue
            known = self.m.files.map(f"{name}-key")
            at = np.minimum(np.searchsorted(known, keys[a:b]), len(known) - 1)
            found = np.where(known[at] == keys[a:b], self.m.files.map(f"{name}-count")[at], 0).astype(np.int64)
            full = found == 255
            if full.any():
                found[full] = self.m.files.map(f"{name}-bigcount")[np.searchsorted(self.m.files.map(f"{name}-bigkey"), keys[a:b][full])]
            out[rows[a:b]] = found
        return out

    def score(self, texts: list[list[bytes]]) -> dict[str, np.ndarray]:
        m = self.m
        coded = self.numbers.of(texts)
        bounds = row_bounds([len(t) for t in coded])
        begin = m.words.size
        first, second = _bigrams(coded, begin)
        vocabulary, place = np.unique(second, return_inverse=True)
        count, before, mass = (m.words.take(m.files, what, vocabulary) if m.words.size else np.zeros(len(vocabulary)) for what in ("count", "before", "mass"))
        word = np.maximum(before - _discount(before, m.word_discounts), 0) / max(1, m.types) + m.share / (m.words.size + 1)
        base = np.log10((count + 0.5) / (m.tokens + 0.5 * (m.words.size + 1)))
        total, left = np.r_[0.0, count[place[:-1]]], np.r_[0.0, mass[place[:-1]]]
        total[bounds[:-1]], left[bounds[:-1]] = m.start
        pair = self._counts(first, second)
        seen = total > 0
        safe = np.where(seen, total, 1)
        given = np.where(seen, np.maximum(pair - _discount(pair, m.discounts), 0) / safe + left / safe * word[place], word[place])
        sums = lambda values: np.add.reduceat(values, bounds[:-1])  # noqa: E731 — every text has at least its end token
        return {"n_tokens": np.diff(bounds), "n_known": sums((count[place] > 0).astype(np.int64)), "base_score": sums(base[place]), "score": sums(np.log10(given))}


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, n_known, base_score, score, perplexity`` of every text.

    One row per input row, repeated rows and null keys included; a null or empty text is one
    end token. A word the model does not know has the share of the uniform distribution. A
    model of an empty corpus is that distribution. Other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for block in text_blocks(batches):
            found = scorer.score(_words_of(block))
            yield pa.RecordBatch.from_arrays([block.column("key"), *map(pa.array, found.values())], ["key", *found])

    rows = keyed_text(docs, key, text)
    out = rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, n_tokens BIGINT, n_known BIGINT, base_score DOUBLE, score DOUBLE")
    return out.withColumnRenamed("key", key).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
