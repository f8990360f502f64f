"""Benchmark decontamination by winnowing.

Every window of ``WINDOW`` words keeps one fingerprint, the least hash of its k-grams. A text
that shares a window with a benchmark item therefore shares that window's fingerprint, so no
shared span of ``WINDOW`` words or more is missed. Where an item is shorter, its whole length
is one window, winnowed in the same way. The fingerprints of the benchmark fill a bitmap of
fixed size that travels to the documents; windows it lets through are extended to all their
words (a 128-bit digest) and joined with the benchmark's windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import keyed_text, stored, text_blocks
from nearfield.llm.wordhash import WordHashes, alnum_words, mix, row_bounds
from nearfield.sizing import broadcast_if_small

WINDOW = 13
GRAM = 5
BITMAP_BITS = 24
SCAN_BYTES = 1 << 20  # of text at a time; its words take some ten times as much
HASH_SEED = 42
_BIT = np.uint8(128) >> np.arange(8, dtype=np.uint8)  # of a slot in its byte, as np.packbits puts it
_FACTORS = [np.uint64((0xD6E8FEB86659FD93 * (2 * j + 1) + 2 * j) & 0xFFFFFFFFFFFFFFFF | 1) for j in range(GRAM)]


def fingerprints(words: np.ndarray, length: int) -> np.ndarray:
    """The winnowed fingerprint of each window of ``length`` words that starts in the array."""
    gram = min(GRAM, length)
    count = len(words) - gram + 1
    if len(words) < length:
        return np.empty(0, np.uint64)
    hashes = mix(sum(words[j : j + count] * _FACTORS[j] for j in range(gram)))
    span, least = length - gram + 1, hashes
    width = 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return least


def _slot(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def _digest(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _item_windows(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes(HASH_SEED)
        for block in text_blocks(batches):
            at, lengths, slots, digests = [], [], [], []
            for row, text in enumerate(block.column("text").to_pylist()):
                words = alnum_words(text)
                length = min(window, len(words))
                if not length:
                    continue
                for start, value in enumerate(_slot(fingerprints(known.of(words), length)).tolist()):
                    at.append(row)
                    lengths.append(length)
                    slots.append(value)
                    digests.append(_digest(words[start : start + length]))
            yield pa.RecordBatch.from_arrays(
                [block.column("key").take(pa.array(at, pa.int64())), pa.array(lengths, pa.int32()), pa.array(slots, pa.int32()), pa.array(digests, pa.binary())],
                ["item", "length", "slot", "digest"],
            )

    return run


def _suspects(shared, lengths: list[int]) -> Callable:
    """Per document its number of words and the windows whose fingerprint the bitmap knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes(HASH_SEED)
        bitmap = np.frombuffer(shared.value, np.uint8)
        for block in text_blocks(batches, limit=SCAN_BYTES):
            texts = [alnum_words(text) for text in block.column("text").to_pylist()]
            bounds = row_bounds([len(words) for words in texts])
            words = np.concatenate([known.of(w) for w in texts])
            found: list[list[dict]] = [[] for _ in texts]
            for length in lengths:
                slots = _slot(fingerprints(words, length))
                passed = np.flatnonzero(bitmap[slots >> 3] & _BIT[slots & 7])
                rows = np.searchsorted(bounds, passed, side="right") - 1
                inside = passed + length <= bounds[rows + 1]
                for row, place in zip(rows[inside].tolist(), (passed - bounds[rows])[inside].tolist()):
                    found[row].append({"start": place, "length": length, "digest": _digest(texts[row][place : place + length])})
            yield pa.RecordBatch.from_arrays(
                [block.column("key"), block.column("row"), block.column("th"), pa.array(np.diff(bounds)), pa.array(found, WINDOWS)],
                ["key", "row", "th", "n_words", "windows"],
            )

    return run


WINDOWS = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("digest", pa.binary())]))


def contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, hashed: bool = False
) -> DataFrame:
    """Words of each document that lie inside a window of a benchmark item.

    One row per input row (repeated rows and null keys included): ``key, n_words, n_hit,
    items``. ``items`` holds the ids, as sorted distinct strings, of the items with an
    occurring window. Null and empty texts have no words; items without words are ignored,
    and an empty benchmark hits nothing. Other columns are left out, so no name can clash;
    with ``hashed`` a hash ``th`` of the text is added.
    """
    spark = docs.sparkSession
    sides = keyed_text(benchmark, item, item_text)
    kind = sides.schema["key"].dataType.simpleString()
    items = stored(sides.mapInArrow(_item_windows(window), f"item {kind}, length INT, slot INT, digest BINARY").distinct(), "benchmark-windows")
    lengths = sorted(r.length for r in items.select("length").distinct().collect())  # at most `window` values
    slots = items.select("slot").distinct().toArrow().column("slot").to_numpy()  # at most 2**BITMAP_BITS values
    bits = np.zeros(1 << BITMAP_BITS, bool)
    bits[slots] = True
    shared = spark.sparkContext.broadcast(np.packbits(bits).tobytes())

    rows = keyed_text(docs, key, text).withColumn("row", F.monotonically_increasing_id()).withColumn("th", F.xxhash64("text"))
    kind = rows.schema["key"].dataType.simpleString()
    scanned = stored(
        rows.mapInArrow(_suspects(shared, lengths), f"key {kind}, row BIGINT, th BIGINT, n_words BIGINT, windows ARRAY<STRUCT<start: INT, length: INT, digest: BINARY>>"), "suspects"
    )
    clean = scanned.where(F.size("windows") == 0).select("key", "th", "n_words", F.lit(0).cast("bigint").alias("n_hit"), F.expr("cast(array() as array<string>)").alias("items"))
    asked = scanned.where(F.size("windows") > 0).select("key", "row", "th", "n_words", F.inline("windows"))
    of_item = broadcast_if_small(items.select("digest", F.col("item").cast("string").alias("item")))
    joined = asked.join(of_item, "digest", "left")
    spans = (
        joined.groupBy("key", "row", "th", "n_words")
        .agg(
            F.sort_array(F.collect_set(F.when(F.col("item").isNotNull(), F.struct("start", "length")))).alias("spans"),
            F.sort_array(F.collect_set("item")).alias("items"),
        )
        .select("key", "th", "n_words", _covered("spans").alias("n_hit"), "items")
    )
    both = clean.unionByName(spans)
    return (both if hashed else both.drop("th")).withColumnRenamed("key", key)


def _covered(spans: str):
    """Words covered by spans that are sorted by start."""
    return F.expr(
        f"""aggregate({spans}, named_struct('till', 0, 'n', 0L),
            (a, s) -> named_struct('till', greatest(a.till, s.start + s.length), 'n', a.n + greatest(0, s.start + s.length - greatest(a.till, s.start))),
            a -> a.n)"""
    )


def is_contaminated(n_hit, n_words):
    """At least one word in twenty lies inside a benchmark window."""
    return (n_hit > 0) & (F.lit(20) * n_hit >= n_words)
