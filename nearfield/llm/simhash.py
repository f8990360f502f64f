"""Near-duplicate documents by SimHash, joined through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. If two fingerprints differ
in at most three bits, the two segments with the fewest differences have at most one each.
The binary Golay code is perfect: every 23-bit word lies within three bits of exactly one
codeword, so a segment has one own codeword, and at most six that are own codewords of a word
one bit away. For each pair of segments a fingerprint is indexed under its two own codewords
and looked up under the pairs of its nearby ones; whatever meets is verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import keyed_text, stored, text_blocks
from nearfield.llm.graph import components
from nearfield.llm.wordhash import space_words
from nearfield.sizing import broadcast_if_small

SHINGLE = 3
MAX_BITS = 3
HASH_SEED = 42
# Generator polynomial of the binary Golay code (23, 12), and its length.
GENERATOR = 0b110001110101
LENGTH = 23


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the hashes of the shingles; no words give zero."""
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    count = max(1, len(words) - shingle + 1)
    starts, stops = (ends - sizes)[:count].tolist(), ends[-count:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], HASH_SEED) for a, b in zip(starts, stops)), np.dtype("<u8"), count)
    ones = np.zeros(64, np.int64)
    for start in range(0, count, 1 << 16):
        part = hashes[start : start + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``key, th, fp``: a hash of the text and its fingerprint as a signed 64-bit number, one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            prints = np.array([fingerprint(space_words(t), shingle) for t in block.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([block.column("key"), block.column("th"), pa.array(prints.view(np.int64))], ["key", "th", "fp"])

    rows = keyed_text(docs, key, text).withColumn("th", F.xxhash64("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, th BIGINT, fp BIGINT")


class Golay:
    """Indexes of the codeword next to a word, and of those next to the words one bit away."""

    def __init__(self) -> None:
        remainder = np.zeros(LENGTH, np.int32)
        for bit in range(LENGTH):
            value = 1 << bit
            for high in range(bit, LENGTH - 13, -1):
                if value >> high & 1 and high >= 11:
                    value ^= GENERATOR << (high - 11)
            remainder[bit] = value
        self.low, self.high = self._sums(remainder[:12]), self._sums(remainder[12:])
        self.error = np.zeros(1 << 11, np.int32)
        for weight in range(4):
            for bits in combinations(range(LENGTH), weight):
                self.error[np.bitwise_xor.reduce(remainder[list(bits)]) if bits else 0] = sum(1 << b for b in bits)

    @staticmethod
    def _sums(parts: np.ndarray) -> np.ndarray:
        out = np.zeros(1, np.int32)
        for part in parts:
            out = np.concatenate((out, out ^ part))
        return out

    def own(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self.error[self.low[words & 0xFFF] ^ self.high[words >> 12]]) >> 11

    def near(self, words: np.ndarray) -> np.ndarray:
        """One row per word, its distinct indexes first, filled up with -1."""
        all_ = np.stack([self.own(words)] + [self.own(words ^ np.int32(1 << b)) for b in range(LENGTH)], axis=1)
        all_.sort(axis=1)
        all_[:, 1:][all_[:, 1:] == all_[:, :-1]] = -1
        all_ = -np.sort(-all_, axis=1)
        return all_[:, : max(1, int((all_ >= 0).sum(1).max(initial=0)))]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code = Golay()
    for batch in batches:
        for start in range(0, len(batch), 4096):
            part = batch.slice(start, 4096)
            prints = part.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            segments = [((prints >> np.uint64(s)) & np.uint64(0x7FFFFF)).astype(np.int32) for s in (0, 23, 46)]
            own, near = [code.own(s) for s in segments], [code.near(s) for s in segments]
            index, look = [], []
            for number, (i, j) in enumerate(combinations(range(3), 2)):
                index.append(number << 24 | own[i] << 12 | own[j])
                pairs = number << 24 | near[i][:, :, None] << 12 | near[j][:, None, :]
                pairs[(near[i] < 0)[:, :, None] | (near[j] < 0)[:, None, :]] = -1
                look.append(pairs.reshape(len(prints), -1))
            look_all = np.concatenate(look, axis=1)
            held = look_all >= 0
            yield pa.RecordBatch.from_arrays(
                [part.column("fp"), _lists(np.stack(index, axis=1)), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(held.sum(1))].astype(np.int32)), pa.array(look_all[held]))],
                ["fp", "index", "look"],
            )


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.astype(np.int32).ravel()))


def links(prints: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of distinct values of ``fp`` that differ in one to three bits."""
    keyed = prints.select("fp").distinct().mapInArrow(_keys, "fp BIGINT, index ARRAY<INT>, look ARRAY<INT>")
    index = keyed.select(F.col("fp").alias("a"), F.explode("index").alias("k"))
    look = keyed.select(F.col("fp").alias("b"), F.explode("look").alias("k"))
    met = look.join(index, "k").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS))
    return met.select("a", "b").distinct()


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``key, th, fp, component, root``: the least key, and the least fingerprint, of the rows reachable through links of up to three bits.

    One row per input row, repeated rows and null keys included; a null key is nobody's least
    key unless the whole component has none. Null and empty texts have the fingerprint zero
    and link like any other. Other columns are left out, so no name can clash.
    """
    rows = stored(fingerprints(docs, key, text, shingle), "fingerprints")
    roots = components(links(rows))
    least = rows.groupBy("fp").agg(F.min("key").alias("key")).join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = least.withColumn("root", F.coalesce("root", "fp"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("key").alias("component")), "root").select("fp", "component", "root")
    return rows.join(named, "fp").select(F.col("key").alias(key), "th", "fp", "component", "root")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the columns they had, one of each component: that with its least key (a null key last), then the least hash of the text."""
    own = stored(classes(docs, key, text), "classes")
    order = F.struct(F.col(f"`{key}`").isNull().alias("none"), F.col(f"`{key}`").alias("key"), "th")
    kept = own.groupBy("root").agg(F.min(order).alias("k"))
    kept = kept.select(F.col("k.key").alias("__of"), F.col("k.th").alias("__kept"))
    texts = own.groupBy(F.col(key).alias("__key"), F.col("th").alias("__th")).agg(F.count(F.lit(1)).alias("__n"))
    # Most documents are neither left out nor repeated. Only the others are asked for, so that no text is shuffled while they are few.
    marks = texts.join(kept, F.col("__key").eqNullSafe(F.col("__of")) & (F.col("__th") == F.col("__kept")), "left")
    marks = marks.select("__key", "__th", F.col("__kept").isNotNull().alias("__stays"), "__n").where("NOT __stays OR __n > 1")
    marks = broadcast_if_small(stored(marks.select("__key", "__th", "__stays"), "left-out"))
    hashed = docs.withColumn("__hash", F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))
    found = hashed.join(marks, F.col(f"`{key}`").eqNullSafe(F.col("__key")) & (F.col("__hash") == F.col("__th")), "left")
    columns = [f"`{c}`" for c in docs.columns]
    return found.where("__stays IS NULL").select(*columns).unionByName(found.where("__stays").dropDuplicates([key, "__hash"]).select(*columns))
