"""Quality by supervised subword embeddings.

A word is hashed together with the character n-grams of its form between marks; every hash
slot has a learned vector. A document is the mean of the vectors of all its words and n-grams,
and a softmax over two classes follows. Both are trained by stochastic gradient descent in
numpy on a bounded sample of labelled rows. The mean and the linear output commute, so scoring
needs one number per slot; a worker adds up the slots of each distinct word once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import keyed_text, text_blocks
from nearfield.llm.wordhash import row_bounds

SLOT_BITS = 16
SLOTS = 1 << SLOT_BITS
GRAMS = (3, 4)
WIDTH = 8
SAMPLE_ROWS = 3_000
KNOWN_WORDS = 200_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def slots_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all words and their n-grams in a row, and how many each word has."""
    marked = [b"<" + w + b">" for w in words]
    sizes = np.array([len(m) for m in marked], np.int64)
    raw = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), sizes)
    ends = np.cumsum(sizes)
    found, owners = [], []
    rolling = np.zeros(len(raw), np.uint64)
    for n in range(1, max(GRAMS) + 1):  # hash of the n bytes from each place on
        ahead = np.zeros(len(raw), np.uint64)
        ahead[: len(raw) - n + 1] = raw[n - 1 :]
        rolling = (rolling + ahead + np.uint64(n)) * _FACTOR
        rolling ^= rolling >> np.uint64(29)
        if n in GRAMS:
            inside = np.arange(len(raw)) + n <= ends[word]
            found.append(rolling[inside])
            owners.append(word[inside])
    whole = np.add.reduceat((raw + np.uint64(1)) * _powers(np.arange(len(raw)) - (ends - sizes)[word]), ends - sizes) if len(words) else np.empty(0, np.uint64)
    found.append(whole)
    owners.append(np.arange(len(words)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    slots = ((np.concatenate(found) * _FACTOR) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    return slots[order], np.bincount(owner, minlength=len(words))


def _powers(exponents: np.ndarray) -> np.ndarray:
    top = int(exponents.max(initial=0)) + 1
    return np.multiply.accumulate(np.full(top, np.uint64(0xD6E8FEB86659FD93)))[exponents]


@dataclass(frozen=True)
class Classifier:
    """The evidence for label 1 of every slot, and of a text without any."""

    evidence: np.ndarray
    prior: float


def _train(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 8, rate: float = 0.5, seed: int = 0) -> Classifier:
    """``texts`` are the distinct slots of each text with their shares of its mean."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (SLOTS, WIDTH)).astype(np.float32)
    out, bias = np.zeros((WIDTH, 2), np.float32), np.zeros(2, np.float32)
    steps = max(1, epochs * len(texts))
    for step, row in enumerate(np.concatenate([rng.permutation(len(texts)) for _ in range(epochs)]) if len(texts) else []):
        slots, shares = texts[row]
        now = rate * (1 - step / steps)
        rows = vectors[slots]
        mean = shares @ rows
        scores = mean @ out + bias
        error = np.exp(scores - scores.max())
        error /= error.sum()
        error[labels[row]] -= 1
        back = out @ error
        out -= now * np.outer(mean, error).astype(np.float32)
        bias -= now * 0.1 * error
        # the shares are small numbers: a step on the vectors is scaled to the number of slots
        vectors[slots] = rows - (now * len(slots) * 0.1) * np.outer(shares, back).astype(np.float32)
    side = out[:, 1] - out[:, 0]
    return Classifier((vectors @ side).astype(np.float64), float(bias[1] - bias[0]))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Classifier:
    """Train on at most ``SAMPLE_ROWS`` labelled documents, chosen by a hash of the key.

    Rows without a key, and labels other than 0 and 1, teach nothing; a null text counts as
    empty; a key with several labels counts with the least, one with several texts with the least text.
    """
    chosen = labels.where(F.col(f"`{label}`").isin(0, 1)).groupBy(F.col(f"`{key}`").alias("key")).agg(F.min(f"`{label}`").cast("int").alias("label")).where("key IS NOT NULL")
    chosen = chosen.orderBy(F.xxhash64("key", F.lit("quality sample")), "key").limit(SAMPLE_ROWS)

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            for label, text in zip(block.column("label").to_pylist(), block.column("text").to_pylist()):
                slots, counts = np.unique(slots_of(text.encode().split())[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([slots.astype("<u2").tobytes()]), pa.array([(counts / max(1, counts.sum())).astype("<f4").tobytes()])], ["label", "slots", "shares"])

    rows = keyed_text(docs, key, text).join(F.broadcast(chosen), "key").groupBy("key").agg(F.min("label").alias("label"), F.min("text").alias("text"))
    table = rows.select("label", "text").mapInArrow(shares, "label INT, slots BINARY, shares BINARY").toArrow().sort_by([("label", "ascending"), ("slots", "ascending")])
    texts = [(np.frombuffer(a, "<u2").astype(np.int64), np.frombuffer(b, "<f4")) for a, b in zip(table["slots"].to_pylist(), table["shares"].to_pylist())]
    return _train(texts, table["label"].to_numpy().astype(np.int64))


class Scorer:
    def __init__(self, model: Classifier):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.index: defaultdict[bytes, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        self.sums = np.empty((0, 2))

    def score(self, texts: list[str]) -> np.ndarray:
        if len(self.index) > KNOWN_WORDS:
            self._forget()
        known, place = len(self.index), self.index.__getitem__
        found = [np.fromiter(map(place, t.encode().split()), np.int64) for t in texts]
        if len(self.index) > known:
            slots, counts = slots_of(list(islice(self.index, known, None)))
            fresh = np.add.reduceat(self.model.evidence[slots], np.cumsum(counts) - counts)
            self.sums = np.concatenate((self.sums, np.stack((fresh, counts), axis=1)))
        bounds = row_bounds([len(f) for f in found])
        total = np.zeros((len(texts), 2))
        full = np.flatnonzero(np.diff(bounds))
        if len(full):
            total[full] = np.add.reduceat(self.sums[np.concatenate(found)], bounds[:-1][full], axis=0)
        return 1 / (1 + np.exp(-(total[:, 0] / np.maximum(total[:, 1], 1) + self.model.prior)))


def score(docs: DataFrame, model: Classifier, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score``: the chance of label 1 for every whole text.

    One row per input row, repeated rows and null keys included. A null or empty text, or one
    of white space, has the score of the bias alone. Other columns are left out.
    """
    plain = (model.evidence, model.prior)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Classifier(*plain))
        for block in text_blocks(batches):
            yield pa.RecordBatch.from_arrays([block.column("key"), pa.array(scorer.score(block.column("text").to_pylist()))], ["key", "score"])

    rows = keyed_text(docs, key, text)
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, score DOUBLE").withColumnRenamed("key", key)
