"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word between two marks, forwards and backwards, and gives
every byte a distribution over the languages; a document gets the mean over all its bytes.
It is trained in numpy by backpropagation through time on a bounded sample of documents. As
the state starts anew with each word, a worker runs the network once for each distinct word
it meets and adds up what the words of a text gave.
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
from pyspark.sql import types as T
from pyspark.sql.window import Window

from nearfield.llm.common import text_blocks
from nearfield.llm.wordhash import row_bounds

UNKNOWN = "und"
SAMPLE_DOCS = 400  # at most so many for each language
SAMPLE_WORDS = 60  # of each of them
HIDDEN = 16
PIECE_BYTES = 48
MARK = 256  # before and after every word
KNOWN_WORDS = 200_000
READ_WORDS = 1024  # read at a time; the states of every byte of them are held


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Direction:
    """A gated recurrent unit: ``x`` holds the input part of its three gates for each byte, ``u`` the part of the state."""

    x: np.ndarray
    u: np.ndarray

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Direction:
        return cls(rng.normal(0, 0.3, (MARK + 1, 3 * HIDDEN)).astype(np.float32), rng.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)).astype(np.float32))

    def forward(self, symbols: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after every symbol, time first."""
        h = np.zeros((symbols.shape[1], HIDDEN), np.float32)
        out = np.empty((*symbols.shape, HIDDEN), np.float32)
        for t, s in enumerate(symbols):
            x, past = self.x[s], h @ self.u
            gates = _sigmoid(x[:, : 2 * HIDDEN] + past[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * past[:, 2 * HIDDEN :])
            if keep is not None:
                keep.append((h, z, r, n, past[:, 2 * HIDDEN :]))
            h = n + z * (h - n)
            out[t] = h
        return out

    def backward(self, symbols: np.ndarray, kept: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dx, du = np.zeros_like(self.x), np.zeros_like(self.u)
        dh = np.zeros_like(d_out[0])
        for t in range(len(symbols) - 1, -1, -1):
            h, z, r, n, past = kept[t]
            dh = dh + d_out[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * past * r * (1 - r)
            into = np.concatenate((dz, dr, dn), axis=1)
            back = np.concatenate((dz, dr, dn * r), axis=1)
            np.add.at(dx, symbols[t], into)
            du += h.T @ back
            dh = dh * z + back @ self.u.T
        return dx, du


class Network:
    def __init__(self, languages: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ahead, self.back = Direction.fresh(rng), Direction.fresh(rng)
        self.out = rng.normal(0, 0.1, (2 * HIDDEN, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.ahead.x, self.ahead.u, self.back.x, self.back.u, self.out, self.bias]

    def probabilities(self, symbols: np.ndarray, keep: tuple | None = None) -> np.ndarray:
        """A distribution over the languages at every position, time first."""
        forth = self.ahead.forward(symbols, keep and keep[0])
        back = self.back.forward(symbols[::-1], keep and keep[1])[::-1]
        states = np.concatenate((forth, back), axis=2)
        if keep is not None:
            keep[2].append(states)
        scores = states @ self.out + self.bias
        scores = np.exp(scores - scores.max(axis=2, keepdims=True))
        return scores / scores.sum(axis=2, keepdims=True)

    def gradients(self, symbols: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        keep: tuple = ([], [], [])
        d = self.probabilities(symbols, keep)
        d[:, np.arange(len(labels)), labels] -= 1
        d /= d.shape[0] * d.shape[1]
        states = keep[2][0]
        d_states = d @ self.out.T
        ax, au = self.ahead.backward(symbols, keep[0], d_states[:, :, :HIDDEN])
        bx, bu = self.back.backward(symbols[::-1], keep[1], d_states[::-1, :, HIDDEN:])
        return [ax, au, bx, bu, np.einsum("tbi,tbj->ij", states, d), d.sum((0, 1))]

    def train(self, words: list[bytes], labels: np.ndarray, epochs: int = 3, batch: int = 512, rate: float = 0.01, seed: int = 0) -> None:
        """Adam over batches of words of one length, in an order fixed by the seed."""
        rng = np.random.default_rng(seed)
        groups = _by_length(words)
        first = [np.zeros_like(w) for w in self.weights()]
        second = [np.zeros_like(w) for w in self.weights()]
        step = 0
        for _ in range(epochs):
            batches = [rows[i : i + batch] for rows in (rng.permutation(g) for g in groups) for i in range(0, len(rows), batch)]
            for b in rng.permutation(len(batches)):
                rows = batches[b]
                step += 1
                for w, g, m, v in zip(self.weights(), self.gradients(_symbols([words[i] for i in rows]), labels[rows]), first, second):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    w -= rate * np.sqrt(1 - 0.99**step) / (1 - 0.9**step) * m / (np.sqrt(v) + 1e-7)


def _by_length(words: list[bytes]) -> list[np.ndarray]:
    sizes = np.array([len(w) for w in words])
    order = np.argsort(sizes, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(words) else []


def _symbols(words: list[bytes]) -> np.ndarray:
    """Words of one length as symbols between marks, time first."""
    raw = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1).T.astype(np.int64)
    mark = np.full((1, len(words)), MARK)
    return np.concatenate((mark, raw, mark))


def _cuts(rows: DataFrame, counts: dict[str, int]) -> dict[str, int]:
    """For each language the hash of the last of its ``SAMPLE_DOCS`` different texts in the order of their hashes.

    Only hashes are looked at, each once however often its row repeats. Those below a share that
    should hold four times the sample are enough unless copies leave too few of them.
    """
    for slack in (4, None):
        share = {name: 1.0 if slack is None else min(1.0, slack * SAMPLE_DOCS / n) for name, n in counts.items()}
        below = F.create_map(*[F.lit(x) for name, s in share.items() for x in (name, s)])
        near = rows.select("lang", "h").where((F.col("h") / 2.0**64 + 0.5) <= below[F.col("lang")]).groupBy("lang", "h").agg(F.lit(1).alias("one"))
        place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
        first = near.select("lang", "h", place.alias("place")).where(F.col("place") <= SAMPLE_DOCS)
        found = {r["lang"]: r for r in first.groupBy("lang").agg(F.max("h").alias("h"), F.count(F.lit(1)).alias("n")).collect()}
        if all(share[name] == 1.0 or name in found and found[name]["n"] == SAMPLE_DOCS for name in counts):
            break
    return {name: r["h"] for name, r in found.items()}


def _pieces(text: str) -> list[bytes]:
    """At most ``SAMPLE_WORDS`` words at even distances over the whole text, long ones in pieces as prediction reads them."""
    words = [w[i : i + PIECE_BYTES] for w in text.encode().split() for i in range(0, len(w), PIECE_BYTES)]
    if len(words) <= SAMPLE_WORDS:
        return words
    return [words[i] for i in np.linspace(0, len(words) - 1, SAMPLE_WORDS).round().astype(int)]


def _sample(docs: DataFrame, key: str, text: str, lang: str) -> tuple[list[str], list[bytes], np.ndarray]:
    """Words of at most ``SAMPLE_DOCS`` different documents of each language, whatever their keys."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    rows = rows.withColumn("h", F.xxhash64(F.lit("language sample"), "key", "text"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return [], [], np.empty(0, np.int64)
    languages = sorted(counts)
    cut = F.create_map(*[F.lit(x) for item in _cuts(rows, counts).items() for x in item])
    chosen = rows.where(F.col("h") <= cut[F.col("lang")]).dropDuplicates(["lang", "h"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            kept = [_pieces(t) for t in block.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column("lang"), pa.array(kept, pa.list_(pa.binary()))], ["lang", "words"])

    table = chosen.select("text", "lang").mapInArrow(words, "lang STRING, words ARRAY<BINARY>").toArrow()
    pairs = sorted((name, w) for name, ws in zip(table["lang"].to_pylist(), table["words"].to_pylist()) for w in ws)
    number = {name: i for i, name in enumerate(languages)}
    return languages, [w for _, w in pairs], np.array([number[name] for name, _ in pairs], np.int64)


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Network:
    """A network for the languages of the given documents; rows without text or language teach nothing."""
    languages, words, labels = _sample(docs, key, text, lang)
    network = Network(languages or [UNKNOWN])
    network.train(words, labels)
    return network


class Predictor:
    def __init__(self, network: Network):
        self.network = network
        self._forget()

    def _forget(self) -> None:
        self.index: defaultdict[bytes, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        self.sums = np.empty((0, len(self.network.languages) + 2), np.float32)

    def _read(self, words: list[bytes]) -> np.ndarray:
        """For each word the sum of its bytes' distributions, its number of bytes, and whether it holds a letter."""
        pieces = [(i, w[a : a + PIECE_BYTES]) for i, w in enumerate(words) for a in range(0, len(w), PIECE_BYTES)]
        out = np.zeros((len(words), len(self.network.languages) + 2), np.float32)
        owner, raw = np.array([i for i, _ in pieces], np.int64), [p for _, p in pieces]
        for rows in _by_length(raw):
            for start in range(0, len(rows), READ_WORDS):
                part = rows[start : start + READ_WORDS]
                chances = self.network.probabilities(_symbols([raw[i] for i in part]))[1:-1]
                np.add.at(out, owner[part], np.concatenate((chances.sum(0), np.full((len(part), 1), len(chances)), np.zeros((len(part), 1))), axis=1))
        out[:, -1] = [any(map(str.isalpha, w.decode())) for w in words]
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if len(self.index) > KNOWN_WORDS:
            self._forget()
        known, place = len(self.index), self.index.__getitem__
        found = [np.fromiter(map(place, t.encode().split()), np.int64) for t in texts]
        if len(self.index) > known:
            self.sums = np.concatenate((self.sums, self._read(list(islice(self.index, known, None)))))
        bounds = row_bounds([len(f) for f in found])
        words = np.concatenate(found)
        total = np.zeros((len(texts), self.sums.shape[1]))
        full = np.flatnonzero(np.diff(bounds))
        if len(full):
            total[full] = np.add.reduceat(self.sums[words], bounds[:-1][full], axis=0, dtype=np.float64)
        chances = total[:, :-2] / np.maximum(total[:, -2:-1], 1)
        best = chances.argmax(1)
        worded = total[:, -1] > 0
        names = [self.network.languages[b] if w else UNKNOWN for b, w in zip(best, worded)]
        return names, np.where(worded, np.minimum(chances[np.arange(len(best)), best], 1.0), 0.0)


def predict(docs: DataFrame, network: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, th, lang_pred, score``: the language with the greatest mean probability over the bytes of the whole text.

    One row per input row, repeated rows and null keys included; ``th`` is a hash of the text.
    A text that is null or has no letter is ``und`` with score 0. Ties go to the first language
    in order of name. A network that learned from no row knows only ``und``. Other columns are
    left out, so no name can clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(network)
        for block in text_blocks(batches):
            names, scores = predictor.predict(block.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([block.column("key"), block.column("th"), pa.array(names, pa.string()), pa.array(scores)], ["key", "th", "lang_pred", "score"])

    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(body).alias("th"), body.alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, th BIGINT, lang_pred STRING, score DOUBLE").withColumnRenamed("key", key)


def marked(docs: DataFrame, network: Network, lang_pred: str, score: str, text: str = "text") -> DataFrame:
    """Every row with all its columns and what ``predict`` gives for it, under two new names."""
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(network)
        for block in text_blocks(batches, text):
            names, scores = predictor.predict([t or "" for t in block.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(names, pa.string()), pa.array(scores)], [*block.schema.names, lang_pred, score])

    return docs.mapInArrow(run, schema)
