"""Models that are trained: held-out accuracy, and the language model against a plain count."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import ROWS
from pyspark.sql import functions as F

from nearfield.llm import kneser_ney as K
from nearfield.llm import langid, quality
from nearfield.llm.common import hash_bucket

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_of_held_out_documents(spark, documents, messy, nothing):
    held = hash_bucket(F.col("doc_id"), 3) == 1
    network = langid.learn(documents.where(~held))
    rows = langid.predict(documents.where(held), network).join(documents, "doc_id").select("lang", "lang_pred", "score").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    odd = langid.predict(messy, network).collect()
    assert len(odd) == len(ROWS)
    assert {(r.lang_pred, r.score) for r in odd if r.doc_id in (4, 6, 8)} == {("und", 0.0)}
    assert langid.predict(nothing, network).count() == 0
    empty = langid.learn(documents.where("false"))
    assert {r.lang_pred for r in langid.predict(messy, empty).collect()} == {"und"}


ENGLISH = "the water of the river was high that year and nobody crossed it".split()
FRENCH = "la rivière était haute cette année et personne ne la traversait".split()


def test_languages_whose_rows_share_a_key(spark):
    """A shared or null key neither hides a language nor sends all its rows to the driver."""
    for shared in (None, 5):
        rows = [(shared, " ".join(ENGLISH[i % 7 :] + ENGLISH[: i % 5] + [f"year {i}"]), "en") for i in range(3000)]
        rows += [(i, " ".join(FRENCH[i % 7 :] + FRENCH[: i % 5] + [f"année {i}"]), "fr") for i in range(500)] + [(9, "the same text", "en")] * 2000
        docs = spark.createDataFrame(rows, "doc_id INT, text STRING, lang STRING").repartition(4)
        languages, words, labels = langid._sample(docs, "doc_id", "text", "lang")
        assert languages == ["en", "fr"]
        numbers = {w for w, y in zip(words, labels) if y == 0 and w.isdigit()}
        assert 390 <= len(numbers) <= langid.SAMPLE_DOCS and (labels == 1).sum() > 3000
        network = langid.learn(docs)
        found = langid.marked(docs.where("text <> 'the same text'"), network, "p", "s").groupBy("lang").agg(F.avg((F.col("lang") == F.col("p")).cast("int")).alias("right")).collect()
        assert len(found) == 2 and min(r.right for r in found) > 0.95


def test_training_words_lie_all_over_the_text():
    words = langid._pieces(" ".join(f"w{i}" for i in range(110)))
    assert len(words) == 60 and words[0] == b"w0" and words[-1] == b"w109"
    assert langid._pieces("a b") == [b"a", b"b"] and langid._pieces("") == []
    long = "日本語" * 500
    assert len(langid._pieces(long)) == 60 and max(map(len, langid._pieces(long))) <= langid.PIECE_BYTES


def test_marks_are_the_predictions(messy, documents):
    network = langid.learn(documents)
    docs = messy.withColumnRenamed("lang_pred", "own")
    rows = langid.marked(docs, network, "__l", "__s")
    assert rows.columns == [*docs.columns, "__l", "__s"]
    assert sorted((str(r.doc_id), r["__l"], round(r["__s"], 12)) for r in rows.collect()) == sorted((str(r.doc_id), r.lang_pred, round(r.score, 12)) for r in langid.predict(docs, network).collect())


def test_backpropagation():
    """The gradients agree with finite differences."""
    network = langid.Network(["a", "b", "c"], seed=3)
    for w in network.weights():
        w[...] = w * 2
    for direction in (network.ahead, network.back):
        direction.x, direction.u = direction.x.astype(np.float64), direction.u.astype(np.float64)
    network.out, network.bias = network.out.astype(np.float64), network.bias.astype(np.float64)
    symbols, labels = langid._symbols([b"abc", b"xyz", b"abz"]), np.array([0, 2, 1])

    def loss():
        chances = network.probabilities(symbols)
        return -np.log(chances[:, np.arange(3), labels]).mean()

    rng = np.random.default_rng(0)
    for weights, gradient in zip(network.weights(), network.gradients(symbols, labels)):
        busy = np.argwhere(np.abs(gradient) > 1e-4)
        for at in busy[rng.permutation(len(busy))[:4]]:
            at, step = tuple(at), 1e-3
            old = weights[at]
            weights[at] = old + step
            up = loss()
            weights[at] = old - step
            down = loss()
            weights[at] = old
            assert abs((up - down) / (2 * step) - gradient[at]) < 2e-3 * max(1, abs(gradient[at]))


def test_quality_of_held_out_documents(spark, documents, messy, nothing):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.learn(documents, labels.where(hash_bucket(F.col("doc_id"), 4) != 2))
    rows = quality.score(documents.where(hash_bucket(F.col("doc_id"), 4) == 2), model).join(labels, "doc_id").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.9
    odd = quality.score(messy, model).collect()
    assert len(odd) == len(ROWS) and all(0 <= r.score <= 1 for r in odd)
    assert len({r.score for r in odd if r.doc_id in (4, 8)}) == 1
    assert quality.score(nothing, model).count() == 0
    blank = quality.learn(documents, labels.where("false"))
    assert {r.score for r in quality.score(messy, blank).collect()} == {0.5}


def test_quality_learns_the_least_text_of_a_repeated_key(spark):
    rows = [(i, f"plain words about number {i}" if i % 2 else f"buy now {i} !!!") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id BIGINT, quality INT")
    later = [(i, "zz " + t) for i, t in rows[::3]]
    plain, first, last = (quality.learn(spark.createDataFrame(r, "doc_id BIGINT, text STRING"), labels) for r in (rows, later + rows, rows + later))
    assert np.array_equal(first.evidence, plain.evidence) and np.array_equal(last.evidence, plain.evidence)
    assert first.prior == last.prior == plain.prior


def test_slots_do_not_depend_on_the_neighbours():
    words = [b"a", b"abc", b"abcd", "ü".encode(), b"abc"]
    slots, counts = quality.slots_of(words)
    ends = counts.cumsum()
    for word, end, count in zip(words, ends, counts):
        assert quality.slots_of([word])[0].tolist() == slots[end - count : end].tolist()


def plain_model(texts):
    words = [[*(t or "").encode().lower().split(), b""] for t in texts]
    count, pairs = Counter(w for t in words for w in t), Counter(p for t in words for p in zip([None, *t], t))
    before, after = Counter(w for _, w in pairs), defaultdict(Counter)
    for (u, _), c in pairs.items():
        after[u][min(c, 3)] += 1
        after[u]["all"] += c

    def cut(counts):
        return [0.0, *K.discounts([sum(c == i for c in counts.values()) for i in (1, 2, 3, 4)])]

    d2, d1, types, size = cut(pairs), cut(before), len(pairs), len(count)
    share = sum(d1[min(c, 3)] for c in before.values()) / types if types else 1.0

    def word(w):
        return (max(before[w] - d1[min(before[w], 3)], 0) / types if types else 0) + share / (size + 1)

    def score(text):
        w = [*(text or "").encode().lower().split(), b""]
        total = 0.0
        for u, v in zip([None, *w], w):
            p = word(v)
            if after.get(u):
                a, c = after[u], pairs[u, v]
                p = (max(c - d2[min(c, 3)], 0) + sum(d2[i] * a[i] for i in (1, 2, 3)) * p) / a["all"]
            total += math.log10(p)
        n = sum(count.values())
        return len(w), sum(count[x] > 0 for x in w), sum(math.log10((count[x] + 0.5) / (n + 0.5 * (size + 1))) for x in w), total

    return score


@pytest.mark.parametrize("shard", [4_000_000, 40])
def test_language_model_against_plain_counts(spark, messy, monkeypatch, shard):
    monkeypatch.setattr(K, "SHARD_BIGRAMS", shard)
    monkeypatch.setattr(K, "PART_WORDS", max(50, shard // 10))
    train = [t for i, t in ROWS if i != 1]
    plain = plain_model(train)
    model = K.train(messy.where("doc_id IS DISTINCT FROM 1"))
    rows = K.score(messy, model).collect()
    expected = sorted((i or -1, *plain(t)) for i, t in ROWS)
    got = sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.base_score, r.score) for r in rows)
    for g, e in zip(got, expected, strict=True):
        assert g[:3] == e[:3] and g[3:] == pytest.approx(e[3:], rel=1e-9)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(1, "a b a c b a"), (2, "a b"), (3, "c a c")], "doc_id INT, text STRING")
    model = K.train(docs)
    scorer = K.Scorer(model)
    for u in (b"a", b"c", b"zzz"):
        ends = [b"a", b"b", b"c", b"", b"unknown"]
        alone = scorer.score([[u]])["score"][0]
        assert sum(10 ** (scorer.score([[u, w]])["score"][0] - alone) for w in ends) == pytest.approx(1)


def test_language_model_of_nothing(spark, messy, nothing):
    model = K.train(nothing)
    assert K.score(nothing, model).count() == 0
    rows = K.score(messy, model).collect()
    assert len(rows) == len(ROWS) and all(r.n_known == 0 and abs(r.score) < 1e-9 for r in rows)
