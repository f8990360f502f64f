"""Block postings: numbers, blocks, pruning, and the ranking against the scan."""

import random

import numpy as np
import pytest

from nearfield.operators import bm25 as B
from nearfield.operators import bm25_blocks as K
from nearfield.sources import corpora as C


def test_numbers_come_back():
    rng = np.random.default_rng(4)
    for values in (np.array([], np.int64), np.array([0]), np.array([127, 128, 16383, 16384, 2**31, 2**40]), rng.integers(0, 2 ** rng.integers(1, 40, 5000))):
        flat, sizes = K.pack_numbers(values)
        assert K.unpack_numbers(flat.tobytes()).tolist() == values.tolist() and sizes.sum() == len(flat)


def corpus_of(n, seed=1):
    """Few common words, many rare ones, and copies of one text in a third of the rows."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(400)], k=rng.randint(0, 60))) for _ in range(n)]
    return [texts[0] if i % 3 == 0 else t for i, t in enumerate(texts)]


def shown(hits):
    return sorted((str(r.qid), r["rank"], str(r.doc_id), round(r.score, 6)) for r in hits.collect())


@pytest.mark.parametrize("sizes", [(1024, 1 << 16), (3, 50)])
@pytest.mark.parametrize("kind", ["BIGINT", "STRING"])
def test_same_ranking_as_the_scan(spark, tmp_path, monkeypatch, sizes, kind):
    monkeypatch.setattr(K, "BLOCK", sizes[0])
    monkeypatch.setattr(K, "SEGMENT_DOCS", sizes[1])
    cast = str if kind == "STRING" else int
    docs = [(cast(i % 250), t) for i, t in enumerate(corpus_of(300))] + [(cast(7), None), (cast(8), "")]
    corpus = spark.createDataFrame(docs, f"doc_id {kind}, text STRING").repartition(3)
    asked = [(cast(i), t) for i, t in enumerate(corpus_of(25, 2))] + [(cast(900), "unknown words"), (cast(901), ""), (cast(902), None)]
    queries = spark.createDataFrame(asked, f"qid {kind}, text STRING")
    assert C.write_documents(corpus, str(tmp_path)) == len(docs)
    blocks, stats = C.read_blocks(spark, str(tmp_path))
    want = shown(B.bm25_topk(corpus, queries, 10))
    for params in (None, B.Bm25(k1=0.9, b=0.4), B.Bm25(avgdl=3.0)):
        want = shown(B.bm25_topk(corpus, queries, 10, params=params))
        assert shown(B.bm25_from_blocks(blocks, stats, queries, 10, params=params)) == want
    monkeypatch.setattr(B, "SCAN_TERMS", -1)
    found = B.bm25_from_blocks(blocks, stats, queries, 10, params=B.Bm25(avgdl=3.0))
    assert shown(found) == want and found.schema["doc_id"].dataType == corpus.schema["doc_id"].dataType


def test_blocks_that_cannot_matter_are_not_read(monkeypatch):
    """A common term adds little: of its blocks only those near a candidate are read, and the scores are exact."""
    rng = np.random.default_rng(0)
    n = 20_000
    dl = np.full(n, 10)

    def impact(tf, dl):
        return tf / (tf + 1.0)

    def term(docs):
        made, out = np.sort(docs), K._Term(impact, dl)
        for at in range(0, len(made), 100):
            part = made[at : at + 100]
            flat, _ = K.pack_numbers(np.column_stack((np.diff(part, prepend=0), np.ones(len(part), np.int64))).ravel())
            out.add({"data": flat.tobytes(), "first": part[0], "last": part[-1], "max_tf": 1, "min_dl": 10})
        return out

    rare, common = rng.choice(n, 20, replace=False), rng.choice(n, 15_000, replace=False)
    terms = [(8.0, term(rare)), (0.5, term(common))]
    full = np.zeros(n)
    full[rare] += 4.0
    full[common] += 0.25
    total = np.zeros(n)
    docs = K.rank_segment(terms, total, 1.0)
    assert sorted(docs) == sorted(rare) and np.allclose(total[docs], full[docs])
    assert np.count_nonzero(total) == len(docs)
    assert len(terms[1][1].read) <= 20 < len(terms[1][1].blocks)
    total = np.zeros(n)
    assert len(K.rank_segment(terms, total, 5.0)) == 0 and not total.any()
    assert len(K.rank_segment(terms, np.zeros(n), -np.inf)) == np.count_nonzero(full)


def test_an_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id BIGINT, text STRING")
    queries = spark.createDataFrame([(1, "a b")], "qid BIGINT, text STRING")
    assert C.write_documents(none, str(tmp_path)) == 0
    assert B.bm25_from_blocks(*C.read_blocks(spark, str(tmp_path)), queries, 5).count() == 0
    odd = spark.createDataFrame([(1.5, "a")], "doc_id DOUBLE, text STRING")
    with pytest.raises(TypeError, match="whole numbers"):
        B.block_postings(B.analyzed(odd))
