import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from nearfield.functions.text import Analyzer
from nearfield.operators import bm25 as B
from nearfield.sources import corpora as C

DOCS = {
    1: "The quick brown fox jumps over the lazy dog",
    2: "the dog sleeps; the DOG snores",
    3: "Ärger über Straßen und 42 Füchse",
    4: "fox fox fox",
    5: "",
    6: None,
    7: "fox fox fox",
}
QUERIES = {10: "quick fox", 11: "dog dog", 12: "straßen 42", 13: "nothing here", 14: ""}


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(k, k1=1.2, b=0.75, avgdl=None):
    docs = {i: words(t) for i, t in DOCS.items()}
    n = len(docs)
    mean = avgdl or sum(map(len, docs.values())) / n
    df = Counter(t for ws in docs.values() for t in set(ws))
    out = []
    for qid, text in QUERIES.items():
        scores = {}
        for term, qtf in Counter(words(text)).items():
            for i, ws in docs.items():
                tf = ws.count(term)
                if tf:
                    idf = math.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5))
                    scores[i] = scores.get(i, 0) + qtf * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(ws) / mean))
        best = sorted(scores.items(), key=lambda s: (-round(s[1], 9), s[0]))[:k]
        out += [(qid, r, i, round(s, 6)) for r, (i, s) in enumerate(best)]
    return sorted(out)


@pytest.fixture(scope="module")
def tables(spark):
    corpus = spark.createDataFrame(list(DOCS.items()), "doc_id BIGINT, text STRING").repartition(3)
    return corpus, spark.createDataFrame(list(QUERIES.items()), "qid BIGINT, text STRING")


def rows(hits):
    return sorted((r.qid, r.rank, r.doc_id, round(r.score, 6)) for r in hits.collect())


@pytest.mark.parametrize("params", [B.Bm25(), B.Bm25(k1=0.9, b=0.4), B.Bm25(avgdl=3.0)])
def test_ranking_equals_brute_force(tables, params):
    corpus, queries = tables
    want = brute(3, params.k1, params.b, params.avgdl)
    assert rows(B.bm25_topk(corpus, queries, 3, params=params)) == want
    assert rows(B.bm25_by_postings(corpus, queries, 3, params=params)) == want


def test_stored_index_gives_the_same_ranking(spark, tables, tmp_path):
    corpus, queries = tables
    assert C.write_documents(corpus, str(tmp_path)) == len(DOCS)
    stored, stats = C.read_postings(spark, str(tmp_path))
    assert rows(B.bm25_from_postings(stored, stats, queries, 3)) == brute(3)
    blocks, stats = C.read_blocks(spark, str(tmp_path))
    assert rows(B.bm25_from_blocks(blocks, stats, queries, 3)) == brute(3)
    plain = B.postings(B.analyzed(corpus))
    assert sorted(stored.drop("row").collect()) == sorted(plain.collect())
    assert sorted(stats.collect()) == sorted(B.term_stats(B.analyzed(corpus)).select(*stats.columns).collect())


def test_truth_is_padded_and_stripped(tables):
    corpus, queries = tables
    truth = {r.qid: r for r in B.bm25_ground_truth(corpus, queries, 3).select("qid", "neighbors", B.strip_padding(F.col("neighbors")).alias("ids")).collect()}
    assert truth[13].neighbors == ["-1", "-1", "-1"] and truth[13].ids == []
    assert truth[12].neighbors == ["3", "-1", "-1"] and truth[10].ids == ["1", "4", "7"]


def test_analyzers(spark):
    df = spark.createDataFrame([("The Cat-sat ON extraordinarily the mat",)], "text STRING")

    def terms(analyzer):
        return df.select(analyzer.terms(F.col("text"))).first()[0]

    given = Analyzer.from_manifest({"tokenizer": "standard", "filter": ["lowercase", {"type": "length", "max": 5}, {"type": "stop", "stop_words": ["the", "on"]}]})
    assert terms(given) == ["cat", "sat", "mat"]
    as_text = Analyzer.from_manifest({"tokenizer": "standard", "filter": ["lowercase", '{"type": "stop", "stop_words": "the,on"}']})
    assert terms(as_text) == ["cat", "sat", "extraordinarily", "mat"]
    assert terms(Analyzer.from_manifest({"tokenizer": "whitespace", "filter": []}))[:2] == ["The", "Cat-sat"]
    assert len(terms(Analyzer(tokenizer="keyword"))) == 1
    assert terms(Analyzer.from_manifest(None))[0] == "the"
    with pytest.raises(ValueError):
        Analyzer(tokenizer="other")


def test_manifest(spark, tables, tmp_path):
    corpus, queries = tables
    path = tmp_path / "build_manifest.json"
    path.write_text(
        '{"source_ir_dataset": "a/b",\n "doc_limit": 7, "indexed_doc_count": 6, "query_count": 5,\n'
        ' "bm25": {"k1": 0.9, "b": 0.4}, "analyzer": {"tokenizer": "standard", "filter": ["lowercase", {"type": "length", "max": 40}]}}'
    )
    manifest = C.read_manifest(spark, str(path))
    params, analyzer = C.manifest_settings(manifest)
    assert params == B.Bm25(k1=0.9, b=0.4) and analyzer == Analyzer(max_length=40)
    bad = C.manifest_violations(manifest, 7, "a/b", queries, queries.limit(4)).collect()
    assert sorted((r.field, r.found, r.expected) for r in bad) == [("indexed_doc_count", "6", "7"), ("truth_count", "4", "5")]


def test_titles_and_blanks(spark):
    df = spark.createDataFrame([(1, "T", "a\tb\nc "), (2, None, None)], "doc_id BIGINT, title STRING, text STRING")
    assert [r.text for r in C.titled_corpus(df).orderBy("doc_id").collect()] == ["T a b c", ""]
    assert [r.text for r in C.passage_corpus(df).orderBy("doc_id").collect()] == ["a b c ", None]


def test_all_paths_agree_on_repeated_and_text_ids(spark, monkeypatch):
    """Every row is a document; text ids work on both sides; ids keep their types on every path."""
    docs = [(1, "quick fox"), (1, "quick fox jumps"), (2, "lazy dog"), (3, "fox")]
    asked = [(5, "quick fox"), (6, "dog")]
    for kinds in (("INT", "INT"), ("INT", "STRING"), ("STRING", "BIGINT")):
        cast = [str if k == "STRING" else int for k in kinds]
        corpus = spark.createDataFrame([(cast[0](i), t) for i, t in docs], f"doc_id {kinds[0]}, text STRING")
        queries = spark.createDataFrame([(cast[1](i), t) for i, t in asked], f"qid {kinds[1]}, text STRING")
        one = B.bm25_topk(corpus, queries, 3)
        monkeypatch.setattr(B, "SCAN_TERMS", -1)
        two = B.bm25_topk(corpus, queries, 3)
        monkeypatch.undo()
        assert [f.dataType for f in one.schema] == [f.dataType for f in two.schema]
        rows = [sorted((str(r.qid), r["rank"], str(r.doc_id), round(r.score, 6)) for r in df.collect()) for df in (one, two)]
        assert rows[0] == rows[1] and [r[2] for r in rows[0] if r[0] == "5"].count("1") == 2


def test_stored_postings_keep_rows_with_one_doc_id_apart(spark, tmp_path):
    """All three paths give one ranking where a doc_id repeats, rows of equal and of different length."""
    docs = [(1, "quick fox"), (1, "quick fox jumps"), (1, "brown fox"), (2, "lazy dog"), (3, "fox"), (3, "fox")]
    corpus = spark.createDataFrame(docs, "doc_id BIGINT, text STRING").repartition(3)
    queries = spark.createDataFrame([(5, "quick fox"), (6, "dog")], "qid BIGINT, text STRING")
    assert C.write_documents(corpus, str(tmp_path)) == len(docs)
    stored, stats = C.read_postings(spark, str(tmp_path))
    scan = rows(B.bm25_topk(corpus, queries, 10))
    assert len(scan) == 6 and rows(B.bm25_by_postings(corpus, queries, 10)) == scan
    assert rows(B.bm25_from_postings(stored, stats, queries, 10)) == scan
    blocks, stats = C.read_blocks(spark, str(tmp_path))
    assert rows(B.bm25_from_blocks(blocks, stats, queries, 10)) == scan
