"""Queries over text analysis and BM25."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearfield.functions.text import Analyzer
from nearfield.operators import bm25 as B
from nearfield.operators import evaluate as E
from nearfield.plans.inputs import corpus, text_queries
from nearfield.plans.registry import query
from nearfield.session import work_dir
from nearfield.sources import corpora as C

K = 10
WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
STOPS = ("the", "in", "and", "er")

INDEX = f"""d AS (SELECT doc_id, {WORDS} AS w FROM documents), dl AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS dl FROM d),
p AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY 1, 2),
n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
i AS (SELECT term, df, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf, n AS n_docs, avgdl FROM f, n)"""
RANKED = f"""{INDEX}, q AS (SELECT item_id AS qid, term, count(*) AS qtf FROM (SELECT item_id, unnest({WORDS}) AS term FROM benchmark) GROUP BY 1, 2),
s AS (SELECT q.qid, p.doc_id, round(sum(q.qtf * i.idf * p.tf * 2.2::DOUBLE / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl.dl / i.avgdl))), 9) AS score
FROM q JOIN i ON i.term = q.term JOIN p ON p.term = q.term JOIN dl ON dl.doc_id = p.doc_id GROUP BY 1, 2),
h AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) - 1 AS BIGINT) AS rank FROM s) WHERE rank < {K})"""


def shown(hits, *more):
    return hits.select("qid", F.col("rank").cast("bigint").alias("rank"), "doc_id", F.round("score", 6).alias("score"), *more)


@query(
    "tokenize",
    f"""WITH t AS (SELECT doc_id, list_filter({WORDS}, lambda x: length(x) <= 12 AND x NOT IN ('the', 'in', 'and', 'er')) AS w FROM documents)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS tokens, CAST(len(list_distinct(w)) AS BIGINT) AS terms, md5(array_to_string(w, ' ')) AS text_md5 FROM t""",
)
def tokenize(spark, sf):
    words = Analyzer(max_length=12, stop_words=STOPS).terms(F.col("text"))
    rows = corpus(spark, sf).select("doc_id", words.alias("w"))
    return rows.select(
        "doc_id", F.size("w").cast("bigint").alias("tokens"), F.size(F.array_distinct("w")).cast("bigint").alias("terms"), F.md5(F.array_join("w", " ")).alias("text_md5")
    )


@query("postings", f"WITH {INDEX} SELECT term, p.doc_id, tf, dl FROM p JOIN dl ON dl.doc_id = p.doc_id")
def postings(spark, sf):
    return B.postings(B.analyzed(corpus(spark, sf)))


@query("corpus_stats", f"WITH {INDEX} SELECT term, df, round(idf, 6) AS idf, n_docs, round(avgdl, 6) AS avgdl FROM i")
def corpus_stats(spark, sf):
    stats = B.corpus_stats(B.analyzed(corpus(spark, sf)))
    return stats.select("term", "df", F.round("idf", 6).alias("idf"), "n_docs", F.round("avgdl", 6).alias("avgdl"))


@query("bm25_topk", f"WITH {RANKED} SELECT qid, rank, doc_id, round(score, 6) AS score FROM h")
def bm25_topk(spark, sf):
    return shown(B.bm25_topk(corpus(spark, sf), text_queries(spark, sf), K))


@query("bm25_by_postings", f"WITH {RANKED} SELECT qid, rank, doc_id, round(score, 6) AS score FROM h")
def bm25_by_postings(spark, sf):
    """The path for query sets of any size."""
    return shown(B.bm25_by_postings(corpus(spark, sf), text_queries(spark, sf), K))


@query("bm25_stored", f"WITH {RANKED} SELECT qid, rank, doc_id, round(score, 6) AS score FROM h")
def bm25_stored(spark, sf):
    """The same ranking over stored block postings."""
    path = work_dir(spark, "index")
    C.write_documents(corpus(spark, sf), path)
    blocks, stats = C.read_blocks(spark, path)
    return shown(B.bm25_from_blocks(blocks, stats, text_queries(spark, sf), K))


@query("bm25_payload_text", f"WITH {RANKED} SELECT qid, rank, h.doc_id, round(score, 6) AS score, md5(t.text) AS text_md5 FROM h JOIN documents t ON t.doc_id = h.doc_id")
def bm25_payload_text(spark, sf):
    docs, asked = corpus(spark, sf), text_queries(spark, sf)
    return shown(B.with_text(B.bm25_topk(docs, asked, K), docs, asked.count() * K), F.md5("text").alias("text_md5"))


@query(
    "bm25_ground_truth",
    f"WITH {RANKED}, g AS (SELECT qid, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS ids, count(*) AS n FROM h GROUP BY 1) "
    f"SELECT b.item_id AS qid, coalesce(ids, '') || repeat(',-1', CAST({K} - coalesce(n, 0) AS INTEGER)) AS neighbors, coalesce(n, 0) AS found FROM benchmark b LEFT JOIN g ON g.qid = b.item_id",
)
def bm25_ground_truth(spark, sf):
    truth = B.bm25_ground_truth(corpus(spark, sf), text_queries(spark, sf), K)
    return truth.select(
        "qid", F.array_join("neighbors", ",").alias("neighbors"), F.size(B.strip_padding(F.col("neighbors"))).cast("bigint").alias("found")
    )


@query(
    "recall_fts",
    f"""WITH {RANKED}, w AS (SELECT qid, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS n FROM s) WHERE n <= 20),
    x AS (SELECT qid, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score2 DESC, doc_id) AS n FROM
      (SELECT q.qid, p.doc_id, round(sum(q.qtf * i.idf * p.tf * 2.2::DOUBLE / (p.tf + 1.2::DOUBLE)), 9) AS score2 FROM q JOIN i ON i.term = q.term JOIN p ON p.term = q.term GROUP BY 1, 2)) WHERE n <= {K})
    SELECT w.qid, round(count(x.doc_id) / CAST(count(*) AS DOUBLE), 6) AS recall FROM w LEFT JOIN x ON x.qid = w.qid AND x.doc_id = w.doc_id GROUP BY 1""",
)
def recall_fts(spark, sf):
    """How much of the top 20 a ranking without length normalisation finds in its top 10."""
    docs, asked = corpus(spark, sf), text_queries(spark, sf)
    truth = B.bm25_topk(docs, asked, 20)
    answer = B.bm25_topk(docs, asked, K, params=B.Bm25(b=0.0))
    return E.recall_fts(answer, truth, K).select("qid", F.round("recall", 6).alias("recall"))
