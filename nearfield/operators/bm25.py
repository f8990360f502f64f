"""BM25 ranking (Robertson / Lucene form) over tokenised documents.

    idf = ln(1 + (N - df + 0.5) / (df + 0.5))
    tf part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))

A query ranks every document holding at least one of its terms; a term repeated in the
query counts as often as it occurs. Order is the score rounded to 9 decimals, then the
document id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from nearfield.functions.text import Analyzer
from nearfield.operators.bm25_blocks import postings_rows, rank_blocks, write_blocks
from nearfield.operators.bm25_scan import PARTIAL_DDL, STATS_DDL, WHOLE_NO, QueryTerms, count_terms, score_documents
from nearfield.operators.fetch import attach
from nearfield.operators.nearest import top_k
from nearfield.sizing import broadcast_bounded, settle, spread

_WHOLE = ""  # no token is empty, so this term stands for the document itself


@dataclass(frozen=True)
class Bm25:
    """Parameters; ``avgdl`` is measured unless given."""

    k1: float = 1.2
    b: float = 0.75
    avgdl: float | None = None

    def tf_part(self, tf: Column, dl: Column, avgdl: float) -> Column:
        spread = F.lit(self.k1) * (F.lit(1.0 - self.b) + F.lit(self.b) * dl / F.lit(avgdl))
        return tf * F.lit(self.k1 + 1.0) / (tf + spread)


def analyzed(corpus: DataFrame, analyzer: Analyzer | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, tokens, dl``, after ``doc_id`` the columns to keep."""
    tokens = (analyzer or Analyzer()).terms(F.col("text"))
    return corpus.select("doc_id", *keep, tokens.alias("tokens")).withColumn("dl", F.size("tokens").cast("bigint"))


def postings(docs: DataFrame) -> DataFrame:
    """``term, doc_id, tf, dl`` of analysed documents; counts are combined before the shuffle.

    Documents with a ``row`` number are told apart by it, also where a doc_id repeats, and it comes last.
    """
    rows = ["row"] if "row" in docs.columns else []
    occurrences = docs.select("doc_id", *rows, "dl", F.explode("tokens").alias("term"))
    return occurrences.groupBy("term", "doc_id", *rows, "dl").agg(F.count(F.lit(1)).alias("tf")).select("term", "doc_id", "tf", "dl", *rows)


def term_stats(docs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """``term, df, total_dl``, with the whole corpus under the empty term. One pass."""
    terms = docs.select("dl", F.explode(F.array_append(F.array_distinct("tokens"), F.lit(_WHOLE))).alias("term"))
    if vocabulary is not None:
        known = vocabulary.withColumn("known", F.lit(True))
        terms = terms.join(known, "term", "left").where(F.col("known") | (F.col("term") == _WHOLE)).drop("known")
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("dl").alias("total_dl"))


def corpus_size(stats: DataFrame) -> tuple[int, float]:
    """Number of documents and their mean length (1.0 for an empty corpus)."""
    row = stats.where(F.col("term") == _WHOLE).select("df", "total_dl").first()
    if row is None or not row["df"]:
        return 0, 1.0
    return row["df"], (row["total_dl"] / row["df"]) or 1.0


def idf(df: Column, n: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """``term, df, idf, n_docs, avgdl`` of every term."""
    stats = term_stats(docs)
    whole = stats.where(F.col("term") == _WHOLE)
    n = F.lit(whole.select("df").scalar())
    mean = F.lit(whole.select(F.col("total_dl") / F.col("df")).scalar())
    return stats.where(F.col("term") != _WHOLE).select(
        "term", "df", idf(F.col("df"), n).alias("idf"), n.alias("n_docs"), mean.alias("avgdl")
    )


def query_terms(queries: DataFrame, analyzer: Analyzer | None = None) -> DataFrame:
    """``qid, term, qtf`` of text queries (``qid, text``)."""
    tokens = (analyzer or Analyzer()).terms(F.col("text"))
    return (
        queries.select("qid", F.explode(tokens).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))
    )


def _weights(asked: DataFrame, stats: DataFrame, n_asked: int, width: int, n: int) -> DataFrame:
    """``term, qid, weight``: at most one row per query and term."""
    rows = asked.join(broadcast_bounded(stats, n_asked, width), "term")
    return rows.select("term", "qid", (F.col("qtf") * idf(F.col("df"), F.lit(n))).alias("weight"))


SCAN_TERMS = 2_000_000
SCAN_BYTES = 256 * 1024 * 1024


def bm25_topk(corpus: DataFrame, queries: DataFrame, k: int, analyzer: Analyzer | None = None, params: Bm25 | None = None) -> DataFrame:
    """The k best documents of every query: ``qid, rank, doc_id, score``.

    Query terms up to a measured bound are broadcast. Documents are tokenised where they
    are read (a small corpus is dealt over the cores first) and scored inside Arrow batches,
    once to count the terms and once to rank: each task passes on one row per query term,
    then k rows per query. Larger query sets, and text ids on either side, are joined with
    the postings instead. Every row is a document, also where a doc_id repeats, and ids keep
    the types they have.
    """
    params = params or Bm25()
    asked, n_asked, width = _asked(queries, analyzer)
    whole = all(isinstance(df.schema[c].dataType, T.IntegralType) for df, c in ((corpus, "doc_id"), (queries, "qid")))
    if n_asked > SCAN_TERMS or n_asked * width > SCAN_BYTES or not whole:
        return bm25_by_postings(corpus, queries, k, analyzer, params)
    docs = analyzed(spread(corpus.select("doc_id", "text"), "doc_id"), analyzer)
    terms = QueryTerms.build(asked.select(F.col("qid").cast("bigint").alias("qid"), "term", "qtf").toArrow())
    share = corpus.sparkSession.sparkContext.broadcast
    counted = docs.select("dl", "tokens").mapInArrow(count_terms(share(terms.parts())), STATS_DDL)
    stats = counted.groupBy("term_no").agg(F.sum("df").alias("df"), F.sum("total_dl").alias("dl")).toArrow()
    number, found = stats["term_no"].to_numpy(), stats["df"].to_numpy()
    df = np.zeros(len(terms.vocabulary))
    df[number[number >= 0]] = found[number >= 0]
    n = int(found[number == WHOLE_NO].sum())
    measured = float(stats["dl"].to_numpy()[number == WHOLE_NO].sum()) / max(n, 1) or 1.0
    weighted = terms.weighted(np.log(1.0 + (n - df + 0.5) / (df + 0.5)))
    score = score_documents(share(weighted.parts()), k, params.k1, params.b, params.avgdl or measured)
    partial = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "dl", "tokens").mapInArrow(score, PARTIAL_DDL)
    best = top_k(partial, k, tie="doc_id", ascending=False)
    kinds = queries.schema["qid"].dataType, corpus.schema["doc_id"].dataType
    return best.select(F.col("qid").cast(kinds[0]).alias("qid"), "rank", F.col("doc_id").cast(kinds[1]).alias("doc_id"), "score")


def bm25_by_postings(corpus: DataFrame, queries: DataFrame, k: int, analyzer: Analyzer | None = None, params: Bm25 | None = None) -> DataFrame:
    """As ``bm25_topk``, by joins: for query sets of any size.

    Only occurrences of query terms leave the second scan. They are moved once, by
    document, so that term counts, query sums and each task's share of the top k need no
    further exchange.
    """
    params = params or Bm25()
    docs = analyzed(corpus, analyzer)
    asked, n_asked, width = _asked(queries, analyzer)
    vocabulary = broadcast_bounded(asked.select("term").distinct(), n_asked, width)
    stats = settle(term_stats(docs, vocabulary))
    n, measured = corpus_size(stats)
    weights = broadcast_bounded(_weights(asked, stats, n_asked, width, n), n_asked, width)
    tf = (
        docs.withColumn("row", F.monotonically_increasing_id())
        .select("doc_id", "row", "dl", F.explode("tokens").alias("term"))
        .join(vocabulary, "term", "left_semi")
        .repartition("doc_id", "row")
        .groupBy("doc_id", "row", "dl", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    return _rank(tf, weights, k, params, params.avgdl or measured)


def _asked(queries: DataFrame, analyzer: Analyzer | None) -> tuple[DataFrame, int, int]:
    """Query terms, computed once, their number, and the measured size of such a row."""
    asked = settle(query_terms(queries, analyzer))
    n, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    return asked, n, 64 + size // max(n, 1)


def block_postings(docs: DataFrame) -> DataFrame:
    """Postings of analysed documents in blocks, made where the documents are read: nothing is shuffled.

    One row per segment of at most 65 536 documents of a task, with the ids and lengths of its
    documents (under the empty term), and one row per block of a term, in the order of the terms.
    Documents without an id are left out. Ids are whole numbers or texts.
    """
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, (T.IntegralType, T.StringType)):
        raise TypeError(f"doc_id is {kind.simpleString()}; block postings take whole numbers and texts")
    ddl = f"segment BIGINT, term STRING, n BIGINT, first INT, last INT, max_tf BIGINT, min_dl BIGINT, total_dl BIGINT, data BINARY, ids ARRAY<{kind.simpleString()}>"
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "tokens").mapInArrow(write_blocks(to_arrow_type(kind)), ddl)


def block_stats(blocks: DataFrame) -> DataFrame:
    """``term, df, total_dl`` as ``term_stats`` gives, from the heads of the blocks."""
    return blocks.groupBy("term").agg(F.sum("n").alias("df"), F.sum("total_dl").alias("total_dl"))


def _by_segment(blocks: DataFrame) -> DataFrame:
    return blocks.repartition("segment").sortWithinPartitions("segment", "term")


def unpacked(blocks: DataFrame) -> DataFrame:
    """``term, doc_id, tf, dl, row`` of block postings."""
    kind = blocks.schema["ids"].dataType.elementType
    return _by_segment(blocks).mapInArrow(postings_rows(to_arrow_type(kind)), f"term STRING, doc_id {kind.simpleString()}, tf BIGINT, dl BIGINT, row BIGINT")


def bm25_from_blocks(blocks: DataFrame, stats: DataFrame, queries: DataFrame, k: int, analyzer: Analyzer | None = None, params: Bm25 | None = None) -> DataFrame:
    """As ``bm25_topk``, over stored block postings and their term statistics.

    Only blocks of query terms, and the ids and lengths of the documents, leave the scan; they are
    moved by segment, which is bounded in size however common a term is. A task ranks its segments
    one after the other and leaves out what cannot reach the k-th score it has. Query sets past the
    bound of ``bm25_topk`` are joined with the unpacked postings.
    """
    params = params or Bm25()
    asked, n_asked, width = _asked(queries, analyzer)
    wanted = asked.select("term").distinct()
    if n_asked > SCAN_TERMS or n_asked * width > SCAN_BYTES:
        needed = blocks.join(broadcast_bounded(_with_whole(wanted), n_asked + 1, width), "term", "left_semi")
        return bm25_from_postings(unpacked(needed), stats, queries, k, analyzer, params)
    table = asked.select("qid", "term", "qtf").toArrow()
    qids = table["qid"].combine_chunks().dictionary_encode()
    terms = QueryTerms.build(pa.table({"qid": qids.indices, "term": table["term"], "qtf": table["qtf"]}))
    n, measured = corpus_size(stats)
    known = stats.join(broadcast_bounded(wanted, n_asked, width), "term", "left_semi").select("term", "df").toArrow()
    df = np.zeros(len(terms.vocabulary))
    df[pc.index_in(known["term"].combine_chunks(), value_set=terms.vocabulary).to_numpy(zero_copy_only=False)] = known["df"].to_numpy()
    weighted = terms.weighted(np.log(1.0 + (n - df + 0.5) / (df + 0.5)))
    kinds = queries.schema["qid"].dataType, blocks.schema["ids"].dataType.elementType
    shared = queries.sparkSession.sparkContext.broadcast((*weighted.parts(), qids.dictionary))
    rank = rank_blocks(shared, k, params.k1, params.b, params.avgdl or measured, tuple(map(to_arrow_type, kinds)))
    needed = blocks.join(broadcast_bounded(_with_whole(wanted), n_asked + 1, width), "term", "left_semi")
    partial = _by_segment(needed).mapInArrow(rank, f"qid {kinds[0].simpleString()}, doc_id {kinds[1].simpleString()}, score DOUBLE")
    return top_k(partial, k, tie="doc_id", ascending=False).select("qid", "rank", "doc_id", "score")


def _with_whole(terms: DataFrame) -> DataFrame:
    return terms.union(terms.sparkSession.range(1).select(F.lit(_WHOLE)))


def bm25_from_postings(stored: DataFrame, stats: DataFrame, queries: DataFrame, k: int, analyzer: Analyzer | None = None, params: Bm25 | None = None) -> DataFrame:
    """As ``bm25_topk``, over stored postings and their term statistics."""
    params = params or Bm25()
    asked, n_asked, width = _asked(queries, analyzer)
    n, measured = corpus_size(stats)
    wanted = asked.select("term").distinct()
    known = settle(stats.join(broadcast_bounded(wanted, n_asked, width), "term", "left_semi"))
    weights = broadcast_bounded(_weights(asked, known, n_asked, width, n), n_asked, width)
    return _rank(stored, weights, k, params, params.avgdl or measured)


def _rank(tf: DataFrame, weights: DataFrame, k: int, params: Bm25, avgdl: float) -> DataFrame:
    part = F.col("weight") * params.tf_part(F.col("tf"), F.col("dl"), avgdl)
    rows = ["row"] if "row" in tf.columns else []
    scored = tf.join(weights, "term").groupBy("qid", "doc_id", *rows).agg(F.round(F.sum(part), 9).alias("score"))
    return top_k(scored, k, tie="doc_id", ascending=False).select("qid", "rank", "doc_id", "score")


def with_text(hits: DataFrame, corpus: DataFrame, max_hits: int) -> DataFrame:
    """Add document texts to hits (at most ``max_hits`` rows); only those meet the corpus."""
    return attach(corpus.select("doc_id", "text"), hits, max_hits, key="doc_id").select("qid", "rank", "doc_id", "score", "text")


def bm25_ground_truth(corpus: DataFrame, queries: DataFrame, k: int, analyzer: Analyzer | None = None, params: Bm25 | None = None) -> DataFrame:
    """``qid, neighbors``: ids of the k best documents as text, filled up to k with ``-1``."""
    hits = bm25_topk(corpus, queries, k, analyzer, params)
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda h: h["doc_id"].cast("string")
    )
    found = hits.groupBy("qid").agg(ordered.alias("found"))
    kept = F.coalesce(F.col("found"), F.expr("cast(array() as array<string>)"))
    padded = F.concat(kept, F.array_repeat(F.lit("-1"), F.lit(k) - F.size(kept)))
    return queries.select("qid").join(found, "qid", "left").select("qid", padded.alias("neighbors"))


def strip_padding(neighbors: Column) -> Column:
    """Neighbour list without its ``-1`` entries, as text ids."""
    return F.filter(F.transform(neighbors, lambda x: x.cast("string")), lambda x: x != "-1")
