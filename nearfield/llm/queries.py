"""Named queries of the corpus operators. The rows come from the operator; the query only derives its digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import bpe, decontaminate, fill_middle, hamming_index, kneser_ney, langid, line_dedup, packing, pii, quality, sharding, simhash, whitening
from nearfield.llm.common import hash_bucket, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_byte_level_bpe")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf, "documents"), RANKS, public_tokenizers.PATTERN, decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


_PII_SQL = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS size FROM documents),
    k AS (SELECT d.*, ord, kind, regexp_extract_all(t, re) AS m, string_split_regex(t, re) AS g
          FROM d, (VALUES (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
                          (2, 'card', '[0-9]([\x20-]?[0-9])+'), (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')) v(ord, kind, re)),
    s AS (SELECT doc_id, t, size, ord, kind, m[i] AS v, regexp_replace(m[i], '[^0-9]', '', 'g') AS digits,
                 (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS b
          FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k)),
    base AS (SELECT *, b + length(v) AS e, ord::VARCHAR || ':' || v AS entity FROM s WHERE CASE kind WHEN 'email' THEN true
          WHEN 'ip' THEN list_bool_and(list_transform(string_split(v, '.'), lambda x: coalesce(try_cast(nullif(ltrim(x, '0'), '') AS BIGINT), CASE WHEN ltrim(x, '0') = '' THEN 0 ELSE 256 END) <= 255))
          WHEN 'card' THEN length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i:
               ([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 0, 2, 4, 6, 8, 1, 3, 5, 7, 9])[1 + CAST(substr(digits, length(digits) - i + 1, 1) AS INT) + CASE WHEN i % 2 = 0 THEN 10 ELSE 0 END])) % 10 = 0
          ELSE length(digits) BETWEEN 9 AND 15 END),
    w AS (SELECT *, substr(t, lo + 1, hi - lo) AS near FROM (
          SELECT doc_id, t, size, entity, b, e, greatest(0, b - CONTEXT) AS lo, b AS hi FROM base UNION ALL SELECT doc_id, t, size, entity, b, e, e, least(size, e + CONTEXT) FROM base)),
    wm AS (SELECT *, regexp_extract_all(near, '\p{L}{3,}') AS m, string_split_regex(near, '\p{L}{3,}') AS g FROM w),
    wp AS (SELECT doc_id, entity, size, b, e, lo, hi, lower(m[i]) AS term, length(m[i]) AS n,
                  (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS pos
           FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM wm)),
    occ AS (SELECT doc_id, entity, term, lo + pos AS b, lo + pos + n AS e FROM wp o
            WHERE (pos > 0 OR lo = 0 OR lo = o.e) AND (pos + n < hi - lo OR hi = size OR hi = o.b)),
    free AS (SELECT * FROM occ WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = occ.doc_id AND occ.b < base.e AND base.b < occ.e)),
    pair AS (SELECT entity, term, count(DISTINCT doc_id) AS c FROM free GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 3),
    ent AS (SELECT entity, count(DISTINCT doc_id) AS c FROM base GROUP BY 1),
    has AS (SELECT term, count(DISTINCT doc_id) AS c FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(t), '\p{L}{3,}'))) AS term FROM d) WHERE term IN (SELECT term FROM pair) GROUP BY 1),
    told AS (SELECT pair.entity, pair.term, CASE WHEN ent.c < n THEN ln(n * pair.c / (has.c * ent.c)) / ln(n / ent.c) ELSE 0 END AS disclosure
             FROM pair JOIN ent USING (entity) JOIN has USING (term), (SELECT count(*)::DOUBLE AS n FROM d)),
    marked AS (SELECT doc_id, b, e, min(CASE WHEN disclosure >= 0.9 THEN 4 ELSE 5 END) AS ord FROM free JOIN told USING (entity, term) WHERE disclosure >= 0.7 GROUP BY 1, 2, 3),
    spans AS (SELECT doc_id, ord, b, kind || ':' || b || ':' || e AS span FROM base
              UNION ALL SELECT doc_id, ord, b, CASE ord WHEN 4 THEN 'removed' ELSE 'generalised' END || ':' || b || ':' || e FROM marked)
    SELECT d.doc_id, count(CASE WHEN ord = 0 THEN 1 END) AS n_email, count(CASE WHEN ord = 1 THEN 1 END) AS n_ip, count(CASE WHEN ord = 2 THEN 1 END) AS n_card,
           count(CASE WHEN ord = 3 THEN 1 END) AS n_phone, sha256(coalesce(string_agg(span, ',' ORDER BY ord, b) FILTER (ord < 4), '')) AS base_sha256,
           coalesce(string_agg(span, ',' ORDER BY ord, b), '') AS spans
    FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id
    """.replace("CONTEXT", str(pii.CONTEXT))


@query("op2_pii", _PII_SQL)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.find(table(spark, sf, "documents"))
    base, terms = pii.written("base", pii.KINDS), pii.written("terms", pii.TERM_KINDS)
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {i})) AS bigint)").alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, terms), ",").alias("spans"))


@query("op3_quality_classifier")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.learn(docs, labels.where(hash_bucket(F.col("doc_id"), 4) != 2))
    found = quality.score(docs, model)
    return found.select("doc_id", (hash_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query(
    "op4_benchmark_decontamination",
    f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
           FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
    dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
           FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
    hit AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN bw USING (win) WHERE dw.n = bw.n),
    words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
    its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
    """,
)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


@query("op5_line_dedup")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    kept = line_dedup.deduplicate(table(spark, sf, "documents"))
    removed = F.array_except(F.sequence(F.lit(0), F.col("n_lines") - 1), "kept")
    return kept.select("doc_id", "n_lines", F.size("kept").alias("n_kept"), F.array_join(removed.cast("array<string>"), ",").alias("removed"))


@query("op6_approximate_nearest_neighbours")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    found = hamming_index.search(table(spark, sf, "embeddings"), F.col("id") % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("op7_simhash_near_dedup")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.classes(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query("op8_language_id")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held = hash_bucket(F.col("doc_id"), 3) == 1
    found = langid.predict(docs, langid.learn(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query(
    "op9_sharding",
    f"""
    WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
                      lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT), 60, '0') AS bits FROM documents),
    b AS (SELECT depth, substr(bits, 1, depth) AS shard, sum(n_bytes)::BIGINT AS shard_bytes
          FROM d, (SELECT unnest(range(0, 31))::INT AS depth) GROUP BY ALL HAVING sum(n_bytes) <= {sharding.LIMIT_BYTES} OR count(*) = 1)
    SELECT doc_id, n_bytes, shard, depth, shard_bytes FROM d JOIN b ON substr(bits, 1, depth) = shard
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
    """,
)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.assign(table(spark, sf, "documents"))


@query("op10_lm_scoring")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held = hash_bucket(F.col("doc_id"), 5) == 1
    model = kneser_ney.train(docs.where(~held))
    found = kneser_ney.score(docs, model)
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score", "perplexity")


@query("op11_embedding_whitening")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    vectors, grid = table(spark, sf, "embeddings"), whitening.Grid(64, 1_000_000)
    model = whitening.fit(vectors, grid=grid)
    if model is None or not len(model.values):
        return spark.createDataFrame([], "vec_id BIGINT, component INT, n BIGINT, deviation BIGINT, whitened DOUBLE, explained DOUBLE, identity_error DOUBLE")
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    rows = whitening.transform(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(share, F.col("at")).alias("explained"),
        F.lit(whitening.identity_error(vectors, model)).alias("identity_error"),
    )


@query(
    "op12_fill_in_middle",
    """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u,
                      sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
    h AS (SELECT *, ('0x' || s[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || s[9:16])::BIGINT % (len(u) + 1) AS b,
                 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
                      WHEN ('0x' || s[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
    p AS (SELECT *, array_to_string(u[1:least(a, b)], '') AS pre, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS mid, array_to_string(u[greatest(a, b) + 1:], '') AS suf FROM h)
    SELECT doc_id, len(u)::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
           sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
           sha256(t) AS restored_sha256 FROM p
    """,
)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    made = fill_middle.examples(table(spark, sf, "documents"))
    again = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


@query("op13_best_fit_packing")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))
