"""Personal data, and terms that give it away, in DataFrame operations only.

Emails, IP addresses, payment cards and phone numbers are found by pattern and check. Then
the corpus says how much the words around them disclose: for a protected value ``e`` and a
term ``t`` in its context, ``PMI(e; t) / IC(e)`` is 1 if the term occurs nowhere but with that
value and 0 if they are independent, where ``PMI = ln(N n(t,e) / (n(t) n(e)))`` and
``IC = ln(N / n(e))`` over documents. Terms over the upper threshold are removed, terms over
the lower one are generalised.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import stored
from nearfield.sizing import broadcast_if_small

KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("removed", "generalised")
CONTEXT = 80  # code points on each side of a value
_DIGITS = "regexp_replace(m, '[^0-9]', '')"
# The patterns differ from the plain ones only in starting where a run starts and in keeping
# what a run took, which finds the same matches without trying every place of a long run.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_LUHN = (
    f"aggregate(sequence(1, length({_DIGITS})), 0, (s, i) -> s + element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9),"
    f" 1 + cast(substring({_DIGITS}, -i, 1) AS int)) * ((i + 1) % 2) + cast(substring({_DIGITS}, -i, 1) AS int) * (i % 2)) % 10 = 0"
)
_CHECKS = {
    "email": "length(m) > 0",
    "ip": r"m rlike r'^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}'",
    "card": f"CASE WHEN length({_DIGITS}) BETWEEN 13 AND 19 THEN {_LUHN} ELSE false END",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}
_GATES = {"email": "contains(text, '@')", "ip": "digits", "card": "digits", "phone": "contains(text, '+')"}
_SPAN = "struct<kind: int, start: int, stop: int, value: string>"
_TERM = r"\p{L}{3,}"


@dataclass(frozen=True)
class Thresholds:
    """Disclosure from which a term is removed or generalised, and the least number of documents that must show it."""

    remove: float = 0.9
    generalise: float = 0.7
    documents: int = 3


def _found(text: str, pattern: str, kind: int, check: str) -> str:
    """SQL for the spans of a pattern: the lengths of what lies between and in the matches add up to their places."""
    return f"""aggregate(
        zip_with(split({text}, r'{pattern}', -1), concat(regexp_extract_all({text}, r'{pattern}', 0), array('')), (g, m) -> struct(length(g) AS gap, m AS m)),
        struct(0 AS at, cast(array() AS array<{_SPAN}>) AS out),
        (a, x) -> struct(a.at + x.gap + length(x.m) AS at,
            if(x.m <> '' AND {check.replace("m rlike", "x.m rlike").replace("(m,", "(x.m,").replace("length(m)", "length(x.m)")},
               concat(a.out, array(struct({kind} AS kind, a.at + x.gap AS start, a.at + x.gap + length(x.m) AS stop, x.m AS value))), a.out) AS out),
        a -> a.out)"""


def base_spans(text: str = "text") -> Column:
    """Base spans of a text column, by kind and start; columns ``text`` and ``digits`` (whether it has any) must be there."""
    parts = [f"CASE WHEN {_GATES[k]} THEN {_found(text, _PATTERNS[k], i, _CHECKS[k])} ELSE cast(array() AS array<{_SPAN}>) END" for i, k in enumerate(KINDS)]
    return F.expr(f"concat({', '.join(parts)})")


def _context() -> Column:
    """Terms near every base span: ``entity, term, start, stop``."""
    sides = (f"greatest(0, s.start - {CONTEXT})", "s.start"), ("s.stop", f"least(size, s.stop + {CONTEXT})")
    lists = []
    for low, high in sides:
        words = _found("w.text", _TERM, 0, "true")
        lists.append(
            f"""flatten(transform(array(named_struct('low', {low}, 'high', {high}, 'text', substring(text, {low} + 1, {high} - {low}))), w -> transform(
                filter({words}, x -> (x.start > 0 OR w.low = 0 OR w.low = s.stop) AND (x.stop < w.high - w.low OR w.high = size OR w.high = s.start)),
                x -> named_struct('entity', concat_ws(':', s.kind, s.value), 'term', lower(x.value), 'start', w.low + x.start, 'stop', w.low + x.stop))))"""
        )
    every = f"flatten(transform(spans, s -> concat({', '.join(lists)})))"
    return F.expr(f"filter({every}, t -> NOT exists(spans, s -> t.start < s.stop AND s.start < t.stop))")


def _mentions(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(body).alias("th"), body.alias("text"))
    rows = rows.withColumn("digits", F.col("text").rlike("[0-9]")).withColumn("spans", base_spans())
    none = "cast(array() AS array<struct<entity: string, term: string, start: int, stop: int>>)"
    terms = F.when(F.size("spans") > 0, _context()).otherwise(F.expr(none))
    return rows.withColumn("size", F.length("text")).select("key", "th", "spans", terms.alias("terms"))


def _disclosing(docs: DataFrame, text: str, mentions: DataFrame, limits: Thresholds) -> DataFrame:
    """``entity, term, action``: 0 to remove, 1 to generalise."""
    near = mentions.select(F.expr("inline(array_distinct(transform(terms, t -> struct(t.entity AS entity, t.term AS term))))")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("together"))
    near = near.where(F.col("together") >= limits.documents)
    entity = mentions.select(F.explode(F.expr("array_distinct(transform(spans, s -> concat_ws(':', s.kind, s.value)))")).alias("entity"))
    entities = entity.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    total = docs.count()

    def disclosure(holds: Column) -> Column:
        pmi = F.log(F.lit(float(total)) * F.col("together") / (holds * F.col("n_entity")))
        known = F.log(F.lit(float(total)) / F.col("n_entity"))
        return F.when(known > 0, pmi / known).otherwise(0.0)

    # A term is in at least as many documents as show it near some value. Where that alone keeps a pair
    # under the threshold, its term need not be counted in all documents; most common words go so.
    shown = mentions.select(F.explode(F.expr("array_distinct(transform(terms, t -> t.term))")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_shown"))
    open_ = near.join(entities, "entity").join(shown, "term").where(disclosure(F.col("n_shown")) >= limits.generalise - 1e-9)
    open_ = stored(open_.drop("n_shown"), "term-pairs")
    asked = broadcast_if_small(open_.select("term").distinct())
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(f"`{text}`").cast("string")), F.lit(_TERM), F.lit(0)))
    terms = docs.select(F.explode(words).alias("term")).join(asked, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    scored = open_.join(terms, "term").withColumn("disclosure", disclosure(F.col("n_term")))
    return scored.where(F.col("disclosure") >= limits.generalise).select("entity", "term", F.when(F.col("disclosure") >= limits.remove, 0).otherwise(1).alias("action"))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", limits: Thresholds = Thresholds()) -> DataFrame:
    """``key, th, base, terms``: base spans and disclosing terms of every text.

    Spans are ``kind, start, stop`` in code points, end exclusive; ``base`` also has the value.
    ``kind`` counts through ``KINDS``, and through ``TERM_KINDS`` for terms. One row per input
    row, null keys included; rows that repeat a key and its text each count as a document among
    the entities and terms, and all get the same spans. Null and empty texts have none. ``th``
    is a hash of the text. Other columns are left out, so no name can clash.
    """
    mentions = stored(_mentions(docs, key, text), "mentions")
    told = stored(_disclosing(docs, text, mentions, limits), "disclosing")
    places = mentions.select("key", "th", F.inline("terms")).join(broadcast_if_small(told), ["entity", "term"])
    each = places.groupBy("key", "th", "start", "stop").agg(F.min("action").alias("kind"))
    marked = each.groupBy("key", "th").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "stop"))).alias("told"))
    base, found = mentions.alias("m"), marked.alias("f")
    joined = base.join(found, F.col("m.key").eqNullSafe(F.col("f.key")) & (F.col("m.th") == F.col("f.th")), "left")
    none = F.expr("cast(array() AS array<struct<kind: int, start: int, stop: int>>)")
    return joined.select(F.col("m.key").alias(key), F.col("m.th").alias("th"), F.col("m.spans").alias("base"), F.coalesce("f.told", none).alias("terms"))


def written(spans: str, kinds: tuple[str, ...]) -> Column:
    """Spans as ``kind:start:stop``."""
    names = ", ".join(f"'{k}'" for k in kinds)
    return F.expr(f"transform({spans}, s -> concat_ws(':', element_at(array({names}), s.kind + 1), s.start, s.stop))")


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", limits: Thresholds = Thresholds()) -> DataFrame:
    """The documents with the columns they had; base values become ``[KIND]``, generalised terms ``[TERM]``, removed terms go. Null texts stay null."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    tags = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    spans = F.expr(
        f"""array_sort(concat(transform(base, s -> named_struct('start', s.start, 'stop', s.stop, 'tag', element_at(array({tags}), s.kind + 1))),
            transform(terms, s -> named_struct('start', s.start, 'stop', s.stop, 'tag', if(s.kind = 0, '', '[TERM]')))))"""
    )
    found = find(docs, key, text, limits).dropDuplicates([key, "th"]).select(F.col(f"`{key}`").alias("__key"), F.col("th").alias("__th"), spans.alias("__spans"))
    joined = docs.withColumn("__hash", F.xxhash64(body)).join(found, F.col(f"`{key}`").eqNullSafe(F.col("__key")) & (F.col("__hash") == F.col("__th")), "left")
    clean = F.expr(
        f"""aggregate(__spans, named_struct('at', 0, 'out', ''), (a, s) -> named_struct('at', greatest(a.at, s.stop),
            'out', if(s.start < a.at, a.out, concat(a.out, substring(`{text}`, a.at + 1, s.start - a.at), s.tag))), a -> concat(a.out, substring(`{text}`, a.at + 1)))"""
    )
    joined = joined.withColumn(text, F.when(F.size("__spans") > 0, clean).otherwise(F.col(f"`{text}`")))
    return joined.select(*[f"`{c}`" for c in docs.columns])
