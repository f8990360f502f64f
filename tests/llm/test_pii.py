import math
import re
from collections import Counter

from conftest import ROWS

from nearfield.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in match.split(".")),
        "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def base(text):
    return [f"{kind}:{m.start()}:{m.end()}" for kind, pattern in PLAIN.items() for m in re.finditer(pattern, text or "") if valid(kind, m[0])]


ODD = [
    "a@b.c_d@e.f.g x@y@z.com ..@-.- a@b.c@d.e",
    "1.2.3.4.5.6.7.8 256.1.1.1 000255.1.1.01 1.2.3",
    "4111 1111-1111 1111 4111111111111111 12 3 +1 (555) 123-4567 +123",
    "1" * 30_000,
    "a" * 30_000,
    "é😀 a@b.co 😀 +49 30 1234567-",
    "+1(((((((",
    "12 34\n" * 200,
    "5" * 3000 + "@" + "x." * 3000,
]


def test_base_spans_against_the_plain_patterns(spark, messy):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id INT, text STRING")
    for r in pii.find(docs).select("doc_id", pii.written("base", pii.KINDS).alias("w")).collect():
        assert r.w == base(ODD[r.doc_id])
    got = sorted((r.doc_id or -1, r.w) for r in pii.find(messy).select("doc_id", pii.written("base", pii.KINDS).alias("w")).collect())
    assert got == sorted((i or -1, base(t)) for i, t in ROWS)


def brute_terms(rows, limits):
    near, holds, has = Counter(), Counter(), Counter()
    found = []
    for i, text in rows:
        spans = [(kind, m[0], m.start(), m.end()) for kind, p in PLAIN.items() for m in re.finditer(p, text) if valid(kind, m[0])]
        words = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", text)]
        has.update({w for w, _, _ in words})
        holds.update({(k, v) for k, v, _, _ in spans})
        pairs = [
            ((k, v), w, a, b, i)
            for k, v, s, e in spans
            for w, a, b in words
            if (s - pii.CONTEXT <= a and b <= s or e <= a and b <= e + pii.CONTEXT) and not any(a < y and x < b for _, _, x, y in spans)
        ]
        near.update({(e, w) for e, w, *_ in pairs})
        found += pairs
    out = {}
    for entity, word, a, b, i in found:
        together = near[entity, word]
        if together >= limits.documents and holds[entity] < len(rows):
            told = math.log(len(rows) * together / (has[word] * holds[entity])) / math.log(len(rows) / holds[entity])
            if told >= limits.generalise:
                out[i, a, b] = min(out.get((i, a, b), 1), 0 if told >= limits.remove else 1)
    return sorted((i, kind, a, b) for (i, a, b), kind in out.items())


def rows_with_secrets():
    rows = [(i, f"our agent zorro writes from ada@x.org about trade number {i} in the harbour") for i in range(4)]
    rows += [(10 + i, f"another note on trade in the harbour, call +49 30 123456{i} today") for i in range(6)]
    return rows + [(30, "the harbour and the trade and our zorros"), (31, "our agent rests"), (32, "from ada@x.org without the word")]


def test_terms_that_disclose(spark):
    rows, limits = rows_with_secrets(), pii.Thresholds(remove=0.95, generalise=0.6)
    docs = spark.createDataFrame(rows + rows[:2], "doc_id INT, text STRING")
    got = sorted({(r.doc_id, s.kind, s.start, s.stop) for r in pii.find(docs, limits=limits).collect() for s in r.terms})
    assert got == brute_terms(rows + rows[:2], limits)
    assert {k for _, k, _, _ in got} == {0, 1}


def test_sanitised_texts(spark, messy, nothing):
    docs = spark.createDataFrame(rows_with_secrets(), "doc_id INT, text STRING")
    texts = {r.doc_id: r.text for r in pii.sanitise(docs, limits=pii.Thresholds(0.95, 0.6)).collect()}
    assert "zorro" not in texts[0] and "ada@x.org" not in texts[0] and "[EMAIL]" in texts[0] and texts[31] == "our agent rests"
    out = pii.sanitise(messy)
    assert out.columns == messy.columns and out.count() == len(ROWS)
    assert out.where("doc_id = 8 AND text IS NULL").count() == 1
    assert pii.find(nothing).count() == 0 and pii.sanitise(nothing).count() == 0


def test_common_words_are_not_counted_in_all_documents(spark, monkeypatch):
    """What is written near values already shows that a common word cannot disclose; the result is that of the plain count."""
    rows = [(i, f"the note of zorro{i % 3} from ada{i % 3}@x.org in the harbour") for i in range(12)] + [(20 + i, f"the harbour {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id INT, text STRING")
    terms, keep = [], pii.stored

    def stored(df, name):
        out = keep(df, name)
        if name == "term-pairs":
            terms.extend(r.term for r in out.select("term").distinct().collect())
        return out

    monkeypatch.setattr(pii, "stored", stored)
    limits = pii.Thresholds(remove=0.95, generalise=0.8)
    got = sorted({(r.doc_id, s.kind, s.start, s.stop) for r in pii.find(docs, limits=limits).collect() for s in r.terms})
    assert got == brute_terms(rows, limits) and "the" not in terms
