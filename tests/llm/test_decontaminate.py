import re

from conftest import ROWS, TEXTS

from nearfield.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute(text, items, size=13):
    doc, hit, found = words(text), set(), set()
    for item, body in items:
        w = words(body)
        n = min(size, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            for b in range(len(doc) - n + 1):
                if doc[b : b + n] == w[a : a + n]:
                    hit.update(range(b, b + n))
                    found.add(str(item))
    return len(doc), len(hit), sorted(found)


def test_against_brute_force(spark, messy):
    long = words(TEXTS[1])
    items = [(1, " ".join(long)), (2, "A thing, or TWO"), (3, ""), (4, None), (5, "never seen anywhere"), (10, "façade"), (2, "A thing, or TWO"), (6, " ".join(long[3:16]))]
    benchmark = spark.createDataFrame(items, "item_id INT, text STRING")
    got = sorted((r.doc_id or -1, r.n_words, r.n_hit, r["items"]) for r in D.contamination(messy, benchmark).collect())
    expected = sorted((i or -1, *brute(t, items)) for i, t in ROWS if i != 5)
    assert [g for g in got if g[0] != 5] == expected
    assert any(g[2] for g in got)


def test_every_shared_window_is_found():
    import numpy as np

    rng = np.random.default_rng(3)
    for length in (1, 4, 5, 7, 13):
        shared = rng.integers(0, 1 << 63, length).astype(np.uint64)
        one, two = (np.concatenate((rng.integers(0, 1 << 63, n).astype(np.uint64), shared, rng.integers(0, 1 << 63, 9).astype(np.uint64))) for n in (5, 30))
        assert D.fingerprints(one, length)[5] == D.fingerprints(two, length)[30]
        assert len(D.fingerprints(shared[:-1], length)) == 0


def test_empty_tables(spark, messy, nothing):
    benchmark = spark.createDataFrame([(1, "a b c")], "item_id INT, text STRING")
    assert D.contamination(nothing, benchmark).count() == 0
    assert D.contamination(messy, benchmark.where("false")).where("n_hit > 0").count() == 0
