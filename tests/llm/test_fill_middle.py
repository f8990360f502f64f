"""Examples against the rule written out, and an exact way back."""

import hashlib
import random
import re

import pytest
from conftest import ROWS
from pyspark.sql import functions as F

from nearfield.llm import fill_middle as M


def plain(key, text, seed=7, rate=100, spm_rate=50):
    text, digest = text or "", hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(lines), "plain", None, None, text
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if h[3] % 100 < spm_rate:
        return len(lines), "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return len(lines), "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


ODD = ["\n", "\n\n\n", "a", "a\nb", "a\r\nb c\u0085\n", "x<P>y\nz", "<S>", "a<M>", "<\n<P\n<S\nM>\n", "S>\nP>\n<\n", "😀\n" * 5, ">\n" * 9 + "<", "\x00\n\x00"]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(12)
    texts = ODD + ["".join(rng.choice("ab<>PSM\n\n é") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    return [(i, t) for i, t in enumerate(texts)] + ROWS


def test_against_the_rule(spark, table):
    docs = spark.createDataFrame(table, "doc_id BIGINT, text STRING").repartition(4)
    for args in ({}, {"seed": 3, "rate": 60, "spm_rate": 10}):
        made = M.examples(docs, **args).withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
        order = lambda r: str(r)
        assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made), key=order) == sorted(((i, *plain(i, t, **args)) for i, t in table), key=order)
        assert sorted((str(r.doc_id), r.back) for r in made) == sorted((str(i), t or "") for i, t in table)
        assert {r.form for r in made} == {"plain", "psm", "spm"}


def test_long_texts_in_runs_of_lines(monkeypatch):
    cutter, texts = M.Cutter(), ["word word\n" * 500 + "tail", "x" * 3000, "\n" * 2000, "x" * 3000 + "\n" + "y", "ab\n" * 700]
    whole = [cutter.ends(t) for t in texts]
    monkeypatch.setattr(M, "MATCH_CHARS", 100)
    assert [cutter.ends(t) for t in texts] == whole
    assert whole == [[m.end() for m in re.finditer(M.UNIT, t)] for t in texts]


def test_clashing_columns_repeats_and_nothing(messy, nothing):
    rows = M.examples(messy)
    assert rows.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert sorted((str(r.doc_id), r.output) for r in rows.collect()) == sorted((str(i), plain(i, t)[-1]) for i, t in ROWS)
    assert M.examples(nothing).count() == 0
