"""Ids against the library, layouts against packing one sequence at a time, and places without gap or overlap."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import ROWS
from tokenizers import Tokenizer

from nearfield.llm import packing as P

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def test_ids_of_chunks_are_ids_of_texts(library, monkeypatch):
    rng = random.Random(5)
    letters = "abcDEΣσé́̀'sßİ日本😀 \t\n\r\x0b\x0c\x1c  \u0085<|endoftext|>019-"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    texts += ["", " ", "ΑΣ ΑΣ'", "don't  stop", "a <|endoftext|> b", "e ́", "word " * 5000, "x" * 4000]
    plain = [[*library.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    with open(FILE, encoding="utf-8") as file:
        coder = P.ChunkTokenizer(file.read())
    for run, known in ((P.RUN_BYTES, P.KNOWN_BYTES), (16, 1000)):
        monkeypatch.setattr(P, "RUN_BYTES", run)
        monkeypatch.setattr(P, "KNOWN_BYTES", known)
        for part in (slice(0, 1500), slice(1500, None)):
            ids, sizes = coder.encode(texts[part])
            ends = sizes.cumsum()
            assert [ids[e - n : e].tolist() for e, n in zip(ends, sizes)] == plain[part]


def one_by_one(lengths, capacity):
    """The method on single pieces: every sequence is filled and mended by itself."""
    left, out = sorted(lengths), []
    while left:
        held, room = [], capacity
        while fits := [x for x in left if x <= room]:
            held.append(fits[-1])
            left.remove(fits[-1])
            room -= fits[-1]
        smallest, best = held[-1], (0, 0, 0)
        for i, b in enumerate(left):
            for a in left[i + 1 :]:
                if room and smallest < a + b <= room + smallest:
                    best = max(best, (a + b, a, b))
        if best[0]:
            held.remove(smallest)
            left.remove(best[1])
            left.remove(best[2])
            held += best[1:]
            left = sorted([*left, smallest])
        out.append(tuple(sorted(held, reverse=True)))
    return Counter(out)


def laid_out(lengths, capacity):
    counts = np.bincount(lengths, minlength=capacity + 1)
    plan = P.layout(counts, capacity)
    keys, first, each, sequence, offset = plan.parts()
    rank, held = Counter(), defaultdict(list)
    for n in lengths:
        at = int(np.searchsorted(keys, n << P._RANK_BITS | rank[n], side="right")) - 1
        within = rank[n] - int(first[at])
        held[int(sequence[at]) + within // int(each[at])].append((int(offset[at]) + within % int(each[at]) * n, n))
        rank[n] += 1
    for places in held.values():
        end = 0
        for start, n in sorted(places):
            assert start == end
            end += n
        assert end <= capacity
    assert sorted(held) == list(range(plan.sequences))
    return Counter(tuple(sorted((n for _, n in p), reverse=True)) for p in held.values())


def test_layouts_are_those_of_one_sequence_at_a_time():
    rng = random.Random(9)
    for trial in range(150):
        capacity = rng.choice([1, 2, 7, 20, 33])
        kinds = [rng.randint(1, capacity) for _ in range(rng.randint(1, 8))]
        lengths = [rng.choice(kinds) for _ in range(rng.randint(0, 90))]
        assert laid_out(lengths, capacity) == one_by_one(lengths, capacity), (trial, capacity, lengths)


def test_layouts_do_not_grow_with_the_documents():
    rng = np.random.default_rng(1)
    shares = rng.random(2049) ** 6
    shares[0] = 0
    steps = [P.layout((shares * n).astype(np.int64)).steps for n in (1e4, 1e7, 1e10)]
    assert max(steps) < 5 * 2048 and steps[2] < 1.5 * steps[1]


def test_two_pieces_fit_better_than_one():
    assert laid_out([7, 4, 5, 4, 10], 11) == Counter({(10,): 1, (7, 4): 1, (5, 4): 1})
    assert laid_out([8, 5, 4, 4], 16) == Counter({(8, 4, 4): 1, (5,): 1})


@pytest.mark.parametrize("capacity", [2048, 40])
def test_places(spark, messy, library, capacity):
    placed = P.pack(messy, FILE, capacity, ids=True).cache()
    plain = sorted((str(i), [*library.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in ROWS)
    rows = placed.collect()
    own = defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert r.start == r.piece * capacity and 1 <= r.length <= capacity and r.offset + r.length <= capacity
        own[str(r.doc_id), r.start].append(r)
    assert Counter((k, s) for k, s in own for _ in own[k, s]) == Counter((k, s) for k, ids in plain for s in range(0, len(ids), capacity))
    once = {k: ids for k, ids in plain if sum(k == x for x, _ in plain) == 1}
    for k, ids in once.items():
        assert [i for s in range(0, len(ids), capacity) for i in own[k, s][0].ids] == ids
    whole = {r.sequence_id: r.ids for r in P.sequences(placed).collect()}
    assert all(whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids for r in rows)
    assert sum(map(len, whole.values())) == sum(len(ids) for _, ids in plain)


def test_nothing(nothing):
    assert P.pack(nothing, FILE).count() == 0
    assert P.pack(nothing, FILE).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_few_sequences_over_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    row = P.pack(docs, FILE).selectExpr("count(DISTINCT sequence_id) AS n", "ceil(sum(length) / 2048) AS least").first()
    assert row.least <= row.n <= row.least + 1
