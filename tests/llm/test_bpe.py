import random

import public_tokenizers
import tiktoken
from conftest import ROWS

from nearfield.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def library(pattern=public_tokenizers.PATTERN):
    tokens = bpe.read_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def test_same_ids_as_the_library_and_exact_round_trip(spark, messy):
    own = library()
    rows = bpe.encode(messy, RANKS, public_tokenizers.PATTERN, decoded=True).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for i, t in ROWS:
        by.setdefault((i, (t or "").encode()), []).append(own.encode_ordinary(t or ""))
    for r in rows:
        assert list(r.ids) == by[(r.doc_id, bytes(r.decoded))][0]


def test_pieces_of_all_kinds():
    rng = random.Random(7)
    letters = "aeintr  \n\t.,'0129éß日本😀\u0000"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(800)] + ["a" * 5000, "=-" * 2000, " " * 300]
    encoder = bpe.BlockEncoder(bpe.Vocabulary.build(bpe.read_ranks(RANKS)), public_tokenizers.PATTERN)
    own = library()
    for part in (texts[:300], texts[300:]):
        ids, counts = encoder.encode(part)
        ends = counts.cumsum()
        assert [ids[e - c : e].tolist() for e, c in zip(ends, counts)] == [own.encode_ordinary(t) for t in part]


def test_a_merge_that_opens_a_pair_of_lower_rank():
    tokens = [bytes([b]) for b in range(256)] + [b"bcd", b"cd", b"ab"]  # bcd ranks before what it is made of
    replay = bpe.Replay(bpe.Vocabulary.build(tokens))
    own = tiktoken.Encoding("own", pat_str=".+", mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    for word in (b"abcd", b"bcdbcd", b"xcdb", b"aabcdcdab"):
        ids, _ = replay.encode([word])
        assert ids.tolist() == own.encode_ordinary(word.decode())


def test_decode(spark, messy, nothing):
    coded = bpe.encode(messy, RANKS, public_tokenizers.PATTERN)
    back = sorted(bytes(r.decoded) for r in bpe.decode(coded, RANKS).collect())
    assert back == sorted((t or "").encode() for _, t in ROWS)
    odd = spark.createDataFrame([(1, None), (2, [None, 64]), (3, [])], "doc_id INT, ids ARRAY<INT>")
    assert {r.doc_id: bytes(r.decoded) for r in bpe.decode(odd, RANKS).collect()} == {1: b"", 2: bpe.read_ranks(RANKS)[64], 3: b""}
    assert bpe.encode(nothing, RANKS, public_tokenizers.PATTERN).count() == 0
