import random

import numpy as np
import xxhash
from conftest import ROWS

from nearfield.llm import simhash as S
from nearfield.llm.graph import components


def plain(text):
    words = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(links, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_classes_against_brute_force(spark, messy):
    rows = S.classes(messy).collect()
    assert len(rows) == len(ROWS)
    prints = [(i, plain(t)) for i, t in ROWS]
    assert sorted(r.fp & (1 << 64) - 1 for r in rows) == sorted(p for _, p in prints)
    close = [(a, b) for x, a in prints for y, b in prints if a < b and (a ^ b).bit_count() <= 3]
    root = groups(close, {p for _, p in prints})
    least = {}
    for i, p in prints:
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    assert sorted(((r.doc_id or 0), (r.component or 0)) for r in rows) == sorted((i or 0, least.get(root[p], 0)) for i, p in prints)


def test_all_links_up_to_three_bits(spark):
    rng = random.Random(1)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints):
        for bits in (1, 2, 3, 4):
            prints.add(p ^ sum(1 << b for b in rng.sample(range(64), bits)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = {(r.a, r.b) for r in S.links(spark.createDataFrame([(p,) for p in signed], "fp BIGINT")).collect()}
    mask = (1 << 64) - 1
    assert found == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 3}


def test_golay_code_is_perfect():
    code = S.Golay()
    words = np.random.default_rng(2).integers(0, 1 << 23, 5000).astype(np.int32)
    own, near = code.own(words), code.near(words)
    assert (code.error >= 0).all() and len(np.unique(code.error)) == 2048
    assert (near == own[:, None]).any(1).all()
    for bit in (0, 11, 22):
        assert (near == code.own(words ^ np.int32(1 << bit))[:, None]).any(1).all()


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 40)] + [(1000, i) for i in range(900, 960)] + [(i, 5000) for i in range(4000, 4010)] + [(7, 7)]
    rng.shuffle(links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a BIGINT, b BIGINT")).collect()}
    nodes = {n for link in links for n in link}
    assert got == {n: r for n, r in groups(links, nodes).items() if n != r}
    assert components(spark.createDataFrame([], "a BIGINT, b BIGINT")).count() == 0


def test_one_of_each_group_stays(spark, messy, nothing):
    kept = S.keep_one(messy)
    assert kept.columns == messy.columns
    rows = S.classes(messy)
    assert kept.count() == rows.select("root").distinct().count()
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and ids.count(3) == 1 and ids.count(None) == 1  # the empty texts are one group, which has keys
    assert S.classes(nothing).count() == 0 and S.keep_one(nothing).count() == 0
