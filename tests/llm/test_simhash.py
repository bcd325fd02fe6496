import random

import numpy as np
import xxhash

from galerna.llm import simhash
from galerna.llm.components import connected


def components(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {n: root(n) for n in nodes}


def test_fingerprint():
    assert simhash.fingerprint([]) == 0
    assert simhash.fingerprint([b"a", b"b"]) == xxhash.xxh64_intdigest(b"a b", 42)
    w = [b"a", b"b", b"c", b"d", b"b", b"c", b"d"]
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(5)]
    assert simhash.fingerprint(w) == sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > 5)


def test_links_have_the_components_of_all_pairs(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = {x ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (2**64 - 1) for x in base for _ in range(12)} | {0, 2**64 - 1}
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = components([(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3], signed)
    for tile in (1024, 3):  # 3: blocks are cut into tiles
        found = [(r.a, r.b) for r in simhash.links(df, tile=tile).collect()]
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in found)
        assert components(found, signed) == want


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 300)] + [(7, 7), (400, 399), (399, 400)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {k: v for k, v in components(chain, {x for e in chain for x in e}).items()}
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_edges(edges, nothing):
    rows = simhash.near_duplicates(edges).collect()
    assert len(rows) == edges.count()
    by = {r.doc_id: r for r in rows}
    assert {by[k].fingerprint for k in (1, 2, 3)} == {"0" * 16} and {by[k].component_id for k in (1, 2, 3)} == {1}
    assert {r.component_id for r in rows if r.doc_id in (8, 9)} == {8}
    assert simhash.near_duplicates(nothing).count() == 0
