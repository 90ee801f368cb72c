"""Fingerprints, trees and groups against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from tapeworks.llm.components import components
from tapeworks.llm.simhash import BKTree, fingerprint, link_fingerprints, near_duplicates


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def points(seed, centres=40, each=12, flips=7):
    rnd = random.Random(seed)
    out = {0}
    for _ in range(centres):
        x = rnd.getrandbits(64)
        for _ in range(each):
            for b in rnd.sample(range(64), rnd.randint(0, flips)):
                out.add(x ^ 1 << b)
            x ^= 1 << rnd.randrange(64)
            out.add(x)
    return sorted(out)


def test_fingerprints(awkward):
    for _, t in awkward:
        assert fingerprint(t) == plain_fingerprint(t)


def test_tree():
    pts = np.array(points(1), np.uint64)
    np.random.default_rng(0).shuffle(pts)
    got = {(min(p), max(p)) for i, j in BKTree(pts).within(3) for p in zip(i.tolist(), j.tolist())}
    near = np.bitwise_count(pts[:, None] ^ pts[None, :]) <= 3
    assert got == {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(np.triu(near, 1))))}
    assert list(BKTree(pts[:1]).within(3)) == []


@pytest.mark.parametrize("shard", [4096, 3])
def test_links_join_the_same_groups(spark, shard):
    pts = points(2)
    signed = [p - (1 << 64) if p >> 63 else p for p in pts]
    df = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(3)
    links = [(r.a, r.b) for r in link_fingerprints(df, shard).collect()]
    a = np.array(pts, np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(a[:, None] ^ a[None, :]) <= 3, 1))
    assert grouped(links, signed) == grouped([(signed[i], signed[j]) for i, j in near], signed)
    roots = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    expect = grouped(links, {x for pair in links for x in pair})
    assert roots == expect


def test_long_chain(spark):
    links = [(i, i + 1) for i in range(200)] + [(7, 7), (300, 301), (301, 300)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert roots == {i: 0 for i in range(201)} | {300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark, make, awkward):
    rnd = random.Random(3)
    base = [" ".join(rnd.choices("abcdefghij", k=200)) for _ in range(4)]
    docs = awkward + [(40 + i, base[i % 4] + (" x" if i % 3 == 0 else "")) for i in range(24)]
    rows = near_duplicates(make(docs)).collect()
    fps = [(i, plain_fingerprint(t)) for i, t in docs]
    a = np.array([f for _, f in fps], np.uint64)
    groups = grouped([tuple(p) for p in np.argwhere(np.triu(np.bitwise_count(a[:, None] ^ a[None, :]) <= 3, 1))], range(len(docs)))
    least = {}
    for n, g in groups.items():
        if fps[n][0] is not None:
            least[g] = min(least.get(g, fps[n][0]), fps[n][0])
    expect = sorted(((i, f, least.get(groups[n])) for n, (i, f) in enumerate(fps)), key=repr)
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component) for r in rows), key=repr) == expect
    assert near_duplicates(make([])).count() == 0
