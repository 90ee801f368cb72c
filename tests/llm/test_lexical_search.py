"""Ranked search against a scan of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tapeworks.llm.lexical_search import Bucket, ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, `key` string, item string, rank string, score string, doc_id string"


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, best=10):
    rows = [(i, Counter(terms(t))) for i, t in docs]
    rows = [(i, c) for i, c in rows if c]
    total, size = len(rows), sum(c.total() for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, sought in asked.items():
        scored = []
        for i, c in rows:
            m = 100 - 90 + (90 * c.total() * total) // size
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in sought if c[t])
            if s > 0:
                scored.append((-s, i is None, i))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, n, i, -s) for n, (s, _, i) in enumerate(scored[:best], 1)]
    return sorted(out, key=repr)


def check(spark, make, docs, items, **kw):
    asked = spark.createDataFrame([(i, t, *"abcde") for i, t in items], ITEMS).repartition(2)
    got = ranking(make(docs) if docs else make([(0, "x")]).limit(0), asked, **kw)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items, kw.get("best", 10))


def test_awkward(spark, make, awkward):
    items = [(1, "two words"), (1, "another text"), (2, None), (3, ""), (4, "École 日本語 É"), (None, "word a"), (5, "absent"), (6, "a " * 3000 + "one TWO"), (6, "three")]
    check(spark, make, awkward, items)
    check(spark, make, awkward, items, best=2, most_terms=3)
    check(spark, make, [], items)
    check(spark, make, awkward, [(2, None)])


def test_random_with_copies(spark, make):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rnd.choices(vocabulary, weights, k=rnd.randint(1, 120)))) for i in range(1500)]
    docs += [(i, docs[0][1]) for i in range(2000, 2700)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 30)))) for i in range(40)]
    check(spark, make, docs, items)


def test_bucket_drops_no_document():
    rnd = np.random.default_rng(2)
    weights = rnd.integers(0, 9000, 50)
    lists = [sorted(rnd.choice(50, rnd.integers(1, 20), replace=False).tolist()) for _ in range(400)]
    tf = [rnd.integers(1, 9, len(x)).tolist() for x in lists]
    n = [sum(x) for x in tf]
    impact = [{t: int(weights[t]) * (1_000_000_000 * f // (1000 * f + 8 * (10 + 90 * m * 400 // sum(n)))) for t, f in zip(x, fs)} for x, fs, m in zip(lists, tf, n)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(400)), pa.array(range(400)), pa.array(n), pa.array(lists, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32())), pa.array([math.sqrt(sum(v * v for v in x.values())) for x in impact])],
        ["key", "id", "n", "terms", "tf", "length"],
    )
    bucket = Bucket(batch, weights, 400, sum(n))
    for _ in range(60):
        sought = np.array(sorted(rnd.choice(60, 12, replace=False)), np.int32)
        exact = [sum(x.get(int(t), 0) for t in sought) for x in impact]
        for least in (1, int(np.quantile(exact, 0.5)) or 1, sorted(exact)[-3], max(exact) + 1):
            found, scores = bucket.better(sought, least)
            assert dict(zip(found.tolist(), scores.tolist())) == {i: s for i, s in enumerate(exact) if s >= least and s > 0}
