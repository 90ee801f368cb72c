"""Near copies against comparing all pairs, and the stage that keeps one of each group."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeworks.llm import near_copies as nc

SF = "/root/testdata/sf0.01"


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def similarity(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / max(1, len(x | y))


def partition(df):
    groups = defaultdict(set)
    for r in df.collect():
        groups[bytes(r["root"])].add(r["id"])
    return sorted(map(sorted, groups.values()))


def variants(rnd, words, k):
    out = list(words)
    for at in rnd.sample(range(len(out)), k):
        out[at] = f"new{rnd.randint(0, 10**6)}"
    return " ".join(out)


def test_jaccard():
    rnd = random.Random(2)
    base = [f"w{rnd.randint(0, 40)}" for _ in range(200)]
    for k in (0, 1, 5, 30):
        other = variants(rnd, base, k)
        assert nc.jaccard(" ".join(base), other) == pytest.approx(similarity(" ".join(base), other))
    assert nc.jaccard("a b", "A  B") == 1 and nc.jaccard(None, "") == 0 and nc.jaccard("a b", "a b c") == 0


def test_counts_bound_the_similarity_from_above():
    rnd = random.Random(5)
    base = [f"w{rnd.randint(0, 3000)}" for _ in range(250)]
    texts = [variants(rnd, base, k) for k in (0, 1, 3, 5, 8, 12, 40)] + ["a", "", " ".join(f"z{i % 70000}" for i in range(90000))]
    counts = nc.counted(pa.array([nc.sketch(t)[3] for t in texts], pa.binary()))
    assert counts.sum(axis=1).tolist() == [len(shingles(t)) for t in texts]
    i, j = np.triu_indices(len(texts), 1)
    real = np.array([similarity(texts[a], texts[b]) for a, b in zip(i, j)])
    able = nc._possible(counts, i, j, 0.8)
    assert able[real >= 0.8].all() and (real >= 0.8).any() and not able[real < 0.5].any()


def test_forest_joins_what_the_radius_connects():
    rnd = np.random.default_rng(4)
    seeds = rnd.integers(0, 1 << 63, 12, dtype=np.uint64)
    points = np.unique(np.array([s ^ np.uint64(sum(1 << int(b) for b in rnd.choice(64, rnd.integers(0, 9), replace=False))) for s in seeds for _ in range(30)]))
    i, j, group = nc.forest(points, 9)
    assert len(i) == len(points) - len(set(group.tolist())) and (np.bitwise_count(points[i] ^ points[j]) <= 9).all()
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 9
    label = np.arange(len(points))
    while True:
        new = np.array([label[near[k]].min() for k in range(len(points))])
        if (new == label).all():
            break
        label = new
    assert all((label == label[k]).tolist() == (group == group[k]).tolist() for k in range(len(points)))


@pytest.mark.parametrize("large", [1 << 17, 60])
def test_planted_copies(spark, make, large):
    rnd = random.Random(9)
    docs, expect = [], []
    for g in range(60):
        base = [f"v{rnd.randint(0, 5000)}" for _ in range(rnd.randint(120, 400))]
        ids = []
        for _ in range(rnd.choice([1, 1, 2, 3])):
            ids.append(len(docs))
            docs.append((len(docs), " ".join(base) if not ids[1:] else variants(rnd, base, max(1, len(base) // 60))))
        expect.append(ids)
    hot = [f"h{rnd.randint(0, 5000)}" for _ in range(300)]
    expect.append(list(range(1000, 1500)))
    docs += [(i, variants(rnd, hot, 3)) for i in range(1000, 1500)]
    found = partition(nc.similar_groups(make(docs), large=large))
    truth = {frozenset((a, b)) for ids in expect for a in ids for b in ids if a < b}
    got = {frozenset((a, b)) for ids in found for a in ids for b in ids if a < b}
    assert len(truth & got) >= 0.99 * len(truth) and got <= truth


def crowd(bits):
    """More points than a chunk keeps open, far from each other, and of each one more that only the first bit tells apart."""
    rnd, far = np.random.default_rng(7), []
    for p in rnd.integers(0, 1 << 63, 4000, dtype=np.uint64):
        if not far or np.bitwise_count(np.array(far) ^ p).min() > bits:
            far.append(p)
    points = np.array(far[: nc.CHUNK + 500], np.uint64)
    assert len(points) == nc.CHUNK + 500
    return points, points | np.uint64(1 << 63)


@pytest.mark.parametrize("block", [nc.BLOCK, 400])
def test_no_pair_of_a_crowded_shard_is_lost(spark, block):
    """Groups beyond those that the first round keeps open still meet their partners."""
    points = np.concatenate(crowd(8))
    rows = [(bytes([1]) + i.to_bytes(4, "big"), int(p), 5) for i, p in enumerate(points.view(np.int64).tolist())]
    shards = spark.createDataFrame(rows, "words binary, fp long, shard long").select("shard", "fp", "words")
    close = np.bitwise_count(points[:, None] ^ points[None, :]) <= 8
    truth = {(rows[i][0], rows[j][0]) for i, j in zip(*np.nonzero(close)) if i < j}
    ranges = shards.select("words", F.lit(bytes(nc.RANGES)).alias("ranges"))
    no_roots = spark.createDataFrame([], "node binary, root binary")
    found = nc.other_links(shards, no_roots, ranges, 0.0, 8, block).collect()
    assert {(bytes(r["a"]), bytes(r["b"])) for r in found} == truth and len(truth) >= nc.CHUNK + 500
    root = spark.createDataFrame([(rows[i][0], b"one") for i in range(0, len(rows), 2)], "node binary, root binary")
    found = nc.other_links(shards, root, ranges, 0.0, 8, block).collect()
    same = {rows[i][0] for i in range(0, len(rows), 2)}
    assert {(bytes(r["a"]), bytes(r["b"])) for r in found} == {(a, b) for a, b in truth if not (a in same and b in same)}


def test_a_refuted_link_does_not_hide_another(spark, make, monkeypatch):
    """All partners are found when the links that the first round tries are none."""
    rnd = random.Random(3)
    base = [f"v{rnd.randint(0, 5000)}" for _ in range(300)]
    docs = make([(i, variants(rnd, base, 2)) for i in range(12)])
    monkeypatch.setattr(nc, "candidate_links", lambda shards, *_: spark.createDataFrame([], "a binary, b binary"))
    assert partition(nc.similar_groups(docs)) == [list(range(12))]


def test_recall_on_documents(spark):
    """At least 0.9 of the pairs of different texts that all pairs of the sample find at 0.8, and nothing unlike."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    by, sets = defaultdict(list), {i: shingles(t) for i, t in rows}
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    pairs = {(a, b) for ids in by.values() for n, a in enumerate(ids) for b in ids[n + 1 :]}
    truth = {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    group = {r["id"]: bytes(r["root"]) for r in nc.similar_groups(docs).collect()}
    caught = sum(group[a] == group[b] for a, b in truth)
    unequal = [(a, b) for a, b in truth if sets[a] != sets[b]]
    print(len(truth), len(unequal), caught)
    assert len(truth) > 50 and caught >= 0.95 * len(truth)
    if unequal:
        assert sum(group[a] == group[b] for a, b in unequal) >= 0.9 * len(unequal)
    linked = defaultdict(set)
    for a, b in truth:
        linked[a].add(b)
        linked[b].add(a)
    members = defaultdict(list)
    for i, g in group.items():
        members[g].append(i)
    for ids in members.values():  # every member of a group has a partner in it
        assert len(ids) == 1 or all(linked[i] & set(ids) or not sets[i] for i in ids)


def test_awkward(spark, make, awkward):
    docs = make(awkward)
    rows = nc.similar_groups(docs).collect()
    assert len(rows) == docs.count()
    root = defaultdict(set)
    for r, words in zip(rows, rows):
        root[bytes(r["root"])].add(r["id"])
    assert any({5, 6} <= g and -11 in g for g in root.values()) and any({1, 2, 3} <= g for g in root.values())
    kept = nc.keep_one(spark, docs, "")
    assert kept.columns == docs.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert "-11" in ids and "5" not in ids and ids.count("1") == 1 and "2" not in ids
    clash = docs.withColumnsRenamed({"key": "_key", "kind": "_copy"})
    assert sorted(str(r["doc_id"]) for r in nc.keep_one(spark, clash, "").collect()) == ids and nc.keep_one(spark, clash, "").columns == clash.columns
    assert nc.keep_one(spark, docs.limit(0), "").count() == 0
