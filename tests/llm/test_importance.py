"""Importance ratios, thresholds and samples against plain Python."""

import random

import numpy as np
import pytest

from tapeworks.llm.importance import BUCKETS, Features, Resampler, bucket_counts, keep_quality, log_ratios, resample, top_k_threshold, with_keys

LABELS = "doc_id long, quality int, toxic int, `key` string"


def corpus(n=300):
    rnd = random.Random(4)
    good = [(i, " ".join(rnd.choices(["the", "tree", "of", "green", "leaf", "grows"], k=30))) for i in range(n)]
    bad = [(n + i, " ".join(rnd.choices(["WIN!!", "cash!!", "click", "now"], k=30))) for i in range(n // 3)]
    return good, bad


def test_counts_and_ratios(spark):
    texts = [("a b a", True), ("a c", False), (None, False), ("", True), ("b", None)]
    df = spark.createDataFrame(texts, "text string, target boolean").repartition(3)
    buckets = 1 << 10
    raw, target = np.zeros(buckets), np.zeros(buckets)
    f = Features(buckets)
    for t, good in texts:
        np.add.at(raw, f(t), 1)
        if good:
            np.add.at(target, f(t), 1)
    got_raw, got_target = np.zeros(buckets), np.zeros(buckets)
    counts = bucket_counts(df, buckets)
    for r in counts.collect():
        got_raw[r.part * 8 : r.part * 8 + 8], got_target[r.part * 8 : r.part * 8 + 8] = np.frombuffer(r.raw, np.int64), np.frombuffer(r.target, np.int64)
    assert (raw == got_raw).all() and (target == got_target).all()
    ratios = log_ratios(counts, buckets)
    word = int(f("c")[0])
    scale = target[: buckets // 2].sum() / raw[: buckets // 2].sum()
    assert ratios[word] == pytest.approx(np.log((target[word] + 1) / (raw[word] * scale + 1)), abs=1e-6)


def test_top_k(spark):
    rnd = random.Random(1)
    for values in ([rnd.gauss(0, 10) for _ in range(5000)], [1.0] * 100 + [2.0] * 10, [1e300, -1e300, 0.0, 1e-300], [5.0]):
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
        for k in {1, 2, len(values) // 3, len(values) - 1, len(values), len(values) + 5} - {0}:
            expect = sorted(values, reverse=True)[min(k, len(values)) - 1]
            assert top_k_threshold(df, k, "v") == expect
    empty = spark.createDataFrame([], "v double")
    assert top_k_threshold(empty, 3, "v") == float("inf")


def test_sample(spark, make, tmp_path):
    good, bad = corpus()
    labels = spark.createDataFrame([(i, 1, 0, "x") for i, _ in good[::2]] + [(i, 0, 0, "x") for i, _ in bad[::2]] + [(good[1][0], 1, 1, "x")], LABELS)
    docs = make(good + bad)
    rows = resample(docs, labels, buckets=1 << 14).collect()
    chosen = {r.doc_id for r in rows if r.selected}
    assert len(rows) == len(good) + len(bad) and not chosen & {i for i, _ in bad} and len(chosen) > 0.97 * len(good)
    ten = [r for r in resample(docs, labels, k=10, buckets=1 << 14).collect() if r.selected]
    assert len(ten) == 10 and min(r.key for r in ten) >= max(r.key for r in rows if r.doc_id not in {x.doc_id for x in ten})
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    left = keep_quality(spark, docs, str(tmp_path))
    assert left.columns == docs.columns and not {r.doc_id for r in left.collect()} & {i for i, _ in bad}


def test_gumbel_sampling_follows_the_ratio(spark, make):
    # 4000 documents with ratio 0 and 4000 with ratio log 3: a small sample holds three of these for one of those
    ratios = np.zeros(1 << 10, np.float32)
    ratios[Features(1 << 10)("b")[0]] = np.log(3)
    docs = make([(i, "b" if i % 2 else "") for i in range(8000)])
    keyed = with_keys(docs, ratios, 7)
    low = top_k_threshold(keyed.cache(), 600, "_key")
    odd = keyed.where(f"_key >= {low}").where("doc_id % 2 = 1").count()
    assert 0.69 < odd / 600 < 0.81


def test_awkward(spark, make, awkward):
    none = spark.createDataFrame([], LABELS)
    rows = resample(make(awkward), none).collect()
    assert len(rows) == len(awkward) and all(r.selected and r.log_ratio == 0 for r in rows)
    assert resample(make([]), none).count() == 0
    odd = spark.createDataFrame([(None, 1, 0, ""), (5, 1, 0, ""), (5, 0, 0, ""), (6, None, None, ""), (6, 1, 0, "")], LABELS)
    assert len(resample(make(awkward), odd).collect()) == len(awkward)
    assert len(Resampler(make(awkward), odd).ratios) == BUCKETS


def test_toxic_and_short_junk_go(spark, make):
    rnd = random.Random(5)
    prose = lambda n: rnd.choices([f"w{i}" for i in range(50)], k=n)
    good = [(i, " ".join(prose(rnd.choice([20, 40, 100, 400])))) for i in range(4000)] + [(4000, "zz " * 400)] * 2
    toxic = [(5000 + i, " ".join(prose(100) + ["idiot", "moron", "scum"])) for i in range(300)]
    junk = [(6000 + i, " ".join(rnd.choices(["#$%", "|||", "&&&"], k=20))) for i in range(300)]
    labels = spark.createDataFrame([(i, 1, 0, "") for i, _ in good[:4001]] + [(i, 1, 1, "") for i, _ in toxic[::2]] + [(i, 0, 0, "") for i, _ in junk], LABELS)
    chosen = {r.doc_id for r in resample(make(good + toxic + junk), labels, buckets=1 << 16).where("selected").collect()}
    left = lambda docs: len(chosen & {i for i, _ in docs}) / len({i for i, _ in docs})
    assert left(good) > 0.98 and left(toxic) < 0.05 and left(junk) == 0
