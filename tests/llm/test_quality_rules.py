"""Counts against a plain count, cutoffs against the exact binomial."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from tapeworks.llm.quality_rules import RULES, base_counts, cutoffs, judge, tail

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text or "")
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_counts(make, awkward):
    docs = awkward + [(50, "a b c a b c d"), (51, "a a a a"), (52, "a b c x a b c\na b c x a b c\n\n \na\na"), (53, "x y"), (54, "a b c b c d c d"), (55, " lead\ttail \x0b\x0c\r\n")]
    got = base_counts(make(docs)).collect()
    plain = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got]
    assert sorted(plain, key=repr) == sorted(((i, *counts(t)) for i, t in docs), key=repr)


def test_tail(spark):
    cases = [(0, 10, 0.1), (3, 100, 0.05), (7, 2000, 0.004), (0, 100_000, 0.01), (900, 100_000, 0.01), (5, 5, 0.5), (0, 0, 0.3)]
    for k, n, p in cases:
        got = spark.range(1).select(tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p).alias("p")).first().p
        exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log(1 - p)) for j in range(k + 1))
        assert got == 1.0 if k >= n * p else abs(got - exact) < 1e-9 * max(exact, 1e-300) + 1e-300 or abs(got / exact - 1) < 1e-6


def labelled(spark, good, bad):
    row = lambda share, flag: ("en", 1000, 5000, int(1000 * share), 0, 0, flag)
    data = [row(s, True) for s in good] + [row(s, False) for s in bad]
    return spark.createDataFrame(data, "stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, good boolean")


def test_cutoffs_are_certified(spark):
    rules = {"symbols": RULES["symbols"]}
    found = lambda good, bad: [r.cut_symbols for r in cutoffs(labelled(spark, good, bad), rules, share=0.02, error=0.05).collect()]
    assert found([0.0] * 400, [0.6] * 50) == [0.5]  # the most lenient of the useful ones
    assert found([0.0] * 100, [0.6] * 50) == []  # 100 documents certify nothing at 2 %
    assert found([0.6] * 40 + [0.0] * 400, [0.6] * 50) == []  # it would reject a tenth of the good ones
    assert found([0.0] * 400, []) == [] and found([], [0.6]) == []


def test_judge(spark, make, awkward):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    got = judge(make(awkward), labels).collect()
    assert len(got) == len(awkward) and all(r.kept == (not r.base_failed) for r in got)
    assert {r.doc_id for r in got if r.kept} == set()
    assert judge(make([]), labels.limit(0)).count() == 0
    good = [(i, " ".join(f"w{i}x{k}" for k in range(60))) for i in range(1500)]
    bad = [(2000 + i, " ".join(f"w{i}x{k}***" for k in range(60))) for i in range(100)]
    flags = spark.createDataFrame([(i, int(i < 2000), 0) for i, _ in good + bad], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in judge(make(good + bad), flags, share=0.1).where("kept").collect()}
    assert kept == {i for i, _ in good}


def test_every_label_counts(spark):
    # 1,100,000 more labels, of documents that are not here: the 1200 good ones of a rare language still certify a cutoff
    body = lambda mark: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda k: F.concat(F.lit("w"), F.col("id"), F.lit("x"), k, F.lit(mark))), " ")
    docs = spark.range(1300).select(F.col("id").alias("doc_id"), F.lit("rare").alias("lang"), F.when(F.col("id") < 1200, body("")).otherwise(body("***")).alias("text"))
    labels = spark.range(1_101_300).select(F.col("id").alias("doc_id"), ((F.col("id") < 1200) | (F.col("id") >= 1300)).cast("int").alias("quality"))
    kept = judge(docs, labels).where("kept").agg(F.count("doc_id").alias("n"), F.max("doc_id").alias("last")).first()
    assert (kept.n, kept.last) == (1200, 1199)
