"""Scores against the recursive definition of the model."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.llm.lm import Automaton, Grams, planes, score, unplanes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [""]


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def brute(docs, order):
    counts = [Counter() for _ in range(order)]
    for i, t in docs:
        if not held_out(i):
            w = ["", *split(t)]
            for at in range(1, len(w)):
                for k in range(min(order, at + 1)):
                    counts[k][tuple(w[at - k : at + 1])] += 1
    n, v = sum(counts[0].values()), len(counts[0])
    seen = [0.0] + [1 - (sum(c == 1 for c in counts[k].values()) + 1) / (sum(counts[k].values()) + 2) if counts[k] else 0.0 for k in range(1, order)]

    def p(history, word):
        k = len(history)
        if not k:
            return (counts[0][word,] + 1) / (n + v + 1)
        lower = p(history[1:], word)
        total = counts[k - 1][tuple(history)]
        return seen[k] * counts[k][(*history, word)] / total + (1 - seen[k]) * lower if total else lower

    out = []
    for i, t in docs:
        w = ["", *split(t)]
        full = sum(math.log10(p(tuple(w[max(0, at - order + 1) : at]), w[at])) for at in range(1, len(w)))
        base = sum(math.log10((counts[0][x,] + 1) / (n + 1 * (v + 1))) for x in w[1:])
        out.append((i, held_out(i), len(w) - 1, sum(counts[0][x,] > 0 for x in w[1:]), n, base, full))
    return out


def check(df, docs, **options):
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    got = sorted(map(tuple, score(df.withColumn("held", held), ident="doc_id", **options).collect()), key=repr)
    expect = sorted(brute(docs, options.get("order", 2)), key=repr)
    assert len(got) == len(expect)
    for a, b in zip(sorted(got, key=lambda r: (repr(r[:5]), r[6])), sorted(expect, key=lambda r: (repr(r[:5]), r[6]))):
        assert a[:5] == b[:5]
        np.testing.assert_allclose(a[5:], b[5:], rtol=1e-9, atol=1e-9)


def texts():
    rnd = np.random.default_rng(3)
    return [(100 + i, " ".join(f"w{x}" for x in np.minimum(rnd.geometric(0.15, rnd.integers(0, 80)), 30))) for i in range(60)]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores(make, awkward, order):
    docs = texts() + awkward
    check(make(docs), docs, order=order, block=2000, bucket=300)


def test_long_texts_in_pieces():
    rnd = np.random.default_rng(5)
    tokens = np.r_[rnd.integers(1, 20, 3000), 0].astype(np.uint32)
    meta = [{"id": 1, "held": False, "n": 2001}, {"id": 2, "held": False, "n": 1000}]
    words = rnd.integers(0, 2**63, 20, dtype=np.uint64)
    grams = Grams(meta, words.tobytes(), planes(tokens), 3, 4)
    auto = Automaton(grams, [c.astype(np.int64) for c in grams.counts], 3001, 20, [0.0, 0.7, 0.4])
    whole = auto.score(grams.tokens, grams.starts, grams.n, piece=10_000)
    for piece in (1, 2, 7, 1000):
        np.testing.assert_allclose(auto.score(grams.tokens, grams.starts, grams.n, piece=piece), whole, rtol=1e-9)
    assert (unplanes(planes(tokens), "u4") == tokens).all()


def test_nothing_to_learn_from(make, awkward):
    docs = [(i, t) for i, t in awkward if i == 4] or [(4, "x")]
    rows = score(make(docs).withColumn("held", F.lit(True)), ident="doc_id").collect()
    assert [(r.n_known, r.train_tokens) for r in rows] == [(0, 0)] and rows[0].score == 0.0
    assert score(make([]).withColumn("held", F.lit(False)), ident="doc_id").count() == 0
