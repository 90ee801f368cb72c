"""Collocations against counting every phrase."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from tapeworks.llm import collocations as module
from tapeworks.llm.collocations import collocations

SCHEMA = "doc_id long, text string, lang string, words string, w1 string, f string, n string"


def brute(rows, least, best):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + m]) for m in range(1, 6) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in found.items():
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            s, _, left, right = min(cuts)
            if not any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                scored.append((-s, -a, " ".join(p).encode(), left, right))
        scored.sort()
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(scored[:best], 1)]
    return sorted(out)


def check(spark, rows, least, best=2000, parts=3, **kw):
    df = spark.createDataFrame([(i, t, lang, *"abcd") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(parts)
    got = collocations(df, least=least, best=best, **kw)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got, expect = sorted(map(tuple, got.collect())), brute(rows, least, best)
    assert got == expect
    return got


def texts(rnd, n):
    vocabulary = ["the", "of", "AND", "\x01x", "b\x00", "é", "日本", *[f"w{i}" for i in range(25)]]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    seps = [" "] * 12 + ["  ", "\t", ". ", ",", "\n", "\x0b", " ? ", "\r\n"]
    return ["".join(w + rnd.choice(seps) for w in rnd.choices(vocabulary, weights, k=rnd.randint(0, 60))) for _ in range(n)]


def test_random(spark):
    rnd = random.Random(1)
    rows = [(t, rnd.choice(["en", "en", "en", "de", None, "und"])) for t in texts(rnd, 300)]
    assert check(spark, rows, 6)
    assert check(spark, rows, 6, best=7, block=2000) == check(spark, rows, 6, best=7, budget=40, block=500)


def test_awkward(spark, awkward):
    rows = [(t, lang) for _, t in awkward for lang in ("en", None)]
    check(spark, rows, 2)
    check(spark, [], 2)
    check(spark, [(None, None), ("", "en"), (". ! ?", "en"), ("lone", "en")], 1)
    check(spark, [("a a a a a a a a", "en"), ("a b c d e f", "fr")] * 9, 3, budget=4)


def test_one_phrase_holds_most(spark):
    rows = [("of the same old story told", "en")] * 400 + [("of the day", "en")] * 50 + [("of the", None)] * 120
    assert check(spark, rows, 20, budget=60, parts=7)


def test_python_gets_few_blocks_at_a_time(spark, monkeypatch):
    batches, store = {}, module.store

    def sizes(given):
        for b in given:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "bytes"])

    def spy(df, name, *codec):
        out = store(df, name, *codec)
        if name in ("blocks", "coded"):
            batches[name] = out.coalesce(1).mapInArrow(sizes, "rows long, bytes long").collect()
        return out

    monkeypatch.setattr(module, "store", spy)
    rows = [("to be or not. " * 75_000, "en")] * 16
    df = spark.createDataFrame([(i, t, lang, *"abcd") for i, (t, lang) in enumerate(rows)], SCHEMA)
    got = collocations(df, block=1 << 20).collect()
    assert [r["a"] for r in got] == [16 * 75_000]
    for name in ("blocks", "coded"):
        assert sum(r["rows"] for r in batches[name]) == 16
        assert sum(r["bytes"] for r in batches[name]) > 3 * module.BATCH
        assert max(r["bytes"] for r in batches[name]) < 2 * module.BATCH


@pytest.mark.parametrize("own", [None, "1048576"])
def test_the_session_keeps_its_batches(spark, own):
    def held():
        return spark.conf.get(module.BATCH_BYTES, None)

    def work(docs, fails):
        assert held() == str(module.BATCH)
        if fails:
            raise ValueError("no")
        return "done"

    if own:
        spark.conf.set(module.BATCH_BYTES, own)
    try:
        run = module.in_small_batches(work)
        assert run(spark.range(1), False) == "done"
        assert held() == own
        with pytest.raises(ValueError):
            run(spark.range(1), fails=True)
        assert held() == own
    finally:
        spark.conf.unset(module.BATCH_BYTES)
