"""Exact phrases and proximity against a scan of every window."""

import hashlib
import random
import re

import pytest

from tapeworks.llm.decontamination import contamination, drop_contaminated, index, matches, windows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width=10):
    wins = [(str(i), w[k : k + width]) for i, t in items for w in [split(t)] if w for k in range(max(1, len(w) - width + 1))]
    out = []
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for item, win in wins:
            for s in range(len(w) - len(win) + 1):
                if w[s : s + len(win)] == win:
                    hit.update(range(s, s + len(win)))
                    found.add(item)
        names = sorted(found)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def random_docs(seed):
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "É", "é", "B2", *[f"w{i}" for i in range(12)]]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([1, 2, 3, 9, 10, 11, 25])))) for i in range(12)]
    docs = []
    for i in range(40):
        words = rnd.choices(vocabulary, k=rnd.randint(0, 60))
        for _ in range(rnd.randint(0, 2)):
            at = rnd.randint(0, len(words))
            piece = rnd.choice(items)[1].split()
            words[at:at] = piece[: rnd.randint(1, len(piece))]
        docs.append((i, rnd.choice([" ", "-", ". "]).join(w.upper() if rnd.random() < 0.2 else w for w in words)))
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_windows(spark, make, awkward, seed):
    docs, items = random_docs(seed)
    docs = docs + awkward
    items = items + [(90, None), (91, ""), (92, items[0][1]), (93, "ONE two three")]
    got = contamination(make(docs), spark.createDataFrame(items, "item_id long, text string")).drop("key").collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, items)


def test_item_without_an_id(spark, make):
    items = spark.createDataFrame([(None, "a b")], "item_id long, text string")
    got = contamination(make([(1, "x a b a b"), (1, "x a b a b")]), items).collect()
    assert [(r.n_hit, r.n_items, r.contaminated) for r in got] == [(4, 0, True)] * 2


def test_no_items_and_no_documents(spark, make):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in contamination(make([(1, "a b")]), none).collect()] == [0]
    assert contamination(make([]), none).count() == 0


def test_proximity(spark, make):
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    docs = [(1, "alpha beta gamma delta"), (2, "alpha x beta gamma delta"), (3, "alpha x y z beta gamma delta"), (4, "alpha gamma beta delta"), (5, "alpha beta gamma")]
    wins, _ = windows(items)
    terms = wins.selectExpr("explode(terms) AS word").distinct()
    postings = index(make(docs), terms)
    names = {r.key: r.id for r in postings.where("id IS NOT NULL").collect()}
    found = lambda slop: {names[r.key] for r in matches(wins, postings, slop).collect()}
    assert found(0) == {1}
    assert found(1) == {1, 2, 4}
    assert found(3) == {1, 2, 3, 4}


def test_stage(spark, make, tmp_path):
    spark.createDataFrame([(1, "one two three four")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = make([(1, "and one TWO three, four!"), (2, "clean"), (3, None), (None, "one two three four"), (2, "clean")])
    left = drop_contaminated(spark, docs, str(tmp_path))
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 2, 3]
