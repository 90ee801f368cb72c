"""Repeated substrings against a count of every window, and the suffix array against sorting."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeworks.llm.substrings import WIDTH, remove_repeats
from tapeworks.llm.suffix_array import suffix_array


@given(st.lists(st.integers(0, 3), max_size=60))
@settings(max_examples=400, deadline=None)
def test_suffix_array(text):
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_suffix_array_of_long_repeats():
    for text in ([1] * 3000, [0, 1] * 1500, [2, 1, 0] * 1000, list(range(3000)), list(range(3000, 0, -1))):
        order = suffix_array(text)
        assert sorted(order) == list(range(len(text)))
        assert all(text[a:] < text[b:] for a, b in zip(order[::97], order[1::97]))


def brute(docs):
    raws = [(i, (t or "").encode()) for i, t in docs]
    windows = Counter(r[s : s + WIDTH] for _, r in raws for s in range(len(r) - WIDTH + 1))
    out = []
    for i, r in raws:
        covered = bytearray(len(r))
        for s in range(len(r) - WIDTH + 1):
            if windows[r[s : s + WIDTH]] > 1:
                covered[s : s + WIDTH] = b"\x01" * WIDTH
        spans = [k for k in range(len(r)) if covered[k] and (k == 0 or not covered[k - 1])]
        out.append((i, len(r), sum(covered), len(spans), bytes(b for b, c in zip(r, covered) if not c)))
    return sorted(out, key=repr)


def texts(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7)))
    base = [" ".join(word() for _ in range(300)) for _ in range(5)]
    docs = [(100, "ab c" * 300), (101, "x" + "ab c" * 120), (102, "b" * 399), (103, "b" * 2000)]
    for n in range(25):
        t = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            t[rnd.randrange(len(t))] = rnd.choice("xyz")
        t = "".join(t)[rnd.randint(0, 300) :]
        if rnd.random() < 0.4:
            at = rnd.randint(0, 200)
            t += rnd.choice(base)[at : at + rnd.randint(385, 700)]
        docs.append((n, t))
    return docs + [docs[9], docs[9], docs[10]]


@pytest.mark.parametrize("seed, most", [(1, 4096), (2, 4096), (3, 2)])
def test_repeats(make, awkward, seed, most):
    docs = texts(seed) + awkward
    got = remove_repeats(make(docs), most=most).collect()
    plain = [(r.doc_id, r.n_bytes, sum(s.e - s.b for s in r.removed), len(r.removed), bytes(r.kept)) for r in got]
    assert sorted(plain, key=repr) == brute(docs)


def test_no_documents(make):
    assert remove_repeats(make([])).count() == 0
    assert [bytes(r.kept) for r in remove_repeats(make([(1, None)])).collect()] == [b""]
