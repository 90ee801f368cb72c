"""Pieces and sequences against the tokenizer, patterns against their limits."""

import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tapeworks.llm.packing import cut_documents, encoder, pack, pack_documents, patterns, price

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_encoder_gives_the_tokenizers_ids():
    encode, plain = encoder(PATH), Tokenizer.from_file(PATH)
    rnd = random.Random(2)
    latin = [chr(i) for i in range(256)]
    texts = ["".join(rnd.choice(latin if rnd.random() < 0.5 else "ae the'sll 12 \n\t.,\x85\xa0é") for _ in range(rnd.randint(0, 60))) for _ in range(2000)]
    texts += ["", " " * 5000, "a" * 5000, "<|endoftext|> x", "日本 語 text", "!" * 3000, "x\n" * 3000, "\U0001f600é"]
    for t in texts:
        assert encode(t).tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_pieces_and_sequences(spark, make, awkward):
    docs = awkward + [(30 + i, "word " * n) for i, n in enumerate([2047, 2048, 2049, 4095, 10_000, 700, 700, 700, 1, 1, 1])]
    got = pack_documents(make(docs)).collect()
    plain = Tokenizer.from_file(PATH)
    ids = [(i, plain.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in docs]
    expect = sorted(
        ((i, s, min(2048, len(x) - s), zlib.crc32(struct.pack(f"<{min(2048, len(x) - s)}I", *x[s : s + 2048])), len(x)) for i, x in ids for s in range(0, len(x), 2048)), key=repr
    )
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got), key=repr) == expect
    seats = {}
    for r in got:
        seats.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seats.values():
        ends = [o + n for o, n in sorted(s)]
        assert [o for o, _ in sorted(s)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert pack_documents(make([])).count() == 0


def test_ids_pass_through(spark, make):
    pieces = cut_documents(make([(1, "a b c"), (2, "d")]), PATH, width=3)
    packed = pack(pieces, ["doc_id", "start"], width=3, step=1).collect()
    assert all(len(r.ids) == 4 * r.length for r in packed) and {r.doc_id for r in packed} == {1, 2}


def test_hot_length_over_buckets(spark):
    lengths = [777] * 3000 + [(i * 37) % 2048 + 1 for i in range(1500)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long").repartition(4)
    got = pack(df, ["doc_id"], bucket=100).collect()
    assert sorted((r.doc_id, r.length) for r in got) == list(enumerate(lengths))
    fill = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048 and sorted(fill) == list(range(len(fill)))
    rooms = []
    for n in sorted((-(-n // 8) * 8 for n in lengths), reverse=True):  # first fit decreasing over the length classes
        at = next((i for i, room in enumerate(rooms) if room >= n), None)
        if at is None:
            rooms.append(2048 - n)
        else:
            rooms[at] -= n
    assert len(fill) <= 1.01 * len(rooms) + 2


def best(values, sizes, capacity):
    table = [0.0] * (capacity + 1)
    for w in range(1, capacity + 1):
        table[w] = max([table[w - 1], *(table[w - s] + v for v, s in zip(values, sizes) if s <= w)])
    return table[capacity]


@pytest.mark.parametrize("seed", range(5))
def test_patterns(seed):
    rnd = np.random.default_rng(seed)
    sizes = np.sort(rnd.choice(np.arange(1, 41), 12, replace=False))
    demand = rnd.integers(0, 500, 12)
    values = rnd.random(12)
    counts = price(values, sizes, 40)
    assert counts @ sizes <= 40 and abs(counts @ values - best(values, sizes, 40)) < 1e-9
    plan = patterns(sizes, demand, 40)
    assert (sum(c * n for c, n in plan) == demand).all() and all(c @ sizes <= 40 and n > 0 for c, n in plan)
    alone = sum(-(-int(d) // (40 // int(s))) for s, d in zip(sizes, demand))
    used = sum(n for _, n in plan)
    assert sizes @ demand / 40 <= used <= alone
    assert patterns(sizes[:0], demand[:0], 40) == []
