"""SimHash near-duplicates through BK-trees.

Equal fingerprints are merged first, so a group of copies of any size is one
entry.  Two fingerprints at distance 3 or less, cut into five pieces, agree in at
least two of them: each pair of pieces and its value is a shard.  A shard's
fingerprints form a BK-tree, whose children are keyed by their Hamming distance
to the parent; every fingerprint of the shard is looked up in it and follows only
the edges within the radius.  A shard above ``SHARD`` entries is cut once more by
the pieces of its other bits (four of them: one must agree), and so on until the
shard is small or its tree can hold no more than 2^17 entries, so no task meets
an unbounded tree and no link is lost.

Each shard returns a spanning set of its links, and large-star/small-star steps
join those to components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.common import lean, query, store, table
from tapeworks.llm.components import components

WORD_BREAKS = b" \t\n\x0b\x0c\r"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
RADIUS, SHARD = 3, 4096
HASH_BATCH = 8192


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a text; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    line = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    last = max(1, len(words) - width + 1)
    stops = (ends[-last:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, last, HASH_BATCH):
        part = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts[i : min(last, i + HASH_BATCH)], stops[i : i + HASH_BATCH])), np.uint64)
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > last).tobytes(), "big")


def with_fingerprints(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``key`` (a hash of id and text) and signed 64-bit ``fp`` of every row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_py()) for x in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["id", "key", "fp"])

    key = F.xxhash64(F.col(ident), F.xxhash64(text))
    given = docs.select(F.col(ident).cast("long").alias("id"), key.alias("key"), F.col(text).cast("string").alias("text"))
    return given.mapInArrow(lean(hashed), "id long, key long, fp long")


class BKTree:
    """A BK-tree over distinct fingerprints, built and searched a level at a time."""

    def __init__(self, points: np.ndarray):
        self.points = points
        n = len(points)
        owner = np.zeros(n, np.int64)  # the node each waiting point stands at
        waiting = np.arange(1, n)
        edges = []
        while len(waiting):
            at = owner[waiting]
            key = at * 65 + np.bitwise_count(points[waiting] ^ points[at])
            order = np.argsort(key, kind="stable")
            key, waiting = key[order], waiting[order]
            first = np.r_[True, key[1:] != key[:-1]]
            heads = waiting[first]
            edges.append((key[first], heads))
            owner[waiting] = heads[np.cumsum(first) - 1]
            waiting = waiting[~first]
        keys = np.concatenate([k for k, _ in edges]) if edges else np.empty(0, np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.child = np.concatenate([c for _, c in edges])[order] if edges else np.empty(0, np.int64)

    def within(self, radius: int, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (i, j), i < j, of points within the radius, a block of queries at a time."""
        for start in range(0, len(self.points), block):
            query = np.arange(start, min(len(self.points), start + block))
            node = np.zeros(len(query), np.int64)
            found = []
            while len(query):
                d = np.bitwise_count(self.points[query] ^ self.points[node]).astype(np.int64)
                hit = (d <= radius) & (query < node)
                found.append((query[hit], node[hit]))
                low = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
                high = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), "right")
                n = high - low
                offset = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                query, node = np.repeat(query, n), self.child[offset]
            i = np.concatenate([x for x, _ in found])
            if len(i):
                yield i, np.concatenate([y for _, y in found])


def _linked(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the groups of a shard: each point with the first of its group."""
    group = np.arange(len(points))
    pairs = list(BKTree(points).within(RADIUS))
    while True:
        before = group.copy()
        for i, j in pairs:
            low = np.minimum(group[i], group[j])
            np.minimum.at(group, i, low)
            np.minimum.at(group, j, low)
        group = group[group]
        if np.array_equal(before, group):
            break
    own = np.flatnonzero(group != np.arange(len(points)))
    return points[own], points[group[own]]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each run of equal shards in sorted rows."""

    def links(key: np.ndarray, fp: np.ndarray):
        ends = np.r_[np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
        starts = np.r_[0, ends[:-1]]
        for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            a, b = _linked(fp[s:e].view(np.uint64))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    rest_k, rest_f = np.empty(0, np.int64), np.empty(0, np.int64)
    for b in batches:
        key, fp = np.r_[rest_k, b.column(0).to_numpy()], np.r_[rest_f, b.column(1).to_numpy()]
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        yield from links(key[:cut], fp[:cut]) if cut else ()
        rest_k, rest_f = key[cut:], fp[cut:]
    if len(rest_k):
        yield from links(rest_k, rest_f)


#: Five pieces of the fingerprint as (first bit, number of bits).
PIECES = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]


def _piece(bits: list[tuple[int, int]]):
    """The value of some bit ranges of ``fp``, each in its place."""
    mask = sum(((1 << n) - 1) << at for at, n in bits)
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _splits(free: list[tuple[int, int]], parts: int) -> list[list[tuple[int, int]]]:
    """The free bits in ``parts`` pieces of about equal size."""
    bits = [b for at, n in free for b in range(at, at + n)]
    cuts = [len(bits) * i // parts for i in range(parts + 1)]
    return [[(b, 1) for b in bits[x:y]] for x, y in zip(cuts, cuts[1:])]


def link_fingerprints(fps: DataFrame, shard: int = SHARD) -> DataFrame:
    """Links (a, b) that join exactly the fingerprints connected within the radius.

    ``fps`` has distinct non-null values in ``fp``.
    """
    pairs = list(combinations(range(5), 2))
    fixed = [[PIECES[i], PIECES[j]] for i, j in pairs]
    rows = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(n).alias("path"), F.xxhash64(F.lit(n), _piece(bits)).alias("shard")) for n, bits in enumerate(fixed)
    ])).alias("at")).select("at.path", "at.shard", "fp")
    links = None
    while True:
        rows = store(rows, "shards")
        sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
        last = all(64 - sum(n for _, n in bits) <= 17 for bits in fixed)
        large = sizes.where(F.col("n") > shard).select("shard")
        over = not last and not large.isEmpty()
        small = rows.join(large, "shard", "left_anti") if over else rows
        found = small.select("shard", "fp").repartition("shard").sortWithinPartitions("shard").mapInArrow(lean(_shards), "a long, b long")
        links = found if links is None else links.unionByName(found)
        if not over:
            return links
        cut = []
        for bits in fixed:
            taken = {b for at, n in bits for b in range(at, at + n)}
            for piece in _splits([(b, 1) for b in range(64) if b not in taken], RADIUS + 1):
                cut.append(bits + piece)
        step = F.array(*[F.struct(F.lit(n).alias("path"), F.xxhash64(F.lit(len(cut)), F.lit(n), _piece(bits)).alias("shard")) for n, bits in enumerate(cut)])
        ways = F.slice(step, F.col("path") * (RADIUS + 1) + 1, RADIUS + 1)
        rows = rows.join(large, "shard", "left_semi").select("fp", F.explode(ways).alias("at")).select("at.path", "at.shard", "fp")
        fixed = cut


def groups(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``key``, ``fp``, ``root`` (the group's smallest fingerprint) and ``component`` (its smallest id) of every row."""
    rows = store(with_fingerprints(docs, ident, text), "fingerprints")
    fps = store(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = components(link_fingerprints(fps.select("fp")))
    rooted = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(least, "root").select("fp", "root", "component")
    return rows.join(named, "fp").select("id", "key", "fp", "root", "component")


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``ident``, signed ``fp`` and ``component`` (the smallest id reachable), one row per input row.

    Texts without words, null ones among them, have fingerprint 0 and are linked
    like any other; texts shorter than a shingle count as one shingle.  Equal ids
    and equal rows are fine, a null id is no candidate for the smallest.
    """
    return groups(docs, ident, text).select(F.col("id").alias(ident), "fp", "component")


@query("op10_simhash")
def op10(spark, d):
    return near_duplicates(table(spark, d, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id")
    )
