"""Removal of substrings that occur more than once in the corpus, through suffix arrays.

Strings of ``WIDTH`` bytes are compared.  Each such window has an anchor, its
leftmost smallest hash of ``GRAM`` bytes, so equal windows have equal anchors at
equal distance.  Consecutive windows with one anchor form a segment; segments are
gathered by anchor:

* A segment whose whole content occurs again is covered without further search.
  Copies are counted where they lie and before the shuffle, so a group of copies of
  any size is one row per task.
* The different segments of an anchor are laid side by side, cut into blocks of
  ``BLOCK`` bytes aligned at the anchor, and their suffixes are sorted by linear
  grouping over the blocks as symbols.  A window of 400 bytes holds a run of whole
  blocks; suffixes that share it stand together in the array, and the few bytes on
  either side decide, byte for byte, which windows are equal.
* An anchor with more than ``MOST`` different segments is not gathered: its windows
  are counted by their own hash, which spreads over all tasks.

Texts are shuffled twice: to fetch the segments to compare, and to cut the result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.common import query, shuffle_partitions, store, table
from tapeworks.llm.suffix_array import suffix_array

WIDTH, GRAM, BLOCK = 400, 32, 16
CHUNK = 1 << 20
MOST = 4096
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SPANS = "array<struct<b:bigint,e:bigint>>"


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)], dtype=np.uint64)


class Hashes:
    """Hashes of all strings of one length in a text, from running sums."""

    def __init__(self, length: int):
        self.length, self.up, self.down = length, _powers(BASE, 1024), _powers(INVERSE, 1024)

    def __call__(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        while len(self.up) < n + 1:
            self.up, self.down = _powers(BASE, 2 * len(self.up)), _powers(INVERSE, 2 * len(self.down))
        with np.errstate(over="ignore"):
            sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.down[:n], dtype=np.uint64)]
            h = (sums[self.length :] - sums[: n - self.length + 1]) * self.up[: n - self.length + 1]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        return h


def window_anchors(h: np.ndarray, size: int) -> np.ndarray:
    """Place of the leftmost smallest hash (by its upper 43 bits) in each run of ``size`` hashes."""
    n = len(h)
    key = (h & ~np.uint64((1 << 21) - 1)) | np.arange(n, dtype=np.uint64)
    padded = np.r_[key, np.full(-n % size, np.iinfo(np.uint64).max, np.uint64)].reshape(-1, size)
    forward = np.minimum.accumulate(padded, axis=1).ravel()
    backward = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - size + 1
    return (np.minimum(backward[:m], forward[size - 1 : size - 1 + m]) & np.uint64((1 << 21) - 1)).astype(np.int64)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((b, e))
    return out


def segments(docs: DataFrame) -> DataFrame:
    """The distinct segments of each document (key, text): anchor, digest, how often, where, and the first's anchor and windows."""
    names = ["key", "anchor", "digest", "times", "spans", "start", "at", "windows"]
    span = pa.list_(pa.struct([("b", pa.int64()), ("e", pa.int64())]))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), span, pa.int64(), pa.int64(), pa.int64()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, digest = Hashes(GRAM), xxhash.xxh3_64_intdigest
        out: list[tuple] = []
        for b in batches:
            keys = b.column(0).to_pylist()
            for i in range(b.num_rows):
                raw = (b.column(1)[i].as_py() or "").encode("utf-8", "surrogatepass")
                seen: dict[tuple[int, int], list] = {}
                for c in range(0, len(raw) - WIDTH + 1, CHUNK):
                    part = raw[c : c + CHUNK + WIDTH - 1]
                    h = hashes(np.frombuffer(part, np.uint8))
                    at = window_anchors(h, WIDTH - GRAM + 1)
                    cuts = np.r_[0, np.flatnonzero(at[1:] != at[:-1]) + 1, len(at)]
                    starts, stops, at = cuts[:-1].tolist(), cuts[1:].tolist(), at[cuts[:-1]]
                    view = memoryview(part)
                    for s, e, a, anchor in zip(starts, stops, at.tolist(), h[at].view(np.int64).tolist()):
                        name = (anchor, digest(view[s : e + WIDTH - 1]))
                        held = seen.get(name)
                        if held is None:
                            seen[name] = [1, [(c + s, c + e + WIDTH - 1)], c + s, a - s, e - s]
                        else:
                            held[0] += 1
                            held[1].append((c + s, c + e + WIDTH - 1))
                for (anchor, d), (times, spans, s, a, n) in seen.items():
                    spans = [{"b": x, "e": y} for x, y in (merged(spans) if times > 1 else spans)]
                    out.append((keys[i], anchor, d - (1 << 64) if d >> 63 else d, times, spans, s, a, n))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)

    return docs.mapInArrow(rows, f"key long, anchor long, digest long, times long, spans {SPANS}, start long, at long, windows long")


def repeated_windows(parts: list[tuple[bytes, int, int, bool]]) -> Iterator[tuple[int, int, int]]:
    """Windows (part, from, to) that occur more than once among parts (content, anchor's place, windows, wanted).

    Only windows of wanted parts are returned; a part's content does not occur twice.
    """
    names: dict[bytes, int] = {}
    text, part_of, byte_of = [], [], []
    for p, (data, at, _, _) in enumerate(parts):
        first = at % BLOCK
        for b in range(first, len(data) - BLOCK + 1, BLOCK):
            text.append(names.setdefault(data[b : b + BLOCK], len(names)))
            part_of.append(p)
            byte_of.append(b)
        text.append(-1 - p)  # ends differ from each other and all blocks
        part_of.append(p)
        byte_of.append(len(data))
    order = suffix_array([c + len(parts) for c in text])
    core = (WIDTH // BLOCK - 1) * BLOCK
    group: list[tuple[int, int]] = []
    before = b""
    for i in [*order, None]:
        if i is None:
            now = b""
        else:
            p, b = part_of[i], byte_of[i]
            now = parts[p][0][b : b + core]
            if len(now) < core:
                continue
        if group and now != before:
            if len(group) > 1:
                yield from _equal(parts, group, core)
            group = []
        if i is not None:
            group.append((p, b))
            before = now


def _equal(parts: list[tuple[bytes, int, int, bool]], group: list[tuple[int, int]], core: int) -> Iterator[tuple[int, int, int]]:
    """Windows around a core that its occurrences (part, byte) share."""
    rest = WIDTH - core
    around = defaultdict(list)
    for p, b in group:
        data, _, windows, _ = parts[p]
        around[data[max(0, b - rest + 1) : b], data[b + core : b + core + rest]].append((p, b))
    if len(around) == 1:
        for p, b in group:
            low, high = max(0, b - rest + 1), min(b + 1, parts[p][2])
            if parts[p][3] and low < high:
                yield p, low, high
        return
    for e in range(rest):
        same = defaultdict(list)
        for (left, right), members in around.items():
            if len(left) >= e and len(right) >= rest - e:
                same[left[len(left) - e :], right[: rest - e]] += members
        for members in same.values():
            if len(members) > 1:
                for p, b in members:
                    if parts[p][3] and b - e < parts[p][2]:
                        yield p, b - e, b - e + 1


def fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The contents of segments: ``wanted`` (key and columns of a segment) cut from ``docs`` (key, text)."""
    columns = ["anchor", "start", "at", "windows", "single"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct(*columns)).alias("parts"))  # at most the segments of a document

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for b in batches:
            keys = b.column(0).to_pylist()
            for i in range(b.num_rows):
                raw = b.column(1)[i].as_py().encode("utf-8", "surrogatepass")
                for p in b.column(2)[i].as_py():
                    data = raw[p["start"] : p["start"] + p["windows"] + WIDTH - 1]
                    out.append((keys[i], *[p[c] for c in columns], data))
                    size += len(data)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], ["key", *columns, "data"])
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], ["key", *columns, "data"])

    kind = "key long, anchor long, start long, at long, windows long, single boolean, data binary"
    return docs.join(lists, "key").select("key", "text", "parts").mapInArrow(rows, kind)


def _sorted_groups(parts: DataFrame) -> DataFrame:
    """Spans (key, b, e) of repeated windows, a suffix array for each anchor."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, held, where = None, [], []
        out: list[tuple[int, int, int]] = []

        def done() -> None:
            found = defaultdict(list)
            for p, low, high in repeated_windows(held):
                found[p].append((low, high))
            for p, spans in found.items():
                key, start = where[p]
                out.extend((key, start + low, start + high + WIDTH - 1) for low, high in merged(spans))

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["key", "b", "e"])

        for b in batches:
            for r in b.to_pylist():
                if r["anchor"] != anchor:
                    done()
                    anchor, held, where = r["anchor"], [], []
                    if len(out) > 50_000:
                        yield batch()
                        out.clear()
                held.append((r["data"], r["at"], r["windows"], r["single"]))
                where.append((r["key"], r["start"]))
        done()
        if out:
            yield batch()

    return parts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(rows, "key long, b long, e long")


def _distinct(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of an (n, 2) array in order: the first place of each, its number for every row, and the counts."""
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    ordered = pairs[order]
    new = np.r_[True, (ordered[1:] != ordered[:-1]).any(axis=1)] if len(pairs) else np.empty(0, bool)
    number = np.empty(len(pairs), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number, np.bincount(number, minlength=int(new.sum()))


def _counted_windows(parts: DataFrame, windows: int, batch: int = 200_000) -> DataFrame:
    """The same spans for anchors with too many segments: windows are counted by a 128-bit hash.

    A task sends each different window of a batch once, with its count, packed by
    ranges of the hash; what repeats inside the batch is known there and then.
    ``windows`` is their number and sets that of the ranges.
    """
    buckets = max(shuffle_partitions(parts.sparkSession), -(-windows // 1_000_000))
    names = ["bucket", "digests", "counts", "keys", "begins"]
    kind = "bucket long, digests binary, counts binary, keys binary, begins binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests: list[bytes] = []
        keys, begins, single = [], [], []

        def packed() -> pa.RecordBatch:
            pairs = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64)
            first, number, counts = _distinct(pairs)
            key, begin, wanted = np.concatenate(keys), np.concatenate(begins), np.concatenate(single)
            out = []
            known = np.flatnonzero(wanted & (counts[number] > 1))
            if len(known):
                out.append((int(key[known[0]]) % buckets, b"", b"", key[known].tobytes(), begin[known].tobytes()))
            # a begin of -1 stands for a window that is not asked for any more
            begin = np.where(wanted[first] & (counts == 1), begin[first], -1)
            bucket = ((pairs[first, 0] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            cuts = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]
            for x, y in zip(cuts[:-1], cuts[1:]):
                out.append((int(bucket[x]), pairs[first[x:y]].tobytes(), counts[x:y].tobytes(), key[first[x:y]].tobytes(), begin[x:y].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i else pa.int64()) for i, c in enumerate(zip(*out))], names)

        size = 0
        for b in batches:
            for r in b.to_pylist():
                view, n = memoryview(r["data"]), r["windows"]
                digests += [xxhash.xxh3_128_digest(view[i : i + WIDTH]) for i in range(n)]
                keys.append(np.full(n, r["key"]))
                begins.append(np.arange(n) + r["start"])
                single.append(np.full(n, r["single"]))
                size += n
                if size >= batch:
                    yield packed()
                    digests, keys, begins, single, size = [], [], [], [], 0
        if size:
            yield packed()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def spans(keys: np.ndarray, begins: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(begins), pa.array(begins + WIDTH)], ["key", "b", "e"])

        def added() -> pa.RecordBatch:
            pairs = np.frombuffer(b"".join(r["digests"] for r in held), np.uint64).reshape(-1, 2)
            counts, keys, begins = (np.frombuffer(b"".join(r[c] for r in held), np.int64) for c in ("counts", "keys", "begins"))
            _, number, _ = _distinct(pairs)
            total = np.bincount(number, weights=counts)
            again = (total[number] > 1) & (begins >= 0)
            return spans(keys[again], begins[again])

        for b in batches:
            for r in b.to_pylist():
                if not r["digests"]:
                    yield spans(np.frombuffer(r["keys"], np.int64), np.frombuffer(r["begins"], np.int64))
                    continue
                if held and held[0]["bucket"] != r["bucket"]:
                    yield added()
                    held = []
                held.append(r)
        if held:
            yield added()

    sent = parts.mapInArrow(send, kind).repartition("bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(count, "key long, b long, e long")


def repeated_spans(keyed: DataFrame, most: int = MOST) -> DataFrame:
    """``key`` and ``spans``: the bytes of each text (key, text) that a repeated window covers, not merged yet."""
    found = store(segments(keyed), "segments", "zstd")
    counted = found.groupBy("anchor", "digest").agg(
        F.sum("times").alias("n"), *[F.any_value(c).alias(c) for c in ("key", "start", "at", "windows")]
    )
    shared = counted.groupBy("anchor").agg(F.count(F.lit(1)).alias("different"), F.count_if(F.col("n") == 1).alias("singles"))
    shared = shared.where("different > 1 and singles > 0").drop("singles")
    marked = store(counted.join(shared, "anchor", "left").where("n > 1 or different is not null"), "marked", "zstd")
    copies = found.join(marked.where("n > 1").select("anchor", "digest"), ["anchor", "digest"], "left_semi").select("key", F.inline("spans"))
    wanted = marked.where("different is not null").withColumn("single", F.col("n") == 1)
    every = copies.unionByName(_sorted_groups(fetched(keyed, wanted.where(F.col("different") <= most))))
    crowded = wanted.where(F.col("different") > most)
    windows = crowded.agg(F.sum("windows")).first()[0]
    if windows:
        every = every.unionByName(_counted_windows(fetched(keyed, crowded), windows))
    return store(every.groupBy("key").agg(F.collect_list(F.struct("b", "e")).alias("spans")), "spans", "zstd")


def remove_repeats(docs: DataFrame, ident: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """``ident``, n_bytes, the removed spans and the bytes ``kept``, one row per row of ``docs``.

    A byte is removed if a string of 400 bytes that covers it starts anywhere else too,
    in this or another text.  Null and empty texts, and those of fewer bytes, stay.
    Rows equal in id and text are copies of each other like any others.  ``kept`` may
    end inside a character, so it is binary.
    """
    keyed = docs.select(F.col(ident), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(ident), F.xxhash64(text)).alias("key"))
    spans = repeated_spans(keyed.where(F.octet_length("text") >= WIDTH).select("key", "text"), most)
    names = [ident, "n_bytes", "removed", "kept"]
    span = pa.list_(pa.struct([("b", pa.int64()), ("e", pa.int64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, removed, kept = [], [], []
            for t, found in zip(b.column(1), b.column(2)):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                cut = merged([(x["b"], x["e"]) for x in found.as_py() or ()])
                parts, end = [], 0
                for x, y in cut:
                    parts.append(raw[end:x])
                    end = y
                sizes.append(len(raw))
                removed.append([{"b": x, "e": y} for x, y in cut])
                kept.append(b"".join([*parts, raw[end:]]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(removed, span), pa.array(kept, pa.binary())], names)

    joined = keyed.join(spans, "key", "left").select(F.col(ident).cast("long").alias(ident), "text", "spans")
    return joined.mapInArrow(rows, f"`{ident}` long, n_bytes long, removed {SPANS}, kept binary")


@query("op6_substrings")
def op6(spark, d):
    lengths = F.transform("removed", lambda s: s.getField("e") - s.getField("b"))
    return remove_repeats(table(spark, d, "documents")).select(
        "doc_id", "n_bytes", F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"), "removed",
    )
