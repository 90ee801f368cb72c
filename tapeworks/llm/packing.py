"""Packing by column generation for the cutting-stock problem.

Documents are cut into pieces of at most one sequence.  Full pieces fill a
sequence each; of the rest only the histogram over length classes is needed, at
most ``width / step`` numbers, so the linear program is small whatever the size
of the corpus.  Its columns are patterns, multisets of length classes that fit a
sequence.  Starting from the patterns of first-fit decreasing, a knapsack dynamic program over
the dual prices finds the pattern that lowers the number of sequences most,
until none does.  Pattern counts are rounded down, the few pieces left over are
packed first-fit decreasing, and pieces take their slots in the patterns by rank
within their class.

Ranks come from counts per class and bucket, so no class, however common, is
ordered in one task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.llm.common import lean, query, store, table

WIDTH, STEP, END = 2048, 8, 1
BUCKET = 65_536
ROUNDS = 10_000
#: The pre-tokenizer's pattern for byte-level BPE; a fixed value of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_BLANK = re.compile(r"\s{512}")


@lru_cache(maxsize=1)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=1)
def encoder(path: str):
    """Text to ids by the tokenizer file at ``path``.

    Texts in Latin-1 letters go through a faster library built from the same
    vocabulary; it gives the same ids, which the tests verify.  Texts with other
    letters, special tokens or very long blanks go through the tokenizer itself, which
    is loaded by the tasks that meet one.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec["added_tokens"]]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    bytes_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(bytes_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("fast", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            usual = False
        else:
            usual = not any(s in text for s in special) and not LONG_BLANK.search(text)
        ids = fast.encode_ordinary(text) if usual else tokenizer(path).encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4")

    return encode


def cut_documents(docs: DataFrame, path: str, ident: str = "doc_id", text: str = "text", width: int = WIDTH, end: int = END) -> DataFrame:
    """Pieces of each text's ids and the ``end`` id: ``ident``, start, length, doc_tokens and ids (little-endian 32 bit)."""
    names = ["id", "start", "length", "doc_tokens", "ids"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            rows, held = [], 0
            for i in range(b.num_rows):
                ids = np.append(encode(b.column(1)[i].as_py() or ""), np.uint32(end)).astype("<u4")
                for s in range(0, len(ids), width):
                    part = ids[s : s + width]
                    rows.append((b.column(0)[i].as_py(), s, len(part), len(ids), part.tobytes()))
                held += len(ids)
                if held > 2_000_000 or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.binary()])], names)
                    rows, held = [], 0

    given = docs.select(F.col(ident).cast("long"), F.col(text).cast("string"))
    return given.mapInArrow(lean(cut), "id long, start long, length long, doc_tokens long, ids binary").withColumnRenamed("id", ident)


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The multiset of sizes of most value within the capacity, by dynamic programming."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for w in range(1, capacity + 1):
        fits = sizes <= w
        gains = best[w - sizes[fits]] + values[fits]
        best[w], last[w] = best[w - 1], -1
        if len(gains) and gains.max() > best[w] + 1e-12:
            last[w] = np.flatnonzero(fits)[gains.argmax()]
            best[w] = gains.max()
    counts, w = np.zeros(len(sizes), np.int64), capacity
    while w > 0:
        if last[w] < 0:
            w -= 1
        else:
            counts[last[w]] += 1
            w -= sizes[last[w]]
    return counts


def first_fit(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns of first-fit decreasing and how often to use each; together they hold exactly ``demand``."""
    left, order, plan = demand.astype(np.int64).copy(), np.argsort(-sizes), []
    while left.any():
        column, room = np.zeros(len(sizes), np.int64), capacity
        for i in order:
            column[i] = min(left[i], room // sizes[i])
            room -= column[i] * sizes[i]
        held = column > 0
        n = int((left[held] // column[held]).min())
        plan.append((column, n))
        left -= n * column
    return plan


def patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, int]]:
    """Patterns over ``sizes`` and how often to use each; together they hold exactly ``demand``.

    Revised simplex: a column enters for a surplus with a negative price, else from the
    patterns of first-fit decreasing, else from the knapsack, whose value also bounds the
    optimum from below.  Then rounding down, and first-fit decreasing for what is left.
    Stopping after ``rounds`` leaves a feasible plan.
    """
    m = len(sizes)
    if not m:
        return []
    columns = [np.where(np.arange(m) == i, capacity // sizes[i], 0) for i in range(m)]
    costs, inverse, bound = np.ones(m), np.diag(1.0 / np.array([c.max() for c in columns])), 0.0
    known = np.array([c for c, _ in first_fit(sizes, demand, capacity)]).reshape(-1, m)
    for _ in range(rounds):
        prices, amount = costs @ inverse, inverse @ demand
        values, cost = known @ prices, 1.0
        if prices.min() < -1e-9:
            new, cost = -(np.arange(m) == prices.argmin()).astype(np.int64), 0.0
        elif len(values) and values.max() > 1 + 1e-7:
            new = known[values.argmax()]
        else:
            new = price(np.maximum(prices, 0), sizes, capacity)
            bound = max(bound, demand @ np.maximum(prices, 0) / max(1.0, prices @ new))
            if prices @ new <= 1 + 1e-7 or costs @ amount - bound <= 1e-4 * bound:
                break
        way = inverse @ new
        able = np.flatnonzero(way > 1e-9)
        leave = able[np.argmin(np.maximum(amount[able], 0) / way[able])]
        columns[leave], costs[leave] = new, cost
        row = inverse[leave] / way[leave]
        inverse -= np.outer(way, row)
        inverse[leave] = row
    used = np.floor(np.maximum(inverse @ demand, 0) * costs + 1e-6).astype(np.int64)
    left, plan = demand.astype(np.int64).copy(), []
    for column, n in sorted(zip(columns, used.tolist()), key=lambda x: -x[1]):
        held = column > 0
        n = min(n, int((left[held] // column[held]).min())) if held.any() else 0
        if n > 0:
            plan.append((column, n))
            left -= n * column
    return plan + first_fit(sizes, left, capacity)


def pack(pieces: DataFrame, order: list[str], width: int = WIDTH, step: int = STEP, bucket: int = BUCKET) -> DataFrame:
    """All columns of ``pieces`` with sequence_id and offset; ``length`` is between 1 and ``width``.

    Pieces are ranked by a hash of ``order`` and then by ``order``; rows equal in it
    have the same length, so either may take the other's slot.
    """
    spark = pieces.sparkSession
    kind = F.when(F.col("length") == width, 0).otherwise(F.ceil(F.col("length") / step)).cast("int")
    buckets = max(1, -(-pieces.count() // bucket)) * 4
    rows = pieces.withColumn("_kind", kind).withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = store(rows.groupBy("_kind", "_bucket").agg(F.count(F.lit(1)).alias("_n")), "sizes")
    earlier = Window.partitionBy("_kind").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_kind", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    histogram = {r._kind: r.n for r in sizes.groupBy("_kind").agg(F.sum("_n").alias("n")).collect()}  # a row per length class
    kinds = np.array(sorted(k for k in histogram if k), np.int64)
    plan = patterns(kinds, np.array([histogram[k] for k in kinds], np.int64), width // step)
    slots, taken, first = [(0, 0, histogram.get(0, 0), 1, sum(n for _, n in plan), 0)], dict.fromkeys(kinds.tolist(), 0), 0
    for column, n in plan:
        place = 0
        for i in np.flatnonzero(column)[::-1].tolist():
            k, each = int(kinds[i]), int(column[i])
            slots.append((k, taken[k], taken[k] + each * n, each, first, place))
            taken[k] += each * n
            place += each
        first += n
    given = spark.createDataFrame(slots, "_kind int, _from long, _to long, _each long, _first long, _place long")
    local = Window.partitionBy("_kind", "_bucket").orderBy(*order)
    ranked = rows.withColumn("_rank", F.row_number().over(local) - 1).join(F.broadcast(before) if buckets * len(histogram) <= 1_000_000 else before, ["_kind", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before"))
    r, s = ranked.alias("r"), F.broadcast(given).alias("s")
    inside = (F.col("r._kind") == F.col("s._kind")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    seat = F.col("_rank") - F.col("_from")
    placed = r.join(s, inside).select(
        *[F.col(f"r.{c}") for c in pieces.columns], (F.col("_first") + F.floor(seat / F.col("_each"))).alias("sequence_id"),
        (F.col("_place") + seat % F.col("_each")).alias("_seat"),
    )
    above = Window.partitionBy("sequence_id").orderBy("_seat").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(above), F.lit(0)).cast("long")).drop("_seat")


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with a checksum of their ids, and their places in sequences.

    A null text is empty: its document is the end id alone.  Rows with equal ids are
    documents of their own; no rows give no pieces.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = cut_documents(docs, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(store(pieces, "pieces"), ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])


@query("op4_packing")
def op4(spark, d):
    return pack_documents(table(spark, d, "documents"))


def pack_stage(spark, docs: DataFrame, d: str) -> DataFrame:
    """Pipeline stage: the sequences that the documents fill."""
    return pack_documents(docs)
