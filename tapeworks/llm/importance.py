"""Quality classifier by importance resampling.

A text is a bag of hashed words and word pairs.  Two generative models over the
hash buckets, one of the target texts (labelled good, not toxic) and one of all
raw text, give each document its log importance ratio.  A document's key is that
ratio plus Gumbel noise drawn from a hash of the row, and the documents with the
k largest keys are a sample without replacement in proportion to importance.

``k`` is given, or the sample follows from the labels.  Keys are sums over tokens, so
each length class has a threshold of its own, at which all but ``loss`` of the good
documents held out of the model stay.  A second pair of models, of the toxic and of
the good labelled documents, gives weights to the buckets that are far more frequent
among toxic ones; a document above the weight that all but ``toxic_loss`` of the good
held-out ones of its class stay below is rejected as well.

The models are tables of ``buckets`` numbers, whatever the size of the corpus:
each task returns its counts per bucket, and the ratios (4 MB for the default
size) are what the scoring tasks receive.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tapeworks.llm.common import lean, query, store, table

TOKEN = re.compile(r"\w+|[^\w\s]+")
BUCKETS = 1 << 20
#: Pseudo counts of a word bucket and of a word pair bucket; rarer buckets say little.
PRIOR = (1.0, 10.0)
MEMO = 50_000
#: The buckets travel in so many parts.
PARTS = 128
#: Classes of 2^n to 2^(n+1) tokens, the first and last open; neighbours are joined up to so many held-out documents.
CLASSES, CALIBRATE = range(4, 12), 200
#: Standard deviations by which a bucket must be more frequent in toxic documents.
DEVIATIONS = 6.0
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Features:
    """Bucket numbers of a text: words in the lower half, pairs in the upper half."""

    def __init__(self, buckets: int):
        self.half = np.uint64(buckets // 2)
        self.memo: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int64)
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        hashes = []
        for word in TOKEN.findall(text):
            h = memo.get(word)
            if h is None:
                h = memo[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
            hashes.append(h)
        one = np.array(hashes, np.uint64)
        two = (one[:-1] * MIX_A + one[1:] * MIX_B) >> np.uint64(24)
        return np.r_[one % self.half, two % self.half + self.half].astype(np.int64)


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, once: bool = False) -> DataFrame:
    """Counts of a table with ``text`` and boolean ``target``: ``part`` of the buckets and its ``raw`` and ``target`` counts as arrays of bytes.

    ``once``: documents are counted, not occurrences.
    """
    width = max(1, buckets // PARTS)
    names = ["part", "raw", "target"]

    def rows(raw: np.ndarray, target: np.ndarray, first: int = 0) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(raw), width):
            if raw[i : i + width].any():
                pair = [pa.array([x[i : i + width].tobytes()]) for x in (raw, target)]
                yield pa.RecordBatch.from_arrays([pa.array([first + i // width]), *pair], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(buckets)
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            for text, good in zip(b.column(0), b.column(1).to_pylist()):
                f = features(text.as_py())
                f = np.unique(f) if once else f
                np.add.at(raw, f, 1)
                if good:
                    np.add.at(target, f, 1)
        yield from rows(raw, target)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}  # at most PARTS entries
        for b in batches:
            for part, *both in zip(*[c.to_pylist() for c in b.columns]):
                held = sums.setdefault(part, [np.zeros(width, np.int64), np.zeros(width, np.int64)])
                for x, y in zip(held, both):
                    x += np.frombuffer(y, np.int64)
        for part, (raw, target) in sums.items():
            yield from rows(raw, target, part)

    kind = "part long, raw binary, target binary"
    return docs.select("text", "target").mapInArrow(lean(count), kind).repartition("part").mapInArrow(lean(add), kind)


def _gather(counts: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The counts on the driver: two numbers for each bucket."""
    width = max(1, buckets // PARTS)
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for part, *both in counts.toLocalIterator():
        for x, y in zip((raw, target), both):
            x[part * width : (part + 1) * width] = np.frombuffer(y, np.int64)
    return raw, target


def log_ratios(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Log ratio of the smoothed models per bucket."""
    raw, target = _gather(counts, buckets)
    out = np.zeros(buckets, np.float32)
    for half, prior in zip((slice(0, buckets // 2), slice(buckets // 2, buckets)), PRIOR):
        scale = target[half].sum() / max(1.0, raw[half].sum())
        out[half] = np.log((target[half] + prior) / (raw[half] * scale + prior))
    return out


def toxic_weights(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Log ratio of toxic to good documents for the buckets that tell them apart, else 0.

    ``docs`` has ``text`` and boolean ``target``, true for toxic and false for good.
    """
    n, toxic = docs.agg(F.count(F.lit(1)), F.count_if("target")).first()
    both, bad = _gather(bucket_counts(docs, buckets, once=True), buckets)
    share = toxic / max(1, n)
    far = (bad - both * share) / np.sqrt(both * share * (1 - share) + 1) > DEVIATIONS
    weights = np.log((bad + 1) / ((both - bad) * toxic / max(1, n - toxic) + 1))
    return np.where(far, np.maximum(weights, 0), 0).astype(np.float32)


def with_keys(docs: DataFrame, ratios: np.ndarray, seed: int, text: str = "text", ident: str = "doc_id", toxic: np.ndarray | None = None) -> DataFrame:
    """``docs`` with ``_ratio``, the log importance ratio, and ``_key``, the ratio plus Gumbel noise; the text becomes a string.

    With weights in ``toxic`` also ``_toxic``, their sum, and ``_class``, the place of the length class.
    """
    docs = docs.withColumn(text, F.col(text).cast("string"))
    given = [ratios] if toxic is None else [ratios, toxic]
    sent, buckets, at = docs.sparkSession.sparkContext.broadcast(given), len(ratios), docs.columns.index(text)
    names = ["_ratio", "_key", "_toxic", "_class"][: 2 * len(given)]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, models = Features(buckets), sent.value
        for b in batches:
            sums, tokens = np.zeros((len(models), b.num_rows)), np.zeros(b.num_rows, np.int64)
            for i, t in enumerate(b.column(at)):
                f = features(t.as_py())
                tokens[i] = (len(f) + 1) // 2
                for row, weights in zip(sums, models):
                    row[i] = weights[f].sum(dtype=np.float64)
            uniform = ((b.column(b.num_columns - 1).to_numpy().view(np.uint64) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
            place = np.clip(np.log2(np.maximum(tokens, 1)).astype(np.int32), CLASSES[0], CLASSES[-1]) - CLASSES[0]
            added = [sums[0], sums[0] - np.log(-np.log(uniform)), sums[-1], place.astype(np.int32)][: len(names)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *map(pa.array, added)], [*b.schema.names[:-1], *names])

    draw = F.xxhash64(F.lit(seed), F.col(ident), F.xxhash64(text))
    kinds = [StructField(n, IntegerType() if n == "_class" else DoubleType()) for n in names]
    return docs.withColumn("_draw", draw).mapInArrow(lean(score), StructType([*docs.schema.fields, *kinds]))


def top_k_threshold(scored: DataFrame, k: int, key: str) -> float:
    """The k-th largest key, found by counting in ever narrower bins; rows equal to it belong to the sample."""
    low, high, n = scored.agg(F.min(key), F.max(key), F.count(key)).first()
    if k <= 0 or not n:
        return float("inf")
    if k >= n:
        return low
    above, bins = 0, 4096
    while True:
        width = (high - low) / bins
        if not width or low + width == low:
            break
        at = F.least(F.floor((F.col(key) - low) / width), F.lit(bins - 1))
        inside = scored.where((F.col(key) >= low) & (F.col(key) <= high))
        hist = inside.groupBy(at.alias("bin")).agg(F.count(key).alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
        for row in hist.orderBy(F.desc("bin")).collect():  # at most ``bins`` rows
            if above + row.n >= k:
                low, high = row.low, row.high
                break
            above += row.n
        if low == high:
            break
    return low


def class_bounds(held: DataFrame, loss: float, toxic_loss: float) -> list[tuple[float, float]]:
    """Least ``_key`` and largest ``_toxic`` of each length class, at which all but the given shares of the held-out rows stay.

    The rows are some of the bounded labelled ones.  Without any, everything stays.
    """
    rows = held.select("_class", "_key", "_toxic").toPandas()
    if rows.empty:
        return [(-math.inf, math.inf)] * len(CLASSES)
    sizes, joined = np.bincount(rows["_class"], minlength=len(CLASSES)), [[]]
    for c in range(len(CLASSES)):
        if sizes[joined[-1]].sum() >= CALIBRATE and sizes[c:].sum() >= CALIBRATE:
            joined.append([])
        joined[-1].append(c)
    bounds = []
    for classes in joined:
        own = rows[rows["_class"].isin(classes)]
        n = len(own)
        bounds += [(float(np.sort(own["_key"])[int(n * loss)]), float(np.sort(own["_toxic"])[n - 1 - int(n * toxic_loss)]))] * len(classes)
    return bounds


class Resampler:
    """Models and thresholds for one corpus; ``keys`` holds id, ratio, key, toxic weight and length class of every row.

    ``docs``: doc_id and text; ``labels``: doc_id, quality and toxic (null: unknown).  A
    document with contradicting labels is not good.  At most about ``labelled`` good or
    toxic documents, chosen by a hash of their id, take part; a fifth of them is held out.
    A given ``k`` is the size of the sample by key alone.
    """

    def __init__(
        self, docs: DataFrame, labels: DataFrame, k: int | None = None, loss: float = 0.001, seed: int = 7, labelled: int = 1_000_000, buckets: int = BUCKETS, toxic_loss: float = 0.005
    ):
        known = labels.where("doc_id is not null").groupBy("doc_id").agg(
            F.min(F.coalesce("quality", F.lit(0))).alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")
        ).where("toxic = 1 or quality = 1").select("doc_id", (F.col("toxic") == 0).alias("good"))
        share = min(1.0, labelled / max(1, known.count()))
        part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)
        held = F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(5)) == 0
        rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known.where(part)), "doc_id", "left")
        good = F.coalesce("good", F.lit(False))
        marked = rows.select("doc_id", "text", (good & ~held).alias("target"), (good & held).alias("held"))
        self.seed = seed
        self.ratios = log_ratios(bucket_counts(marked, buckets), buckets)
        self.toxic = toxic_weights(rows.where(F.col("good").isNotNull() & ~held).select("text", (~F.col("good")).alias("target")), buckets)
        self.keys = store(with_keys(marked.drop("target"), self.ratios, seed, toxic=self.toxic).drop("text"), "keys")
        if k is None:
            self.bounds = class_bounds(self.keys.where("held"), loss, toxic_loss)
        else:
            self.bounds = [(top_k_threshold(self.keys, k, "_key"), math.inf)] * len(CLASSES)

    def stays(self) -> Column:
        """Whether a row with keys belongs to the sample."""
        low, high = (F.get(F.array(*map(F.lit, x)), F.col("_class")) for x in zip(*self.bounds))
        return (F.col("_key") >= low) & (F.col("_toxic") <= high)


def resample(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``log_ratio``, ``key`` and ``selected``, one row per row of ``docs``; options as for Resampler.

    Null and empty texts have ratio 0.  Rows with the same id and text draw the same
    noise and are kept or left together, so ties may add rows to the sample.  Without
    good labels the ratios are 0, and without held-out ones every document is kept.
    """
    fitted = Resampler(docs, labels, **options)
    return fitted.keys.select(
        "doc_id", F.col("_ratio").alias("log_ratio"), F.col("_key").alias("key"), fitted.stays().alias("selected")
    )


@query("op8_importance_resampling")
def op8(spark, d):
    return resample(table(spark, d, "documents"), table(spark, d, "labels"))


def keep_quality(spark, docs: DataFrame, d: str) -> DataFrame:
    """Pipeline stage: the documents that the sample keeps, with their columns."""
    fitted = Resampler(docs, table(spark, d, "labels"))
    return with_keys(docs, fitted.ratios, fitted.seed, toxic=fitted.toxic).where(fitted.stays()).drop("_ratio", "_key", "_toxic", "_class")
