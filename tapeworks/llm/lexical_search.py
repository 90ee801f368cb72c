"""Exact ranked search with impact vectors in buckets by length.

A document is a vector of impacts: for each of its terms, the weight of the term
times the term's share in a score.  The score of an item is the sum of the impacts
at its terms.  Vectors are ordered by Euclidean length and cut into buckets.  The
square root of the number of an item's terms times the longest length of a bucket
bounds every score in it (Cauchy-Schwarz), so whole buckets are left out once an item
has enough better documents.  Inside a bucket the largest impact of each
coordinate orders the terms; from the first place where what the remaining
coordinates can add stays below the item's threshold no new document can enter, and
those met so far are dropped by the same bound and by Cauchy-Schwarz on what is left
of their length.  Survivors are scored in 64-bit integers.

The index is a table of all documents with all their terms.  Items are taken in blocks
of a bounded number of terms; each block reads the index once, keeps the terms it
knows, and tells the tasks its terms and weights.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.llm.common import ascii_lower, query, shuffle_partitions, store, table
from tapeworks.llm.decontamination import words

BEST = 10
#: Terms of a block of items, documents of a bucket, and about how many of the longest set the first thresholds.
TERMS, BUCKET, SEEDS = 1_000_000, 4096, 8192
SAFE = 1 + 1e-9
# All ASCII but digits and letters separates terms; A-Z are lower-cased.
TO_TERMS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()
VECTOR = "key bigint, id bigint, n bigint, terms array<int>, tf array<int>"


def index(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """All documents with a term: key (one per row), id, n (terms with repeats), terms and tf."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids, lengths, sizes, terms, tf = [], [], [], [], []
                for i in range(part.num_rows):
                    raw = (part.column(1)[i].as_py() or "").encode("utf-8", "surrogatepass").translate(TO_TERMS)
                    found = Counter(raw.split())
                    if found:
                        ids.append(part.column(0)[i].as_py())
                        lengths.append(found.total())
                        sizes.append(len(found))
                        terms.extend(found)
                        tf.append(np.fromiter(found.values(), np.int32, len(found)))
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(terms, pa.binary())),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*tf, np.zeros(0, np.int32)]))),
                ], ["id", "n", "terms", "tf"])

    given = docs.select(F.col(ident).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    found = given.mapInArrow(rows, "id bigint, n bigint, terms array<binary>, tf array<int>")
    return store(found.withColumn("key", F.monotonically_increasing_id()), "terms", "zstd")


def items_of(items: DataFrame, ident: str = "item_id", text: str = "text") -> DataFrame:
    """Items with their different terms: item (one per id), id, terms.  Rows of one id are one item."""
    lowered = F.array_distinct(F.transform(words(F.col(text)), ascii_lower))
    rows = items.select(F.col(ident).alias("id"), F.explode(lowered).alias("term")).distinct()
    return store(rows.groupBy("id").agg(F.collect_list("term").alias("terms")).withColumn("item", F.monotonically_increasing_id()), "sought")


def known_terms(indexed: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Documents with a term of the vocabulary; terms are their places in it."""
    shared = indexed.sparkSession.sparkContext.broadcast(vocabulary)

    def rows(batches):
        sought = pa.array(shared.value, pa.binary())
        for b in batches:
            lists = b.column("terms")
            found = pc.index_in(lists.flatten(), sought)
            hit = found.is_valid().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).to_numpy())[hit]
            sizes = np.bincount(of, minlength=b.num_rows)
            some = np.flatnonzero(sizes)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes[some])]).astype(np.int32))
            tf = b.column("tf").flatten().to_numpy()[hit]
            take = pa.array(some)
            yield pa.RecordBatch.from_arrays([
                b.column("key").take(take), b.column("id").take(take), b.column("n").take(take),
                pa.ListArray.from_arrays(offsets, found.drop_null().cast(pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(tf)),
            ], ["key", "id", "n", "terms", "tf"])

    vectors = store(indexed.select("key", "id", "n", "terms", "tf").mapInArrow(rows, VECTOR), "vectors", "zstd")
    shared.destroy()
    return vectors


def _impacts(n, tf, terms, of, weights, total: int, size: int) -> np.ndarray:
    """Weight times share of each term in a score; every quotient rounds down."""
    m = 100 - 90 + (90 * n * total) // size
    share = (1_000_000_000 * tf) // (1000 * tf + 8 * m[of])
    return weights[terms] * share


def by_length(vectors: DataFrame, weights: list[int], total: int, size: int) -> DataFrame:
    """The vectors with their ``length``, stored in ranges of it from long to short."""
    shared = vectors.sparkSession.sparkContext.broadcast(weights)

    def rows(batches):
        w = np.array(shared.value, np.int64)
        for b in batches:
            of = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("terms")).to_numpy())
            tf, terms = b.column("tf").flatten().to_numpy().astype(np.int64), b.column("terms").flatten().to_numpy()
            x = _impacts(b.column("n").to_numpy(), tf, terms, of, w, total, size).astype(float)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.sqrt(np.bincount(of, x * x, b.num_rows)))], [*b.schema.names, "length"])

    measured = vectors.mapInArrow(rows, VECTOR + ", length double")
    ordered = measured.repartitionByRange(shuffle_partitions(vectors.sparkSession), F.col("length").desc(), "key")
    ordered = store(ordered.sortWithinPartitions(F.col("length").desc(), "key"), "ordered", "zstd")
    shared.destroy()
    return ordered


class Bucket:
    """Some vectors, by coordinate: the documents of a term and their impacts lie together."""

    def __init__(self, batch: pa.RecordBatch, weights: np.ndarray, total: int, size: int):
        count = pc.list_value_length(batch.column("terms")).to_numpy()
        of = np.repeat(np.arange(batch.num_rows), count)
        terms, tf = batch.column("terms").flatten().to_numpy(), batch.column("tf").flatten().to_numpy().astype(np.int64)
        x = _impacts(batch.column("n").to_numpy(), tf, terms, of, weights, total, size)
        order = np.argsort(terms, kind="stable")
        self.of, self.x = of[order], x[order]
        self.terms, self.starts = np.unique(terms[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(terms))
        self.most = np.maximum.reduceat(self.x, self.starts) if len(terms) else np.zeros(0, np.int64)
        self.length = batch.column("length").to_numpy()
        self.keys = batch.column("key").to_numpy()
        ids = batch.column("id")
        self.no_id = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = pc.fill_null(ids, 0).to_numpy()

    def better(self, terms: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents whose score for ``terms`` is at least ``least`` (over 0), and their scores."""
        at = np.searchsorted(self.terms, terms)
        at = at[(at < len(self.terms)) & (np.take(self.terms, at, mode="clip") == terms)] if len(self.terms) else at[:0]
        at = at[np.argsort(-self.most[at], kind="stable")]
        left = np.append(np.cumsum(self.most[at][::-1])[::-1], 0)  # what the terms from here on can add
        score = np.zeros(len(self.length), np.int64)
        opening = int(np.searchsorted(-left, -least, side="right"))  # terms that can open a document
        for j in at[:opening]:
            score[self.of[self.starts[j] : self.ends[j]]] += self.x[self.starts[j] : self.ends[j]]
        if opening >= len(at):
            found = np.flatnonzero(score >= max(least, 1))
            return found, score[found]
        # Coordinates and the length that is left bound what the rest can add.
        met = np.flatnonzero(score)
        rest = np.sqrt(np.maximum(self.length[met] ** 2 * SAFE - score[met].astype(float) ** 2 / max(opening, 1), 0) * (len(at) - opening)) * SAFE
        met = met[score[met] + np.minimum(left[opening], rest + 1) >= least]
        if not len(met):
            return met, score[met]
        place = np.full(len(score), -1)
        place[met] = np.arange(len(met))
        exact = score[met]
        for j in at[opening:]:
            where = place[self.of[self.starts[j] : self.ends[j]]]
            hit = where >= 0
            exact[where[hit]] += self.x[self.starts[j] : self.ends[j]][hit]
        good = exact >= max(least, 1)
        return met[good], exact[good]


def search(ordered: DataFrame, sought: list[tuple[int, list[int]]], weights: list[int], floors: dict[int, int], total: int, size: int, best: int = BEST) -> DataFrame:
    """Of each task, the ``best`` documents of every item that may be among the best of all: item, key, id, score.

    ``floors`` are scores known to be reached by ``best`` documents.
    """
    shared = ordered.sparkSession.sparkContext.broadcast((sought, weights, floors))

    def rows(batches):
        asked, w, least = shared.value
        w = np.array(w, np.int64)
        asked = [(item, np.array(sorted(terms), np.int32)) for item, terms in asked]
        least, top = dict(least), {}
        for b in batches:
            for at in range(0, b.num_rows, BUCKET):
                bucket = Bucket(b.slice(at, BUCKET), w, total, size)
                longest = bucket.length.max()
                for item, terms in asked:
                    floor = least.get(item, 1)
                    if np.sqrt(len(terms)) * longest * SAFE + 1 < floor:
                        continue
                    found, scores = bucket.better(terms, floor)
                    if not len(found):
                        continue
                    new = np.stack([scores, bucket.no_id[found], bucket.ids[found], bucket.keys[found]])
                    new = np.concatenate([top[item], new], axis=1) if item in top else new
                    new = new[:, np.lexsort((new[3], new[2], new[1], -new[0]))[:best]]
                    top[item] = new
                    if new.shape[1] == best:
                        least[item] = max(floor, int(new[0, -1]))
        for item, new in top.items():
            ids = pa.array(new[2], mask=new[1].astype(bool))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(new.shape[1], item)), pa.array(new[3]), ids, pa.array(new[0])], ["item", "key", "id", "score"])

    return ordered.mapInArrow(rows, "item bigint, key bigint, id bigint, score bigint")


def ranking(docs: DataFrame, items: DataFrame, ident: str = "doc_id", text: str = "text", item: str = "item_id", best: int = BEST, most_terms: int = TERMS) -> DataFrame:
    """The ``best`` documents of every item: item, rank, doc id and score.

    Only documents with a score above 0 are ranked; at equal scores the smaller id comes
    first, a missing one last.  Every row is a document of its own, also where an id or a
    whole row repeats; rows of ``items`` with one id are one item.  Null and empty texts
    have no terms: such documents do not count, such items have no rows.
    """
    spark = docs.sparkSession
    indexed, asked = index(docs, ident, text), items_of(items, item)
    total, size = indexed.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = -(-found // most_terms)
    parts = []
    for block in range(blocks if total else 0):
        mine = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).select("item", "terms").collect()
        vocabulary = sorted({t for r in mine for t in r.terms})
        place = {t: i for i, t in enumerate(vocabulary)}
        vectors = known_terms(indexed, [t.encode() for t in vocabulary])
        df = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        w = F.floor(1000 * F.log(F.lit(float(2 * total + 2)) / (2 * F.col("df") + 1)))
        weights = [0] * len(vocabulary)
        for r in df.select("term", w.alias("w")).collect():
            weights[r.term] = r.w
        ordered = by_length(vectors, weights, total, size)
        sought = [(r.item, [place[t] for t in r.terms]) for r in mine]
        cut = ordered.agg(F.percentile_approx("length", max(0.0, 1 - SEEDS / total), 100_000)).first()[0]
        seeds = search(ordered if cut is None else ordered.where(F.col("length") >= cut), sought, weights, {}, total, size, best)
        nth = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc()))
        floors = {r.item: r.score for r in seeds.withColumn("nth", nth).where(F.col("nth") == best).collect()}
        parts.append(store(search(ordered, sought, weights, floors, total, size, best), "hits"))
    if not parts:
        parts = [spark.createDataFrame([], "item bigint, key bigint, id bigint, score bigint")]
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "key")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    named = asked.select("item", F.col("id").alias("_of"))
    return ranked.join(named, "item").select(F.col("_of").alias(item), "rank", F.col("id").alias(ident), "score")


@query("op12_lexical_search", r"""
WITH split AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), docs AS (
  SELECT doc_id, row, w, len(w)::BIGINT AS n FROM split WHERE len(w) > 0
), stats AS (
  SELECT count(*)::BIGINT AS total, sum(n)::BIGINT AS size FROM docs
), tfs AS (
  SELECT doc_id, row, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, row, n, unnest(w) AS term FROM docs) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, stats GROUP BY term, total
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scored AS (
  SELECT item_id, doc_id, row, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * total) // size))))::BIGINT AS score
  FROM asked JOIN tfs USING (term) JOIN weights USING (term), stats GROUP BY item_id, doc_id, row
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
""")
def op12(spark: SparkSession, d: str) -> DataFrame:
    return ranking(table(spark, d, "documents"), table(spark, d, "benchmark"))
