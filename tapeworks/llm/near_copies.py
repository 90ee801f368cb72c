"""Near copies at a given Jaccard similarity of word shingles, through SimHash and BK-trees.

Texts with equal word sequences are one entry.  An entry has a SimHash fingerprint of
its shingles and the smallest shingle hashes under ``MINIMA`` permutations.  Each minimum
is a shard: entries of similarity s meet in at least one of them with probability
1 - (1 - s) ** MINIMA.  A shard's fingerprints form BK-trees, searched with a radius
that texts of similarity 0.8 seldom exceed, and the shard returns a spanning forest of
shortest links.  Every link is then verified: the shingle sets of both texts are
compared exactly.

That first round makes most groups at the cost of their entries: a shard is read in order
of fingerprint, a chunk at a time, what stays open of a chunk are the first entries of its
groups, and a shard above ``LARGE`` entries is cut by leading bits.  It tries some of the
pairs only, so a second round compares the fingerprints of all pairs of a shard that are
not yet in one group.  Of those within the radius it verifies each pair that can be similar
enough: shingles are counted by ranges of their hash, and two texts share no more of a
range than the lesser count, which bounds their similarity from above and loses none.
Large shards are cut there into parts of ``BLOCK`` entries of which every two meet.  So
whatever shares a minimum and lies within the radius is in one group or was compared; the
components of all verified links are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.llm.common import lean, store
from tapeworks.llm.components import components
from tapeworks.llm.simhash import LOWER, BKTree

WIDTH, SIMILARITY, RADIUS, MINIMA = 5, 0.8, 16, 6
CHUNK, LARGE, BLOCK = 1024, 1 << 17, 1 << 14
RANGES = 256
HASHES = 8192
#: Odd multipliers: a permutation of the 64-bit hashes each.
ODD = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) ^ 0xC2B2AE3D27D4EB4F << i) & (1 << 64) - 1 | 1 for i in range(1, MINIMA + 1)], np.uint64)


def shingle_hashes(text: str | None, width: int = WIDTH) -> tuple[bytes, Iterator[np.ndarray]]:
    """The words of a text in lower case joined by blanks, and the hashes of its shingles in parts."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    line = b" ".join(words)

    def parts() -> Iterator[np.ndarray]:
        if not words:
            return
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        stops = np.cumsum(lengths + 1) - 1
        starts, last = stops - lengths, max(1, len(words) - width + 1)
        view, digest = memoryview(line), xxhash.xxh64_intdigest
        for i in range(0, last, HASHES):
            n = min(last - i, HASHES)
            pairs = zip(starts[i : i + n].tolist(), stops[len(words) - last + i :][:n].tolist())
            yield np.fromiter((digest(view[a:b], 42) for a, b in pairs), np.uint64, n)

    return line, parts()


def range_counts(hashes: np.ndarray) -> bytes:
    """How many different hashes lie in each of ``RANGES`` ranges, in as few bytes as the largest count needs."""
    counts = np.bincount((np.unique(hashes) >> np.uint64(56)).astype(np.int64), minlength=RANGES)
    return counts.astype(np.min_scalar_type(counts.max())).tobytes()


def counted(ranges: pa.Array) -> np.ndarray:
    """A row of counts per entry, of what :func:`range_counts` made."""
    return np.array([np.frombuffer(r, f"u{len(r) // RANGES}") for r in ranges.to_pylist()], np.uint32).reshape(-1, RANGES)


def sketch(text: str | None, width: int = WIDTH) -> tuple[bytes, int, np.ndarray, bytes]:
    """Digest of the words, SimHash of the shingles, their minima, and their number by ranges of the hash."""
    line, parts = shingle_hashes(text, width)
    every = [np.empty(0, np.uint64)]
    ones, n, least = np.zeros(64, np.int64), 0, np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for h in parts:
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)
        every.append(h)
        mixed = h ^ (h >> np.uint64(31))
        least = np.minimum(least, [(mixed * odd).min() for odd in ODD])
    return xxhash.xxh3_128_digest(line), int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big"), least, range_counts(np.concatenate(every))


def sketches(docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``id``, ``key`` (a hash of id and text), ``words`` (a digest), ``fp``, ``minima`` and ``ranges`` of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [sketch(x.as_py(), width) for x in b.column(2)]
            fps = np.fromiter((m[1] for m in made), np.uint64, len(made)).view(np.int64)
            minima = pa.array([m[2].view(np.int64) for m in made], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([m[0] for m in made], pa.binary()), pa.array(fps), minima, pa.array([m[3] for m in made], pa.binary())], ["id", "key", "words", "fp", "minima", "ranges"])

    key = F.xxhash64(F.col(ident), F.xxhash64(text))
    given = docs.select(F.col(ident).cast("long").alias("id"), key.alias("key"), F.col(text).cast("string").alias("text"))
    return given.mapInArrow(lean(rows), "id long, key long, words binary, fp long, minima array<long>, ranges binary")


def forest(points: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shortest links (i, j) that join what the radius connects, and the first point of each point's group."""
    group = np.arange(len(points))
    pairs = list(BKTree(points).within(radius))
    if not pairs:
        return group[:0], group[:0], group
    i, j = (np.concatenate(x) for x in zip(*pairs))
    order = np.lexsort((j, i, np.bitwise_count(points[i] ^ points[j])))
    i, j, taken = i[order], j[order], []
    while True:
        a, b = group[i], group[j]
        open_ = np.flatnonzero(a != b)
        if not len(open_):
            return i[taken], j[taken], group
        best = np.full(len(points), len(i))
        np.minimum.at(best, a[open_], open_)
        np.minimum.at(best, b[open_], open_)
        new = np.unique(best[best < len(i)])
        taken = np.concatenate([taken, new]).astype(np.int64)
        while True:  # the groups that the new links join take their smallest member
            low = np.minimum(group[i[new]], group[j[new]])
            before = group.copy()
            for side in (a[new], b[new]):
                np.minimum.at(group, side, low)
            group = group[group]
            if np.array_equal(before, group):
                break


def _linked(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of a shard in order of fingerprint, by place, and the first members of its groups."""
    left, right, roots = [], [], np.empty(0, np.int64)
    for at in range(0, len(points), CHUNK):
        place = np.concatenate([roots, np.arange(at, min(at + CHUNK, len(points)))])
        i, j, group = forest(points[place], radius)
        left.append(place[i])
        right.append(place[j])
        roots = place[np.unique(group)][-CHUNK:]
    return np.concatenate(left), np.concatenate(right), roots


def _shards(radius: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            points = part.column("fp").to_numpy().view(np.uint64)
            i, j, roots = _linked(points, radius)
            words, shard = part.column("words"), part.column("shard")
            if part.column("cut")[0].as_py():  # a part of a large shard: its first members go on
                i, j = np.concatenate([i, roots]), np.concatenate([j, roots])
            yield pa.RecordBatch.from_arrays(
                [words.take(pa.array(i)), words.take(pa.array(j)), shard.take(pa.array(i)), part.column("fp").take(pa.array(i))], ["a", "b", "shard", "fp"]
            )

        for part in _runs(batches, ["shard", "cut"]):
            if part.num_rows > 1 or part.column("cut")[0].as_py():
                yield from links(part)

    return work


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of each run of equal ``keys`` in sorted rows."""
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        both = pa.Table.from_batches([b] if rest is None else [*rest, b])
        values = np.stack([both.column(k).to_numpy() for k in keys])
        cuts = np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1
        for lo, hi in zip(np.append(0, cuts[:-1]).tolist() if len(cuts) else [], cuts.tolist()):
            yield both.slice(lo, hi - lo).combine_chunks().to_batches()[0]
        rest = both.slice(int(cuts[-1]) if len(cuts) else 0).to_batches()
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]


def shared_minima(entries: DataFrame) -> DataFrame:
    """``shard``, ``fp`` and ``words`` of ``entries`` (words, fp, minima) for each minimum that another one shares."""
    shard = F.transform("minima", lambda m, n: F.xxhash64(n, m))
    rows = entries.select("words", "fp", F.explode(F.array_distinct(shard)).alias("shard"))
    several = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return store(rows.join(several, "shard", "left_semi").select("shard", "fp", "words"), "shards")


def candidate_links(shards: DataFrame, radius: int = RADIUS, large: int = LARGE) -> DataFrame:
    """Links (a, b) to verify first: forests of the entries of ``shards`` (shard, fp, words) that lie within the radius.

    They need not join all that does; :func:`other_links` has the rest.
    """
    rows = shards
    found = None
    while True:
        sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        # A cut has at most about ``large`` entries; 0 is a whole shard.
        bits = F.when(F.col("n") > large, F.ceil(F.log2(F.col("n") / large)).cast("int")).otherwise(F.lit(0))
        placed = rows.join(sizes.select("shard", bits.alias("bits")), "shard")
        cut = F.when(F.col("bits") > 0, F.expr("shiftright(fp, 64 - bits) + shiftleft(1L, bits)")).otherwise(F.lit(0).cast("long"))
        placed = placed.select("shard", cut.alias("cut"), "fp", "words")
        work = lean(_shards(radius))
        linked = placed.repartition("shard", "cut").sortWithinPartitions("shard", "cut", "fp", "words").mapInArrow(work, "a binary, b binary, shard long, fp long")
        linked = store(linked, "candidates")
        own = linked.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        found = own if found is None else found.unionByName(own)
        first = linked.where("a = b").select("shard", F.col("a").alias("words"), "fp")
        if first.isEmpty():
            return found.distinct()
        rows = store(first, "firsts")


def _possible(counts: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float, size: int = 1 << 12) -> np.ndarray:
    """Which pairs of entries can reach the similarity, as far as their counts tell."""
    total = counts.sum(axis=1, dtype=np.int64)
    able = np.empty(len(i), bool)
    for at in range(0, len(i), size):
        a, b = i[at : at + size], j[at : at + size]
        both = np.minimum(counts[a], counts[b]).sum(axis=1, dtype=np.int64)
        able[at : at + size] = both / np.maximum(1, total[a] + total[b] - both) >= similarity
    return able


def _other_pairs(radius: int, similarity: float, size: int = 1 << 20):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches, ["shard", "low", "high"]):
            group, words = part.column("root").dictionary_encode().indices.to_numpy(), part.column("words")
            points, own = part.column("fp").to_numpy().view(np.uint64), part.column("part").to_numpy()
            counts = counted(part.column("ranges"))
            low, high = (part.column(k)[0].as_py() for k in ("low", "high"))
            left = np.flatnonzero(own == low)
            right = left if low == high else np.flatnonzero(own == high)
            step = max(1, size // max(1, len(right)))
            for at in range(0, len(left), step):
                some = left[at : at + step]
                near = np.bitwise_count(points[some][:, None] ^ points[right][None, :]) <= radius
                near &= group[some][:, None] != group[right][None, :]
                i, j = np.nonzero(near)
                i, j = some[i], right[j]
                if low == high:
                    i, j = i[i < j], j[i < j]
                able = _possible(counts, i, j, similarity)
                i, j = i[able], j[able]
                if len(i):
                    yield pa.RecordBatch.from_arrays([words.take(pa.array(i)), words.take(pa.array(j))], ["a", "b"])

    return work


def other_links(
    shards: DataFrame, roots: DataFrame, ranges: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, block: int = BLOCK
) -> DataFrame:
    """All links (a, b) of entries that share a shard, lie within the radius, have different ``roots`` (node, root) and can be similar.

    ``ranges`` (words, ranges) are the counts that tell whether they can.

    Every pair of a shard is compared: a shard above ``block`` entries is cut into parts, and
    any two of them, and each with itself, are a task's work of bounded size.
    """
    known = shards.join(roots, shards.words == roots.node, "left")
    rows = store(known.select("shard", "fp", "words", F.coalesce("root", "words").alias("root")), "rooted")
    sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    parts = F.ceil(F.col("n") / F.lit(block)).cast("long")
    placed = rows.join(sizes.select("shard", parts.alias("parts")), "shard").join(ranges, "words").withColumn("part", F.pmod(F.xxhash64("words"), F.col("parts")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cells = placed.select("shard", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "fp", "words", "root", "ranges")
    keys = ["shard", "low", "high"]
    found = cells.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(_other_pairs(radius, similarity)), "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def jaccard(a: str | None, b: str | None, width: int = WIDTH) -> float:
    """Similarity of the sets of shingles of two texts."""
    x, y = (np.unique(np.concatenate([*shingle_hashes(t, width)[1], np.empty(0, np.uint64)])) for t in (a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def verified(links: DataFrame, texts: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The ``links`` (a, b) whose ``texts`` (words, text) are similar enough."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [jaccard(x.as_py(), y.as_py(), width) >= similarity for x, y in zip(b.column(2), b.column(3))]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left, right = (texts.select(F.col("words").alias(k), F.col("text").alias(f"t{k}")) for k in "ab")
    both = links.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(lean(rows), "a binary, b binary")


def similar_groups(
    docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, radius: int = RADIUS, large: int = LARGE, block: int = BLOCK
) -> DataFrame:
    """``id``, ``key`` and ``root`` (a digest that the rows of a group share) of every row.

    Rows with equal words, in lower case, are in one group; null, empty and wordless texts
    are one as well.  Texts shorter than a shingle are one shingle.
    """
    rows = store(sketches(docs, ident, text, width), "sketches")
    entries = store(rows.groupBy("words").agg(F.min("key").alias("key"), F.any_value("fp").alias("fp"), F.any_value("minima").alias("minima"), F.any_value("ranges").alias("ranges")), "entries")
    shards = shared_minima(entries)
    texts = docs.select(F.xxhash64(F.col(ident), F.xxhash64(text)).alias("key"), F.col(text).cast("string").alias("text"))

    def checked(links: DataFrame, name: str) -> DataFrame:
        nodes = links.select(F.explode(F.array("a", "b")).alias("words")).distinct().join(entries.select("words", "key"), "words")
        needed = texts.join(nodes, "key").groupBy("words").agg(F.any_value("text").alias("text"))
        return store(verified(links, store(needed, "texts"), width, similarity), name)

    links = store(candidate_links(shards, radius, large), "links")
    sure = checked(links, "verified")
    roots = components(sure)
    others = store(other_links(shards, roots, entries.select("words", "ranges"), similarity, radius, block).join(links, ["a", "b"], "left_anti"), "others")
    if not others.isEmpty():
        more = checked(others, "verified")
        roots = components(sure.unionByName(more))
    return rows.join(roots, rows.words == roots.node, "left").select("id", "key", F.coalesce("root", "words").alias("root"))


def keep_one(spark, docs: DataFrame, d: str) -> DataFrame:
    """Pipeline stage: of each group of near copies the document with the smallest id, with its columns.

    Of several rows with that id the one with the smallest hash stays, and of equal ones one.
    """
    found = store(similar_groups(docs), "groups")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).getField("key")
    names = {c.lower() for c in docs.columns}
    own, copy = (next(n for n in (f"{stem}{i}" for i in range(len(names) + 1)) if n not in names) for stem in ("_key", "_copy"))
    kept = store(found.groupBy("root").agg(first.alias(own)).select(own).distinct(), "kept")
    key = F.xxhash64(F.col("doc_id"), F.xxhash64(F.col("text")))
    stay = docs.withColumn(own, key).join(kept, own, "left_semi")
    if found.groupBy("key").count().where("count > 1").take(1):
        each = Window.partitionBy(own).orderBy(F.lit(0))
        stay = stay.withColumn(copy, F.row_number().over(each)).where(F.col(copy) == 1).drop(copy)
    return stay.drop(own)
