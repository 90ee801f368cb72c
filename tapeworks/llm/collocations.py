"""Phrase collocations from suffix subtrees of word prefixes.

Every word of a piece starts a suffix, cut to the longest phrase.  A suffix ends
early where a phrase can no longer be frequent: at a rare word, or at a rare pair.
The prefixes of the suffixes are counted first.  A prefix with more suffixes than a
group may hold is replaced by its extensions, one word longer, until it is small
enough or has full length.  Prefixes are then dealt to groups of about ``BUDGET``
suffixes, and each group sorts its suffixes on its own: read in order they are its
subtree, depth first, and the count of a phrase is the total of the leaves below
its node.

Texts are encoded in blocks; a join with the frequent words turns their words into
numbers, and other words into breaks.  A block sends each distinct suffix once, with
its number, in one row for all suffixes of a group.  Which pairs are rare is told to the
tasks by a bit map of a fixed size, made from counters that several pairs may share: a
rare one may pass by chance, a frequent one always passes, and all counts are exact.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import wraps
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.common import lean, query, store, table
from tapeworks.llm.lm import planes, unplanes
from tapeworks.plans.series import number_rows, top_k

LEAST, LONGEST, BEST = 100, 5, 2000
BLOCK = 8 << 20
#: Bytes of an Arrow batch, but for one row that may exceed them: a block is a row, and a task holds a batch three times (vectors, what is sent, Python).
BATCH, BATCH_BYTES = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Suffixes of a group, and how many heavy prefixes of one length the driver may hold at most.
BUDGET, HEAVY = 500_000, 1_000_000
#: Counters of pairs (a bit each in the map that tasks get: 16 MB), and the ranges they are counted in.
BITS, RANGES, PER_RANGE = 27, 64, 50_000_000
# The break characters end a piece, tabs are blanks, A-Z are lower-cased.
CODES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n\n")
MIX = np.uint64(0x9E3779B97F4A7C15)


def encode(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of the texts of one language (block, lang, words, tokens): 0 in tokens ends a piece, i is the i-th of words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, tuple[dict, list]] = {}
        sizes: dict[str, int] = defaultdict(int)
        number = count(TaskContext.get().partitionId() << 32)

        def done(lang: str) -> pa.RecordBatch:
            known, parts = open_.pop(lang)
            del sizes[lang]
            words = pa.array(list(known)[2:], pa.binary())
            tokens = np.concatenate(parts)
            tokens = np.maximum(tokens[tokens > 0] - 1, 0).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array([next(number)]), pa.array([lang]), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.array([planes(tokens)])],
                ["block", "lang", "words", "tokens"],
            )

        for b in batches:
            for i in range(b.num_rows):
                text = b.column(0)[i].as_py()
                if not text:
                    continue
                lang = b.column(1)[i].as_py()
                if lang not in open_:
                    known: dict = defaultdict(count(2).__next__)
                    known[b""], known[b"\n"] = 0, 1
                    open_[lang] = known, []
                known, parts = open_[lang]
                raw = text.encode("utf-8", "surrogatepass").translate(CODES)
                cut = (raw + b"\n").replace(b"\n", b" \n ").split(b" ")
                parts.append(np.fromiter(map(known.__getitem__, cut), np.int32, len(cut)))
                sizes[lang] += len(raw)
                if sum(sizes.values()) >= block:
                    yield done(max(sizes, key=sizes.get))
        for lang in list(open_):
            yield done(lang)

    return docs.mapInArrow(lean(rows), "block bigint, lang string, words array<binary>, tokens binary")


def block_words(blocks: DataFrame) -> DataFrame:
    """The words of each block with their place in it and their number of occurrences: block, lang, word, place, f."""

    def rows(batches):
        for b in batches:
            for i in range(b.num_rows):
                words = b.column("words")[i].values
                f = np.bincount(unplanes(b.column("tokens")[i].as_py(), "int32"), minlength=len(words) + 1)[1:]
                n = len(words)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, b.column("block")[i].as_py())), pa.array([b.column("lang")[i].as_py()] * n, pa.string()),
                    words.cast(pa.string()), pa.array(np.arange(1, n + 1, dtype=np.int32)), pa.array(f.astype(np.int64)),
                ], ["block", "lang", "word", "place", "f"])

    return blocks.mapInArrow(lean(rows), "block bigint, lang string, word string, place int, f bigint")


def numbered_tokens(blocks: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Blocks with the numbers of the ``dictionary`` (lang, word, number) for words; 0 is a break or any other word."""
    known = block_words(blocks).join(dictionary.select("lang", "word", "number"), ["lang", "word"], "left")
    named = known.groupBy("block").agg(F.collect_list(F.when(F.col("number").isNotNull(), F.struct("place", "number"))).alias("names"))

    def rows(batches):
        for b in batches:
            for i in range(b.num_rows):
                names, tokens = b.column("names")[i].values, unplanes(b.column("tokens")[i].as_py(), "int32")
                number = np.zeros(int(tokens.max(initial=0)) + 1, np.int32)
                number[names.field("place").to_numpy()] = names.field("number").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([planes(number[tokens])])], ["tokens"])

    return blocks.select("block", "tokens").join(named, "block").mapInArrow(lean(rows), "tokens binary")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for b in batches:
        for i in range(b.num_rows):
            yield unplanes(b.column("tokens")[i].as_py(), "int32")


def _slots(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The counter of each pair of numbers."""
    pair = (first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
    mixed = (pair ^ (pair >> np.uint64(29))) * MIX
    return ((mixed ^ (mixed >> np.uint64(32))) * MIX >> np.uint64(64 - BITS)).astype(np.int64)


def _among(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0


def pair_counters(coded: DataFrame, ranges: int, least: int, most: int) -> DataFrame:
    """Counters of pairs in ranges: range, bits (which reach ``least``) and heavy (which exceed ``most``)."""
    wide = (1 << BITS) // ranges

    def parts(batches):
        for tokens in _tokens(batches):
            at = np.flatnonzero((tokens[:-1] > 0) & (tokens[1:] > 0))
            slots, f = np.unique(_slots(tokens[at], tokens[at + 1]), return_counts=True)
            cuts = np.searchsorted(slots, np.arange(ranges + 1) * wide)
            some = np.flatnonzero(np.diff(cuts))
            blobs = [planes(np.concatenate([np.diff(slots[cuts[r] : cuts[r + 1]], prepend=r * wide), f[cuts[r] : cuts[r + 1]]]).astype(np.int32)) for r in some]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(blobs, pa.binary())], ["range", "part"])

    def sums(batches):
        now, counters = None, np.zeros(wide, np.int64)

        def done():
            bits = np.packbits(counters >= least, bitorder="little").tobytes()
            heavy = (np.flatnonzero(counters > most) + now * wide).tolist()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([bits]), pa.array([heavy], pa.list_(pa.int64()))], ["range", "bits", "heavy"])

        for b in batches:
            for i in range(b.num_rows):
                r = b.column("range")[i].as_py()
                if r != now:
                    if now is not None:
                        yield done()
                    now = r
                    counters[:] = 0
                steps, f = np.split(unplanes(b.column("part")[i].as_py(), "int32"), 2)
                counters[np.cumsum(steps)] += f
        if now is not None:
            yield done()

    dealt = coded.mapInArrow(lean(parts), "range int, part binary").repartition(ranges, "range").sortWithinPartitions("range")
    return dealt.mapInArrow(lean(sums), "range int, bits binary, heavy array<bigint>")


def _under(cols: np.ndarray, phrases: np.ndarray) -> np.ndarray:
    """Which rows begin with one of ``phrases``, rows of numbers of one length."""
    if not len(phrases):
        return np.zeros(len(cols), bool)
    every = np.concatenate([phrases, cols[:, : phrases.shape[1]]])
    keys = np.unique(every, axis=0, return_inverse=True)[1].ravel()
    return np.isin(keys[len(phrases) :], keys[: len(phrases)])


def _suffixes(tokens: np.ndarray, frequent: np.ndarray, heavy: dict, only: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct suffixes of a block in order: their numbers (0 behind the end), how often, and the length of their prefix."""
    at = np.flatnonzero((tokens[:-1] > 0) & (tokens[1:] > 0))
    slots = _slots(tokens[at], tokens[at + 1])
    keep = _among(frequent, slots)
    at, slots = at[keep], slots[keep]
    joined = np.zeros(len(tokens) + LONGEST, bool)
    joined[at] = True
    padded = np.concatenate([tokens, np.zeros(LONGEST, np.int32)])
    cols = np.zeros((len(at), LONGEST), np.int32)
    alive = np.ones(len(at), bool)
    cols[:, 0] = padded[at]
    for k in range(1, LONGEST):
        alive &= joined[at + k - 1]
        cols[:, k] = np.where(alive, padded[at + k], 0)
    depth = np.where(np.isin(slots, heavy.get(2, ())), 3, 2)
    if only == 2:
        keep, cols[:, 2:] = depth == 3, 0
        depth[:] = 2
    else:
        for d in range(3, LONGEST):
            open_ = np.flatnonzero(depth == d)
            depth[open_[_under(cols[open_], heavy.get(d, ()))]] = d + 1
        keep = cols[np.arange(len(at)), depth - 1] > 0
        if only:
            keep &= depth == only
            cols[:, only:] = 0
    cols, depth = cols[keep], depth[keep]
    order = np.lexsort(cols.T[::-1])
    cols, depth = cols[order], depth[order]
    starts = np.flatnonzero(np.append(True, (cols[1:] != cols[:-1]).any(axis=1))) if len(cols) else np.zeros(0, int)
    return cols[starts], np.diff(np.append(starts, len(cols))).astype(np.int32), depth[starts].astype(np.int32)


def prefix_counts(coded: DataFrame, frequent: Callable[[], np.ndarray], heavy: Callable[[], dict], length: int) -> DataFrame:
    """Prefixes of ``length`` words under heavy ones: head (their numbers, big-endian) and f."""

    def rows(batches):
        for tokens in _tokens(batches):
            cols, f, _ = _suffixes(tokens, frequent(), heavy(), length)
            heads = cols[:, :length].astype(">i4")
            yield pa.RecordBatch.from_arrays([pa.array([h.tobytes() for h in heads], pa.binary()), pa.array(f.astype(np.int64))], ["head", "f"])

    return coded.mapInArrow(lean(rows), "head binary, f bigint").groupBy("head").agg(F.sum("f").alias("f"))


def suffixes(coded: DataFrame, frequent: Callable[[], np.ndarray], heavy: Callable[[], dict], groups: int) -> DataFrame:
    """Suffixes of each block, dealt by prefix: group and part (numbers, how often and length of the prefix, by column).

    ``heavy()`` maps a length to the prefixes that are extended; those of two words are named by
    their counters.  What is no longer than a heavy prefix is left out, for that prefix is
    counted already.
    """

    def rows(batches):
        for tokens in _tokens(batches):
            cols, f, depth = _suffixes(tokens, frequent(), heavy(), None)
            mixed = np.zeros(len(cols), np.uint64)
            for k in range(LONGEST):
                own = np.where(k < depth, cols[:, k], 0).astype(np.uint64)
                mixed = (mixed ^ own) * MIX
                mixed ^= mixed >> np.uint64(29)
            group = (mixed % np.uint64(groups)).astype(np.int32)
            order = np.argsort(group, kind="stable")
            table = np.column_stack([cols, f, depth])[order]
            cuts = np.searchsorted(group[order], np.arange(groups + 1))
            some = np.flatnonzero(np.diff(cuts))
            parts = [planes(np.ascontiguousarray(table[cuts[g] : cuts[g + 1]].T).ravel()) for g in some]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(parts, pa.binary())], ["group", "part"])

    return coded.mapInArrow(lean(rows), "group int, part binary")


def _numbers(head: bytes) -> np.ndarray:
    return np.frombuffer(head, ">i4").astype(np.int32)


def subtrees(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """Phrases (numbers, f) below the prefixes of ``rows`` with at least ``least`` occurrences.

    A group is sorted as a whole, and every node's count is summed over its stretch of leaves.
    A task takes its groups one after another: their number grows with the input, that of tasks is the shuffle's.
    """

    def counted(cols, f, depth):
        order = np.lexsort(cols.T[::-1])
        cols, f, depth = cols[order], f[order], depth[order]
        for k in range(2, LONGEST + 1):
            at = np.flatnonzero((cols[:, k - 1] > 0) & (depth <= k))
            if not len(at):
                continue
            # Within the rows that are long enough a node starts where the path to it changes.
            starts = np.flatnonzero(np.append(True, (cols[at[1:], :k] != cols[at[:-1], :k]).any(axis=1)))
            totals = np.add.reduceat(f[at], starts)
            good = totals >= least
            found = cols[at[starts[good]], :k]
            if len(found):
                offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * k)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(found.ravel())), pa.array(totals[good])], ["numbers", "f"])

    def walk(batches):
        parts, now = [], None

        def done():
            table = np.concatenate(parts, axis=1)
            return counted(np.ascontiguousarray(table[:LONGEST].T), table[LONGEST].astype(np.int64), table[LONGEST + 1])

        for b in batches:
            for i in range(b.num_rows):
                group = b.column("group")[i].as_py()
                if parts and group != now:
                    yield from done()
                    parts = []
                now = group
                parts.append(unplanes(b.column("part")[i].as_py(), "int32").reshape(LONGEST + 2, -1))
        if parts:
            yield from done()

    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(lean(walk), "numbers array<int>, f bigint")


def _shared(spark: SparkSession, value):
    return spark.sparkContext.broadcast(value)


def in_small_batches(work: Callable):
    """``work`` on a table while Python gets batches of ``BATCH`` bytes; the session's own setting holds again afterwards."""

    @wraps(work)
    def run(docs: DataFrame, *args, **kw):
        conf = docs.sparkSession.conf
        own = conf.get(BATCH_BYTES, None)
        conf.set(BATCH_BYTES, str(BATCH))
        try:
            return work(docs, *args, **kw)
        finally:
            if own is None:
                conf.unset(BATCH_BYTES)
            else:
                conf.set(BATCH_BYTES, own)

    return run


@in_small_batches
def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, budget: int = BUDGET, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Words of each language, and its frequent phrases of one to five words: (lang, n) and (lang, words, f)."""
    spark = docs.sparkSession
    given = docs.select(F.col(text).cast("string").alias("t"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("l"))
    blocks = store(encode(given, block), "blocks", "zstd")
    words = store(block_words(blocks).groupBy("lang", "word").agg(F.sum("f").alias("f")), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    often = number_rows(words.where(F.col("f") >= least), [], [F.col("lang"), F.col("word")], name="number", chunk=F.pmod(F.xxhash64("lang", "word"), F.lit(1024)))
    dictionary = store(often.withColumn("number", F.col("number").cast("int")), "dictionary")
    coded = store(numbered_tokens(blocks, dictionary), "coded", "zstd")
    every = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = max(budget, every // HEAVY)
    ranges = RANGES
    while ranges < min(4096, every // PER_RANGE):
        ranges *= 2
    bits, heavy = np.zeros(1 << BITS - 3, np.uint8), {}
    wide = len(bits) // ranges
    crowded = []
    for r in pair_counters(coded, ranges, least, most).collect():  # one bit a counter, and at most HEAVY of them by number
        bits[r.range * wide : (r.range + 1) * wide] = np.frombuffer(r.bits, np.uint8)
        crowded += r.heavy
    told = [_shared(spark, bits)]
    frequent = told[0]

    def known() -> Callable[[], dict]:
        told.append(_shared(spark, dict(heavy)))
        sent = told[-1]
        return lambda: sent.value

    counted = []
    if crowded:
        heavy[2] = np.array(sorted(crowded))
        pairs = prefix_counts(coded, lambda: frequent.value, known(), 2)
        counted.append(store(pairs.where(F.col("f") >= least), "prefixes"))
        for depth in range(3, LONGEST):
            longer = store(prefix_counts(coded, lambda: frequent.value, known(), depth).where(F.col("f") > most), "prefixes")
            found = longer.collect()  # at most HEAVY, as all together are at most HEAVY times ``most``
            if not found:
                break
            counted.append(longer)
            heavy[depth] = np.array([_numbers(bytes(r.head)) for r in found])
    groups = max(1, -(-every // most))
    nodes = subtrees(suffixes(coded, lambda: frequent.value, known(), groups), least)
    numbers = F.expr("transform(sequence(1, octet_length(head) - 3, 4), i -> cast(conv(hex(substring(head, i, 4)), 16, 10) AS int))")
    for c in counted:
        nodes = nodes.unionByName(c.select(numbers.alias("numbers"), "f"))
    named = nodes.select(F.monotonically_increasing_id().alias("id"), "numbers", "f")
    named = store(named, "phrases")
    for b in told:
        b.destroy()
    spelled = named.select("id", "f", F.posexplode("numbers").alias("at", "number")).join(dictionary.select("number", "lang", "word"), "number")
    spelled = spelled.groupBy("id").agg(
        F.first("lang").alias("lang"), F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("words"), F.first("f").alias("f")
    )
    single = dictionary.select("lang", F.array("word").alias("words"), "f")
    return totals, store(spelled.select("lang", "words", "f").unionByName(single), "phrases")


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, best: int = BEST, budget: int = BUDGET, block: int = BLOCK) -> DataFrame:
    """The ``best`` phrases of two to five words per language: lang, rank, phrase, a, l, r, n, score.

    ``a`` is the number of occurrences of a phrase within pieces.  It is cut in two
    where ``floor(1000 a n / (l r))`` is least, ``l`` and ``r`` being those of the parts and
    ``n`` all words of the language; at equal scores the first cut counts.  A phrase all
    of whose occurrences lie in one longer candidate is left out.  A null text has no
    words, a null language is ``und``; repeated rows count as often as they come.
    """
    totals, phrases = phrase_counts(docs, text, lang, least, budget, block)
    counts = phrases.select("lang", _joined(F.col("words")).alias("part"), F.col("f"))
    found = phrases.where(F.size("words") > 1)
    cuts = found.select("lang", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": _joined(F.slice("words", F.lit(1), F.col("k"))), "rest": _joined(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")))})
    cuts = cuts.join(counts.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(totals, "lang")
    wide = {c: F.col(c).cast("decimal(19,0)") for c in "alrn"}
    cuts = cuts.withColumns({"top": F.lit(1000).cast("decimal(4,0)") * wide["a"] * wide["n"], "low": wide["l"] * wide["r"]})
    cuts = cuts.withColumn("score", F.expr("top div low"))
    least_cut = F.min(F.struct("score", "k", "l", "r", "n", "a")).alias("c")
    scored = cuts.groupBy("lang", _joined(F.col("words")).alias("phrase")).agg(least_cut).select("lang", "phrase", "c.a", "c.l", "c.r", "c.n", "c.score")

    size, at = F.size("words"), F.explode(F.expr("filter(flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), i -> struct(i, m)))), s -> s.m < size(words))"))
    inner = found.where(size > 2).select("lang", "words", "f", at.alias("s"))
    inner = inner.select("lang", _joined(F.slice("words", F.col("s.i"), F.col("s.m"))).alias("phrase"), "f")
    around = inner.groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    kept = scored.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (F.col("around") < F.col("a"))).drop("around")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    ranked = top_k(kept, ["lang"], order, best, ["phrase"], "rank")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


@query("op13_collocations", r"""
WITH pieces AS (
  SELECT doc_id, row_number() OVER () AS piece, lang, text FROM (
    SELECT row_number() OVER () AS doc_id, coalesce(lang, 'und') AS lang,
      unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS text
    FROM documents)
), listed AS (
  SELECT piece, lang, regexp_extract_all(text, '[^\x20\x09]+') AS w FROM pieces
), placed AS (
  SELECT piece, lang, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM listed
), often AS (
  SELECT lang, word FROM placed GROUP BY ALL HAVING count(*) >= 100
), marked AS (
  SELECT piece, lang, i, o.word FROM placed p LEFT JOIN often o USING (lang, word)
), led AS (
  SELECT lang, word AS a, lead(word, 1) OVER q AS b, lead(word, 2) OVER q AS c, lead(word, 3) OVER q AS d, lead(word, 4) OVER q AS e
  FROM marked WINDOW q AS (PARTITION BY piece ORDER BY i)
), grams AS (
  SELECT lang, [a] AS words FROM led WHERE a IS NOT NULL
  UNION ALL SELECT lang, [a, b] FROM led WHERE a || b IS NOT NULL
  UNION ALL SELECT lang, [a, b, c] FROM led WHERE a || b || c IS NOT NULL
  UNION ALL SELECT lang, [a, b, c, d] FROM led WHERE a || b || c || d IS NOT NULL
  UNION ALL SELECT lang, [a, b, c, d, e] FROM led WHERE a || b || c || d || e IS NOT NULL
), counts AS (
  SELECT lang, words, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM listed GROUP BY lang
), cuts AS (
  SELECT c.lang, c.words, c.f AS a, k.k, l.f AS l, r.f AS r, t.n,
    ((1000::HUGEINT * c.f * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM counts c JOIN (SELECT unnest(range(1, 5)) AS k) k ON k.k < len(c.words)
  JOIN counts l ON l.lang = c.lang AND l.words = c.words[1 : k.k]
  JOIN counts r ON r.lang = c.lang AND r.words = c.words[k.k + 1 : len(c.words)]
  JOIN totals t ON t.lang = c.lang
), scored AS (
  SELECT lang, words, a, l, r, n, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1
), inner_ AS (
  SELECT c.lang, c.words[i.i : i.i + m.m - 1] AS words, max(c.f) AS around
  FROM counts c, (SELECT unnest(range(1, 5)) AS i) i, (SELECT unnest(range(2, 5)) AS m) m
  WHERE m.m < len(c.words) AND i.i + m.m - 1 <= len(c.words) GROUP BY ALL
), kept AS (
  SELECT s.lang, array_to_string(s.words, ' ') AS phrase, a, l, r, n, score
  FROM scored s LEFT JOIN inner_ i ON i.lang = s.lang AND i.words = s.words WHERE i.around IS NULL OR i.around < s.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) <= 2000
""")
def op13(spark: SparkSession, d: str) -> DataFrame:
    return collocations(table(spark, d, "documents"))
