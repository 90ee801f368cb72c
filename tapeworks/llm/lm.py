"""Language-model scoring with a weighted backoff automaton.

States are the contexts seen in training, arcs their continuations with the log
probability of the smoothed model, and failure arcs lead from a context to the
next shorter one with the log of the mass left to it.  A text is scored in one
traversal from left to right that carries the state.

The model of order k mixes the relative frequency in its context with the model
of order k - 1; the mass of the latter is the Good-Turing share of n-grams seen
once.  Words alone have add-one counts with one more word for all unknown ones,
so every distribution sums to one.

The counts of a large corpus fit no executor.  Documents are therefore encoded in
blocks of some megabytes.  A block sends its distinct n-grams, hashed and dealt
into buckets, with its training counts; a bucket adds the counts of all blocks
and returns the totals in the order of each request.  A block then holds exactly
the part of the automaton that its texts can reach.  What travels grows with the
text, no n-gram comes twice from one block, and buckets are even.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.common import query, store, table

ORDER = 2
BLOCK, BUCKET = 8 << 20, 2_000_000
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
END = b""  # no word is empty
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
DOCS = "array<struct<id:bigint,held:boolean,n:bigint>>"


def planes(values: np.ndarray) -> bytes:
    """The bytes of an array, all first bytes first: upper bytes of small numbers compress away."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def unplanes(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(width, -1).T.copy().view(kind).ravel()


def encode(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of documents (id, text, held): block, docs, words (hashes) and tokens (positions in words)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        words, tokens, meta, size = {END: 0}, [], [], 0

        def done():
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, 1) for w in words), np.uint64, len(words))
            return pa.RecordBatch.from_arrays([
                pa.array([(part << 32) + number]),
                pa.array([meta], pa.list_(pa.struct([("id", pa.int64()), ("held", pa.bool_()), ("n", pa.int64())]))),
                pa.array([hashes.tobytes()]), pa.array([planes(np.concatenate(tokens))]),
            ], ["block", "docs", "words", "tokens"])

        for b in batches:
            ids, held = b.column(0).to_pylist(), b.column(2).to_pylist()
            for i in range(b.num_rows):
                raw = (b.column(1)[i].as_py() or "").encode("utf-8", "surrogatepass").translate(LOWER)
                own = [words.setdefault(w, len(words)) for w in raw.split()]
                own.append(0)
                tokens.append(np.array(own, np.uint32))
                meta.append({"id": ids[i], "held": held[i], "n": len(own)})
                size += len(raw) + 1
                if size >= block:
                    yield done()
                    words, tokens, meta, size, number = {END: 0}, [], [], 0, number + 1
        if meta:
            yield done()

    return docs.select("id", "text", "held").mapInArrow(rows, f"block long, docs {DOCS}, words binary, tokens binary")


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of equal ranges of hashes: sorted keys are in the order of their buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


class Grams:
    """The distinct n-grams of a block, per order sorted by their hash.

    ``at[k - 1]`` has for each place the number of the n-gram of order k that ends
    there (for single words their position in the block's list), or -1.  Before a
    text stands one end.
    """

    def __init__(self, docs: list[dict], words: bytes, tokens: bytes, order: int, buckets: int):
        hashes, self.tokens = np.frombuffer(words, np.uint64), unplanes(tokens, "u4").astype(np.int64)
        self.n, self.size = np.array([d["n"] for d in docs]), len(hashes)
        self.starts = np.r_[0, np.cumsum(self.n)[:-1]]
        train = np.repeat(~np.array([d["held"] for d in docs]), self.n)
        inside = np.ones(len(self.tokens), bool)
        inside[self.starts] = False
        distinct, self.word_rank = np.unique(hashes, return_inverse=True)
        self.at, self.keys = [self.tokens], [distinct]
        self.counts = [np.bincount(self.word_rank[self.tokens[train]], minlength=len(distinct))]
        key, valid = hashes[self.tokens], np.ones(len(self.tokens), bool)
        for k in range(2, order + 1):
            valid = np.where(inside, np.r_[True, valid[:-1]], k == 2)
            last = np.where(inside, np.r_[hashes[0], key[:-1]], hashes[0])
            key = (last * MIX_A ^ hashes[self.tokens] * MIX_B) * MIX_A
            key ^= key >> np.uint64(29)
            distinct, number = np.unique(key[valid], return_inverse=True)
            places = np.full(len(key), -1)
            places[valid] = number
            self.at.append(places)
            self.keys.append(distinct)
            self.counts.append(np.bincount(number[train[valid]], minlength=len(distinct)))
        self.ends = [np.searchsorted(bucket_of(x, buckets), np.arange(buckets, dtype=np.uint64), "right") for x in self.keys]
        self.inside = inside


def requests(blocks: DataFrame, order: int, buckets: int) -> DataFrame:
    """Per block, order and bucket the keys of the block's n-grams and their training counts."""
    names = ["block", "level", "bucket", "keys", "counts"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                grams = Grams(r["docs"], r["words"], r["tokens"], order, buckets)
                for k in range(order):
                    out, start = [], 0
                    for j, end in enumerate(grams.ends[k].tolist()):
                        if end > start:
                            keys = grams.keys[k][start:end]
                            out.append((r["block"], k + 1, j, planes(np.diff(keys, prepend=np.uint64(0))), planes(grams.counts[k][start:end].astype(np.uint32))))
                        start = end
                    if out:  # texts may be too short for the order
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 3 + [pa.binary()] * 2)], names)

    return blocks.mapInArrow(rows, "block long, level long, bucket long, keys binary, counts binary")


def totals(asked: DataFrame) -> DataFrame:
    """The counts over all blocks, in the order of each request.

    Rows without a block hold the sums of a bucket: distinct, tokens and n-grams seen once.
    """
    names = ["block", "level", "bucket", "totals", "distinct", "tokens", "once"]
    types = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3

    def added(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([np.cumsum(unplanes(r["keys"], "u8"), dtype=np.uint64) for r in rows])
        counts = np.concatenate([unplanes(r["counts"], "u4") for r in rows])
        distinct, at = np.unique(keys, return_inverse=True)
        total = np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)
        level, bucket = rows[0]["level"], rows[0]["bucket"]
        out, start = [(None, level, bucket, None, int((total > 0).sum()), int(total.sum()), int((total == 1).sum()))], 0
        for r in rows:
            end = start + len(r["keys"]) // 8
            out.append((r["block"], level, bucket, planes(total[at[start:end]].astype(np.uint64)), None, None, None))
            start = end
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if held and (r["level"], r["bucket"]) != (held[0]["level"], held[0]["bucket"]):
                    yield from added(held)
                    held = []
                held.append(r)
        if held:
            yield from added(held)

    dealt = asked.repartition("level", "bucket").sortWithinPartitions("level", "bucket", "block")
    return dealt.mapInArrow(rows, "block long, level long, bucket long, totals binary, distinct long, tokens long, once long")


class Automaton:
    """The states and arcs that the texts of one block can reach.

    State 0 is the root; the context that is n-gram i of order k has the number
    ``first[k - 1] + i``.  Arcs are sorted by ``state * words + word``.
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], tokens: int, words: int, seen: list[float]):
        order, size = len(counts), grams.size
        counts = [counts[0], *[np.r_[c, 0] for c in counts[1:]]]  # a last place for what no text reaches
        self.order, self.size = order, size
        self.count = counts[0][grams.word_rank]
        prob = (self.count + 1) / (tokens + words + 1)
        self.root = np.log10(prob)
        self.start = np.where(self.count > 0, 1 + np.arange(size), 0) if order > 1 else np.zeros(size, np.int64)
        first = np.r_[1, 1 + np.cumsum([size, *[len(c) for c in counts[1:]]])]
        self.fail, self.back = np.zeros(first[order - 1]), np.zeros(first[order - 1], np.int64)
        keys, logp, after = [], [], []
        below = prob[grams.tokens]  # of each place's word at the order before
        for k in range(2, order + 1):
            numbers = grams.at[k - 2]
            context = np.where(grams.inside, np.r_[0, numbers[:-1]], 0 if k == 2 else -1)
            known = context >= 0
            total = np.where(known, (self.count if k == 2 else counts[k - 2])[context], 0)
            hits = np.where(known, counts[k - 1][grams.at[k - 1]], 0)
            share = np.divide(hits, total, out=np.zeros(len(hits)), where=total > 0)
            below = np.where(total > 0, seen[k - 1] * share + (1 - seen[k - 1]) * below, below)
            place = np.zeros(len(counts[k - 1]), np.int64)  # one place of each n-gram
            place[grams.at[k - 1][known]] = np.flatnonzero(known)
            place = place[counts[k - 1] > 0]
            keys.append((first[k - 2] + context[place]) * size + grams.tokens[place])
            logp.append(np.log10(below[place]))
            # the state behind an arc is the longest context that ends there; at the highest order one word less
            after.append(first[k - 1] + grams.at[k - 1][place] if k < order else first[k - 2] + numbers[place])
            self.fail[first[k - 2] : first[k - 1]] = np.log10(1 - seen[k - 1])
            if k > 2:
                shorter, full = grams.at[k - 3], numbers >= 0
                self.back[first[k - 2] + numbers[full]] = first[k - 3] + shorter[full]
        keys = np.concatenate(keys) if keys else np.empty(0, np.int64)
        by = np.argsort(keys)
        self.keys = np.r_[keys[by], np.iinfo(np.int64).max]
        self.logp = np.r_[np.concatenate(logp)[by], 0.0] if logp else np.zeros(1)
        self.after = np.r_[np.concatenate(after)[by], 0] if after else np.zeros(1, np.int64)

    def score(self, tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray, piece: int = 1024) -> np.ndarray:
        """Log10 probability of each text, one pass from left to right over many texts at once.

        Long texts are taken in pieces.  The state before a piece follows from the
        ``order - 1`` words before it, which are read first and not counted.
        """
        pieces = -(-sizes // piece)
        owner = np.repeat(np.arange(len(sizes)), pieces)
        number = np.arange(len(owner)) - np.repeat(np.r_[0, np.cumsum(pieces)[:-1]], pieces)
        lead = np.minimum(self.order - 1, number * piece)
        whole = number * piece <= self.order - 1  # what is read before begins where the text does
        begin = starts[owner] + number * piece - lead
        length = np.minimum(piece, sizes[owner] - number * piece) + lead
        by = np.argsort(-length, kind="stable")
        owner, lead, begin, length, whole = owner[by], lead[by], begin[by], length[by], whole[by]
        active = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")
        state, total = np.where(whole, self.start[0], 0), np.zeros(len(owner))
        for t, m in enumerate(active.tolist()):
            word, at, gain = tokens[begin[:m] + t], state[:m].copy(), np.zeros(m)
            todo = np.arange(m)
            while len(todo):
                s, w = at[todo], word[todo]
                key = s * self.size + w
                arc = np.searchsorted(self.keys, key)
                hit = self.keys[arc] == key
                found, arc = todo[hit], arc[hit]
                gain[found] += self.logp[arc]
                at[found] = self.after[arc]
                todo, s, w = todo[~hit], s[~hit], w[~hit]
                low = s == 0
                gain[todo[low]] += self.root[w[low]]
                at[todo[low]] = self.start[w[low]]
                todo, s = todo[~low], s[~low]
                gain[todo] += self.fail[s]
                at[todo] = self.back[s]
            state[:m] = at
            total[:m] += np.where(lead[:m] <= t, gain, 0.0)
        return np.bincount(owner, weights=total, minlength=len(sizes))


def _scored(order: int, buckets: int, tokens: int, words: int, seen: list[float]):
    names = ["id", "held", "n_tokens", "n_known", "base_score", "score"]

    def finish(head: dict, counts: list[list[bytes]]) -> pa.RecordBatch:
        grams = Grams(head["docs"], head["words"], head["tokens"], order, buckets)
        auto = Automaton(grams, [np.concatenate([np.empty(0, np.uint64), *[unplanes(x, "u8") for x in c]]).astype(np.int64) for c in counts], tokens, words, seen)
        known = auto.count[grams.tokens] > 0
        base = np.log10((auto.count + 1) / (tokens + 1 * (words + 1)))[grams.tokens]
        starts = grams.starts
        columns = [[d["id"] for d in head["docs"]], [d["held"] for d in head["docs"]], grams.n.tolist()]
        columns += [np.add.reduceat(known.astype(np.int64), starts), np.add.reduceat(base, starts)]
        columns.append(auto.score(grams.tokens, starts, grams.n))
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, counts = None, []
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                if r["level"] == 0:
                    if head:
                        yield finish(head, counts)
                    head, counts = r, [[] for _ in range(order)]
                else:
                    counts[r["level"] - 1].append(r["totals"])
        if head:
            yield finish(head, counts)

    return rows


def score(docs: DataFrame, held: str = "held", ident: str = "id", text: str = "text", order: int = ORDER, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """id, held, n_tokens, n_known, train_tokens, base_score and score of every row.

    The model learns from the rows where ``held`` is false.  A null text is empty and
    consists of its end; a null id stays null; equal rows count and are scored each.
    With nothing to learn from, all words are unknown.
    """
    given = docs.select(F.col(ident).cast("long").alias("id"), F.col(text).cast("string").alias("text"), F.coalesce(F.col(held), F.lit(False)).alias("held"))
    blocks = store(encode(given, block), "blocks", "zstd")
    size = blocks.select(F.sum(F.length("tokens") / 4)).first()[0] or 0
    buckets = max(1, -(-int(size) // bucket))
    found = store(totals(requests(blocks, order, buckets)), "totals", "zstd")
    sums = {r.level: r for r in found.where("block is null").groupBy("level").agg(
        F.sum("distinct").alias("distinct"), F.sum("tokens").alias("tokens"), F.sum("once").alias("once")).collect()}  # a row per order
    tokens, words = (sums[1].tokens, sums[1].distinct) if sums else (0, 0)
    seen = [0.0] + [1 - (sums[k].once + 1) / (sums[k].tokens + 2) if k in sums else 0.0 for k in range(2, order + 1)]
    heads = blocks.select("block", F.lit(0).cast("long").alias("level"), F.lit(0).cast("long").alias("bucket"), "docs", "words", "tokens", F.lit(None).cast("binary").alias("totals"))
    bodies = found.where("block is not null").select(
        "block", "level", "bucket", F.lit(None).cast(DOCS).alias("docs"), F.lit(None).cast("binary").alias("words"), F.lit(None).cast("binary").alias("tokens"), "totals"
    )
    dealt = heads.union(bodies).repartition("block").sortWithinPartitions("block", "level", "bucket")
    out = dealt.mapInArrow(_scored(order, buckets, tokens, words, seen), "id long, held boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("id", "held", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


@query("op9_backoff_automaton")
def op9(spark, d):
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    docs = table(spark, d, "documents").select("doc_id", "text", held.alias("held"))
    return score(docs, ident="doc_id").withColumnsRenamed({"id": "doc_id", "held": "held_out"})
