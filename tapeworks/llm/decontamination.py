"""Benchmark decontamination with a distributed positional inverted index.

The index is a written table of postings: term, document key and position, in
segments sorted by term, one for each slice of the corpus.  It holds the terms
that the test items use; a last posting per document carries its number of words.

Each distinct window of test words is looked up rarest term first.  The postings
of its rarest term, less the term's offset, are the places where it could begin.
They are intersected with the postings of the next rarest term, and the few that
remain with those of all other terms of the documents they lie in.  With a slop
of 0 what is left are exact phrases; otherwise every term may stand that many
words off its place.

Everything is built-in functions.  Tables made from the test items are broadcast
where they are counted to be small, and joined otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.llm.common import UPPER, ascii_lower, query, store, table

WIDTH = 10
#: Rows up to which a table made from the test items, or a list of document keys, is broadcast.
SMALL = 500_000
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of digits, letters A-Z and a-z and characters beyond ASCII, as they are written."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), BREAKS, -1), "")


def bounded(df: DataFrame, most: int = SMALL) -> DataFrame:
    """A hint to broadcast a stored table of at most ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df


def windows(items: DataFrame, ident: str = "item_id", text: str = "text", width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (window, terms) and the items they come from (window, item).

    A window has ``width`` consecutive words; an item of fewer words, but not none, is one window.
    """
    lowered = F.transform(words(F.col(text)), ascii_lower)
    rows = items.select(F.col(ident).cast("string").alias("item"), lowered.alias("w")).where(F.size("w") > 0)
    cut = rows.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))).alias("i"))
    cut = cut.select("item", F.slice("w", F.col("i"), F.lit(width)).alias("terms"))
    cut = cut.select("item", "terms", F.xxhash64("terms").alias("window"))
    return store(cut.select("window", "terms").distinct(), "windows"), store(cut.select("window", "item").distinct(), "items")


def index(docs: DataFrame, terms: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (term, key, position, id) of the words in ``terms`` (column word), stored in segments sorted by term.

    A document ends with the posting of the empty word: its position is the
    number of words, and it alone carries the document's ``id``.
    """
    key = F.xxhash64(F.col(ident), F.xxhash64(text))
    every = terms.select("word").unionByName(terms.sparkSession.createDataFrame([("",)], "word string")).distinct()
    vocabulary = bounded(store(every.select(F.lower("word").alias("low"), "word", F.xxhash64("word").alias("term")), "terms"))
    ended = F.concat(words(F.col(text)), F.array(F.lit("")))
    rows = docs.select(F.col(ident).cast("long").alias("id"), key.alias("key"), F.posexplode(ended).alias("position", "raw"))
    same = (F.col("raw") == F.col("word")) | (F.translate("raw", UPPER, UPPER.lower()) == F.col("word"))
    kept = rows.join(vocabulary, F.lower("raw") == F.col("low")).where(same)
    postings = kept.select("term", "key", "position", F.when(F.col("raw") == "", F.col("id")).alias("id"))
    return store(postings.sortWithinPartitions("term", "key", "position"), "postings")


def ranked_terms(wins: DataFrame, postings: DataFrame) -> DataFrame:
    """Terms of each window (window, term, at, size) with ``rank`` from the rarest; windows with an absent term are left out."""
    counts = postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    terms = wins.select("window", F.size("terms").alias("size"), F.posexplode("terms").alias("at", "word"))
    known = terms.withColumn("term", F.xxhash64("word")).drop("word").join(counts, "term")
    whole = Window.partitionBy("window")
    ranked = known.withColumns({"found": F.count(F.lit(1)).over(whole), "rank": F.row_number().over(whole.orderBy("n", "at"))})
    return store(ranked.where("found = size").select("window", "term", "at", "size", "rank"), "ranked")


def _meet(begun: DataFrame, terms: DataFrame, postings: DataFrame, slop: int) -> DataFrame:
    """The rows of ``begun`` (key, window, start) with postings of all the ``terms`` of their window, at most ``slop`` off their places."""
    offs = F.explode(F.sequence(F.lit(-slop), F.lit(slop))) if slop else F.lit(0)
    sought = begun.join(bounded(terms.select("window", "term", "at")), "window").withColumn("off", offs)
    sought = sought.withColumn("position", F.col("start") + F.col("at") + F.col("off"))
    found = sought.join(postings.select("term", "key", "position").distinct(), ["term", "key", "position"])
    met = found.groupBy("key", "window", "start").agg((F.count_distinct("at") if slop else F.count(F.lit(1))).alias("met"))
    needed = terms.groupBy("window").agg(F.count(F.lit(1)).alias("needed"))
    return met.join(needed, "window").where("met = needed").select("key", "window", "start")


def matches(wins: DataFrame, postings: DataFrame, slop: int = 0) -> DataFrame:
    """Where windows occur: key, window, start and size.

    ``slop`` 0 finds exact phrases.  Otherwise every term lies at most ``slop`` words off
    its place relative to the rarest term of the window, which is the one at ``start``.
    """
    ranked = ranked_terms(wins, postings)
    first = bounded(store(ranked.where("rank = 1").select("window", "term", "at"), "first"))
    begun = postings.join(first, "term").select("key", "window", (F.col("position") - F.col("at")).alias("start")).where("start >= 0" if not slop else "true").distinct()
    second = store(ranked.where("rank = 2"), "second")
    rarer = postings.join(bounded(store(second.select("term").distinct(), "terms")), "term", "left_semi")
    single = ranked.where("rank = 1 and size = 1").select("window")
    alone = begun.join(bounded(store(single, "single")), "window", "left_semi")
    pairs = store(_meet(begun, second, rarer, slop), "pairs")
    rest = store(ranked.where("rank > 2"), "rest")
    keys = store(pairs.select("key").distinct(), "keys")
    near = postings.join(bounded(keys), "key", "left_semi").join(bounded(store(rest.select("term").distinct(), "terms")), "term", "left_semi")
    short = pairs.join(bounded(store(ranked.where("size = 2").select("window").distinct(), "short")), "window", "left_semi")
    whole = _meet(pairs, rest, near, slop).unionByName(short).unionByName(alone)
    sizes = ranked.where("rank = 1").select("window", "size")
    return whole.join(bounded(store(sizes, "sizes")), "window").select("key", "window", "start", "size")


def contamination(docs: DataFrame, items: DataFrame, ident: str = "doc_id", text: str = "text", width: int = WIDTH, slop: int = 0) -> DataFrame:
    """``ident``, key, n_words, n_hit, n_items, items_sha256 and contaminated, one row per row of ``docs``.

    Words of a document inside an occurrence of a window are hit.  Null and empty texts
    have no words, and items without words no window.  Equal windows of several items
    count for each of them, and an item's id counts once, a null one not at all.  Rows equal in id and text
    have equal results.  No items: nothing is hit.
    """
    wins, owners = windows(items, width=width)
    vocabulary = wins.select(F.explode("terms").alias("word")).distinct()
    postings = index(docs, vocabulary, ident, text)
    found = store(matches(wins, postings, slop), "matches")
    before = Window.partitionBy("key").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("key", F.greatest(F.col("start") - slop, F.lit(0)).alias("start"), (F.col("start") + F.col("size") + slop).alias("stop"))
    ends = postings.where(F.col("term") == F.xxhash64(F.lit(""))).select("key", F.col("position").alias("n_words"), F.col("id").alias(ident))
    if slop:  # a neighbourhood may reach beyond the text
        spans = spans.join(ends.select("key", "n_words").distinct(), "key").select("key", "start", F.least("stop", "n_words").alias("stop"))
    begin = F.greatest(F.col("start"), F.coalesce(F.max("stop").over(before), F.lit(0)))
    hit = spans.distinct().withColumn("own", F.greatest(F.col("stop") - begin, F.lit(0))).groupBy("key").agg(F.sum("own").alias("n_hit"))
    held = found.select("key", "window").distinct().join(bounded(owners), "window").select("key", "item").distinct()
    lists = held.groupBy("key").agg(F.count("item").alias("n_items"), F.sort_array(F.collect_list("item")).alias("_items"))
    joined = ends.join(hit.join(lists, "key"), "key", "left")
    return joined.select(
        ident, "key", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("_items", F.array().cast("array<string>"))).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


_LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
OP1_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, len(w) AS n, w[i:i + 9] AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS size FROM bw),
dw AS (SELECT doc_id, i, size, w[i:i + size - 1] AS win FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
m AS (SELECT doc_id, i, size, item FROM dw JOIN bw USING (win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query("op1_decontamination", OP1_SQL)
def op1(spark, d):
    return contamination(table(spark, d, "documents"), table(spark, d, "benchmark")).drop("key")


def drop_contaminated(spark, docs: DataFrame, d: str) -> DataFrame:
    """Pipeline stage: the documents in which no window of the benchmark occurs."""
    found = contamination(docs, table(spark, d, "benchmark")).where("contaminated").select(F.col("key").alias("_key")).distinct()
    found = bounded(store(found, "contaminated"))
    keyed = docs.withColumn("_key", F.xxhash64(F.col("doc_id"), F.xxhash64(F.col("text"))))
    return keyed.join(found, "_key", "left_anti").drop("_key")
