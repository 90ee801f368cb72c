"""Quality rules whose cutoffs come with a guarantee.

A rule rejects a document when a statistic of its text lies beyond a cutoff.  For
each stratum and rule the cutoffs form a sequence from lenient to strict.  On the
labelled documents the number of good ones a cutoff rejects is tested against
the share allowed: the exact binomial tail at that share must not exceed the
error allowed.  Tests run along the sequence and end at the first failure, which
needs no correction within a sequence; the error is divided by the number of
sequences (strata times rules), and the share by the number of rules.  So with
probability ``1 - error`` no stratum loses more than ``share`` of its good
documents.  Of the certified cutoffs a rule uses the one that rejects most bad
documents net of good ones, or none.

Everything is built-in functions.  All labelled documents take part: they are joined
to the counts and counted per stratum, rule and cutoff, so only the tables of tests
and cutoffs, with that many rows, are small.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.llm.common import query, store, table

BLANK = r"[\x20\x09-\x0D]+"
SHARE, ERROR = 0.02, 0.05
#: Good documents count so many times a bad one when a cutoff is chosen.
WEIGHT = 20.0
#: Statistic of each rule, and its cutoffs from lenient to strict; a document beyond a cutoff is rejected.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / nullif(n_words, 0)", [2.5, 2.0, 1.5, 1.0, 0.7, 0.5, 0.35, 0.25, 0.15, 0.1, 0.05]),
    "dup_lines": ("n_dup_lines / nullif(n_words, 0)", [0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01]),
    "repeats": ("n_repeat_words / nullif(n_words, 0)", [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05]),
    "long_words": ("word_chars / nullif(n_words, 0)", [30.0, 20.0, 16.0, 13.0, 11.0, 10.0, 9.0, 8.0]),
    "short_words": ("0 - word_chars / nullif(n_words, 0)", [-1.5, -2.0, -2.5, -3.0, -3.5, -4.0]),
}


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words in place of ``text``.

    All counts come from arrays within the row: three-word windows are hashed, and
    only where some hash repeats are the hashes sorted with their positions.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.withColumn("_body", body)
    rows = rows.withColumn("_words", F.array_remove(F.split("_body", BLANK, -1), ""))
    lines = F.filter(F.split("_body", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashes = F.transform(
        F.when(F.size("_words") > 2, F.sequence(F.lit(1), F.size("_words") - 2)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(*[F.element_at("_words", i + k) for k in range(3)]),
    )
    rows = rows.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace("_body", r"[^#*$%&|<>]+", "")).cast("long"),
        "_lines": lines, "_hashes": hashes,
    }).drop("_body", "_words", text)
    twice = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    placed = F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    rows = rows.withColumns({
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_sorted": F.when(twice, F.sort_array(placed)),
    }).drop("_lines", "_hashes")

    def met(v: Column, i: Column) -> Column:
        at = lambda k: F.get("_sorted", k).getField("h")
        return F.coalesce(at(i - 1) == v.getField("h"), F.lit(False)) | F.coalesce(at(i + 1) == v.getField("h"), F.lit(False))

    places = F.sort_array(F.transform(F.filter("_sorted", met), lambda v: v.getField("i")))
    rows = rows.withColumn("_places", places).drop("_sorted")
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(
        "_places", start, lambda a, p: F.struct(p.alias("last"), (a.getField("n") + F.least(F.lit(3), p - a.getField("last"))).alias("n")), lambda a: a.getField("n")
    )
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_places")


def base_failed() -> Column:
    """Too short, or more than half of it repeats."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for a binomial X of n trials at p, summed in logarithms; 1 where k is at least its mean."""
    step = math.log(p / (1 - p))
    first = n * math.log(1 - p)
    start = F.struct(first.alias("term"), first.alias("sum"))

    def add(a: Column, j: Column) -> Column:
        term = a.getField("term") + F.log((n - j + 1) / j) + F.lit(step)
        high, low = F.greatest(a.getField("sum"), term), F.least(a.getField("sum"), term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(F.aggregate(steps, start, add, lambda a: a.getField("sum"))))


def cutoffs(labelled: DataFrame, rules=None, share: float = SHARE, error: float = ERROR, weight: float = WEIGHT) -> DataFrame:
    """``stratum`` and a cutoff column per rule, for the strata where some cutoff is certified and of use.

    ``labelled`` has stratum, the base counts and boolean ``good``.
    """
    rules = rules or RULES
    grid = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.lit(i).alias("step"), F.lit(cut).alias("cutoff"), (F.expr(stat) > cut).alias("out"))
        for name, (stat, cuts) in rules.items() for i, cut in enumerate(cuts)
    ])
    tests = labelled.select("stratum", "good", F.inline(grid)).groupBy("stratum", "rule", "step", "cutoff").agg(
        *[F.expr(f"count_if({what})").alias(n) for n, what in {"n": "good", "k": "good and out", "bad": "not good", "caught": "not good and out"}.items()]
    )
    sequences = labelled.where("good").select("stratum").distinct().count() * len(rules)
    along = Window.partitionBy("stratum", "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    certified = tests.withColumn("p", F.max(tail(F.col("k"), F.col("n"), share / len(rules))).over(along)).where(F.col("p") <= error / max(1, sequences))
    use = certified.withColumn("use", F.expr("caught / nullif(bad, 0)") - weight * F.col("k") / F.col("n")).where("use > 0")
    best = use.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct("use", -F.col("step"))).alias("cutoff"))
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in rules])


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", text: str = "text", rules=None, **options) -> DataFrame:
    """doc_id, stratum, the base counts, base_failed and kept, one row per row of ``docs``.

    ``labels``: doc_id and quality (1 good, 0 bad, null not labelled; of several the
    worst).  All labelled documents take part but those that fail the base rules.  Null
    strata form one of their own.  Without labels, or with too few to certify a cutoff,
    the base rules decide.
    """
    rules = rules or RULES
    given = docs.select("doc_id", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), F.col(text).alias("_text"))
    counted = store(base_counts(given, "_text").withColumn("base_failed", base_failed()), "counts")
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    seen = store(counted.where("not base_failed").join(known, "doc_id"), "labelled")
    cuts = cutoffs(seen, rules, **options)  # a row per stratum with some hundreds of labels or more
    beyond = [F.coalesce(F.expr(stat) > F.col(f"cut_{name}"), F.lit(False)) for name, (stat, _) in rules.items()]
    out = F.array_contains(F.array(*beyond), True)
    return counted.join(F.broadcast(cuts), "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~out).drop(*[f"cut_{r}" for r in rules])


def _sql() -> str:
    grid = ", ".join(f"('{name}', {i}, {cut}::DOUBLE)" for name, (_, cuts) in RULES.items() for i, cut in enumerate(cuts))
    stat = "CASE rule " + " ".join(f"WHEN '{name}' THEN {expr}" for name, (expr, _) in RULES.items()) + " END"
    p = SHARE / len(RULES)
    return f"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), tri AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS t FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), rep AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS c FROM tri) WHERE c > 1
), cov AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM rep, (VALUES (0), (1), (2)) v(o) GROUP BY doc_id
), lines AS (
  SELECT doc_id, list_filter(string_split(body, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM w
), m AS (
  SELECT w.doc_id, stratum, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(cov.n, 0) AS n_repeat_words
  FROM w JOIN lines USING (doc_id) LEFT JOIN cov USING (doc_id)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
k AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
grid(rule, step, cutoff) AS (VALUES {grid}),
tests AS (
  SELECT stratum, rule, step, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (good AND {stat} > cutoff) AS k,
    count(*) FILTER (NOT good) AS bad, count(*) FILTER (NOT good AND {stat} > cutoff) AS caught
  FROM b JOIN k USING (doc_id) CROSS JOIN grid WHERE NOT base_failed GROUP BY ALL
), tails AS (
  SELECT *, max(CASE WHEN k >= n * {p!r} THEN 1.0 ELSE list_sum(list_transform(range(k + 1),
    lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p!r}) + (n - j) * ln(1 - {p!r})))) END)
    OVER (PARTITION BY stratum, rule ORDER BY step) AS p FROM tests
), best AS (
  SELECT stratum, rule, cutoff FROM (SELECT *, caught / nullif(bad, 0) - {WEIGHT!r} * k / n AS use FROM tails
    WHERE p <= {ERROR!r} / ((SELECT count(DISTINCT stratum) FROM tests WHERE n > 0) * {len(RULES)}))
  WHERE use > 0 QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY use DESC, step) = 1
), out AS (SELECT DISTINCT doc_id FROM b JOIN best USING (stratum) WHERE {stat} > cutoff)
SELECT b.doc_id, b.stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND out.doc_id IS NULL AS kept FROM b LEFT JOIN out USING (doc_id)
"""


@query("op7_quality_rules", _sql())
def op7(spark, d):
    return judge(table(spark, d, "documents"), table(spark, d, "labels"))
