"""URL filters: a sort-merge range join of canonical keys and nested rule intervals.

A rule names a host, which stands for itself and all its subdomains, and a path
prefix.  The canonical key of a host and path is the host's labels in reverse,
a separator and the path.  A url has one key for each ending of its host; a rule
is then the interval of all keys that begin with its own.  Rules of one host
nest, so a sweep over rule starts, rule ends and url keys in sorted order keeps
a stack of active rules: a start pushes its rule, an end restores the one below
it.  Both carry the number of the rule on top from then on, so the sweep is one
running ``last`` in a sorted window.

Urls are dealt into even shares, each with a copy of the sorted markers; a hot
host is spread over all shares.  There are at most an eighth as many markers as
urls, whatever the number of rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.llm.common import ascii_lower, query, shuffle_partitions, table

#: Bytes that UTF-8 never has: between host and path, and after all keys with a prefix.
SEPARATOR, AFTER_ALL = b"\xfe", b"\xff"
LEVEL = 1 << 32


def host_of(url: Column) -> Column:
    """Host in lower case: behind the first ``://`` up to ``/``, ``?`` or ``#``; empty without one."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """Path: behind the host up to ``?`` or ``#``; empty without ``://``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def _key(labels: Column, levels: Column, path: Column) -> Column:
    host = F.array_join(F.slice(labels, F.lit(1), levels), ".")
    return F.concat(F.encode(host, "UTF-8"), F.lit(SEPARATOR), F.encode(path, "UTF-8"))


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def _markers(rules: DataFrame) -> DataFrame:
    """Start and end of each rule's interval, with the number of the rule on top from there on.

    The number orders rules by host labels, then path length; among the rules that
    fit one url it names exactly one.  Its last bit tells allow from block.
    """
    host, path = ascii_lower(F.coalesce("host", F.lit(""))), F.coalesce("path", F.lit(""))
    own = (
        rules.select(_labels(host).alias("labels"), path.alias("path"), (F.col("verdict") == "allow").cast("long").alias("allow"))
        .groupBy("labels", "path").agg(F.min(F.coalesce("allow", F.lit(0))).alias("allow"))
        .withColumn("size", F.size("labels"))
        .withColumn("number", F.col("size").cast("long") * LEVEL + F.length("path") * 2 + F.col("allow"))
    )
    shorter = F.when(F.length("path") > 0, F.sequence(F.lit(0), F.length("path") - 1)).otherwise(F.array().cast("array<int>"))
    below = own.select("labels", "path", F.explode(shorter).alias("n")).select(
        "labels", "path", F.substr("path", F.lit(1), F.col("n")).alias("prefix")
    )
    outer = own.select("labels", F.col("path").alias("prefix"), F.col("number").alias("outer"))
    parent = below.join(outer, ["labels", "prefix"]).groupBy("labels", "path").agg(F.max("outer").alias("outer"))
    key = _key(F.col("labels"), F.col("size"), F.col("path"))
    nested = own.join(parent, ["labels", "path"], "left").withColumn("key", key)
    starts = nested.select("key", F.col("number").alias("top"))
    ends = nested.select(F.concat("key", F.lit(AFTER_ALL)).alias("key"), F.coalesce("outer", F.lit(0)).alias("top"))
    return starts.union(ends)


def filter_urls(urls: DataFrame, rules: DataFrame, keep: list[str], url: str = "url", default: str = "allow") -> DataFrame:
    """The ``keep`` columns and the url's host, path, deciding rule and verdict, one row per input row.

    ``rules``: host, path and verdict (``allow`` or ``block``).  The rule with most host
    labels wins, then the one with the longest path; of two verdicts for one rule, block.
    Without a rule the verdict is ``default``.  A null url, or one without ``://``, has
    an empty host and path.  Equal rows stay as often as they come; no urls or no rules
    are fine; other columns of either table are ignored.
    """
    spark = urls.sparkSession
    sizes = rules.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size(_labels(F.coalesce("host", F.lit(""))))).alias("levels"), F.max(F.length("path")).alias("path")
    ).first()
    rows = urls.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(url).alias("url"))
    most = min(4 * shuffle_partitions(spark), rows.count() // max(1, 16 * sizes.n))
    shares = max(1, most)
    share = F.pmod(F.xxhash64("url", *rows.columns[:-1], F.spark_partition_id()), F.lit(shares)).cast("int")
    ids = [c for c in rows.columns if c != "url"]
    labels, levels = _labels(host_of(F.col("url"))), F.least(F.size(_labels(host_of(F.col("url")))), F.lit(sizes.levels or 1))
    keyed = (
        rows.withColumn("share", share)
        .withColumns({"labels": labels, "path": F.substr(path_of(F.col("url")), F.lit(1), F.lit(sizes.path or 0))})
        .withColumn("level", F.explode(F.sequence(F.lit(1), levels)))
        .select("share", *ids, "url", "level", _key(F.col("labels"), F.col("level"), F.col("path")).alias("key"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("top"))
    )
    copies = _markers(rules).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).withColumn("kind", F.lit(0))
    sweep = Window.partitionBy("share").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = keyed.unionByName(copies, allowMissingColumns=True).withColumn("active", F.last("top", True).over(sweep)).where("kind = 1")
    decided = swept.groupBy("share", *ids, "url").agg(
        F.max(F.coalesce("active", F.lit(0))).alias("number"), F.sum(F.when(F.col("level") == 1, 1)).alias("copies")
    )
    each = decided.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    n_labels, n_path = F.floor(F.col("number") / LEVEL).cast("int"), F.floor((F.col("number") % LEVEL) / 2).cast("int")
    rule = F.concat(F.array_join(F.reverse(F.slice(F.col("labels"), F.lit(1), n_labels)), "."), F.substr(F.col("path"), F.lit(1), n_path))
    found = F.col("number") > 0
    return each.withColumns({"host": host, "path": path}).withColumn("labels", _labels(F.col("host"))).select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "host", "path",
        F.when(found, rule).alias("rule"),
        F.when(found & (F.col("number") % 2 == 0), "block").when(found, "allow").otherwise(default).alias("verdict"),
    )


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

OP5_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), rules(rhost, rpath, rverdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), best AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS v
  FROM hosts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT h.page_id, h.host, h.path, b.rule, coalesce(b.v, 'allow') AS verdict FROM hosts h LEFT JOIN best b USING (page_id)
"""


@query("op5_url_filters", OP5_SQL)
def op5(spark, d):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, d, "pages"), rules, ["page_id"])
