"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.common import store


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it is connected with, for each node of ``links`` (a, b).

    Large-star and small-star steps in turn, each written to the shared folder,
    until the links no longer change; the number of steps grows with the
    logarithm of the size of the largest component.
    """
    now = store(_tidy(links.select("a", "b")), "links")
    sign = _sign(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = store(_tidy(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))), "links")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        now = store(_tidy(small), "links")
        before, sign = sign, _sign(now)
        if sign == before:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _tidy(links: DataFrame) -> DataFrame:
    """Each link once, from the larger to the smaller node."""
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _sign(links: DataFrame):
    return links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
