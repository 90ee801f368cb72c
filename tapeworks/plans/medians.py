"""Exact medians of groups of any size.

``median`` and ``percentile`` keep all distinct values of a group in one task.
Here a mergeable quantile sketch bounds the value of each rank from both sides,
whatever the tails of the distribution, equal values are counted, one histogram
between the bounds closes in further, and only what is left is sorted.  Values
meet the bounds of their group in a salted join, so a group holding most of the
values is spread over tasks there too.

Finite values count; NaN, infinities and nulls do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.numeric import finite

BINS = 4096
#: Quantiles kept of each group, and the sketch's accuracy: its ranks are off by at most ``n / ACCURACY``.
GRID, ACCURACY = 512, 16_384


def narrowed(df: DataFrame, keys: list[str], value: str, ranks: Column, bins: int = BINS) -> tuple[DataFrame, DataFrame]:
    """Counted values with a salt, and for each rank the interval ``_lo`` to ``_hi`` that holds it, with the number of values ``_before``."""
    v = F.col("_v")
    rows = df.select(*keys, finite(F.col(value).cast("double")).alias("_v")).where(v.isNotNull())
    freq = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    span = rows.groupBy(keys).agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", grid, ACCURACY).alias("_q"), F.min("_v").alias("_least"), F.max("_v").alias("_most")
    )
    cell = F.floor(F.col("r") * F.lit(float(GRID)) / F.col("n")).cast("int")
    # two cells of slack are far more than the sketch can be off
    low = F.when(cell >= 3, F.get("_q", cell - 2)).otherwise(F.col("_least"))
    high = F.when(cell <= GRID - 3, F.get("_q", cell + 3)).otherwise(F.col("_most"))
    target = span.withColumn("r", F.explode(F.array_distinct(ranks))).select(*keys, "r", low.alias("_lo"), high.alias("_hi"))
    part = [*keys, "r"]
    salts = max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = freq.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(salts)).cast("int"))
    copies = target.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    share = (v - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    # halves, so that the span of two huge values of unlike sign stays finite
    share = F.when(F.abs(F.col("_hi") / 2 - F.col("_lo") / 2) > 4e307, (v / 4 - F.col("_lo") / 4) / (F.col("_hi") / 4 - F.col("_lo") / 4)).otherwise(share)
    inside = F.coalesce(F.least((share * bins).cast("int"), F.lit(bins - 1)), F.lit(0))
    cells = (
        spread.join(copies, [*keys, "_salt"]).where(v <= F.col("_hi"))
        .groupBy(*part, F.when(v < F.col("_lo"), -1).otherwise(inside).alias("_bin"))
        .agg(F.sum("_c").alias("_size"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        .withColumn("_end", F.sum("_size").over(Window.partitionBy(part).orderBy("_bin")))
    )
    bounds = cells.where((F.col("_end") >= F.col("r")) & (F.col("_end") - F.col("_size") < F.col("r")))
    bounds = bounds.select(*part, "_lo", "_hi", (F.col("_end") - F.col("_size")).alias("_before"))
    copies = bounds.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = spread.join(copies, [*keys, "_salt"]).where(v.between(F.col("_lo"), F.col("_hi")))
    return left, bounds


def ranked_values(df: DataFrame, keys: list[str], value: str, ranks: Column, bins: int = BINS) -> DataFrame:
    """``keys, r, value`` for every rank in ``ranks``, an array built from the count ``n``."""
    part = [*keys, "r"]
    left, _ = narrowed(df, keys, value, ranks, bins)
    ends = F.sum("_c").over(Window.partitionBy(part).orderBy("_v")) + F.col("_before")
    return (
        left.withColumn("_end", ends)
        .where((F.col("_end") >= F.col("r")) & (F.col("_end") - F.col("_c") < F.col("r")))
        .select(*part, F.col("_v").alias("value"))
    )


def medians(
    df: DataFrame, keys: list[str], columns: dict[str, str], upper: bool = False
) -> DataFrame:
    """Median of several columns per group; ``columns`` maps output name to input.

    An even count gives the mean of the two middle values, or with ``upper`` the
    larger of them.
    """
    n = F.col("n")
    low = F.call_function("div", n + 1, F.lit(2))
    high = F.call_function("div", n, F.lit(2)) + 1
    pairs = [F.struct(F.lit(o).alias("m"), F.col(c).cast("double").alias("v")) for o, c in columns.items()]
    long = df.select(*keys, F.explode(F.array(*pairs)).alias("p")).select(
        *keys, F.col("p.m").alias("_m"), F.col("p.v").alias("_x")
    )
    picked = ranked_values(long, [*keys, "_m"], "_x", F.array(high) if upper else F.array(low, high))
    return picked.groupBy(keys).agg(
        *[F.avg(F.when(F.col("_m") == o, F.col("value"))).alias(o) for o in columns]
    )
