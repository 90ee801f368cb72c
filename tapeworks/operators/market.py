"""Risk ratios over a trailing day, the market as seen by every symbol, and votes of several runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.numeric import not_nan, ratio
from tapeworks.operators.bars import DAY, MINUTE
from tapeworks.plans.rolling import asof_join, trailing_sums, with_time_halo
from tapeworks.plans.series import CHUNK

#: Below this share of the variance of its block a window counts as constant.
CONSTANT = 1e-12
#: Share of the voters that must agree, and what happens when they do not.
QUORUM, HOLD = 0.6, 0


def rolling_risk(
    bars: DataFrame, value: str = "return_1", order: str = "bucket", key: str = "symbol",
    span: int = DAY, target: float = 0.0, least: int = 2, size: int = 8 * DAY,
) -> DataFrame:
    """Add ``n, mean_return, sharpe, sortino`` of the returns in the ``span`` up to each bar.

    The first ratio divides the mean above ``target`` by the standard deviation, the second
    by the root mean square of what falls short of the target.  Either is null where its
    divisor is zero or fewer than ``least`` returns are known.  Moments are kept about the
    mean of a block, so that their differences keep their digits.
    """
    rows = with_time_halo(bars.withColumn("_r", not_nan(F.col(value).cast("double"))), [key], order, size, span)
    block = Window.partitionBy(key, "_block")
    rows = rows.withColumn("_mid", F.avg("_r").over(block)).withColumn("_d", F.col("_r") - F.col("_mid"))
    rows = rows.withColumn("_spread", F.avg(F.col("_d") * F.col("_d")).over(block))
    short = F.least(F.col("_r") - F.lit(float(target)), F.lit(0.0))
    rows = trailing_sums(rows, [key], order, span, {
        "n": F.when(F.col("_r").isNotNull(), 1), "_s1": F.col("_d"), "_s2": F.col("_d") * F.col("_d"),
        "_missed": F.when(short < 0, 1), "_down": short * short,
    })
    n = F.col("n")
    spread = F.greatest(F.lit(0.0), F.col("_s2") - F.col("_s1") * F.col("_s1") / n)
    mean = F.col("_mid") + ratio(F.col("_s1"), n)
    enough, above = n >= F.lit(max(least, 1)), F.col("mean_return") - F.lit(float(target))
    varied = enough & (n > 1) & (spread > F.lit(CONSTANT) * F.col("_spread") * n)
    rows = rows.where(~F.col("_halo")).withColumn("mean_return", F.when(enough, mean))
    return rows.select(
        *bars.columns, "n", "mean_return",
        F.when(varied, above / F.sqrt(spread / (n - 1))).alias("sharpe"),
        F.when(enough & (F.col("_missed") > 0), above / F.sqrt(F.greatest(F.col("_down"), F.lit(0.0)) / n)).alias("sortino"),
    )


def market_proxy(
    bars: DataFrame, leaders: Sequence[str] | None = None, value: str = "log_return_1", order: str = "bucket",
    tolerance: int | None = None, width: int = CHUNK * MINUTE, salts: int = 16,
) -> DataFrame:
    """Add ``market_value, market_members, market_excess``: the mean of the leading symbols last known at each bar.

    ``leaders`` are all symbols if not given.  At every time the leaders that have a bar are
    averaged; a symbol takes the latest of these averages at or before its own bar, so that it
    has one whether or not any leader traded at that time.
    """
    known = not_nan(F.col(value).cast("double"))
    heads = bars.where(F.col("symbol").isin(list(leaders))) if leaders is not None else bars
    cross = heads.where(known.isNotNull()).groupBy(order).agg(F.avg(known).alias("market_value"), F.count(F.lit(1)).alias("market_members"))
    rows = asof_join(bars, cross, [], order, ["market_value", "market_members"], tolerance, width, salts, ["symbol"])
    return rows.withColumn("market_excess", F.col(value) - F.col("market_value"))


def majority_vote(votes: DataFrame, keys: Sequence[str] = ("step", "symbol"), action: str = "action", quorum: float = QUORUM, hold: int = HOLD) -> DataFrame:
    """Per key the most frequent action: ``votes, leading_action, leading_votes, runner_up, agreed, action``.

    At equal numbers the smaller action leads.  ``action`` is the leading one if at least
    ``quorum`` of the votes agree, else ``hold``.  Null actions do not vote.  Votes are counted
    per key and action first, so a key with most of all votes is a few rows afterwards.
    """
    cast = votes.where(F.col(action).isNotNull()).groupBy(*keys, action).agg(F.count(F.lit(1)).alias("_n"))
    first = F.struct(F.col("_n"), (-F.col(action)).alias("_least"))
    best = cast.groupBy(*keys).agg(F.sum("_n").alias("votes"), F.max_by(F.col(action), first).alias("leading_action"), F.max("_n").alias("leading_votes"), F.sort_array(F.collect_list("_n"), False).alias("_all"))
    agreed = F.col("leading_votes") >= F.ceil(F.lit(float(quorum)) * F.col("votes") - F.lit(1e-9))
    return best.select(
        *keys, "votes", "leading_action", "leading_votes", F.coalesce(F.get("_all", F.lit(1)), F.lit(0)).alias("runner_up"),
        agreed.alias("agreed"), F.when(agreed, F.col("leading_action")).otherwise(F.lit(hold)).alias(action),
    )
