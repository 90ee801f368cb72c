"""Exit labelling: entries against the price path of their symbol.

``entries(symbol, entry_step, entry_price, ...)`` and ``prices(symbol, step, close)``
with one price per symbol and step.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.numeric import floor_div, ratio
from tapeworks.plans.series import Fold, running

# Defaults of the exit rules, and the order of reasons at one step.
STOP_LOSS = 0.05
HOLD_LIMIT = 1440
REASONS = ["sell", "stop_loss", "time_limit", "end_of_episode"]


def stop_loss_exit(
    entries: DataFrame, prices: DataFrame, stop_loss: float = STOP_LOSS, limit: int = HOLD_LIMIT
) -> DataFrame:
    """Entries plus ``stop_step, stop_price``: the first step after the entry, and within
    ``limit + 1`` steps, where the loss exceeds ``stop_loss`` (strictly).

    Prices are packed into short runs of about ``sqrt(limit)`` steps with their
    minimum, and the runs into buckets as long as the limit.  An entry meets the
    runs of at most two buckets in an equi-join; only runs whose minimum is low
    enough are opened, and only their first qualifying step is kept.
    """
    reach = limit + 1
    length = max(1, isqrt(reach))
    span = -(-reach // length) * length

    packed = (
        prices.groupBy("symbol", floor_div(F.col("step"), length).alias("_piece"))
        .agg(
            F.min("close").alias("_low"),
            F.max("step").alias("_to"),
            F.array_sort(F.collect_list(F.struct("step", "close"))).alias("_path"),
        )
        .withColumn("_bucket", floor_div(F.col("_piece") * length, span))
    )
    own = floor_div(F.col("entry_step"), span)
    # Equal entries of many runs are searched once.
    wanted = entries.select("symbol", "entry_step", "entry_price").distinct()
    wanted = wanted.withColumn("_bucket", F.explode(F.array(own, own + 1)))

    def loses(price: Column) -> Column:
        return (price - F.col("entry_price")) / F.col("entry_price") < F.lit(-float(stop_loss))

    opened = wanted.join(packed, ["symbol", "_bucket"]).where(
        (F.col("_to") > F.col("entry_step"))
        & (F.col("_piece") * length <= F.col("entry_step") + reach)
        & (F.col("entry_price") > 0)
        & loses(F.col("_low"))
    )
    hit = F.filter(
        "_path",
        lambda x: (x["step"] > F.col("entry_step"))
        & (x["step"] <= F.col("entry_step") + reach)
        & loses(x["close"]),
    )
    hits = opened.select("symbol", "entry_step", "entry_price", F.get(hit, F.lit(0)).alias("_hit"))
    first = (
        hits.where(F.col("_hit").isNotNull())
        .groupBy("symbol", "entry_step", "entry_price")
        .agg(
            F.min(F.col("_hit")["step"]).alias("stop_step"),
            F.min_by(F.col("_hit")["close"], F.col("_hit")["step"]).alias("stop_price"),
        )
    )
    return entries.join(first, ["symbol", "entry_step", "entry_price"], "left")


def time_limit_exit(entries: DataFrame, prices: DataFrame, limit: int = HOLD_LIMIT) -> DataFrame:
    """Entries plus ``limit_step, limit_price``: the first step held longer than ``limit``.

    Steps may be missing.  Each entry becomes a mark among its symbol's prices, just
    before the first step that counts, and looks ahead to the next price.
    """
    entry = F.struct(*[F.col(c) for c in entries.columns])
    marks = entries.select("symbol", ((F.col("entry_step") + limit + 1) * 2).cast("bigint").alias("_at"), entry.alias("_entry"))
    steps = prices.select("symbol", (F.col("step") * 2 + 1).cast("bigint").alias("_at"), F.struct("step", "close").alias("_price"))
    rows = marks.unionByName(steps, allowMissingColumns=True)
    ahead = running(rows, ["symbol"], "_at", {"_next": Fold("last", F.col("_price"), reverse=True)})
    found = ahead.where(F.col("_entry").isNotNull())
    return found.select("_entry.*", F.col("_next.step").alias("limit_step"), F.col("_next.close").alias("limit_price"))


def end_of_data_exit(entries: DataFrame, prices: DataFrame) -> DataFrame:
    """Entries plus ``end_step, end_price``: the last step of the symbol."""
    last = prices.groupBy("symbol").agg(
        F.max("step").alias("end_step"), F.max_by("close", "step").alias("end_price")
    )
    return entries.join(last, "symbol", "left")


def resolve_exit(candidates: DataFrame) -> DataFrame:
    """Earliest exit per entry, in the order of ``REASONS`` within a step.

    Expects the columns ``sell_step/sell_price, stop_*, limit_*, end_*`` (nullable).
    """
    names = ["sell", "stop", "limit", "end"]
    options = [
        F.when(
            F.col(f"{n}_step").isNotNull(),
            F.struct(
                F.col(f"{n}_step").cast("bigint").alias("step"),
                F.lit(i).alias("order"),
                F.col(f"{n}_price").alias("price"),
                F.lit(reason).alias("reason"),
            ),
        )
        for i, (n, reason) in enumerate(zip(names, REASONS, strict=True))
    ]
    rows = candidates.withColumn("_exit", F.array_min(F.array(*options)))
    return rows.select(
        *candidates.columns,
        F.col("_exit")["step"].alias("exit_step"),
        F.col("_exit")["price"].alias("exit_price"),
        F.col("_exit")["reason"].alias("reason"),
    )


def label_exits(
    entries: DataFrame, prices: DataFrame, stop_loss: float = STOP_LOSS, limit: int = HOLD_LIMIT
) -> DataFrame:
    """All exit rules on entries that may carry a recorded ``sell_step, sell_price``."""
    rows = time_limit_exit(stop_loss_exit(entries, prices, stop_loss, limit), prices, limit)
    # where steps are missing, the first one beyond the limit may be the one that loses too much
    late = F.col("stop_step").isNull() & ((F.col("limit_price") - F.col("entry_price")) / F.col("entry_price") < F.lit(-float(stop_loss)))
    late = late & (F.col("entry_price") > 0)
    step, price = F.when(late, F.col("limit_step")).otherwise(F.col("stop_step")), F.when(late, F.col("limit_price")).otherwise(F.col("stop_price"))
    rows = rows.withColumns({"stop_step": step, "stop_price": price})
    return resolve_exit(end_of_data_exit(rows, prices))


def exit_reason_mix(trades: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Trades, profit and mean return by exit reason."""
    return trades.groupBy(*(keys or []), "reason").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("realized_pnl").alias("total_pnl"),
        F.avg("return_pct").alias("mean_return"),
        F.count_if(F.col("reason") == "stop_loss").alias("stop_loss_exits"),
    )


def closed_trades(labelled: DataFrame, qty: Column, sell_fee: float) -> DataFrame:
    """Turn labelled exits into closed-trade records."""
    proceeds = qty * F.col("exit_price") * (1.0 - sell_fee)
    return labelled.select(
        "symbol", "entry_price", "exit_price", qty.alias("qty"), "entry_step", "exit_step",
        (proceeds - qty * F.col("entry_price")).alias("realized_pnl"),
        ratio(F.col("exit_price") - F.col("entry_price"), F.col("entry_price")).alias("return_pct"),
        "reason",
    )
