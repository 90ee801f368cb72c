"""Fees, fills, lots and realized profit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.numeric import floor_div, hash_uniform, ratio
from tapeworks.operators.lot_states import dust_closings
from tapeworks.plans.series import CHUNK, UNBOUNDED, attach, chunked, summarize, top_k

# Fee presets (buy and sell alike), account limits, ledger length.
FEE_PRESETS = {"mexc_spot_mx": 0.0004, "legacy": 0.0010}
FEE_STANDARD = 0.0005
MAX_BUDGET = 20.0
MIN_POSITION = 5.0
INITIAL_CASH = 100.0
LEDGER_ROWS = 1000
DUST = 1e-8


def fee_profile(configs: DataFrame) -> DataFrame:
    """Resolve ``fee_regime, flat_cost, buy_fee, sell_fee`` (nullable) to rates per side.

    A flat cost of at least 0 wins, then rates per side, then the named preset.
    """
    flat = F.when(F.col("flat_cost") >= 0, F.col("flat_cost"))
    buy, sell = F.col("buy_fee"), F.col("sell_fee")
    sided = buy.isNotNull() | sell.isNotNull()
    regime = F.lower(F.coalesce(F.nullif(F.col("fee_regime"), F.lit("")), F.lit("mexc_spot_standard")))
    preset = F.lit(FEE_STANDARD)
    for name, rate in FEE_PRESETS.items():
        preset = F.when(regime == name, rate).otherwise(preset)

    def side(own: Column) -> Column:
        return (
            F.when(flat.isNotNull(), F.coalesce(own, flat))
            .when(sided, F.coalesce(own, F.lit(FEE_STANDARD)))
            .otherwise(preset)
        )

    rates = configs.withColumn("buy_fee_rate", side(buy)).withColumn("sell_fee_rate", side(sell))
    mean = (F.col("buy_fee_rate") + F.col("sell_fee_rate")) / 2.0
    return rates.withColumn("transaction_cost", F.coalesce(flat, mean))


def fee_jitter(episodes: DataFrame, jitter: float, seed: int = 0) -> DataFrame:
    """Fee multipliers per ``(run, episode)`` and side, the same on every evaluation."""
    j = max(0.0, jitter)
    low, high = max(0.01, 1.0 - j), 1.0 + j

    def draw(side: str) -> Column:
        if j == 0:
            return F.lit(1.0)
        u = hash_uniform(F.col("run"), F.col("episode"), F.lit(side), F.lit(seed))
        return F.lit(low) + u * F.lit(high - low)

    return episodes.withColumn("buy_multiplier", draw("buy")).withColumn("sell_multiplier", draw("sell"))


def effective_fee(rate: Column, flat: Column, multiplier: Column | None = None) -> Column:
    fee = F.coalesce(rate, flat)
    return fee if multiplier is None else fee * multiplier


def size_buy(
    orders: DataFrame, fee: Column | float, budget: float = MAX_BUDGET, least: float = MIN_POSITION
) -> DataFrame:
    """Add ``amount, fee_paid, qty, accepted`` from ``cash, pct, price``."""
    fee = fee if isinstance(fee, Column) else F.lit(float(fee))
    amount = F.least(F.col("cash") * F.col("pct"), F.lit(float(budget)))
    rows = orders.withColumn("amount", amount)
    return (
        rows.withColumn("accepted", F.col("amount") >= least)
        .withColumn("fee_paid", F.col("amount") * fee)
        .withColumn("qty", ratio(F.col("amount") * (1.0 - fee), F.col("price")))
    )


LOT_INPUT = ["run", "sym", "step", "side", "pct", "price", "qty"]


def lots(
    fills: DataFrame, width: int = CHUNK, carry: Sequence[str] = (), closes: str | None = None, least: float = DUST
) -> DataFrame:
    """Rebuild positions from ``run, sym, step, side, pct, price, qty`` (and columns to ``carry``).

    Holdings are not added to: a buy counts only if the last earlier buy or full
    sell of the same ``(run, sym)`` was a full sell, or there was none; a sell
    counts only while something is held.  The result has the accepted buys and
    sells with ``lot, entry_step, entry_price, qty0, qty`` (bought or sold),
    ``remaining`` and ``next_step``, that of the next row of the same ``(run, sym)``; ``dust`` marks a remainder below ``least`` after a partial sell.
    ``closes`` names a column that marks partial sells to end their lot.

    The work is two passes over one shuffle by ``(run, sym, chunk of steps)``: the
    first carries whether something is held into each chunk, the second carries
    the number of lots, the open entry and the share of it that is left.
    """
    keys, part = ["run", "sym"], ["run", "sym", "_chunk"]
    buy = F.col("side") == "buy"
    ends_lot = F.coalesce(F.col(closes), F.lit(False)) if closes else F.lit(False)
    full = (F.col("side") == "sell") & ((F.col("pct") >= 1.0) | ends_lot)
    state = F.when(buy, F.lit(1)).when(full, F.lit(0))
    columns = [*LOT_INPUT, *carry, *([closes] if closes else [])]
    rows = fills.where(F.col("side").isin("buy", "sell")).select(*columns)
    rows = chunked(rows, keys, floor_div(F.col("step"), width))
    in_chunk = Window.partitionBy(part).orderBy("step")
    chunks = Window.partitionBy(keys).orderBy("_chunk")
    earlier = chunks.rowsBetween(UNBOUNDED, -1)

    ends = summarize(rows, part, [F.max_by(state, F.when(state.isNotNull(), F.col("step"))).alias("_end")], columns)
    held_in = ends.select(*part, "_touch", F.last("_end", True).over(earlier).alias("_held_in"))
    known = F.last(state, True).over(in_chunk.rowsBetween(UNBOUNDED, -1))
    rows = attach(rows.withColumn("_known", known), held_in, part)
    held = F.coalesce(F.col("_known"), F.col("_held_in"), F.lit(0))
    rows = rows.where(F.when(buy, held == 0).otherwise(held == 1)).drop("_known", "_held_in")

    entry = {"entry_step": F.col("step"), "entry_price": F.col("price"), "qty0": F.col("qty")}
    so_far = in_chunk.rowsBetween(UNBOUNDED, 0)
    kept = F.when(buy, F.lit(1.0)).otherwise(F.greatest(1.0 - F.col("pct"), F.lit(0.0)))
    rows = rows.select(
        "*",
        F.count_if(buy).over(so_far).alias("_lots"),
        F.lead("step").over(in_chunk).alias("_next"),
        *[F.last(F.when(buy, c), True).over(so_far).alias(n) for n, c in entry.items()],
    )
    in_lot = Window.partitionBy(*part, "_lots").orderBy("step").rowsBetween(UNBOUNDED, -1)
    rows = rows.withColumn("_share", F.coalesce(F.product(kept).over(in_lot), F.lit(1.0)))

    bought = F.when(buy, F.col("step"))
    sums = summarize(
        rows,
        part,
        [
            F.count_if(buy).alias("_n"),
            F.min("step").alias("_begin"),
            F.max_by(F.col("_share") * kept, "step").alias("_tail"),
            *[F.max_by(c, bought).alias(f"_e_{n}") for n, c in entry.items()],
        ],
        columns,
    )
    sums = sums.withColumn("_run_of_chunks", F.count_if(F.col("_n") > 0).over(chunks.rowsBetween(UNBOUNDED, 0)))
    one_lot = Window.partitionBy(*keys, "_run_of_chunks").orderBy("_chunk").rowsBetween(UNBOUNDED, 0)
    sums = sums.withColumn("_open_share", F.product("_tail").over(one_lot))
    carried = sums.select(
        *part, "_touch",
        F.sum("_n").over(earlier).alias("_lots_in"),
        F.lag("_open_share").over(chunks).alias("_share_in"),
        F.lead("_begin").over(chunks).alias("_next_in"),
        *[F.last(f"_e_{n}", True).over(earlier).alias(f"_in_{n}") for n in entry],
    )
    rows = attach(rows, carried, part)
    carried_over = F.when(F.col("_lots") == 0, F.col("_share_in")).otherwise(F.lit(1.0))
    rows = rows.select(
        *[c for c in columns if c != "qty"],
        (F.coalesce(F.col("_lots_in"), F.lit(0)) + F.col("_lots")).alias("lot"),
        *[F.coalesce(F.col(n), F.col(f"_in_{n}")).alias(n) for n in entry],
        (F.col("_share") * carried_over).alias("_share"),
        F.coalesce("_next", "_next_in").alias("next_step"),
    )
    before = F.col("qty0") * F.col("_share")
    sold = F.when(F.col("pct") >= 1.0, before).otherwise(before * F.col("pct"))
    rows = rows.withColumn("qty", F.when(buy, F.col("qty0")).otherwise(sold))
    rows = rows.withColumn("remaining", F.when(buy, F.col("qty0")).otherwise(before - F.col("qty")))
    dust = ~buy & (F.col("pct") < 1.0) & (F.col("remaining") < least)
    return rows.withColumn("dust", dust).drop("_share")


def exact_lots(fills: DataFrame, width: int = CHUNK, carry: Sequence[str] = (), dust: float = DUST) -> DataFrame:
    """:func:`lots` where partial sells that leave less than ``dust`` close the lot.

    Those sells are found first, from composed state transitions; their lots then end
    like any other.  What such a sell leaves stays in ``remaining`` of its row.
    """
    closing = dust_closings(fills, dust, width).withColumn("_closes", F.lit(True))
    marked = fills.join(closing, ["run", "sym", "step"], "left")
    return lots(marked, width, carry, "_closes", dust).drop("_closes")


def realized(sells: DataFrame, fee: Column | float) -> DataFrame:
    """Profit of sells: the buy fee is already inside the quantity, the return is before fees."""
    fee = fee if isinstance(fee, Column) else F.lit(float(fee))
    gross = F.col("qty") * F.col("price")
    rows = sells.withColumn("gross", gross).withColumn("fee_paid", gross * fee)
    rows = rows.withColumn("proceeds", F.col("gross") - F.col("fee_paid"))
    return rows.withColumn("realized_pnl", F.col("proceeds") - F.col("qty") * F.col("entry_price")).withColumn(
        "return_pct", ratio(F.col("price") - F.col("entry_price"), F.col("entry_price"))
    )


def ledger_cap(trades: DataFrame, order: list[Column], salt_on: list[str], rows: int = LEDGER_ROWS) -> DataFrame:
    """Last ``rows`` closed trades per run; ``order`` is latest first and total."""
    return top_k(trades, ["run"], order, rows, salt_on)


def trade_counts(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Trades are buys and closes; ``win_rate`` is over both, ``close_win_rate`` over closes only."""
    buy, close = F.col("side") == "buy", F.col("side") == "sell"
    win = close & (F.col("realized_pnl") >= 0)
    counts = events.groupBy(keys or ["run"]).agg(
        F.count_if(buy | close).alias("trades"),
        F.count_if(close).alias("closes"),
        F.count_if(win).alias("winning_trades"),
        F.count_if(close & ~win).alias("losing_trades"),
    )

    def rate(base: str) -> Column:
        return F.coalesce(ratio(F.col("winning_trades").cast("double"), F.col(base).cast("double")), F.lit(0.0))

    return counts.withColumn("win_rate", rate("trades")).withColumn("close_win_rate", rate("closes"))


def turnover(
    events: DataFrame, initial_cash: float = INITIAL_CASH, penalty_rate: float = 0.0, notional: str = "notional"
) -> DataFrame:
    """Executed value over starting cash per run, and its penalty."""
    sums = events.groupBy("run").agg(F.sum(notional).alias("notional"))
    share = F.col("notional") / F.lit(max(1e-6, float(initial_cash)))
    return sums.withColumn("turnover", share).withColumn("penalty", share * F.lit(float(penalty_rate)))
