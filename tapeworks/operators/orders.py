"""Order decoding and constraint audits over recorded decisions.

``decisions(run, step, a0, a1, a2, n_positions)``: action types are 0 hold,
1 buy, 2 sell.  Everything but the two audits that look back along a run is a
projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.numeric import clip
from tapeworks.plans.series import CHUNK, Fold, running, with_halo

HOLD, BUY, SELL = 0, 1, 2

# Defaults of the order rules.
DEADZONE = 0.15
BOOTSTRAP_PCT = 0.18
BOOTSTRAP_PENALTY = 0.05
MIN_PCT = 0.05
FORCED_PCT = 0.1
INVALID_SELL_PENALTY = 3.0


def _int(c: Column) -> Column:
    return c.cast("int")


def _symbol_and_pct(df: DataFrame, symbols: int) -> DataFrame:
    return df.withColumn("symbol_idx", _int(clip(F.col("a1"), 0.0, float(symbols - 1)))).withColumn(
        "pct", clip(F.col("a2"), 0.0, 1.0)
    )


def decode_legacy(decisions: DataFrame, symbols: int) -> DataFrame:
    return _symbol_and_pct(decisions, symbols).withColumn("action", _int(clip(F.col("a0"), 0.0, 2.0)))


def _intent() -> Column:
    return clip(F.col("a0"), -1.0, 1.0)


def decode_validity(decisions: DataFrame, symbols: int, deadzone: float = DEADZONE) -> DataFrame:
    zone = max(0.0, deadzone)
    action = (
        F.when(F.abs(_intent()) <= zone, HOLD)
        .when(_intent() > zone, BUY)
        .when(F.col("n_positions") > 0, SELL)
        .otherwise(HOLD)
    )
    return _symbol_and_pct(decisions, symbols).withColumn("action", action)


def decode_inventory(
    decisions: DataFrame,
    symbols: int,
    deadzone: float = DEADZONE,
    bootstrap_pct: float = BOOTSTRAP_PCT,
    bootstrap_penalty: float = BOOTSTRAP_PENALTY,
) -> DataFrame:
    """As the validity decoding, but a sell without any position becomes a starting buy."""
    zone = max(0.0, deadzone)
    start = (_intent() < -zone) & (F.col("n_positions") == 0)
    action = (
        F.when(F.abs(_intent()) <= zone, HOLD).when((_intent() > zone) | start, BUY).otherwise(SELL)
    )
    rows = _symbol_and_pct(decisions, symbols)
    return (
        rows.withColumn("bootstrap", start)
        .withColumn("action", action)
        .withColumn("pct", F.when(start, F.greatest(F.col("pct"), F.lit(bootstrap_pct))).otherwise(F.col("pct")))
        .withColumn("penalty", F.when(start, F.lit(bootstrap_penalty)).otherwise(F.lit(0.0)))
    )


def min_order_pct(orders: DataFrame) -> DataFrame:
    """Raise tiny order sizes; ``executable`` marks orders above the strict threshold."""
    size = F.when((F.col("action") > HOLD) & (F.col("pct") < MIN_PCT), FORCED_PCT).otherwise(F.col("pct"))
    return orders.withColumn("pct", size).withColumn(
        "executable", (F.col("action") > HOLD) & (F.col("pct") > MIN_PCT)
    )


def invalid_sell_remap(
    orders: DataFrame, mode: Column, penalty: Column | float = INVALID_SELL_PENALTY, inventory: bool = False
) -> DataFrame:
    """Sells without a position: count them, and turn them into buys or holds by ``mode``."""
    bad = F.lit(False) if inventory else (F.col("action") == SELL) & (F.col("n_positions") == 0)
    mode = F.lower(mode)
    mapped = F.when(mode == "hold", HOLD).when(mode == "penalize", SELL).otherwise(BUY)
    cost = F.abs(penalty if isinstance(penalty, Column) else F.lit(float(penalty)))
    return (
        orders.withColumn("invalid_sell", bad)
        .withColumn("remapped", bad)
        .withColumn("penalty", F.when(bad, cost).otherwise(F.lit(0.0)))
        .withColumn("action", F.when(bad, mapped).otherwise(F.col("action")))
    )


def sell_redirect(orders: DataFrame, positions: DataFrame, mode: str = "oldest") -> DataFrame:
    """Sells of a symbol not held go to the oldest or the largest held one.

    ``positions(run, step, symbol_idx, entry_step, notional)`` lists what is held
    when the order of that step is decided; a run opens at most one position per
    step, so the entry step also orders positions by insertion.  Only sells are
    joined, and positions are reduced to one row per ``(run, step)`` first.
    """
    held = F.col("symbol_idx")
    if mode == "largest_notional":
        rank = F.struct((-F.col("notional")).alias("a"), F.col("entry_step").alias("b"), held.alias("pick"))
    else:
        rank = F.struct(F.col("entry_step").alias("a"), held.alias("pick"))
    at = positions.groupBy("run", "step").agg(
        F.min(rank)["pick"].alias("_pick"), F.collect_set(held).alias("_held")
    )
    sells = orders.where(F.col("action") == SELL).join(at, ["run", "step"], "left")
    moved = F.col("_held").isNotNull() & ~F.array_contains("_held", F.col("symbol_idx"))
    sells = sells.withColumn("redirected", moved).withColumn(
        "symbol_idx", F.when(moved, F.col("_pick")).otherwise(F.col("symbol_idx"))
    )
    rest = orders.where(F.col("action") != SELL).withColumn("redirected", F.lit(False))
    return rest.unionByName(sells.drop("_pick", "_held"))


def action_mix(orders: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts and shares of holds, buys, sells, invalid sells and remapped orders."""
    counts = {
        "hold": F.col("action") == HOLD,
        "buy": F.col("action") == BUY,
        "sell": F.col("action") == SELL,
        "invalid_sell": F.col("invalid_sell"),
        "remapped": F.col("remapped"),
    }
    mix = orders.groupBy(keys or ["run"]).agg(
        *[F.count_if(c).alias(f"{n}_actions") for n, c in counts.items()]
    )
    taken = F.col("hold_actions") + F.col("buy_actions") + F.col("sell_actions")
    base = F.greatest(taken, F.lit(1)).cast("double")
    return mix.select("*", *[(F.col(f"{n}_actions") / base).alias(f"{n}_pct") for n in counts])


def audit_window_cap(trades: DataFrame, cap: int, window: int, size: int = CHUNK) -> DataFrame:
    """Flag trades with at least ``cap`` others in the ``window`` steps before them."""
    window = max(1, window)
    rows = with_halo(trades, "step", max(size, window), window)
    frame = Window.partitionBy("run", "_block").orderBy("step").rangeBetween(-(window - 1), -1)
    seen = F.count(F.lit(1)).over(frame)
    flagged = rows.withColumn("recent_trades", seen).where(~F.col("_halo")).drop("_block", "_halo")
    return flagged.withColumn("over_cap", F.lit(cap > 0) & (F.col("recent_trades") >= cap))


def audit_cooldown(trades: DataFrame, cooldown: int, width: int = CHUNK) -> DataFrame:
    """Flag trades closer than ``cooldown`` steps to the previous trade of the run."""
    rows = running(trades, ["run"], "step", {"prev_step": Fold("last", F.col("step"), False)}, width)
    near = F.coalesce(F.col("step") - F.col("prev_step") < cooldown, F.lit(False))
    return rows.withColumn("in_cooldown", F.lit(cooldown > 0) & near)


def audit_min_hold(closes: DataFrame, min_hold: int) -> DataFrame:
    """Flag closes held fewer than ``min_hold`` steps."""
    held = F.col("exit_step") - F.col("entry_step")
    return closes.withColumn("held_steps", held).withColumn("too_short", F.lit(min_hold > 0) & (held < min_hold))


def constraint_reason(
    audited: DataFrame, penalty: float, over_cap: str = "over_cap", in_cooldown: str = "in_cooldown",
    too_short: str = "too_short",
) -> DataFrame:
    """First violated rule, in the order window cap, cooldown, minimum hold."""
    reason = F.coalesce(
        F.when(F.col(over_cap), "trade_window_cap"),
        F.when(F.col(in_cooldown), "cooldown"),
        F.when(F.col(too_short), "min_hold"),
    )
    return audited.withColumn("reason", F.coalesce(reason, F.lit(""))).withColumn(
        "penalty", F.when(reason.isNotNull(), F.lit(float(penalty))).otherwise(F.lit(0.0))
    )
