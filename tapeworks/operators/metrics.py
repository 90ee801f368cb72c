"""Run metrics, split payloads, fold summaries and trade summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.numeric import ratio
from tapeworks.operators.fills import INITIAL_CASH
from tapeworks.operators.telemetry import latest_value
from tapeworks.plans.medians import medians
from tapeworks.plans.series import top_k

# Shares that name a run without trades, the promotion floor, the
# line layout of summaries, and the number of listed trades.
HOLD_SHARE = 0.90
REMAP_SHARE = 0.25
PROMOTION_FLOOR = -0.75
SUMMARY_TAIL = "%3d | WR: %5.1f%% | Return: %6.2f%%"
TOP_TRADES = 5
COUNTED = {"redirected": "sell_redirects", "bootstrap": "bootstrap_buys", "constraint": "constraint_remaps"}


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(ratio(a.cast("double"), b.cast("double")), F.lit(0.0))


def run_metrics(steps: DataFrame, trades: DataFrame, initial_cash: float = INITIAL_CASH) -> DataFrame:
    """One row per ``(run, split)``.

    ``steps`` has ``step, reward, portfolio_value, n_positions, action,
    invalid_sell, remapped``; ``trades`` has ``side, realized_pnl, fee_paid``.
    Both sides are aggregated before they are joined.  Where ``steps`` has the flags
    ``redirected``, ``bootstrap`` or ``constraint`` they are counted, its ``cash`` gives
    the final cash, and a ``reason`` of ``trades`` the stop-loss exits.
    """
    keys = ["run", "split"]
    pv = F.col("portfolio_value")
    cash = F.lit(float(initial_cash))
    actions = {
        "hold_pct": F.col("action") == 0, "buy_pct": F.col("action") == 1, "sell_pct": F.col("action") == 2,
        "invalid_sell_pct": F.col("invalid_sell"), "remapped_action_pct": F.col("remapped"),
    }
    per_run = steps.groupBy(keys).agg(
        F.sum("reward").alias("total_reward"),
        F.max_by(pv, F.col("step")).alias("final_portfolio_value"),
        F.greatest(cash, F.max(pv)).alias("max_portfolio_value"),
        F.count(F.lit(1)).alias("steps"),
        F.max_by("n_positions", "step").alias("final_positions"),
        *[(F.count_if(c) / F.count(F.lit(1))).alias(n) for n, c in actions.items()],
        *[F.count_if(flag).alias(n) for flag, n in COUNTED.items() if flag in steps.columns],
        *([F.max_by("cash", "step").alias("cash")] if "cash" in steps.columns else []),
    )
    close = F.col("side") == "sell"
    won = close & (F.col("realized_pnl") >= 0)
    per_trade = trades.groupBy(keys).agg(
        F.count_if(F.col("side").isin("buy", "sell")).alias("trades"),
        F.count_if(won).alias("winning_trades"),
        F.count_if(close & ~won).alias("losing_trades"),
        F.coalesce(F.sum(F.when(close, F.col("realized_pnl"))), F.lit(0.0)).alias("realized_pnl"),
        F.sum("fee_paid").alias("fees_paid"),
        *([F.count_if(close & (F.col("reason") == "stop_loss")).alias("stop_loss_exits")] if "reason" in trades.columns else []),
    )
    rows = per_run.join(per_trade, keys, "left").na.fill(0, [c for c in per_trade.columns if c not in keys])
    gain = F.col("final_portfolio_value") - cash
    return (
        rows.withColumn("total_return", gain / cash)
        .withColumn("unrealized_pnl", gain - F.col("realized_pnl"))
        .withColumn("win_rate", _share(F.col("winning_trades"), F.col("trades")))
        .withColumn(
            "drawdown_pct",
            ratio(F.col("max_portfolio_value") - F.col("final_portfolio_value"), F.col("max_portfolio_value")),
        )
    )


def zero_trade_diagnostic(metrics: DataFrame) -> DataFrame:
    idle = (F.col("remapped_action_pct") >= REMAP_SHARE) | (F.col("invalid_sell_pct") >= REMAP_SHARE)
    name = (
        F.when(F.col("trades") > 0, "n/a")
        .when(F.col("hold_pct") >= HOLD_SHARE, "hold_dominant")
        .when(idle, "remap_or_invalid_dominant")
        .otherwise("mixed_low_activity")
    )
    return metrics.withColumn("zero_trade_diagnostic", name)


def trade_summary(trades: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Wins, losses, win rate, total and mean profit of closed trades."""
    pnl = F.col("realized_pnl")
    sums = trades.groupBy(keys or ["split"]).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(pnl >= 0).alias("wins"),
        F.count_if(pnl < 0).alias("losses"),
        F.sum(pnl).alias("total_pnl"),
        F.avg(pnl).alias("mean_pnl"),
    )
    return sums.withColumn("win_rate_pct", _share(F.col("wins"), F.col("n")) * 100)


def top_trades(
    trades: DataFrame, tie: list[Column], salt_on: list[str], keys: list[str] | None = None, k: int = TOP_TRADES
) -> DataFrame:
    """Best trades by profit with ``rank``; ``tie`` makes the order total."""
    return top_k(trades, keys or ["split"], [F.desc("realized_pnl"), *tie], k, salt_on, rank="rank")


def trade_line(trades: DataFrame) -> DataFrame:
    """One text line per ranked trade."""
    line = F.format_string(
        "%d. %-8s | Entry: $%10.6f → Exit: $%10.6f | Return: %6.2f%% | PnL: $%8.4f | Reason: %s",
        F.col("rank"), F.col("symbol"), F.col("entry_price"), F.col("exit_price"),
        F.col("return_pct") * 100, F.col("realized_pnl"), F.col("reason"),
    )
    return trades.withColumn("line", line)


def split_payload(metrics: DataFrame) -> DataFrame:
    """What a run document stores per split."""
    mean = F.col("total_reward") / F.greatest(F.lit(1), F.col("steps"))
    return metrics.select(
        "run", "split", "steps", "total_reward",
        mean.alias("avg_reward_per_step"), (-mean).alias("proxy_loss"),
        "final_portfolio_value", (F.col("total_return") * 100).alias("total_return_pct"),
        "trades", "winning_trades", "losing_trades",
        (F.col("win_rate") * 100).alias("win_rate_pct"), "realized_pnl", "unrealized_pnl",
    )


def final_summary(splits: DataFrame, finance: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """One row per run: the dev and test payloads combined, else the live figures.

    ``splits`` is :func:`split_payload`; ``finance`` has one row per run with the
    same figures taken while training.  Figures missing there are taken from the
    last points of the run's series, if ``points`` are given; figures the preferred
    split lacks are taken from there too, and 0 is the last resort.  A ``mode`` column
    of ``finance`` is kept.
    """
    if points is not None:
        traced = ["portfolio_value", "realized_pnl", "trades"]
        last = latest_value(points.where(F.col("key").isin(traced))).groupBy("run").agg(
            *[F.max(F.when(F.col("key") == k, F.col("value"))).alias(f"_last_{k}") for k in traced]
        )
        finance = finance.join(last, "run", "left").select(
            *[c for c in finance.columns if c not in traced],
            *[F.coalesce(F.col(k), F.col(f"_last_{k}").cast(finance.schema[k].dataType)).alias(k) for k in traced],
        )
    used = F.col("steps") > 0

    def of(split: str, c: str) -> Column:
        return F.max(F.when(F.col("split") == split, F.col(c)))

    single = ["final_portfolio_value", "total_return_pct", "unrealized_pnl", "win_rate_pct"]
    summed = ["trades", "winning_trades", "losing_trades", "realized_pnl"]
    per_run = splits.where(F.col("split").isin("dev", "test")).groupBy("run").agg(
        F.count_if(used).alias("_used"),
        *[F.sum(F.when(used, F.col(c))).alias(f"_{c}") for c in summed],
        F.count_if(F.col("split") == "test").alias("_has_test"),
        *[of(s, c).alias(f"_{s}_{c}") for s in ("dev", "test") for c in single],
    )
    rows = finance.join(per_run, "run", "left")
    combined = F.coalesce(F.col("_used"), F.lit(0)) > 0

    def preferred(c: str) -> Column:
        return F.when(F.col("_has_test") > 0, F.col(f"_test_{c}")).otherwise(F.col(f"_dev_{c}"))

    trades, wins, losses = F.col("_trades"), F.col("_winning_trades"), F.col("_losing_trades")
    derive = (wins == 0) & (losses == 0) & (trades > 0)
    derived = F.bround(preferred("win_rate_pct") / 100 * trades).cast("bigint")
    wins_out = F.when(derive, derived).otherwise(wins)
    losses_out = F.when(derive, F.greatest(F.lit(0), trades - derived)).otherwise(losses)
    rate = F.when(trades > 0, wins_out / trades * 100).otherwise(preferred("win_rate_pct"))

    def pick(c: Column, live: str) -> Column:
        return F.coalesce(F.when(combined, c), F.col(live), F.lit(0))

    source = F.when(F.col("_used") > 1, "dev+test aggregate").when(combined, "test/dev final")
    return rows.select(
        "run",
        *[c for c in ["mode"] if c in finance.columns],
        F.when(combined, "split_aggregate").otherwise("finance_snapshot").alias("kind"),
        pick(preferred("final_portfolio_value"), "portfolio_value").alias("portfolio_value"),
        pick(preferred("total_return_pct"), "total_return_pct").alias("total_return_pct"),
        pick(F.col("_realized_pnl"), "realized_pnl").alias("realized_pnl"),
        pick(preferred("unrealized_pnl"), "unrealized_pnl").alias("unrealized_pnl"),
        pick(trades, "trades").alias("trades"),
        pick(wins_out, "winning_trades").alias("winning_trades"),
        pick(losses_out, "losing_trades").alias("losing_trades"),
        pick(rate, "win_rate_pct").alias("win_rate_pct"),
        F.coalesce(source, F.lit("train/live snapshot")).alias("source"),
    )


def fold_summary(folds: DataFrame, floor_pct: float = PROMOTION_FLOOR) -> DataFrame:
    """Medians over the folds of a run and the promotion gate on its worst test return.

    ``folds`` has ``run, fold`` and ``val_/test_`` columns ``return, trades, win_rate``.
    """
    columns = {f"median_{s}_{m}": f"{s}_{m}" for m in ("return", "trades", "win_rate") for s in ("val", "test")}
    worst = folds.groupBy("run").agg((F.min("test_return") * 100.0).alias("min_test_return_pct"))
    rows = medians(folds, ["run"], columns).join(worst, "run")
    return rows.withColumn("gate_pass", F.col("min_test_return_pct") >= floor_pct)


def require_gate(summary: DataFrame) -> DataFrame:
    bad = summary.where(~F.col("gate_pass")).select("run").head()
    if bad:
        raise ValueError(f"promotion gate failed, first for run {bad['run']}")
    return summary


def summary_line(label: Column, trades: Column, win_rate: Column, total_return: Column) -> Column:
    """Text line as printed at the end of a run, e.g. ``Val Trades:   12 | WR:  50.0% | Return:   1.25%``."""
    text = F.format_string(
        "%-13s" + SUMMARY_TAIL, F.concat(label, F.lit(" Trades:")), trades, win_rate * 100, total_return * 100
    )
    return text
