"""Cash, portfolio value, drawdown and the parts of the step reward.

Tables are keyed by ``(run, step)``.  Running values use chunked folds, so a run
of any length is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.numeric import floor_div, ratio
from tapeworks.operators.fills import INITIAL_CASH
from tapeworks.plans.series import CHUNK, UNBOUNDED, Fold, attach, chunked, number_rows, running, summarize, top_k, with_halo

#: Steps of a packed array of prices.
PIECE = 256

# Defaults of the reward terms.
MAX_DRAWDOWN = 0.20
EQUITY_SCALE = 100.0
INACTIVITY = -5.0
DRAWDOWN_PENALTY = 100.0
PROFIT_SCALE = 200.0
PROFIT_CAP = 100.0
UNREALIZED_DIVISOR = 200.0
DIVERSITY_BONUS = 0.1
BAD_SELL = -3.0
RATE_WINDOW = 240
RATE_MIN_WINDOW = 10
TARGET_RATE = 0.18
HISTORY_ROWS = 100


def running_cash(events: DataFrame, initial_cash: float = INITIAL_CASH, width: int = CHUNK) -> DataFrame:
    """Add ``cash`` after each step from the signed ``cash_delta`` of the step."""
    rows = running(events, ["run"], "step", {"cash": Fold("sum", F.col("cash_delta"))}, width)
    return rows.withColumn("cash", F.lit(float(initial_cash)) + F.col("cash"))


def holdings(lot_events: DataFrame, cash_delta: Column) -> DataFrame:
    """Lot events as ``run, sym, lot, entry_step, step, to_step, held, cash_delta``.

    ``held`` is what is held from the step of the event until just before the next event of
    its ``(run, sym)``, or up to the run's ``last_step``; null where nothing is.
    """
    open_ = (F.col("remaining") > 0) & ~((F.col("side") == "sell") & (F.col("pct") >= 1.0))
    return lot_events.select(
        "run", "sym", "lot", "entry_step", F.col("step").cast("bigint").alias("step"),
        F.when(open_, F.coalesce(F.col("next_step") - 1, F.col("last_step"))).cast("bigint").alias("to_step"),
        F.when(open_, F.col("remaining")).alias("held"), cash_delta.alias("cash_delta"),
    )


def _priced_pieces(moves: DataFrame, prices: DataFrame, size: int) -> DataFrame:
    """``moves`` in pieces of at most ``size`` steps, each with the prices of its piece.

    Prices are packed into one array per ``(sym, piece)``, null where a step has none, so a
    holding meets a few arrays in an equi-join instead of a row per step.  The first piece
    of a move carries its cash.
    """
    def fill(acc: Column, x: Column) -> Column:
        gap = F.pmod(x["step"], F.lit(size)) - F.size(acc)
        return F.concat(acc, F.array_repeat(F.lit(None).cast("double"), gap.cast("int")), F.array(x["close"]))

    path = F.array_sort(F.collect_list(F.struct(F.col("step").cast("bigint").alias("step"), F.col("close").cast("double").alias("close"))))
    packed = prices.groupBy("sym", floor_div(F.col("step"), size).alias("_piece")).agg(path.alias("_path"))
    packed = packed.select("sym", "_piece", F.aggregate("_path", F.array().cast("array<double>"), fill).alias("_closes"))
    own = floor_div(F.col("step"), size)
    last = F.greatest(own, floor_div(F.col("to_step"), size))
    cut = moves.withColumn("_piece", F.explode(F.sequence(own, F.coalesce(last, own))))
    start = F.col("_piece") * size
    cut = cut.withColumns({"_start": start, "_from": F.greatest(F.col("step"), start), "_to": F.when(F.col("to_step").isNotNull(), F.least(F.col("to_step"), start + size - 1))})
    return cut.join(packed, ["sym", "_piece"], "left")


def held_values(moves: DataFrame, prices: DataFrame, size: int = PIECE) -> DataFrame:
    """``run, sym, entry_step, step, held, close``: a row per step and open position."""
    rows = _priced_pieces(moves.where(F.col("held").isNotNull()), prices, size)
    at = rows.where(F.col("_from") <= F.col("_to")).withColumn("step", F.explode(F.sequence("_from", "_to")))
    return at.select("run", "sym", "entry_step", "step", "held", F.get("_closes", (F.col("step") - F.col("_start")).cast("int")).alias("close"))


def run_steps(sizes: DataFrame, width: int = CHUNK) -> DataFrame:
    """``run, step`` for the steps 1 to ``last_step`` of every run, made in chunks of ``width``."""
    chunks = sizes.select("run", "last_step", F.explode(F.sequence(F.lit(0).cast("bigint"), floor_div(F.col("last_step") - 1, width))).alias("_c"))
    first, last = F.col("_c") * width + 1, F.least(F.col("last_step"), (F.col("_c") + 1) * width)
    return chunks.select("run", F.explode(F.sequence(first, last)).alias("step"))


def mark_to_market(
    steps: DataFrame, moves: DataFrame, prices: DataFrame, initial_cash: float = INITIAL_CASH, width: int = CHUNK, size: int = PIECE
) -> DataFrame:
    """``run, step, cash, n_positions, position_value, portfolio_value`` for every row of ``steps(run, step)``.

    ``moves`` are :func:`holdings`, ``prices(sym, step, close)``; steps without a price leave
    the value null.  Steps, cash and held values meet in one shuffle by run and chunk of
    steps, where the cash is summed as well.
    """
    rows = _priced_pieces(moves, prices, size)
    part = F.struct  # step, cash, how many are held, their value, and how many have no price
    none = F.lit(None).cast("double")
    price = F.get("_closes", (F.col("_at") - F.col("_start")).cast("int"))
    spans = F.when(F.col("_from") <= F.col("_to"), F.sequence("_from", "_to")).otherwise(F.array().cast("array<bigint>"))
    spent = F.when(F.col("_from") == F.col("step"), F.array(part(F.col("step").alias("_at"), F.col("cash_delta").alias("cash"), F.lit(False).alias("held")))).otherwise(
        F.array().cast("array<struct<_at:bigint,cash:double,held:boolean>>"))
    spans = F.transform(spans, lambda x: part(x.alias("_at"), none.alias("cash"), F.lit(True).alias("held")))
    events = rows.select("run", "held", "_start", "_closes", F.inline(F.concat(spent, spans).cast("array<struct<_at:bigint,cash:double,is_held:boolean>>")))
    events = events.select(
        "run", F.col("_at").alias("step"), F.col("cash").alias("_cash"), F.when(F.col("is_held"), price * F.col("held")).alias("_worth"),
        F.col("is_held").cast("int").alias("_n"), (F.col("is_held") & price.isNull()).cast("int").alias("_unpriced"), F.lit(0).alias("_asked"),
    )
    asked = steps.select("run", F.col("step").cast("bigint").alias("step"), none.alias("_cash"), none.alias("_worth"), *[F.lit(v).alias(n) for n, v in (("_n", 0), ("_unpriced", 0), ("_asked", 1))])
    every = chunked(asked.unionByName(events), ["run"], floor_div(F.col("step"), width))
    columns = ["run", "step", "_cash", "_worth", "_n", "_unpriced", "_asked"]
    chunk = ["run", "_chunk"]
    moved = summarize(every, chunk, [F.sum("_cash").alias("_moved")], columns)
    before = Window.partitionBy("run").orderBy("_chunk").rowsBetween(UNBOUNDED, -1)
    carried = moved.select(*chunk, "_touch", F.coalesce(F.sum("_moved").over(before), F.lit(0.0)).alias("_carried"))
    at = every.groupBy(*chunk, "step").agg(
        F.coalesce(F.sum("_cash"), F.lit(0.0)).alias("_cash"), F.sum("_n").alias("n_positions"), F.coalesce(F.sum("_worth"), F.lit(0.0)).alias("_worth"),
        F.sum("_unpriced").alias("_unpriced"), F.max("_asked").alias("_asked"), F.bit_xor(F.xxhash64(*columns)).alias("_seen"),
    )
    so_far = Window.partitionBy(*chunk).orderBy("step").rowsBetween(UNBOUNDED, 0)
    at = attach(at.withColumn("_so_far", F.sum("_cash").over(so_far)), carried, chunk).where((F.col("_asked") == 1) & F.col("_seen").isNotNull())
    cash = F.lit(float(initial_cash)) + F.col("_carried") + F.col("_so_far")
    value = F.when(F.col("_unpriced") == 0, F.col("_worth"))
    return at.select("run", "step", cash.alias("cash"), "n_positions", value.alias("position_value"), (cash + value).alias("portfolio_value"))


def drawdown(equity: DataFrame, initial_cash: float = INITIAL_CASH, width: int = CHUNK) -> DataFrame:
    """Add the peak before and up to each step, and the drawdown from each of them."""
    pv = F.col("portfolio_value")
    rows = running(
        equity, ["run"], "step", {"peak_before": Fold("max", pv, False), "peak": Fold("max", pv)}, width
    )
    seed = F.lit(float(initial_cash))
    rows = rows.withColumn("peak_before", F.greatest(seed, F.col("peak_before")))
    rows = rows.withColumn("peak", F.greatest(seed, F.col("peak")))
    fall = F.greatest(F.lit(0.0), ratio(F.col("peak_before") - pv, F.col("peak_before")))
    return rows.withColumn("drawdown", ratio(F.col("peak") - pv, F.col("peak"))).withColumn("step_drawdown", fall)


def drawdown_breach(drawn: DataFrame, limit: float = MAX_DRAWDOWN) -> DataFrame:
    return drawn.where(F.col("step_drawdown") > limit)


def equity_delta_reward(
    drawn: DataFrame,
    initial_cash: float = INITIAL_CASH,
    scale: float = EQUITY_SCALE,
    drawdown_rate: float = 0.0,
    width: int = CHUNK,
) -> DataFrame:
    """Add ``equity_reward``: scaled change in value minus the continuous drawdown penalty.

    The value before a run's first step is its starting cash.
    """
    pv = F.col("portfolio_value")
    rows = running(drawn, ["run"], "step", {"prev_value": Fold("last", pv, False)}, width)
    prev = F.coalesce(F.col("prev_value"), F.lit(float(initial_cash)))
    delta = (pv - prev) / F.lit(max(1e-6, float(initial_cash)))
    return rows.withColumn("prev_value", prev).withColumn(
        "equity_reward", F.lit(float(scale)) * delta - F.lit(float(drawdown_rate)) * F.col("step_drawdown")
    )


def shaped_reward(
    drawn: DataFrame,
    initial_cash: float = INITIAL_CASH,
    inactivity: float = INACTIVITY,
    drawdown_penalty: float = DRAWDOWN_PENALTY,
    limit: float = MAX_DRAWDOWN,
    drawdown_rate: float = 0.0,
) -> DataFrame:
    """Add ``shaped_reward`` from ``held`` (no executable order), ``n_positions`` and drawdown."""
    n, gain = F.col("n_positions"), F.col("portfolio_value") - F.lit(float(initial_cash))
    terms = [
        F.when(F.col("held"), float(inactivity)),
        F.when((n > 0) & (gain > 0), gain / UNREALIZED_DIVISOR),
        F.when(F.col("step_drawdown") > limit, -float(drawdown_penalty)),
        -F.lit(float(drawdown_rate)) * F.col("step_drawdown"),
        F.when(n > 1, n * DIVERSITY_BONUS),
    ]
    return drawn.withColumn("shaped_reward", _total(terms))


def _total(terms: list[Column]) -> Column:
    return sum((F.coalesce(t, F.lit(0.0)) for t in terms), F.lit(0.0))


def sell_reward(sells: DataFrame, scale: float = PROFIT_SCALE, cap: float = PROFIT_CAP) -> DataFrame:
    """Profit is scaled and capped; the reward applied for anything else is a flat penalty."""
    pnl = F.col("realized_pnl")
    raw = F.when(pnl > 0, F.least(pnl * float(scale), F.lit(float(cap)))).otherwise(pnl)
    return sells.withColumn("sell_reward", raw).withColumn(
        "applied_reward", F.when(raw > 0, raw).otherwise(F.lit(BAD_SELL))
    )


def trade_rate(
    steps: DataFrame,
    window: int = RATE_WINDOW,
    target: float = TARGET_RATE,
    penalty: float = 0.0,
    width: int = CHUNK,
    size: int = 4096,
) -> DataFrame:
    """Share of executed steps among the last ``window`` rows, and the penalty above the target."""
    window = max(RATE_MIN_WINDOW, int(window))
    rows = number_rows(steps, ["run"], "step", width, name="_rn")
    rows = with_halo(rows, "_rn", max(size, window), window - 1)
    frame = Window.partitionBy("run", "_block").orderBy("_rn").rowsBetween(-(window - 1), 0)
    done = F.col("executed").cast("int")
    rows = rows.withColumn("trade_rate", F.avg(done).over(frame)).withColumn("_n", F.count(done).over(frame))
    aim = min(1.0, max(0.0, float(target)))
    over = (F.col("_n") >= RATE_MIN_WINDOW) & (F.col("trade_rate") > aim)
    cost = F.when(over, F.lit(float(penalty)) * (F.col("trade_rate") - aim)).otherwise(F.lit(0.0))
    return rows.withColumn("rate_penalty", cost).where(~F.col("_halo")).drop("_rn", "_n", "_block", "_halo")


def step_reward(steps: DataFrame, penalties: list[str], base: str) -> DataFrame:
    """``reward``: the base reward minus every penalty column present."""
    costs = _total([F.col(p) for p in penalties])
    return steps.withColumn("reward", F.coalesce(F.col(base), F.lit(0.0)) - costs)


def returns(snapshots: DataFrame, initial_cash: float = INITIAL_CASH) -> DataFrame:
    """Unrealized profit and total return from ``portfolio_value, realized_pnl``."""
    gain = F.col("portfolio_value") - F.lit(float(initial_cash))
    return snapshots.withColumn("unrealized_pnl", gain - F.col("realized_pnl")).withColumn(
        "total_return", gain / F.lit(float(initial_cash))
    )


def history_cap(equity: DataFrame, rows: int = HISTORY_ROWS) -> DataFrame:
    """Last rows of every run."""
    return top_k(equity, ["run"], [F.col("step").desc()], rows, ["step"])
