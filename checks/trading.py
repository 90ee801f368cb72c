"""Queries for orders, fills, exits, equity and run metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import tables as t
from checks.registry import query
from tapeworks.operators import equity as eq
from tapeworks.operators import exits as xt
from tapeworks.operators import fills as fi
from tapeworks.operators import metrics as me
from tapeworks.operators import orders as od

# ---------------------------------------------------------------- orders

IDX = "CAST(trunc(greatest(0, least(a1, 4))) AS INTEGER) AS symbol_idx"
PCT = "greatest(0, least(a2, 1))"


def legacy(spark, d):
    return t.decisions(spark, d).withColumn("a0", F.col("a0_legacy"))


@query("decode_legacy", f"""
    SELECT run, step, CAST(trunc(greatest(0, least(a0_legacy, 2))) AS INTEGER) AS action, {IDX}, {PCT} AS pct FROM decisions""", "pct")
def _(spark, d):
    return od.decode_legacy(legacy(spark, d), 5).select("run", "step", "action", "symbol_idx", "pct")


VALID = """CASE WHEN abs(a0) <= 0.15 THEN 0 WHEN a0 > 0.15 THEN 1 WHEN n_positions > 0 THEN 2 ELSE 0 END"""


@query("decode_validity", f"SELECT run, step, {VALID} AS action, {IDX}, {PCT} AS pct FROM decisions", "pct")
def _(spark, d):
    return od.decode_validity(t.decisions(spark, d), 5).select("run", "step", "action", "symbol_idx", "pct")


INVENTORY = f"""
    SELECT run, step, n_positions, {IDX},
           CASE WHEN abs(a0) <= 0.15 THEN 0 WHEN a0 > 0.15 OR n_positions = 0 THEN 1 ELSE 2 END AS action,
           a0 < -0.15 AND n_positions = 0 AS bootstrap,
           CASE WHEN a0 < -0.15 AND n_positions = 0 THEN greatest({PCT}, 0.18) ELSE {PCT} END AS pct,
           CASE WHEN a0 < -0.15 AND n_positions = 0 THEN 0.05::DOUBLE ELSE 0 END AS penalty FROM decisions"""


@query("decode_inventory", f"SELECT run, step, action, symbol_idx, bootstrap, pct, penalty FROM ({INVENTORY})", "pct penalty")
def _(spark, d):
    rows = od.decode_inventory(t.decisions(spark, d), 5)
    return rows.select("run", "step", "action", "symbol_idx", "bootstrap", "pct", "penalty")


@query("bootstrap_counts", f"SELECT run, count(*) FILTER (bootstrap) AS bootstraps, sum(penalty) AS penalty FROM ({INVENTORY}) GROUP BY run", "penalty")
def _(spark, d):
    rows = od.decode_inventory(t.decisions(spark, d), 5)
    return rows.groupBy("run").agg(F.count_if("bootstrap").alias("bootstraps"), F.sum("penalty").alias("penalty"))


MINPCT = f"""
    SELECT run, step, action, n_positions, mode, CASE WHEN action > 0 AND pct < 0.05 THEN 0.1::DOUBLE ELSE pct END AS pct
    FROM (SELECT run, step, n_positions, {PCT} AS pct, CAST(trunc(greatest(0, least(a0_legacy, 2))) AS INTEGER) AS action,
          CASE run % 4 WHEN 0 THEN 'force_buy' WHEN 1 THEN 'Hold' WHEN 2 THEN 'penalize' ELSE 'other' END AS mode
          FROM decisions)"""


@query("min_order_pct", f"SELECT run, step, action, pct, action > 0 AND pct > 0.05 AS executable FROM ({MINPCT})", "pct")
def _(spark, d):
    rows = od.min_order_pct(od.decode_legacy(legacy(spark, d), 5))
    return rows.select("run", "step", "action", "pct", "executable")


REMAP = f"""
    SELECT run, step, action = 2 AND n_positions = 0 AS invalid_sell, action = 2 AND n_positions = 0 AS remapped,
           CASE WHEN action = 2 AND n_positions = 0 THEN 3.0::DOUBLE ELSE 0 END AS penalty,
           CASE WHEN action = 2 AND n_positions = 0 THEN
             CASE mode WHEN 'Hold' THEN 0 WHEN 'penalize' THEN 2 ELSE 1 END ELSE action END AS action
    FROM ({MINPCT})"""


def remapped(spark, d):
    rows = od.min_order_pct(od.decode_legacy(legacy(spark, d), 5))
    mode = F.element_at(F.array(*[F.lit(m) for m in ("force_buy", "Hold", "penalize", "other")]), (F.col("run") % 4 + 1).cast("int"))
    return od.invalid_sell_remap(rows, mode, -3.0)


@query("invalid_sell_remap", f"SELECT run, step, action, invalid_sell, remapped, penalty FROM ({REMAP})", "penalty")
def _(spark, d):
    return remapped(spark, d).select("run", "step", "action", "invalid_sell", "remapped", "penalty")


HELD_NOW = """
    SELECT h.run, h.step + 1 AS step, h.sym, h.entry_step, h.qty * p.close AS notional
    FROM held h JOIN (SELECT idx, step, close FROM aligned JOIN symbol_ids USING (symbol)) p ON p.idx = h.sym AND p.step = h.step"""


def redirect(name, mode, order):
    @query(name, f"""
    WITH asks AS (SELECT run, step, action, symbol_idx FROM ({INVENTORY})),
         now_held AS ({HELD_NOW}),
         chosen AS (SELECT run, step, first(sym ORDER BY {order}) AS pick, list(sym) AS syms FROM now_held GROUP BY run, step)
    SELECT a.run, a.step, action, coalesce(action = 2 AND syms IS NOT NULL AND NOT list_contains(syms, symbol_idx), false) AS redirected,
           CASE WHEN action = 2 AND syms IS NOT NULL AND NOT list_contains(syms, symbol_idx) THEN pick ELSE symbol_idx END AS symbol_idx
    FROM asks a LEFT JOIN chosen c ON a.run = c.run AND a.step = c.step""")
    def _(spark, d):
        asks = od.decode_inventory(t.decisions(spark, d), 5).select("run", "step", "action", "symbol_idx")
        held = eq.held_values(t.moves(spark, d), t.run_prices(spark, d)).where(F.col("close").isNotNull())
        positions = held.select(
            "run", (F.col("step") + 1).alias("step"), F.col("sym").alias("symbol_idx"), "entry_step",
            (F.col("held") * F.col("close")).alias("notional"),
        )
        return od.sell_redirect(asks, positions, mode).select("run", "step", "action", "redirected", "symbol_idx")


redirect("sell_redirect", "oldest", "entry_step, sym")
redirect("sell_redirect_largest", "largest_notional", "notional DESC, entry_step, sym")

KINDS = {"hold": "action = 0", "buy": "action = 1", "sell": "action = 2", "invalid_sell": "invalid_sell", "remapped": "remapped"}


@query("action_mix", "SELECT run, " + ", ".join(
    f"count(*) FILTER ({c}) AS {n}_actions, count(*) FILTER ({c}) / count(*)::DOUBLE AS {n}_pct" for n, c in KINDS.items())
    + f" FROM ({REMAP}) GROUP BY run", " ".join(f"{n}_pct" for n in KINDS))
def _(spark, d):
    return od.action_mix(remapped(spark, d))


CAP, WINDOW, COOLDOWN, MIN_HOLD = 2, 6, 3, 4


@query("audit_window_cap", f"""
    SELECT run, step, count(*) OVER w AS recent_trades, count(*) OVER w >= {CAP} AS over_cap FROM lots
    WINDOW w AS (PARTITION BY run ORDER BY step RANGE BETWEEN {WINDOW - 1} PRECEDING AND 1 PRECEDING)""")
def _(spark, d):
    rows = t.lots(spark, d).select("run", "step")
    return od.audit_window_cap(rows, CAP, WINDOW)


@query("audit_cooldown", f"""
    SELECT run, step, coalesce(step - lag(step) OVER (PARTITION BY run ORDER BY step) < {COOLDOWN}, false) AS in_cooldown FROM lots""")
def _(spark, d):
    rows = od.audit_cooldown(t.lots(spark, d).select("run", "step"), COOLDOWN)
    return rows.select("run", "step", "in_cooldown")


@query("audit_min_hold", f"""
    SELECT run, sym, step AS exit_step, entry_step, step - entry_step AS held_steps, step - entry_step < {MIN_HOLD} AS too_short
    FROM lots WHERE side = 'sell'""")
def _(spark, d):
    rows = t.lots(spark, d).where("side = 'sell'").select("run", "sym", F.col("step").alias("exit_step"), "entry_step")
    return od.audit_min_hold(rows, MIN_HOLD)


@query("constraint_reason", f"""
    SELECT run, step, CASE WHEN n >= {CAP} THEN 'trade_window_cap' WHEN gap < {COOLDOWN} THEN 'cooldown'
                           WHEN side = 'sell' AND step - entry_step < {MIN_HOLD} THEN 'min_hold' ELSE '' END AS reason,
           CASE WHEN n >= {CAP} OR gap < {COOLDOWN} OR (side = 'sell' AND step - entry_step < {MIN_HOLD}) THEN 0.5::DOUBLE ELSE 0 END AS penalty
    FROM (SELECT *, step - lag(step) OVER (PARTITION BY run ORDER BY step) AS gap,
                 count(*) OVER (PARTITION BY run ORDER BY step RANGE BETWEEN {WINDOW - 1} PRECEDING AND 1 PRECEDING) AS n FROM lots)""",
       "penalty")
def _(spark, d):
    rows = t.lots(spark, d).select("run", "step", "side", "entry_step", F.col("step").alias("exit_step"))
    rows = od.audit_cooldown(od.audit_window_cap(rows, CAP, WINDOW), COOLDOWN)
    rows = od.audit_min_hold(rows, MIN_HOLD)
    rows = rows.withColumn("too_short", F.col("too_short") & (F.col("side") == "sell"))
    return od.constraint_reason(rows, 0.5).select("run", "step", "reason", "penalty")


# ---------------------------------------------------------------- fees and fills

CONFIG = """
    SELECT s_suppkey AS run, CASE s_suppkey % 4 WHEN 0 THEN 'mexc_spot_mx' WHEN 1 THEN 'LEGACY' WHEN 2 THEN '' ELSE 'other' END AS fee_regime,
           CASE WHEN s_suppkey % 5 = 0 THEN s_nationkey / 10000.0::DOUBLE WHEN s_suppkey % 5 = 1 THEN -1.0::DOUBLE END AS flat_cost,
           CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey / 20000.0::DOUBLE END AS buy_fee,
           CASE WHEN s_suppkey % 7 = 0 THEN s_nationkey / 30000.0::DOUBLE END AS sell_fee FROM supplier"""


def configs(spark, d):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    return t.table(spark, d, "supplier").select(
        k.alias("run"),
        F.when(k % 4 == 0, "mexc_spot_mx").when(k % 4 == 1, "LEGACY").when(k % 4 == 2, "").otherwise("other").alias("fee_regime"),
        F.when(k % 5 == 0, n / 10000.0).when(k % 5 == 1, -1.0).alias("flat_cost"),
        F.when(k % 3 == 0, n / 20000.0).alias("buy_fee"), F.when(k % 7 == 0, n / 30000.0).alias("sell_fee"),
    )


PROFILE = f"""
    SELECT run, b AS buy_fee_rate, s AS sell_fee_rate, CASE WHEN flat_cost >= 0 THEN flat_cost ELSE (b + s) / 2 END AS transaction_cost FROM (
      SELECT *, CASE WHEN flat_cost >= 0 THEN coalesce(buy_fee, flat_cost) WHEN sided THEN coalesce(buy_fee, 0.0005) ELSE preset END AS b,
             CASE WHEN flat_cost >= 0 THEN coalesce(sell_fee, flat_cost) WHEN sided THEN coalesce(sell_fee, 0.0005) ELSE preset END AS s
      FROM (SELECT *, buy_fee IS NOT NULL OR sell_fee IS NOT NULL AS sided,
            CASE lower(fee_regime) WHEN 'mexc_spot_mx' THEN 0.0004::DOUBLE WHEN 'legacy' THEN 0.001::DOUBLE ELSE 0.0005::DOUBLE END AS preset
            FROM ({CONFIG})))"""


@query("fee_profile", PROFILE, "buy_fee_rate sell_fee_rate transaction_cost")
def _(spark, d):
    return fi.fee_profile(configs(spark, d)).select("run", "buy_fee_rate", "sell_fee_rate", "transaction_cost")


def multiplier(side):
    return f"0.8::DOUBLE + CAST(concat('0x', substr(md5(concat(run, '|0|{side}|3')), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496 * 0.4::DOUBLE"


@query("fee_jitter", f"""
    SELECT run, 0 AS episode, {multiplier('buy')} AS buy_multiplier, {multiplier('sell')} AS sell_multiplier
    FROM (SELECT DISTINCT user_id AS run FROM events)""", "buy_multiplier sell_multiplier")
def _(spark, d):
    runs = t.table(spark, d, "events").select(F.col("user_id").alias("run")).distinct()
    return fi.fee_jitter(runs.withColumn("episode", F.lit(0)), 0.2, seed=3)


@query("effective_fee", f"""
    SELECT run, coalesce(buy_fee, flat_cost, 0.001) * 1.25::DOUBLE AS buy, coalesce(sell_fee, flat_cost, 0.001) AS sell FROM ({CONFIG})""", "buy sell")
def _(spark, d):
    flat = F.coalesce(F.col("flat_cost"), F.lit(0.001))
    return configs(spark, d).select(
        "run", fi.effective_fee(F.col("buy_fee"), flat, F.lit(1.25)).alias("buy"),
        fi.effective_fee(F.col("sell_fee"), flat).alias("sell"),
    )


@query("size_buy", """
    SELECT run, step, amount, amount >= 5 AS accepted, amount * 0.001::DOUBLE AS fee_paid, qty FROM sized WHERE side = 'buy'""",
       "amount fee_paid qty")
def _(spark, d):
    rows = fi.size_buy(t.all_fills(spark, d).where("side = 'buy'"), t.FEE)
    return rows.select("run", "step", "amount", "accepted", "fee_paid", "qty")


@query("lots", "SELECT run, sym, step, side, CAST(lot AS BIGINT) AS lot, entry_step, entry_price, qty0, qty, remaining FROM lots",
       "entry_price qty0 qty remaining")
def _(spark, d):
    return t.lots(spark, d).select("run", "sym", "step", "side", "lot", "entry_step", "entry_price", "qty0", "qty", "remaining")


DUST = 0.02

WALK = f"""
    ordered AS (SELECT run, sym, step, side, pct, price, qty, row_number() OVER (PARTITION BY run, sym ORDER BY step) AS i FROM fills),
    walk AS (
      SELECT DISTINCT run, sym, 0::BIGINT AS i, NULL::BIGINT AS step, NULL::VARCHAR AS side, false AS held, false AS taken, 0::BIGINT AS lot,
             NULL::BIGINT AS entry_step, NULL::DOUBLE AS entry_price, NULL::DOUBLE AS qty0, 0.0::DOUBLE AS qty, 0.0::DOUBLE AS remaining, false AS closed FROM fills
      UNION ALL
      SELECT run, sym, i, step, side, CASE WHEN side = 'buy' THEN true WHEN NOT held THEN false ELSE NOT (pct >= 1 OR remaining - sold < {DUST}) END,
             CASE WHEN side = 'buy' THEN NOT held ELSE held END, CASE WHEN opens THEN lot + 1 ELSE lot END,
             CASE WHEN opens THEN step ELSE entry_step END, CASE WHEN opens THEN price ELSE entry_price END, CASE WHEN opens THEN q ELSE qty0 END,
             CASE WHEN side = 'buy' THEN q ELSE sold END, CASE WHEN opens THEN q WHEN side = 'buy' THEN remaining ELSE remaining - sold END,
             side = 'sell' AND held AND (pct >= 1 OR remaining - sold < {DUST})
      FROM (SELECT w.run, w.sym, o.i, o.step, o.side, o.pct, o.price, o.qty AS q, w.held, w.lot, w.entry_step, w.entry_price, w.qty0, w.remaining,
                   o.side = 'buy' AND NOT w.held AS opens, CASE WHEN o.pct >= 1 THEN w.remaining ELSE w.remaining * o.pct END AS sold
            FROM walk w JOIN ordered o ON o.run = w.run AND o.sym = w.sym AND o.i = w.i + 1))"""


@query("lots_exact", "SELECT run, sym, step, side, lot, entry_step, entry_price, qty0, qty, remaining, closed FROM walk WHERE taken",
       "entry_price qty0 qty remaining", WALK)
def _(spark, d):
    rows = fi.exact_lots(t.fills(spark, d), dust=DUST)
    closed = (F.col("side") == "sell") & ((F.col("pct") >= 1) | F.col("dust"))
    return rows.select("run", "sym", "step", "side", "lot", "entry_step", "entry_price", "qty0", "qty", "remaining", closed.alias("closed"))


@query("realized_pnl", """
    SELECT run, sym, step, gross, fee_paid, gross - fee_paid AS proceeds, realized_pnl, (price - entry_price) / entry_price AS return_pct
    FROM lot_pnl WHERE side = 'sell'""", "gross fee_paid proceeds realized_pnl return_pct")
def _(spark, d):
    rows = fi.realized(t.lots(spark, d).where("side = 'sell'"), t.FEE)
    return rows.select("run", "sym", "step", "gross", "fee_paid", "proceeds", "realized_pnl", "return_pct")


TIE = ", ".join(t.TRADE_TIE)


@query("ledger_cap", f"""
    SELECT run, exit_step, l_orderkey, l_linenumber, realized_pnl FROM (
      SELECT *, row_number() OVER (PARTITION BY run ORDER BY exit_step DESC, {TIE}) AS r FROM closed_trades) WHERE r <= 250""", "realized_pnl")
def _(spark, d):
    order = [F.desc("exit_step"), *[F.asc(c) for c in t.TRADE_TIE]]
    rows = fi.ledger_cap(t.closed_trades(spark, d), order, ["l_orderkey", "l_partkey"], 250)
    return rows.select("run", "exit_step", "l_orderkey", "l_linenumber", "realized_pnl")


@query("trade_counts", """
    SELECT run, count(*) AS trades, count(*) FILTER (side = 'sell') AS closes, count(*) FILTER (realized_pnl >= 0) AS winning_trades,
           count(*) FILTER (realized_pnl < 0) AS losing_trades, count(*) FILTER (realized_pnl >= 0) / count(*)::DOUBLE AS win_rate,
           coalesce(count(*) FILTER (realized_pnl >= 0) / nullif(count(*) FILTER (side = 'sell'), 0)::DOUBLE, 0) AS close_win_rate
    FROM lot_pnl GROUP BY run""", "win_rate close_win_rate")
def _(spark, d):
    return fi.trade_counts(t.lot_pnl(spark, d))


@query("turnover", """
    SELECT run, sum(n) AS notional, sum(n) / 100 AS turnover, sum(n) / 100 * 0.02::DOUBLE AS penalty
    FROM (SELECT run, CASE WHEN side = 'buy' THEN amount ELSE gross END AS n FROM lot_pnl) GROUP BY run""", "notional turnover penalty")
def _(spark, d):
    rows = t.lot_pnl(spark, d).withColumn("notional", F.coalesce("gross", "amount"))
    return fi.turnover(rows.withColumn("notional", F.when(F.col("side") == "buy", F.col("amount")).otherwise(F.col("gross"))), 100.0, 0.02)


# ---------------------------------------------------------------- exits

LOSS, LIMIT = 0.3, 12

STOPS = f"""
    SELECT e.symbol, e.entry_step, e.entry_price, min(p.step) AS stop_step, arg_min(p.close, p.step) AS stop_price
    FROM entries e LEFT JOIN prices p ON p.symbol = e.symbol AND p.step > e.entry_step AND p.step <= e.entry_step + {LIMIT + 1}
      AND (p.close - e.entry_price) / e.entry_price < -{LOSS}::DOUBLE
    GROUP BY e.symbol, e.entry_step, e.entry_price"""


@query("stop_loss_exit", STOPS, "entry_price stop_price")
def _(spark, d):
    return xt.stop_loss_exit(t.entries(spark, d), t.prices(spark, d), LOSS, LIMIT)


@query("time_limit_exit", f"""
    SELECT e.symbol, entry_step, entry_price, p.step AS limit_step, p.close AS limit_price
    FROM entries e LEFT JOIN prices p ON p.symbol = e.symbol AND p.step = entry_step + {LIMIT + 1}""", "entry_price limit_price")
def _(spark, d):
    return xt.time_limit_exit(t.entries(spark, d), t.prices(spark, d), LIMIT)


LAST = "(SELECT symbol, max(step) AS end_step, arg_max(close, step) AS end_price FROM prices GROUP BY symbol)"


@query("end_of_data_exit", f"SELECT e.symbol, entry_step, entry_price, end_step, end_price FROM entries e JOIN {LAST} USING (symbol)",
       "entry_price end_price")
def _(spark, d):
    return xt.end_of_data_exit(t.entries(spark, d), t.prices(spark, d))


def with_sells(entries, prices):
    """Every third entry is sold a few steps later, where a price exists."""
    rows = entries.withColumn(
        "_at", F.when(F.col("entry_step") % 3 == 0, F.col("entry_step") + 1 + F.col("entry_step") % 7)
    )
    at = prices.select("symbol", F.col("step").alias("_at"), F.col("close").alias("sell_price"))
    rows = rows.join(at, ["symbol", "_at"], "left")
    return rows.withColumn("sell_step", F.when(F.col("sell_price").isNotNull(), F.col("_at"))).drop("_at")


LABELS = f"""
    WITH sells AS (SELECT e.symbol, entry_step, p.step AS sell_step, p.close AS sell_price FROM entries e JOIN prices p
                   ON p.symbol = e.symbol AND entry_step % 3 = 0 AND p.step = entry_step + 1 + entry_step % 7),
    options AS (
      SELECT symbol, entry_step, sell_step AS step, 0 AS o, sell_price AS price, 'sell' AS reason FROM sells
      UNION ALL SELECT symbol, entry_step, stop_step, 1, stop_price, 'stop_loss' FROM ({STOPS}) WHERE stop_step IS NOT NULL
      UNION ALL SELECT e.symbol, entry_step, p.step, 2, p.close, 'time_limit' FROM entries e JOIN prices p
                ON p.symbol = e.symbol AND p.step = entry_step + {LIMIT + 1}
      UNION ALL SELECT symbol, entry_step, end_step, 3, end_price, 'end_of_episode' FROM entries JOIN {LAST} USING (symbol)),
    best AS (SELECT *, row_number() OVER (PARTITION BY symbol, entry_step ORDER BY step, o) AS r FROM options)
    SELECT e.symbol, e.entry_step, e.entry_price, b.step AS exit_step, b.price AS exit_price, b.reason
    FROM entries e JOIN best b ON e.symbol = b.symbol AND e.entry_step = b.entry_step AND r = 1"""


def labelled(spark, d):
    prices = t.prices(spark, d)
    return xt.label_exits(with_sells(t.entries(spark, d), prices), prices, LOSS, LIMIT)


@query("resolve_exit", LABELS, "entry_price exit_price")
def _(spark, d):
    return labelled(spark, d).select("symbol", "entry_step", "entry_price", "exit_step", "exit_price", "reason")


@query("exit_reason_mix", """
    SELECT run, reason, count(*) AS n, sum(realized_pnl) AS total_pnl, avg(return_pct) AS mean_return,
           count(*) FILTER (reason = 'stop_loss') AS stop_loss_exits FROM closed_trades GROUP BY run, reason""", "total_pnl mean_return")
def _(spark, d):
    return xt.exit_reason_mix(t.closed_trades(spark, d), ["run"])


@query("exit_trades", f"""
    SELECT symbol, reason, count(*) AS n, sum(2 * exit_price * 0.999::DOUBLE - 2 * entry_price) AS total_pnl,
           avg((exit_price - entry_price) / entry_price) AS mean_return,
           count(*) FILTER (reason = 'stop_loss') AS stop_loss_exits FROM ({LABELS}) GROUP BY symbol, reason""", "total_pnl mean_return")
def _(spark, d):
    return xt.exit_reason_mix(xt.closed_trades(labelled(spark, d), F.lit(2.0), t.FEE), ["symbol"])


# ---------------------------------------------------------------- equity

CASH = "SELECT run, step, 100 + sum(cash_delta) OVER (PARTITION BY run ORDER BY step) AS cash FROM cash_flow"


@query("running_cash", CASH, "cash")
def _(spark, d):
    return eq.running_cash(t.cash_flow(spark, d)).select("run", "step", "cash")


@query("mark_to_market", f"""
    SELECT c.run, c.step, cash, coalesce(n_positions, 0) AS n_positions, coalesce(v, 0) AS position_value,
           cash + coalesce(v, 0) AS portfolio_value
    FROM ({CASH}) c LEFT JOIN (
      SELECT run, h.step, count(*) AS n_positions, sum(qty * close) AS v
      FROM held h JOIN (SELECT idx, step, close FROM aligned JOIN symbol_ids USING (symbol)) p ON p.idx = h.sym AND p.step = h.step
      GROUP BY run, h.step) m ON c.run = m.run AND c.step = m.step""", "cash position_value portfolio_value")
def _(spark, d):
    return eq.mark_to_market(t.run_steps(spark, d), t.moves(spark, d), t.run_prices(spark, d))


@query("peak_drawdown", "SELECT run, step, peak_before, peak, drawdown, step_drawdown FROM dd", "peak_before peak drawdown step_drawdown")
def _(spark, d):
    return t.drawn(spark, d).select("run", "step", "peak_before", "peak", "drawdown", "step_drawdown")


@query("max_drawdown_breach", "SELECT run, step, step_drawdown FROM dd WHERE step_drawdown > 0.2", "step_drawdown")
def _(spark, d):
    return eq.drawdown_breach(t.drawn(spark, d)).select("run", "step", "step_drawdown")


DELTA = """
    SELECT *, coalesce(lag(portfolio_value) OVER (PARTITION BY run ORDER BY step), 100) AS prev_value,
           (portfolio_value - coalesce(lag(portfolio_value) OVER (PARTITION BY run ORDER BY step), 100)) - 1.5::DOUBLE * step_drawdown
             AS equity_reward FROM dd"""


def delta(spark, d):
    return eq.equity_delta_reward(t.drawn(spark, d), drawdown_rate=1.5)


@query("equity_delta_reward", f"SELECT run, step, prev_value, equity_reward FROM ({DELTA})", "prev_value equity_reward")
def _(spark, d):
    return delta(spark, d).select("run", "step", "prev_value", "equity_reward")


@query("shaped_reward", """
    SELECT run, step, CASE WHEN held THEN -5 ELSE 0 END
           + CASE WHEN n_positions > 0 AND portfolio_value > 100 THEN (portfolio_value - 100) / 200 ELSE 0 END
           - CASE WHEN step_drawdown > 0.2 THEN 100 ELSE 0 END - 2 * step_drawdown
           + CASE WHEN n_positions > 1 THEN n_positions * 0.1::DOUBLE ELSE 0 END AS shaped_reward FROM dd""", "shaped_reward")
def _(spark, d):
    return eq.shaped_reward(t.drawn(spark, d), drawdown_rate=2.0).select("run", "step", "shaped_reward")


@query("sell_reward", """
    SELECT run, l_orderkey, l_linenumber, l_partkey,
           CASE WHEN realized_pnl > 0 THEN least(realized_pnl * 200, 100) ELSE realized_pnl END AS sell_reward,
           CASE WHEN realized_pnl > 0 THEN least(realized_pnl * 200, 100) ELSE -3 END AS applied_reward FROM closed_trades""",
       "sell_reward applied_reward")
def _(spark, d):
    rows = eq.sell_reward(t.closed_trades(spark, d))
    return rows.select("run", "l_orderkey", "l_linenumber", "l_partkey", "sell_reward", "applied_reward")


RATE = """
    SELECT *, CASE WHEN seen >= 10 AND trade_rate > 0.6 THEN 3 * (trade_rate - 0.6::DOUBLE) ELSE 0 END AS rate_penalty FROM (
      SELECT *, avg(executed::INTEGER) OVER w AS trade_rate, count(*) OVER w AS seen FROM equity
      WINDOW w AS (PARTITION BY run ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""


@query("trade_rate", f"SELECT run, step, trade_rate, rate_penalty FROM ({RATE})", "trade_rate rate_penalty")
def _(spark, d):
    return eq.trade_rate(t.equity(spark, d), 20, 0.6, 3.0).select("run", "step", "trade_rate", "rate_penalty")


@query("step_reward", f"""
    SELECT a.run, a.step, a.equity_reward - b.rate_penalty - a.notional / 100 * 0.02::DOUBLE AS reward
    FROM ({DELTA}) a JOIN ({RATE}) b ON a.run = b.run AND a.step = b.step""", "reward")
def _(spark, d):
    rows = eq.trade_rate(delta(spark, d), 20, 0.6, 3.0)
    rows = rows.withColumn("turnover_penalty", F.col("notional") / 100 * 0.02)
    return eq.step_reward(rows, ["rate_penalty", "turnover_penalty"], "equity_reward").select("run", "step", "reward")


@query("returns", """
    SELECT run, portfolio_value - 100 - coalesce(realized_pnl, 0) AS unrealized_pnl, (portfolio_value - 100) / 100 AS total_return FROM finance""",
       "unrealized_pnl total_return")
def _(spark, d):
    return eq.returns(t.finance(spark, d).na.fill(0.0, ["realized_pnl"])).select("run", "unrealized_pnl", "total_return")


@query("history_cap", """
    SELECT run, step, portfolio_value FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS r FROM equity) WHERE r <= 40""",
       "portfolio_value")
def _(spark, d):
    return eq.history_cap(t.equity(spark, d), 40).select("run", "step", "portfolio_value")


# ---------------------------------------------------------------- metrics

SPLIT = "CASE WHEN step % 2 = 0 THEN 'dev' ELSE 'test' END"

METRICS = f"""
    WITH acts AS (SELECT run, step, action, invalid_sell, remapped FROM ({REMAP})),
    s AS (SELECT e.run, {SPLIT.replace('step', 'e.step')} AS split, sum(portfolio_value / 100 - 1) AS total_reward,
                 arg_max(portfolio_value, e.step) AS final_portfolio_value, greatest(100, max(portfolio_value)) AS max_portfolio_value,
                 count(*) AS steps, arg_max(n_positions, e.step) AS final_positions,
                 count(*) FILTER (action = 0) / count(*)::DOUBLE AS hold_pct, count(*) FILTER (action = 1) / count(*)::DOUBLE AS buy_pct,
                 count(*) FILTER (action = 2) / count(*)::DOUBLE AS sell_pct, count(*) FILTER (invalid_sell) / count(*)::DOUBLE AS invalid_sell_pct,
                 count(*) FILTER (remapped) / count(*)::DOUBLE AS remapped_action_pct,
                 count(*) FILTER (action = 2 AND e.step % 5 = 0) AS sell_redirects, count(*) FILTER (action = 1 AND e.step % 7 = 0) AS bootstrap_buys,
                 count(*) FILTER (remapped AND e.step % 4 = 0) AS constraint_remaps, arg_max(portfolio_value / 4, e.step) AS cash
          FROM equity e JOIN acts a ON e.run = a.run AND e.step = a.step GROUP BY ALL),
    x AS (SELECT run, {SPLIT} AS split, count(*) AS trades, count(*) FILTER (realized_pnl >= 0) AS winning_trades,
                 count(*) FILTER (realized_pnl < 0) AS losing_trades, coalesce(sum(realized_pnl), 0) AS realized_pnl, sum(fee_paid) AS fees_paid,
                 count(*) FILTER (realized_pnl IS NOT NULL AND step % 3 = 0) AS stop_loss_exits
          FROM lot_pnl GROUP BY ALL)
    SELECT s.*, coalesce(trades, 0) AS trades, coalesce(winning_trades, 0) AS winning_trades, coalesce(losing_trades, 0) AS losing_trades,
           coalesce(realized_pnl, 0) AS realized_pnl, coalesce(fees_paid, 0) AS fees_paid, coalesce(stop_loss_exits, 0) AS stop_loss_exits, (final_portfolio_value - 100) / 100 AS total_return,
           final_portfolio_value - 100 - coalesce(realized_pnl, 0) AS unrealized_pnl,
           coalesce(winning_trades / nullif(trades, 0)::DOUBLE, 0) AS win_rate,
           (max_portfolio_value - final_portfolio_value) / max_portfolio_value AS drawdown_pct
    FROM s LEFT JOIN x ON s.run = x.run AND s.split = x.split"""

METRIC_DOUBLES = """total_reward final_portfolio_value max_portfolio_value hold_pct buy_pct sell_pct invalid_sell_pct
    remapped_action_pct cash realized_pnl fees_paid total_return unrealized_pnl win_rate drawdown_pct"""


def metrics(spark, d):
    split = F.when(F.col("step") % 2 == 0, "dev").otherwise("test")
    acts = remapped(spark, d).select("run", "step", "action", "invalid_sell", "remapped")
    steps = t.equity(spark, d).select("run", "step", "portfolio_value", "n_positions").join(acts, ["run", "step"])
    steps = steps.withColumn("reward", F.col("portfolio_value") / 100 - 1).withColumn("split", split)
    every = lambda n: F.col("step") % n == 0
    steps = steps.withColumns({
        "redirected": (F.col("action") == 2) & every(5), "bootstrap": (F.col("action") == 1) & every(7), "constraint": F.col("remapped") & every(4),
        "cash": F.col("portfolio_value") / 4,
    })
    trades = t.lot_pnl(spark, d).withColumn("split", split).withColumn("reason", F.when(every(3), "stop_loss").otherwise("sell"))
    return me.run_metrics(steps, trades)


@query("run_metrics", METRICS, METRIC_DOUBLES)
def _(spark, d):
    return metrics(spark, d)


@query("zero_trade_diagnostic", f"""
    SELECT run, split, CASE WHEN trades > 2 THEN 'n/a' WHEN hold_pct >= 0.9 THEN 'hold_dominant'
        WHEN remapped_action_pct >= 0.25 OR invalid_sell_pct >= 0.25 THEN 'remap_or_invalid_dominant' ELSE 'mixed_low_activity' END
        AS zero_trade_diagnostic FROM ({METRICS})""")
def _(spark, d):
    few = metrics(spark, d).withColumn("trades", F.greatest(F.col("trades") - 2, F.lit(0)))
    return me.zero_trade_diagnostic(few).select("run", "split", "zero_trade_diagnostic")


@query("trade_summary", """
    SELECT run, count(*) AS n, count(*) FILTER (realized_pnl >= 0) AS wins, count(*) FILTER (realized_pnl < 0) AS losses,
           sum(realized_pnl) AS total_pnl, avg(realized_pnl) AS mean_pnl, count(*) FILTER (realized_pnl >= 0) / count(*)::DOUBLE * 100 AS win_rate_pct
    FROM closed_trades GROUP BY run""", "total_pnl mean_pnl win_rate_pct")
def _(spark, d):
    return me.trade_summary(t.closed_trades(spark, d), ["run"])


@query("top_trades", f"""
    SELECT run, CAST(r AS INTEGER) AS rank, symbol, exit_step, realized_pnl, printf('%d. %-8s | Return: %6.2f%%', r, symbol, return_pct * 100) AS line FROM (
      SELECT *, row_number() OVER (PARTITION BY run ORDER BY realized_pnl DESC, exit_step, {TIE}) AS r FROM closed_trades) WHERE r <= 5""",
       "realized_pnl")
def _(spark, d):
    tie = [F.asc(c) for c in ["exit_step", *t.TRADE_TIE]]
    rows = me.top_trades(t.closed_trades(spark, d), tie, ["l_orderkey", "l_partkey"], ["run"])
    line = F.format_string("%d. %-8s | Return: %6.2f%%", "rank", "symbol", F.col("return_pct") * 100)
    return me.trade_line(rows).select("run", "rank", "symbol", "exit_step", "realized_pnl", line.alias("line"))


@query("split_payload", f"""
    SELECT run, split, steps, total_reward, total_reward / greatest(1, steps) AS avg_reward_per_step, -total_reward / greatest(1, steps) AS proxy_loss,
           final_portfolio_value, total_return * 100 AS total_return_pct, trades, winning_trades, losing_trades, win_rate * 100 AS win_rate_pct,
           realized_pnl, unrealized_pnl FROM ({METRICS})""",
       "total_reward avg_reward_per_step proxy_loss final_portfolio_value total_return_pct win_rate_pct realized_pnl unrealized_pnl")
def _(spark, d):
    return me.split_payload(metrics(spark, d))


@query("final_summary", """
    WITH p AS (
      SELECT run, count(*) FILTER (steps > 0) AS used, sum(trades) FILTER (steps > 0) AS tr, sum(winning_trades) FILTER (steps > 0) AS wi,
             sum(losing_trades) FILTER (steps > 0) AS lo, sum(realized_pnl) FILTER (steps > 0) AS pnl,
             last(final_portfolio_value ORDER BY split) AS pv, last(total_return_pct ORDER BY split) AS ret,
             last(unrealized_pnl ORDER BY split) AS unr, last(win_rate_pct ORDER BY split) AS wr FROM payloads GROUP BY run),
    q AS (SELECT *, wi = 0 AND lo = 0 AND tr > 0 AS derive, round_even(wr / 100 * tr, 0) AS dw FROM p)
    SELECT f.run, CASE WHEN used > 0 THEN 'split_aggregate' ELSE 'finance_snapshot' END AS kind,
           CASE WHEN used > 0 THEN pv ELSE portfolio_value END AS portfolio_value,
           CASE WHEN used > 0 THEN ret ELSE total_return_pct END AS total_return_pct,
           CASE WHEN used > 0 THEN pnl ELSE coalesce(realized_pnl, traced, 0) END AS realized_pnl,
           CASE WHEN used > 0 THEN unr ELSE unrealized_pnl END AS unrealized_pnl,
           CAST(CASE WHEN used > 0 THEN tr ELSE trades END AS BIGINT) AS trades,
           CAST(CASE WHEN used > 0 THEN CASE WHEN derive THEN dw ELSE wi END ELSE winning_trades END AS BIGINT) AS winning_trades,
           CAST(CASE WHEN used > 0 THEN CASE WHEN derive THEN greatest(0, tr - dw) ELSE lo END ELSE losing_trades END AS BIGINT) AS losing_trades,
           CASE WHEN used > 0 THEN CASE WHEN tr > 0 THEN (CASE WHEN derive THEN dw ELSE wi END) / tr::DOUBLE * 100 ELSE wr END ELSE win_rate_pct END AS win_rate_pct,
           CASE WHEN used > 1 THEN 'dev+test aggregate' WHEN used > 0 THEN 'test/dev final' ELSE 'train/live snapshot' END AS source
    FROM finance f LEFT JOIN q ON f.run = q.run LEFT JOIN (
      SELECT user_id AS r, arg_max(value, event_id) AS traced FROM events WHERE event_type = 'click' GROUP BY user_id) ON f.run = r""", "portfolio_value total_return_pct realized_pnl unrealized_pnl win_rate_pct")
def _(spark, d):
    name = F.when(F.col("event_type") == "click", "realized_pnl").otherwise(F.col("event_type"))
    points = t.table(spark, d, "events").select(
        F.col("user_id").alias("run"), name.alias("key"), F.col("event_id").alias("pos"), "value"
    )
    return me.final_summary(t.payloads(spark, d), t.finance(spark, d), points)


def fold_rows(spark, d):
    rows = t.run_metrics(spark, d)
    return rows.select(
        F.concat("config", F.lit("-"), F.pmod("run", F.lit(50)).cast("string")).alias("run"), F.col("run").alias("fold"),
        *[F.col(f"{s}_{a}").alias(f"{s}_{b}") for s in ("val", "test")
          for a, b in (("return_pct", "return"), ("trades", "trades"), ("win_rate_pct", "win_rate"))],
    )


MEDIANS = [f"median_{s}_{m}" for m in ("return", "trades", "win_rate") for s in ("val", "test")]

FOLDS = """
    SELECT concat(config, '-', run % 50) AS run, median(val_return_pct) AS median_val_return, median(test_return_pct) AS median_test_return,
           median(val_trades) AS median_val_trades, median(test_trades) AS median_test_trades, median(val_win_rate_pct) AS median_val_win_rate,
           median(test_win_rate_pct) AS median_test_win_rate, min(test_return_pct) * 100 AS min_test_return_pct,
           min(test_return_pct) * 100 >= -480 AS gate_pass FROM run_metrics GROUP BY concat(config, '-', run % 50)"""


@query("fold_summary", FOLDS, " ".join([*MEDIANS, "min_test_return_pct"]))
def _(spark, d):
    return me.fold_summary(fold_rows(spark, d), -480.0)


@query("summary_line", """
    SELECT run, printf('Val Trades:  %3d | WR: %5.1f%% | Return: %6.2f%%', val_trades::INTEGER, val_win_rate_pct, val_return_pct) AS val_line,
           printf('Test Trades: %3d | WR: %5.1f%% | Return: %6.2f%%', test_trades::INTEGER, test_win_rate_pct, test_return_pct) AS test_line
    FROM run_metrics""")
def _(spark, d):
    rows = t.run_metrics(spark, d)

    def line(label, s):
        return me.summary_line(
            F.lit(label), F.col(f"{s}_trades").cast("int"), F.col(f"{s}_win_rate_pct") / 100, F.col(f"{s}_return_pct") / 100
        )

    return rows.select("run", line("Val", "val").alias("val_line"), line("Test", "test").alias("test_line"))
