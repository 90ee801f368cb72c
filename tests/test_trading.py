"""Lots, exits, equity and fees against step-by-step replays."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import equity, exits, fills, metrics, orders


def replay_lots(rows, dust=None):
    """Lots rebuilt one order at a time."""
    out, state, lots = [], {}, {}
    for run, sym, step, side, pct, price, qty in sorted(rows, key=lambda r: r[2]):
        key = (run, sym)
        if side == "buy" and key not in state:
            lots[key] = lots.get(key, 0) + 1
            state[key] = [qty, price, step]
            out.append((run, sym, step, side, lots[key], step, price, qty, qty))
        elif side == "sell" and key in state:
            held, entry, at = state[key]
            sold = held if pct >= 1 else held * pct
            state[key][0] = held - sold
            out.append((run, sym, step, side, lots[key], at, entry, sold, held - sold))
            if pct >= 1 or (dust is not None and state[key][0] < dust):
                del state[key]
    return out


def random_fills(seed, n, tiny=1.0):
    rng = np.random.default_rng(seed)
    rows = []
    for step in range(n):
        rows.append((
            "r" if rng.random() < 0.7 else "s", int(rng.integers(2)), step, str(rng.choice(["buy", "sell", "none"], p=[0.3, 0.6, 0.1])),
            float(rng.choice([1.0, 0.25, 0.5, 0.9])), float(rng.uniform(1, 9)), float(rng.uniform(1, 3)) * tiny,
        ))
    return rows


SCHEMA = "run string, sym int, step bigint, side string, pct double, price double, qty double"
COLUMNS = ["run", "sym", "step", "side", "lot", "entry_step", "entry_price", "qty", "remaining"]


def same_lots(got, expect):
    got = got.select(*COLUMNS).toPandas().sort_values("step").reset_index(drop=True)
    expect = pd.DataFrame(expect, columns=COLUMNS).sort_values("step").reset_index(drop=True)
    assert len(got) == len(expect)
    for c in COLUMNS:
        if c in ("entry_price", "qty", "remaining"):
            np.testing.assert_allclose(got[c].astype(float), expect[c].astype(float), atol=1e-12)
        else:
            assert list(got[c]) == list(expect[c]), c


@pytest.mark.parametrize("width", [3, 17, 1000])
def test_lots_match_a_replay(spark, width):
    rows = random_fills(width, 300)
    same_lots(fills.lots(spark.createDataFrame(rows, SCHEMA), width), replay_lots(rows))


@pytest.mark.parametrize("width,tiny,dust", [(20, 1e-7, 1e-8), (7, 1.0, 0.3), (1, 1.0, 0.05), (1000, 1.0, 0.3), (5, 1.0, 0.0), (9, 0.1, 0.25)])
def test_exact_lots_close_dust(spark, width, tiny, dust):
    rows = random_fills(width, 250, tiny)
    same_lots(fills.exact_lots(spark.createDataFrame(rows, SCHEMA), width, dust=dust), replay_lots(rows, dust))


def test_exact_lots_awkward_orders(spark):
    def orders(series, *rows):
        return [("r", series, i, side, pct, 10.0, qty) for i, (side, pct, qty) in enumerate(rows)]

    half = ("sell", 0.5, None)
    rows = [
        *orders(0, *[("buy", 1.0, 1.0), *[half] * 40, ("buy", 1.0, 2.0), half]),  # falls to dust over many chunks, then opens again
        *orders(1, half, ("buy", 1.0, 1e-9), ("buy", 1.0, 5.0), ("sell", 0.0, None), ("buy", 1.0, 3.0)),  # bought below the dust level
        *orders(2, ("sell", 1.0, None), ("buy", 1.0, 4.0), ("sell", 1.5, None), half),
        *orders(3, ("none", 0.5, 1.0)),
    ]
    got = fills.exact_lots(spark.createDataFrame(rows, SCHEMA), 4)
    expect = replay_lots([r[:6] + (r[6] if r[6] is not None else 0.0,) for r in rows], fills.DUST)
    got = got.select("sym", "step", "side", "lot").toPandas().sort_values(["sym", "step"])
    assert [tuple(r) for r in got.itertuples(index=False)] == [(e[1], *e[2:5]) for e in sorted(expect, key=lambda e: (e[1], e[2]))]
    assert fills.exact_lots(spark.createDataFrame([], SCHEMA)).count() == 0


def test_exact_lots_need_no_job(spark):
    """Nothing runs while the plan is built, however many lots fall to dust."""
    rows = spark.createDataFrame(random_fills(3, 60, 1e-7), SCHEMA)
    spark.sparkContext.setJobGroup("lots", "lots")
    fills.exact_lots(rows, 10)
    assert not list(spark.sparkContext.statusTracker().getJobIdsForGroup("lots"))


def test_small_lot_sequence(spark):
    rows = [("r", 0, i, side, pct, 10.0, 2.0) for i, (side, pct) in enumerate([("buy", 1.0), ("sell", 0.5), ("sell", 1.0), ("buy", 1.0)])]
    got = fills.lots(spark.createDataFrame(rows, SCHEMA)).orderBy("step").collect()
    assert [r["lot"] for r in got] == [1, 1, 1, 2]
    assert [r["qty"] for r in got] == [2.0, 1.0, 1.0, 2.0]


@pytest.mark.parametrize("size", [1, 7, 256])
def test_cash_plus_positions_is_equity(spark, size):
    rows = [r for r in random_fills(9, 120) if r[0] == "r"]
    rows = [(*r[:2], i, *r[3:]) for i, r in enumerate(rows)]
    n = len(rows)
    lots = fills.lots(spark.createDataFrame(rows, SCHEMA), 11)
    price = [(s, t, 5.0 + s + t / 10) for s in range(2) for t in range(n)]
    prices = spark.createDataFrame(price, "sym int, step bigint, close double")
    delta = F.when(F.col("side") == "buy", -F.col("qty") * F.col("price")).otherwise(F.col("qty") * F.col("price"))
    steps = spark.range(n).select(F.lit("r").alias("run"), F.col("id").alias("step"))
    moves = equity.holdings(lots.withColumn("last_step", F.lit(n - 1)), delta)
    got = equity.mark_to_market(steps, moves, prices, 100.0, 9, size)
    got = got.orderBy("step").collect()
    assert len(got) == n

    held, cash = {}, 100.0
    events = {e[2]: e for e in replay_lots(rows)}
    for r in got:
        e = events.get(r["step"])
        if e:
            value = e[7] * rows[r["step"]][5]
            cash += -value if e[3] == "buy" else value
            held[e[1]] = e[8]
            if e[3] == "sell" and rows[r["step"]][4] >= 1:
                del held[e[1]]
        worth = sum(q * (5.0 + s + r["step"] / 10) for s, q in held.items())
        assert r["cash"] == pytest.approx(cash) and r["portfolio_value"] == pytest.approx(cash + worth)
        assert r["n_positions"] == len(held)


def test_steps_without_a_price_have_no_value(spark):
    moves = spark.createDataFrame([("r", 0, 1, 2, 2, 9, 4.0, -8.0), ("r", 1, 1, 3, 3, 3, 1.0, -1.0), ("r", 0, 1, 2, 10, None, None, 50.0)],
                                  "run string, sym int, lot int, entry_step bigint, step bigint, to_step bigint, held double, cash_delta double")
    prices = spark.createDataFrame([(0, t, float(t)) for t in range(12) if t not in (4, 8)], "sym int, step bigint, close double")
    sizes = spark.createDataFrame([("r", 11), ("other", 2)], "run string, last_step bigint")
    got = {(r["run"], r["step"]): tuple(r)[2:] for r in equity.mark_to_market(equity.run_steps(sizes, 3), moves, prices, 100.0, 4, 5).collect()}
    assert len(got) == 13 and got[("other", 1)] == (100.0, 0, 0.0, 100.0) and got[("r", 1)] == (100.0, 0, 0.0, 100.0)
    assert got[("r", 2)] == (92.0, 1, 8.0, 100.0) and got[("r", 3)] == (91.0, 2, None, None) and got[("r", 4)] == (91.0, 1, None, None)
    assert got[("r", 5)] == (91.0, 1, 20.0, 111.0) and got[("r", 10)] == (141.0, 0, 0.0, 141.0)
    held = {(r["sym"], r["step"]): r["close"] for r in equity.held_values(moves, prices, 3).collect()}
    assert held[(0, 4)] is None and held[(0, 9)] == 9.0 and held[(1, 3)] is None and len(held) == 9


@pytest.mark.parametrize("limit", [1, 5, 37])
def test_stop_loss_matches_a_scan(spark, limit):
    rng = np.random.default_rng(limit)
    path = {s: 100 * np.exp(np.cumsum(rng.normal(0, 0.03, 180))) for s in "AB"}
    prices = [(s, i, float(p)) for s, ps in path.items() for i, p in enumerate(ps) if not (s == "B" and i % 11 == 5)]
    entries = [(s, i, p) for s, i, p in prices if i % 3 == 0]
    got = exits.stop_loss_exit(
        spark.createDataFrame(entries, "symbol string, entry_step bigint, entry_price double"),
        spark.createDataFrame(prices, "symbol string, step bigint, close double"), 0.04, limit,
    ).collect()
    assert len(got) == len(entries)
    for r in got:
        hits = [
            i for s, i, p in prices
            if s == r["symbol"] and r["entry_step"] < i <= r["entry_step"] + limit + 1 and (p - r["entry_price"]) / r["entry_price"] < -0.04
        ]
        assert r["stop_step"] == (min(hits) if hits else None)


def test_stop_loss_plan_is_an_equi_join(spark):
    e = spark.createDataFrame([("A", 1, 1.0)], "symbol string, entry_step bigint, entry_price double")
    p = spark.createDataFrame([("A", 1, 1.0)], "symbol string, step bigint, close double")
    plan = exits.stop_loss_exit(e, p)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_same_step_prefers_stop_loss(spark):
    row = [(None, None, 5, 1.0, 5, 2.0, 9, 3.0)]
    names = [f"{n}_{k}" for n in ("sell", "stop", "limit", "end") for k in ("step", "price")]
    df = spark.createDataFrame(row, ", ".join(f"{n} {'bigint' if n.endswith('step') else 'double'}" for n in names))
    got = exits.resolve_exit(df).first()
    assert (got["exit_step"], got["reason"], got["exit_price"]) == (5, "stop_loss", 1.0)


def test_peak_drawdown(spark):
    rows = [("r", i, float(v)) for i, v in enumerate([100, 90, 120, 60])]
    df = spark.createDataFrame(rows, "run string, step bigint, portfolio_value double")
    got = equity.drawdown(df, 100.0, width=2).orderBy("step").toPandas()
    np.testing.assert_allclose(got["drawdown"], [0.0, 0.1, 0.0, 0.5])
    np.testing.assert_allclose(got["peak_before"], [100, 100, 100, 120])


def test_fee_precedence(spark):
    rows = [(None, 0.002, None, None), ("legacy", None, 0.001, None), ("unknown", -1.0, None, None), ("mexc_spot_mx", None, None, None)]
    df = spark.createDataFrame(rows, "fee_regime string, flat_cost double, buy_fee double, sell_fee double")
    got = {(round(r["buy_fee_rate"], 6), round(r["sell_fee_rate"], 6), round(r["transaction_cost"], 6)) for r in fills.fee_profile(df).collect()}
    assert got == {(0.002, 0.002, 0.002), (0.001, 0.0005, 0.00075), (0.0005, 0.0005, 0.0005), (0.0004, 0.0004, 0.0004)}


def test_fee_jitter_is_stable_and_bounded(spark):
    df = spark.range(200).select(F.col("id").alias("run"), F.lit(0).alias("episode"))
    a = fills.fee_jitter(df, 0.1, 1).toPandas()
    b = fills.fee_jitter(df.repartition(7), 0.1, 1).toPandas().sort_values("run").reset_index(drop=True)
    pd.testing.assert_frame_equal(a.sort_values("run").reset_index(drop=True), b)
    assert a["buy_multiplier"].between(0.9, 1.1).all() and (a["buy_multiplier"] != a["sell_multiplier"]).any()
    assert set(fills.fee_jitter(df, 0.0).toPandas()["buy_multiplier"]) == {1.0}


def test_zero_trade_diagnostic(spark):
    rows = [(0, 0.95, 0.3, 0.0), (0, 0.5, 0.3, 0.0), (0, 0.5, 0.0, 0.0), (3, 0.99, 0.9, 0.9)]
    df = spark.createDataFrame(rows, "trades int, hold_pct double, remapped_action_pct double, invalid_sell_pct double")
    got = [r["zero_trade_diagnostic"] for r in metrics.zero_trade_diagnostic(df).collect()]
    assert got == ["hold_dominant", "remap_or_invalid_dominant", "mixed_low_activity", "n/a"]


def test_text_lines(spark):
    df = spark.createDataFrame([(1, "BTCUSDT", 10.0, 10.5, 0.05, 0.4321, "sell")], "rank int, symbol string, entry_price double, exit_price double, return_pct double, realized_pnl double, reason string")
    line = metrics.trade_line(df).first()["line"]
    assert line == "1. BTCUSDT  | Entry: $ 10.000000 → Exit: $ 10.500000 | Return:   5.00% | PnL: $  0.4321 | Reason: sell"
    lines = df.select(*[metrics.summary_line(F.lit(s), F.lit(12), F.lit(0.5), F.lit(0.0125)).alias(s) for s in ("Val", "Test")]).first()
    assert tuple(lines) == ("Val Trades:   12 | WR:  50.0% | Return:   1.25%", "Test Trades:  12 | WR:  50.0% | Return:   1.25%")


def test_redirect_picks_oldest_or_largest(spark):
    asks = spark.createDataFrame([("r", 5, 2, 9), ("r", 6, 2, 1), ("r", 7, 1, 9), ("r", 8, 2, 9)], "run string, step bigint, action int, symbol_idx int")
    held = [("r", s, sym, e, n) for s in (5, 6) for sym, e, n in ((1, 2, 10.0), (2, 1, 10.0), (3, 3, 50.0))]
    positions = spark.createDataFrame(held, "run string, step bigint, symbol_idx int, entry_step bigint, notional double")
    oldest = {r["step"]: (r["symbol_idx"], r["redirected"]) for r in orders.sell_redirect(asks, positions).collect()}
    assert oldest == {5: (2, True), 6: (1, False), 7: (9, False), 8: (9, False)}
    largest = {r["step"]: r["symbol_idx"] for r in orders.sell_redirect(asks, positions, "largest_notional").collect()}
    assert largest[5] == 3


def test_split_and_gate_helpers(spark):
    folds = spark.createDataFrame(
        [("r", i, v, t, 1.0, 2.0, 0.5, 0.5) for i, (v, t) in enumerate([(0.1, 0.2), (0.3, -0.01), (0.2, 0.0)])],
        "run string, fold int, val_return double, test_return double, val_trades double, test_trades double, val_win_rate double, test_win_rate double",
    )
    got = metrics.fold_summary(folds).first()
    assert got["median_val_return"] == 0.2 and got["median_test_return"] == 0.0
    assert got["min_test_return_pct"] == pytest.approx(-1.0) and not got["gate_pass"]
    with pytest.raises(ValueError):
        metrics.require_gate(metrics.fold_summary(folds))


def test_time_limit_over_missing_steps(spark):
    prices = spark.createDataFrame([("A", s, p) for s, p in ((1, 10.0), (2, 11.0), (9, 12.0), (10, 5.0))] + [("B", 1, 3.0)], "symbol string, step bigint, close double")
    entries = spark.createDataFrame([("A", 1, 10.0), ("A", 1, 10.0), ("A", 2, 11.0), ("A", 8, 9.0), ("B", 1, 3.0), ("C", 1, 3.0)], "symbol string, entry_step bigint, entry_price double")
    got = sorted(tuple(r) for r in exits.time_limit_exit(entries, prices, 4).fillna(-1).collect())
    assert got == [
        ("A", 1, 10.0, 9, 12.0), ("A", 1, 10.0, 9, 12.0), ("A", 2, 11.0, 9, 12.0), ("A", 8, 9.0, -1, -1.0), ("B", 1, 3.0, -1, -1.0), ("C", 1, 3.0, -1, -1.0),
    ]
    fallen = spark.createDataFrame([("A", 1, 10.0), ("A", 9, 1.0)], "symbol string, step bigint, close double")
    one = spark.createDataFrame([("A", 1, 10.0)], "symbol string, entry_step bigint, entry_price double")
    row = exits.label_exits(one.withColumn("sell_step", F.lit(None).cast("bigint")).withColumn("sell_price", F.lit(None).cast("double")), fallen, 0.1, 4).first()
    assert (row.exit_step, row.reason) == (9, "stop_loss")
