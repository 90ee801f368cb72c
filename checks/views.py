"""The library's input tables as SQL views over the given tables (DuckDB).

``checks.tables`` states the same tables for Spark.
"""

HOUR = 3_600_000_000

VIEWS = {
    "ticks": """
        SELECT event_type AS symbol, epoch_us(ts) AS open_time,
               value AS open, value AS high, value AS low, value AS close,
               CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume, event_id AS seq
        FROM events""",
    "ticks_epoch": """
        SELECT * REPLACE (CASE WHEN symbol IN ('click', 'view') THEN open_time // 1000
                               WHEN symbol = 'error' THEN open_time * 1000
                               ELSE open_time END AS open_time)
        FROM ticks""",
    "bars": f"""
        SELECT symbol, open_time - open_time % {HOUR} AS bucket, max(open_time) AS open_time,
               first(open ORDER BY open_time, seq) AS open, max(high) AS high, min(low) AS low,
               last(close ORDER BY open_time, seq) AS close, sum(volume) AS volume
        FROM ticks GROUP BY ALL""".replace("GROUP BY ALL", f"GROUP BY symbol, open_time - open_time % {HOUR}"),
    "nbars": """
        SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bucket) AS rn,
               count(*) OVER (PARTITION BY symbol) AS n
        FROM bars""",
    "aligned": """
        SELECT symbol, bucket, open_time, open, high, low, close, volume, rn - (n - m) - 1 AS step
        FROM nbars, (SELECT min(n) AS m FROM nbars) AS shortest WHERE rn > n - m""",
    "symbol_ids": """
        SELECT symbol, CAST(row_number() OVER (ORDER BY symbol) - 1 AS INTEGER) AS idx
        FROM (SELECT DISTINCT event_type AS symbol FROM events)""",
    "entries": """
        SELECT symbol, rn AS entry_step, close AS entry_price
        FROM nbars JOIN (SELECT symbol, median(volume) AS mid FROM bars GROUP BY symbol) USING (symbol)
        WHERE volume > mid AND close > 0""",
    "prices": "SELECT symbol, rn AS step, close FROM nbars",
    "steps": """
        SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step,
               event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, ts
        FROM events""",
    "decisions": """
        SELECT run, step, (k % 31)::DOUBLE / 10 AS a0_legacy, (k - 50)::DOUBLE / 50 AS a0,
               (k % 6)::DOUBLE - 0.5::DOUBLE AS a1, value / 250 AS a2,
               CAST(event_id % 4 AS INTEGER) AS n_positions, k
        FROM steps""",
    "all_fills": """
        SELECT run, step, k % 3 AS sym,
               CASE WHEN event_type IN ('purchase', 'signup') THEN 'buy'
                    WHEN event_type IN ('error', 'click') THEN 'sell' ELSE 'none' END AS side,
               CASE k % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.25::DOUBLE
                          WHEN 2 THEN 0.5::DOUBLE ELSE 0.75::DOUBLE END AS pct,
               value + 8::DOUBLE / 7 AS price, (4 + k)::DOUBLE AS cash
        FROM steps""",
    "sized": """
        SELECT *, least(cash * pct, 20.0::DOUBLE) AS amount,
               least(cash * pct, 20.0::DOUBLE) * (1 - 0.001::DOUBLE) / price AS qty
        FROM all_fills""",
    "fills": "SELECT * FROM sized WHERE side = 'sell' OR (side = 'buy' AND amount >= 5)",
    "held_flags": """
        SELECT *, last_value(CASE WHEN side = 'buy' THEN 1 WHEN pct >= 1 THEN 0 END IGNORE NULLS)
               OVER (PARTITION BY run, sym ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open_flag
        FROM fills""",
    "taken": """
        SELECT *, sum(CASE WHEN side = 'buy' THEN 1 ELSE 0 END) OVER (PARTITION BY run, sym ORDER BY step) AS lot
        FROM held_flags
        WHERE (side = 'buy' AND coalesce(open_flag, 0) = 0) OR (side = 'sell' AND open_flag = 1)""",
    "in_lots": """
        SELECT *, first_value(step) OVER l AS entry_step, first_value(price) OVER l AS entry_price,
               first_value(qty) OVER l AS qty0,
               coalesce(product(CASE WHEN side = 'sell' THEN greatest(1 - pct, 0) ELSE 1 END) OVER (
                 PARTITION BY run, sym, lot ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS share
        FROM taken WINDOW l AS (PARTITION BY run, sym, lot ORDER BY step)""",
    "lots": """
        SELECT run, sym, step, side, pct, price, lot, entry_step, entry_price, qty0,
               CASE WHEN side = 'buy' THEN qty0 ELSE qty0 * share * least(pct, 1) END AS qty,
               CASE WHEN side = 'buy' THEN qty0 ELSE qty0 * share - qty0 * share * least(pct, 1) END AS remaining,
               amount
        FROM in_lots""",
    "lot_pnl": """
        SELECT *, CASE WHEN side = 'sell' THEN qty * price END AS gross,
               CASE WHEN side = 'sell' THEN qty * price * 0.001::DOUBLE ELSE amount * 0.001::DOUBLE END AS fee_paid,
               CASE WHEN side = 'sell' THEN qty * price * (1 - 0.001::DOUBLE) - qty * entry_price END AS realized_pnl
        FROM lots""",
    "cash_flow": """
        SELECT s.run, s.step, coalesce(CASE WHEN l.side = 'buy' THEN -l.amount
               WHEN l.side = 'sell' THEN l.qty * l.price * (1 - 0.001::DOUBLE) END, 0) AS cash_delta
        FROM steps s LEFT JOIN lots l ON s.run = l.run AND s.step = l.step""",
    "segments": """
        SELECT run, sym, lot, entry_step, step AS from_step,
               coalesce(lead(step) OVER (PARTITION BY run, sym ORDER BY step) - 1,
                        (SELECT max(step) FROM steps s WHERE s.run = o.run)) AS to_step, remaining AS qty, side, pct
        FROM lots o""",
    "held": """
        SELECT s.run, s.step, g.sym, g.entry_step, g.qty
        FROM steps s JOIN segments g ON s.run = g.run AND s.step BETWEEN g.from_step AND g.to_step
        WHERE g.qty > 0 AND NOT (g.side = 'sell' AND g.pct >= 1)""",
    "equity": """
        SELECT run, step, 60 + value / 2 AS portfolio_value, CAST(event_id % 4 AS INTEGER) AS n_positions,
               k % 3 = 0 AS held, k % 3 <> 0 AS executed, k::DOUBLE / 10 AS notional
        FROM steps""",
    "drawn": """
        SELECT *, greatest(100, coalesce(max(portfolio_value) OVER (PARTITION BY run ORDER BY step
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 100)) AS peak_before,
               greatest(100, max(portfolio_value) OVER (PARTITION BY run ORDER BY step
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS peak
        FROM equity""",
    "dd": """
        SELECT *, (peak - portfolio_value) / peak AS drawdown,
               greatest(0, (peak_before - portfolio_value) / peak_before) AS step_drawdown
        FROM drawn""",
    "trade_rows": """
        SELECT l_suppkey AS run, o_orderpriority AS symbol, l_quantity AS qty,
               l_extendedprice / l_quantity AS entry_price,
               l_extendedprice / l_quantity * (1 + l_tax - l_discount) AS exit_price,
               date_diff('day', DATE '1995-01-01', least(o_orderdate, l_shipdate)::DATE) AS entry_step,
               date_diff('day', DATE '1995-01-01', greatest(o_orderdate, l_shipdate)::DATE) AS exit_step,
               CASE l_returnflag WHEN 'A' THEN 'sell' WHEN 'R' THEN 'stop_loss' ELSE 'time_limit' END AS reason,
               l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount, l_tax, l_linestatus
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "closed_trades": """
        SELECT *, qty * exit_price * (1 - 1::DOUBLE / 900) - qty * entry_price AS realized_pnl,
               (exit_price - entry_price) / entry_price AS return_pct
        FROM trade_rows""",
    "run_metrics": """
        SELECT o_orderkey AS run, CASE o_orderstatus WHEN 'F' THEN 'gate' WHEN 'O' THEN 'confirm' ELSE 'robust' END AS phase,
               o_orderpriority AS config, o_custkey % 3 AS seed,
               CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS return_code,
               ((o_orderkey * 7) % 5000)::DOUBLE AS val_trades, (o_orderkey % 1000)::DOUBLE / 10 AS val_win_rate_pct,
               ((o_orderkey * 37) % 1001)::DOUBLE / 100 - 5 AS val_return_pct,
               ((o_orderkey * 11 + o_custkey) % 5200)::DOUBLE AS test_trades,
               (o_custkey % 1000)::DOUBLE / 10 AS test_win_rate_pct,
               ((o_orderkey * 53 + o_custkey) % 1103)::DOUBLE / 100 - 5 AS test_return_pct
        FROM orders""",
    "scored": """
        SELECT *, val_trades BETWEEN 100 AND 4500 AND test_trades BETWEEN 100 AND 4500 AS trade_band_ok,
               least(val_return_pct, test_return_pct) + 0.35::DOUBLE * test_return_pct
                 - 0.05::DOUBLE * abs(val_return_pct - test_return_pct) AS score
        FROM run_metrics""",
    "config_stats": """
        SELECT phase, config, count(*) AS n, median(val_return_pct) AS median_val_return_pct,
               median(test_return_pct) AS median_test_return_pct,
               median(least(val_return_pct, test_return_pct)) AS median_min_return_pct,
               median(score) AS median_score, avg(trade_band_ok::INTEGER) AS trade_band_ok_rate
        FROM scored WHERE return_code = 0 GROUP BY phase, config""",
    "logs": r"""
        SELECT o_orderkey AS log,
          concat('start of run ', o_orderkey, E'\n',
            CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat(
              'Val Trades:    1 | WR:  10.0% | Return:  -0.50%', E'\n', 'early test Win Rate: n/a', E'\n',
              'Val Trades:  ', (o_orderkey * 7) % 5000, ' | WR:  ', (o_orderkey % 1000) // 10, '.', o_orderkey % 10,
              '% | Return:   ', CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE '' END, (o_orderkey * 37) % 13, '.',
              lpad(((o_orderkey * 37) % 100)::VARCHAR, 2, '0'), '%', E'\n',
              'Test Trades: ', (o_orderkey * 11) % 5200, ' | WR:  ', (o_custkey % 1000) // 10, '.', o_custkey % 10,
              '% | Return:   ', CASE WHEN o_custkey % 2 = 0 THEN '-' ELSE '' END, o_custkey % 11, '.',
              lpad((o_custkey % 100)::VARCHAR, 2, '0'), '%', E'\n',
              'Test Win Rate: ', o_custkey % 90, '.5% | all', E'\n',
              '  TEST Return: ', o_orderkey % 17, '.25%', E'\n',
              'Test PnL: $', CASE WHEN o_custkey % 3 = 0 THEN '-' ELSE '' END, o_orderkey % 29, '.75 | net  ', E'\n') END,
            'done after ', o_custkey, ' updates') AS text
        FROM orders""",
    "telemetry": """
        SELECT concat('run-', user_id) AS run, event_type AS key,
               date_diff('day', DATE '2024-01-01', ts::DATE) AS step, event_id AS pos,
               CASE k % 10 WHEN 0 THEN NULL WHEN 1 THEN 0.0::DOUBLE ELSE value END AS value
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
    "dedup": """
        SELECT run, key, step, CASE WHEN key IN ('click', 'view') THEN first(value ORDER BY pos)
                                    ELSE last(value ORDER BY pos) END AS value
        FROM telemetry WHERE value IS NOT NULL GROUP BY run, key, step""",
    "wide": """
        SELECT run, step, max(value) FILTER (key = 'click') AS click, max(value) FILTER (key = 'error') AS error,
               max(value) FILTER (key = 'purchase') AS purchase, max(value) FILTER (key = 'signup') AS signup,
               max(value) FILTER (key = 'view') AS view
        FROM dedup GROUP BY run, step""",
    "run_index": """
        SELECT c_custkey AS seq,
               CASE WHEN c_custkey % 11 = 0 THEN concat('job-', c_custkey)
                    ELSE concat('run-', strftime(TIMESTAMP '2024-01-01' + to_seconds(c_custkey), '%Y%m%d-%H%M%S'),
                                '-', lpad(to_hex(c_custkey), 6, '0')) END AS run_id,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'train' WHEN 'BUILDING' THEN 'backtest'
                    WHEN 'FURNITURE' THEN 'walk_forward' WHEN 'HOUSEHOLD' THEN 'eval' ELSE 'backtest_3way' END AS mode,
               CASE c_custkey % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed'
                    ELSE 'stopped' END AS status,
               CASE WHEN c_custkey % 13 = 0 THEN 'unknown' ELSE
                 strftime(TIMESTAMP '2024-01-01' + to_seconds(c_custkey), '%Y-%m-%d %H:%M:%S UTC') END AS started_at,
               CASE WHEN c_custkey % 4 <> 0 THEN strftime(TIMESTAMP '2024-01-01'
                 + to_seconds(c_custkey * 3 + c_nationkey * 700), '%Y-%m-%d %H:%M:%S UTC') END AS finished_at,
               CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey - 100 END AS elapsed_seconds
        FROM customer""",
    "payloads": """
        SELECT c_custkey AS run, split, CAST((c_custkey * 7 + i * 13) % 5 * 100 AS BIGINT) AS steps,
               (c_custkey * 3 + i) % 40 AS trades,
               CASE WHEN c_custkey % 6 = 0 THEN 0 ELSE (c_custkey * 3 + i) % 40 // 3 END AS winning_trades,
               CASE WHEN c_custkey % 6 = 0 THEN 0 ELSE (c_custkey * 3 + i) % 40 - (c_custkey * 3 + i) % 40 // 3 END AS losing_trades,
               ((c_custkey * 17 + i) % 1000)::DOUBLE / 10 AS win_rate_pct, c_acctbal / (10 + i) AS realized_pnl,
               100 + c_acctbal / (20 + i) AS final_portfolio_value, c_acctbal / (30 + i) AS total_return_pct,
               c_acctbal / (40 + i) AS unrealized_pnl
        FROM customer, (VALUES (0, 'dev'), (1, 'test')) AS s(i, split) WHERE c_custkey % 9 <> 4 OR i = 0""",
    "finance": """
        SELECT c_custkey AS run, 90 + c_acctbal / 15 AS portfolio_value, c_acctbal / 25 AS total_return_pct,
               CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal / 12 END AS realized_pnl,
               c_acctbal / 35 AS unrealized_pnl, c_custkey % 50 AS trades, c_custkey % 50 // 2 AS winning_trades,
               c_custkey % 50 - c_custkey % 50 // 2 AS losing_trades, (c_custkey % 1000)::DOUBLE / 10 AS win_rate_pct
        FROM customer""",
    "variants": """
        SELECT concat('v', p_partkey) AS config, p_partkey,
               MAP {'--reward-mode': 'equity_delta', '--days': '14', '--algo': 'ppo', '--quiet': ''} AS base,
               CASE WHEN p_partkey % 4 = 0 THEN MAP {'--days': p_size::VARCHAR}
                    WHEN p_partkey % 4 = 1 THEN MAP {'--reward-mode': 'shaped', '--mode': lower(p_type)}
                    WHEN p_partkey % 4 = 2 THEN MAP {'--action-mapping-mode': 'legacy', '--algo': p_brand, '--quiet': ''}
                    ELSE MAP {'--mode': ''} END AS overrides
        FROM part""",
}
