"""Queries for sources, bars, features, alignment and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import tables as t
from checks.registry import query, scratch
from checks.views import HOUR
from tapeworks.operators import bars as ba
from tapeworks.operators import cube as cu
from tapeworks.operators import features as fe
from tapeworks.operators import market as mk
from tapeworks.operators import orders as od
from tapeworks.operators import splits as sp
from tapeworks.sources import candles as ca
from tapeworks.operators.load import growing_bars, load_bars
from tapeworks.sources.prepared import prepared, source_version

OHLCV = "open high low close volume"
DAY_US = 24 * HOUR
SYMBOLS = ["click", "error", "purchase", "signup", "view"]

# ---------------------------------------------------------------- sources


@query("scan_ohlcv", "SELECT event_type AS symbol, event_id, value FROM events WHERE event_type IN ('click', 'view') AND value > 5",
       "value")
def _(spark, d):
    rows = ca.scan_candles(
        spark, f"{d}/events.parquet", ["event_type", "event_id", "value"],
        F.col("event_type").isin("click", "view") & (F.col("value") > 5),
    )
    return rows.withColumnRenamed("event_type", "symbol")


@query("symbol_universe", """
    WITH named AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN ['btcusdt', 'ETHUSDT', 'BNBUSDT']
        ELSE [c_mktsegment, c_name, concat('n', c_nationkey)] END AS names FROM customer)
    SELECT c_custkey, CAST(i - 1 AS INTEGER) AS position, upper(names[i]) AS symbol
    FROM named, range(1, 4) AS r(i)""")
def _(spark, d):
    c = t.table(spark, d, "customer")
    raw = F.concat(
        F.lit(" "), F.lower("c_mktsegment"), F.lit(" ,, "), F.lower("c_name"), F.lit(",n"),
        F.col("c_nationkey").cast("string"), F.lit(", extra ,"),
    )
    c = c.withColumn("raw", F.when(F.col("c_custkey") % 5 != 0, raw))
    return ca.symbol_universe(c, "raw", 3, ["c_custkey"])


@query("symbol_semi", "SELECT symbol, seq, open_time, close FROM ticks WHERE symbol IN ('click', 'signup')", "close")
def _(spark, d):
    rows = ca.require_rows(ca.only_symbols(t.ticks(spark, d), ["click", "signup", "absent"]))
    return rows.select("symbol", "seq", "open_time", "close")


@query("recent_window", f"""
    SELECT symbol, seq, open_time, close FROM ticks JOIN (
      SELECT symbol, max(open_time) - 3 * {DAY_US} AS cut FROM ticks GROUP BY symbol) USING (symbol)
    WHERE open_time >= cut AND symbol IN ('click', 'error', 'view')""", "close")
def _(spark, d):
    rows = ca.recent_window(t.ticks(spark, d), 3, ["click", "error", "view"])
    return rows.select("symbol", "seq", "open_time", "close")


UNITS = """
    WITH last_rows AS (SELECT symbol, open_time, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS r
                       FROM ticks_epoch),
         gaps AS (SELECT symbol, open_time - lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time) AS gap
                  FROM last_rows WHERE r <= 5000)
    SELECT symbol, CAST(coalesce(floor(median(gap) FILTER (gap > 0)), 60000) AS BIGINT) AS step FROM gaps GROUP BY symbol"""


@query("infer_time_unit", f"""
    SELECT symbol, step, CASE WHEN step >= 10000000000 THEN 'ns' WHEN step >= 10000000 THEN 'us' ELSE 'ms' END AS unit
    FROM ({UNITS})""")
def _(spark, d):
    return ca.infer_time_unit(t.ticks_epoch(spark, d))


@query("epoch_to_ts", """
    SELECT symbol, seq, CASE WHEN symbol IN ('click', 'view') THEN date_trunc('millisecond', make_timestamp(open_time))
                             ELSE make_timestamp(open_time) END AS ts FROM ticks""")
def _(spark, d):
    rows = t.ticks_epoch(spark, d)
    rows = ca.with_unit(rows, ca.epoch_units(rows))
    ts = ca.epoch_to_ts(F.col("open_time"), F.col("unit")).cast("timestamp_ntz")
    return rows.select("symbol", "seq", ts.alias("ts"))


@query("prepared_cache", "SELECT symbol, bucket, open_time, close, volume FROM bars", "close volume")
def _(spark, d):
    root = scratch(spark, "prepared")
    params = {"source": d, "minutes": 60, "symbols": "all"}
    for _ in range(2):
        rows = prepared(spark, root, params, lambda: t.bars(spark, d).select("symbol", "bucket", "open_time", "close", "volume"))
    return rows.select("symbol", "bucket", "open_time", "close", "volume")


LOADED = "open high low close volume log_close return_1 range_pct volume_log"


@query("load_bars", f"""
    WITH t AS (SELECT * REPLACE (CASE WHEN symbol IN ('click', 'view') THEN open_time // 1000 * 1000 ELSE open_time END AS open_time) FROM ticks),
         r AS (SELECT t.* FROM t JOIN (SELECT symbol, max(open_time) AS last FROM t GROUP BY symbol) USING (symbol) WHERE open_time >= last - 10 * 86400000000),
         b AS (SELECT symbol, open_time - open_time % 3600000000 AS bucket, max(open_time) AS open_time, first(open ORDER BY open_time, seq) AS open,
                      max(high) AS high, min(low) AS low, last(close ORDER BY open_time, seq) AS close, sum(volume) AS volume
               FROM r GROUP BY symbol, open_time - open_time % 3600000000)
    SELECT *, ln(1 + greatest(close, 1e-9)) AS log_close,
           coalesce(close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY bucket), 0) - 1, 0) AS return_1,
           coalesce((high - low) / nullif(close, 0), 0) AS range_pct, ln(1 + volume) AS volume_log FROM b""", LOADED)
def _(spark, d):
    """The whole load path, kept and read back under its schema."""
    root = scratch(spark, "loaded")
    params = {"source": d, "version": source_version(spark, f"{d}/events.parquet"), "days": 10, "minutes": 60}
    for _ in range(2):
        rows = prepared(spark, root, params, lambda: load_bars(t.ticks_epoch(spark, d), 10, 60, tie="seq"))
    return rows.select("symbol", "bucket", "open_time", *LOADED.split())


# ---------------------------------------------------------------- bars


@query("resample_ohlcv", "SELECT symbol, bucket, open_time, open, high, low, close, volume FROM bars", OHLCV)
def _(spark, d):
    return t.bars(spark, d)


SEVEN = 7 * 60_000_000


@query("resample_ohlcv_7min", f"""
    SELECT symbol, open_time - (open_time - origin) % {SEVEN} AS bucket, max(open_time) AS open_time,
           first(open ORDER BY open_time, seq) AS open, max(high) AS high, min(low) AS low,
           last(close ORDER BY open_time, seq) AS close, sum(volume) AS volume
    FROM ticks JOIN (SELECT symbol, min(open_time) - min(open_time) % {DAY_US} AS origin FROM ticks GROUP BY symbol) USING (symbol)
    GROUP BY symbol, open_time - (open_time - origin) % {SEVEN}""", OHLCV)
def _(spark, d):
    return ba.resample(t.ticks(spark, d), 7, tie="seq")


HOLES = """
    SELECT symbol, bucket, open_time,
           CASE WHEN (bucket // 3600000000) % 5 = 0 THEN NULL ELSE open END AS open,
           CASE WHEN (bucket // 3600000000) % 7 = 0 THEN NULL ELSE high END AS high, low,
           CASE WHEN (bucket // 3600000000) % 3 = 0 THEN NULL ELSE close END AS close,
           CASE WHEN (bucket // 3600000000) % 4 = 0 THEN NULL ELSE volume END AS volume FROM bars"""


def with_holes(spark, d):
    hour = t.div(F.col("bucket"), HOUR)

    def hole(c, n):
        return F.when(hour % n != 0, F.col(c)).alias(c)

    return t.bars(spark, d).select(
        "symbol", "bucket", "open_time", hole("open", 5), hole("high", 7), "low", hole("close", 3), hole("volume", 4)
    )


@query("drop_empty_bars", f"SELECT * FROM ({HOLES}) WHERE close IS NOT NULL", OHLCV)
def _(spark, d):
    return ba.drop_empty(with_holes(spark, d))


@query("ffill_bars", f"""
    SELECT symbol, bucket, open_time, last_value(open IGNORE NULLS) OVER w AS open, last_value(high IGNORE NULLS) OVER w AS high,
           last_value(low IGNORE NULLS) OVER w AS low, last_value(close IGNORE NULLS) OVER w AS close,
           coalesce(volume, 0) AS volume
    FROM ({HOLES}) WINDOW w AS (PARTITION BY symbol ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", OHLCV)
def _(spark, d):
    return ba.ffill(with_holes(spark, d))


@query("sanitize_numeric", """
    SELECT symbol, seq, CASE WHEN volume = 0 THEN 0 ELSE exp(close / 1000) / volume END AS ratio,
           CASE WHEN volume <= 50 THEN 0 ELSE ln(volume - 50) END AS logged,
           CASE WHEN volume % 3 = 0 THEN 0 ELSE close END AS close FROM ticks""", "ratio logged close")
def _(spark, d):
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    v = F.col("volume")
    rows = t.ticks(spark, d).select(
        "symbol", "seq",
        F.when(v == 0, inf).otherwise(F.try_divide(F.exp(F.col("close") / 1000), v)).alias("ratio"),
        F.when(v < 50, nan).when(v == 50, -inf).otherwise(F.ln(v - 50)).alias("logged"),
        F.when(v % 3 != 0, F.col("close")).alias("close"),
    )
    return ba.sanitize(rows)


@query("identity_timeframe", "SELECT symbol, seq, open_time AS bucket, close FROM ticks", "close")
def _(spark, d):
    return ba.resample(t.ticks(spark, d), 1).select("symbol", "seq", "bucket", "close")


@query("union_symbols", "SELECT symbol, bucket, close FROM bars", "close")
def _(spark, d):
    rows = t.bars(spark, d).select("symbol", "bucket", "close")
    return ba.union_symbols(*[ca.only_symbols(rows, [s]) for s in SYMBOLS])


# ---------------------------------------------------------------- features

EMAS = """ema AS (
    SELECT symbol, bucket, rn, close, close AS fast, close AS slow, 0::DOUBLE AS signal,
           NULL::DOUBLE AS gain, NULL::DOUBLE AS loss
    FROM nbars WHERE rn = 1
    UNION ALL
    SELECT b.symbol, b.bucket, b.rn, b.close,
           e.fast * (1 - 2::DOUBLE / 13) + b.close * (2::DOUBLE / 13),
           e.slow * (1 - 2::DOUBLE / 27) + b.close * (2::DOUBLE / 27),
           e.signal * 0.8::DOUBLE + 0.2::DOUBLE * (e.fast * (1 - 2::DOUBLE / 13) + b.close * (2::DOUBLE / 13)
             - e.slow * (1 - 2::DOUBLE / 27) - b.close * (2::DOUBLE / 27)),
           CASE WHEN e.gain IS NULL THEN greatest(b.close - e.close, 0)
                ELSE e.gain * 13 / 14 + greatest(b.close - e.close, 0) / 14 END,
           CASE WHEN e.loss IS NULL THEN greatest(e.close - b.close, 0)
                ELSE e.loss * 13 / 14 + greatest(e.close - b.close, 0) / 14 END
    FROM ema e JOIN nbars b ON b.symbol = e.symbol AND b.rn = e.rn + 1)"""

PREV = "lag(close) OVER (PARTITION BY symbol ORDER BY bucket)"


def feature(name, column, sql, source="bars", recursive=""):
    @query(name, f"SELECT symbol, bucket, {sql} AS {column} FROM {source}", column, recursive)
    def _(spark, d):
        return fe.add_features(t.bars(spark, d), [column]).select("symbol", "bucket", column)


feature("f_log_close", "log_close", "ln(1 + greatest(close, 1e-9))")
feature("f_return_1", "return_1", f"coalesce(close / nullif({PREV}, 0) - 1, 0)")
feature("f_log_return_1", "log_return_1", f"CASE WHEN close > 0 AND {PREV} > 0 THEN ln(close / {PREV}) ELSE 0 END")
feature("f_range_pct", "range_pct", "coalesce((high - low) / nullif(close, 0), 0)")
feature("f_volume_log", "volume_log", "ln(1 + greatest(volume, 0))")
feature("f_volume_z", "volume_z", """
    CASE WHEN count(*) OVER w >= 3 AND stddev_pop(volume) OVER w > 1e-9
         THEN (volume - avg(volume) OVER w) / stddev_pop(volume) OVER w ELSE 0 END""",
        "(SELECT * FROM bars) WINDOW w AS (PARTITION BY symbol ORDER BY bucket ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
feature("f_macd_hist", "macd_hist_pct", "coalesce((fast - slow - signal) / nullif(close, 0), 0)", "ema", EMAS)
feature("f_rsi", "rsi_14", "coalesce(100 - 100 / (1 + gain / nullif(loss, 0)), 50) / 100", "ema", EMAS)


@query("f_ema", "SELECT symbol, bucket, fast AS ema_12, slow AS ema_26 FROM ema", "ema_12 ema_26", EMAS)
def _(spark, d):
    rows = fe.blocked(t.bars(spark, d))
    close = F.col("close")
    rows = fe.add_emas(rows, {"ema_12": (close, fe.span_alpha(12), 0), "ema_26": (close, fe.span_alpha(26), 0)})
    return fe.unblocked(rows).select("symbol", "bucket", "ema_12", "ema_26")


@query("f_ema_gaps", """
    SELECT symbol, bucket, coalesce((close - fast) / nullif(close, 0), 0) AS ema_fast_gap,
           coalesce((close - slow) / nullif(close, 0), 0) AS ema_slow_gap FROM ema""", "ema_fast_gap ema_slow_gap", EMAS)
def _(spark, d):
    gaps = ["ema_fast_gap", "ema_slow_gap"]
    return fe.add_features(t.bars(spark, d), gaps).select("symbol", "bucket", *gaps)


@query("feature_schema", """
    SELECT symbol, bucket, ln(1 + greatest(close, 1e-9)) AS log_close,
           coalesce((high - low) / nullif(close, 0), 0) AS range_pct FROM bars""", "log_close range_pct")
def _(spark, d):
    rows = fe.add_features(t.bars(spark, d), ["range_pct", "log_close"])
    return rows.select("symbol", "bucket", *fe.feature_schema(rows))


# ---------------------------------------------------------------- alignment

@query("symbol_index", "SELECT symbol, idx FROM symbol_ids")
def _(spark, d):
    return cu.symbol_index(t.ticks(spark, d))


@query("tail_align", "SELECT symbol, step, bucket, close FROM aligned", "close")
def _(spark, d):
    return t.aligned(spark, d).select("symbol", "step", "bucket", "close")


@query("time_align", """
    SELECT symbol, bucket, close FROM bars WHERE bucket IN (SELECT bucket FROM bars GROUP BY bucket HAVING count(*) = 5)""", "close")
def _(spark, d):
    return cu.time_align(t.bars(spark, d), SYMBOLS).select("symbol", "bucket", "close")


@query("price_matrix", "SELECT step, " + ", ".join(f"max(close) FILTER (symbol = '{s}') AS {s}" for s in SYMBOLS)
       + " FROM aligned GROUP BY step", " ".join(SYMBOLS))
def _(spark, d):
    return cu.price_matrix(t.aligned(spark, d), SYMBOLS)


CUBE_ROWS = """
    SELECT step, idx * 2 + f AS pos, CASE f WHEN 0 THEN close ELSE volume END AS value
    FROM aligned JOIN symbol_ids USING (symbol), range(2) AS r(f)"""


@query("feature_cube", f"SELECT step, CAST(pos AS INTEGER) AS pos, value FROM ({CUBE_ROWS})", "value")
def _(spark, d):
    cube = cu.feature_cube(t.aligned(spark, d), ["close", "volume"])
    return cube.select("step", F.posexplode("vector").alias("pos", "value"))


LOOK = 4


@query("lookback_window", f"""
    SELECT a.step, CAST(l AS INTEGER) AS back, CAST(pos AS INTEGER) AS pos, value
    FROM (SELECT DISTINCT step FROM aligned) a, range({LOOK}) AS r(l),
         ({CUBE_ROWS}) c WHERE c.step = greatest(a.step - {LOOK - 1} + l, 0)""", "value")
def _(spark, d):
    cube = cu.feature_cube(t.aligned(spark, d), ["close", "volume"])
    rows = cu.lookback(cube, LOOK).select("step", F.posexplode("window").alias("back", "v"))
    return rows.select("step", "back", F.posexplode("v").alias("pos", "value"))


@query("obs_vector", f"""
    WITH state AS (SELECT run, step, 4 + k AS cash, n_positions, 90 + a2 * 20 AS pv FROM decisions),
    vals AS (
      SELECT run, s.step, l * 10 + pos AS pos, value FROM state s, range({LOOK}) AS r(l), ({CUBE_ROWS}) c
      WHERE c.step = greatest(s.step - {LOOK - 1} + l, 0)
      UNION ALL
      SELECT run, step, {LOOK * 10} + i, CASE i WHEN 0 THEN ln(1 + cash / 1e6) WHEN 1 THEN n_positions / 3.0::DOUBLE
             WHEN 2 THEN (pv - 100) / 100 ELSE step / last::DOUBLE END
      FROM state, range(4) AS r(i), (SELECT max(step) AS last FROM aligned) WHERE step <= last)
    SELECT run, step, count(*) AS n, sum(value) AS total, sum(value * (pos + 1)) AS weighted,
           max(value) FILTER (pos = {LOOK * 10 + 3}) AS progress
    FROM vals GROUP BY run, step""", "total weighted progress")
def _(spark, d):
    rows = t.aligned(spark, d)
    windows = cu.lookback(cu.feature_cube(rows, ["close", "volume"]), LOOK)
    state = t.decisions(spark, d).select(
        "run", "step", (4 + F.col("k")).alias("cash"), "n_positions", (90 + F.col("a2") * 20).alias("portfolio_value")
    )
    obs = cu.observations(windows, state, 100.0, rows.agg(F.max("step")).scalar())
    long = obs.select("run", "step", F.posexplode("obs").alias("pos", "value"))
    return long.groupBy("run", "step").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"),
        F.sum(F.col("value") * (F.col("pos") + 1)).alias("weighted"),
        F.max(F.when(F.col("pos") == LOOK * 10 + 3, F.col("value"))).alias("progress"),
    )


def draw(what, run="run", seed=7):
    return f"CAST(concat('0x', substr(md5(concat({run}, '|', episode, '|{what}|{seed}')), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496"


@query("episode_slices", f"""
    WITH drawn_len AS (SELECT run, episode, m, CAST(least(20, m) + trunc({draw('length')} * (least(40, m) - least(20, m) + 1)) AS BIGINT) AS length
      FROM (SELECT DISTINCT user_id AS run FROM events), range(2) AS r(episode), (SELECT min(n) AS m FROM nbars)),
    placed AS (SELECT *, CAST(trunc({draw('start')} * (greatest(0, m - length) + 1)) AS BIGINT) AS start FROM drawn_len)
    SELECT a.step, run, CAST(episode AS INTEGER) AS episode, symbol, close
    FROM placed JOIN aligned a ON a.step BETWEEN start AND start + length - 1""", "close")
def _(spark, d):
    rows = t.aligned(spark, d)
    runs = t.table(spark, d, "events").select(F.col("user_id").alias("run")).distinct()
    runs = runs.withColumn("episode", F.explode(F.array(F.lit(0), F.lit(1))))
    slices = cu.episodes(runs, cu.shortest(t.bars(spark, d)), 20, 40, seed=7)
    return cu.episode_slices(slices, rows.select("symbol", "step", "close"))


# ---------------------------------------------------------------- splits


@query("split_2way", """
    SELECT symbol, bucket, CASE WHEN rn <= greatest(1, least(trunc(n * 0.8::DOUBLE), n - 1)) THEN 'train' ELSE 'test' END AS split
    FROM nbars""")
def _(spark, d):
    return sp.split_2way(t.bars(spark, d)).select("symbol", "bucket", "split")


THREE = """
    SELECT symbol, bucket, open_time, CASE WHEN rn <= a THEN 'train' WHEN rn <= greatest(a + 1, b) THEN 'val' ELSE 'test' END AS split
    FROM (SELECT *, greatest(1, trunc(n * 0.6::DOUBLE)) AS a, trunc(n * 0.6::DOUBLE) + trunc(n * 0.2::DOUBLE) AS b FROM nbars)"""


@query("split_3way", f"SELECT symbol, bucket, split FROM ({THREE})")
def _(spark, d):
    return sp.split_3way(t.bars(spark, d)).select("symbol", "bucket", "split")


FOLDS = """
    WITH size AS (SELECT m, greatest(1, trunc(m * 0.4::DOUBLE))::BIGINT AS a, greatest(1, trunc(m * 0.15::DOUBLE))::BIGINT AS b,
                         greatest(1, trunc(m * 0.15::DOUBLE))::BIGINT AS c, greatest(1, trunc(m * 0.1::DOUBLE))::BIGINT AS stride
                  FROM (SELECT min(n) AS m FROM nbars)),
         folds AS (SELECT f, f * stride AS start, a, b, c, m FROM size, range(4) AS r(f) WHERE f * stride <= m - a - b - c)
    SELECT symbol, bucket, open_time, CAST(f + 1 AS INTEGER) AS fold, start,
           CASE WHEN rn - 1 - start < a THEN 'train' WHEN rn - 1 - start < a + b THEN 'val' ELSE 'test' END AS split
    FROM nbars JOIN folds ON rn - 1 >= start AND rn - 1 < start + a + b + c"""


def folds(spark, d):
    return sp.walk_forward(t.bars(spark, d), 0.4, 0.15, 0.15, 0.1, 4)


@query("walk_forward", f"SELECT symbol, bucket, fold, start, split FROM ({FOLDS})")
def _(spark, d):
    return folds(spark, d).select("symbol", "bucket", "fold", "start", "split")


@query("balanced_tail", "SELECT symbol, bucket, close FROM nbars WHERE rn > n - 300", "close")
def _(spark, d):
    return sp.balanced_tail(t.bars(spark, d)).select("symbol", "bucket", "close")


@query("align_symbols", """
    SELECT symbol, bucket, CASE symbol WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS symbol_rank FROM bars
    WHERE symbol IN ('view', 'click', 'error')""")
def _(spark, d):
    required = ["view", "click", "error"]
    rows = t.bars(spark, d)
    wanted = spark.createDataFrame(list(enumerate(required)), "position int, symbol string")
    return sp.align_symbols(sp.require_symbols(rows, wanted), required).select("symbol", "bucket", "symbol_rank")


@query("missing_symbols", """
    SELECT CAST(c_custkey AS INTEGER) AS position, c_name AS symbol FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000) ORDER BY c_custkey LIMIT 10""")
def _(spark, d):
    required = t.table(spark, d, "customer").select(F.col("c_custkey").cast("int").alias("position"), F.col("c_name").alias("symbol"))
    have = t.table(spark, d, "orders").where("o_totalprice > 250000").select(
        F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("symbol")
    )
    return sp.missing_symbols(have, required)


@query("split_summary", f"""
    SELECT fold, split, count(*) AS n_rows, count(DISTINCT symbol) AS n_symbols, min(open_time) AS first_time,
           max(open_time) AS last_time FROM ({FOLDS}) GROUP BY fold, split""")
def _(spark, d):
    return sp.split_summary(folds(spark, d), ["fold", "split"])


# ---------------------------------------------------------------- several widths, risk, market, votes

WIDTHS = [15, 60, 240]
MULTI = " UNION ALL ".join(f"""
    SELECT {m} AS minutes, symbol, open_time - open_time % {m * 60_000_000} AS bucket, max(open_time) AS open_time, first(open ORDER BY open_time, seq) AS open,
           max(high) AS high, min(low) AS low, last(close ORDER BY open_time, seq) AS close, sum(volume) AS volume
    FROM ticks GROUP BY symbol, open_time - open_time % {m * 60_000_000}""" for m in WIDTHS)


@query("bars_multi", MULTI, OHLCV)
def _(spark, d):
    return ba.resample_many(t.ticks(spark, d), WIDTHS, tie="seq")


RETURNS = "(SELECT symbol, bucket, coalesce(close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY bucket), 0) - 1, 0) AS return_1 FROM bars)"


@query("rolling_risk", f"""
    SELECT symbol, bucket, return_1, n, CASE WHEN n >= 2 THEN mean END AS mean_return, CASE WHEN n >= 2 AND std > 1e-12 THEN mean / std END AS sharpe,
           CASE WHEN n >= 2 AND down > 0 THEN mean / sqrt(down / n) END AS sortino
    FROM (SELECT *, count(return_1) OVER w AS n, avg(return_1) OVER w AS mean, stddev_samp(return_1) OVER w AS std,
                 sum(least(return_1, 0) * least(return_1, 0)) OVER w AS down
          FROM {RETURNS} WINDOW w AS (PARTITION BY symbol ORDER BY bucket RANGE BETWEEN {DAY_US - 1} PRECEDING AND CURRENT ROW))""",
       "return_1 mean_return sharpe sortino")
def _(spark, d):
    rows = fe.add_features(t.bars(spark, d)).select("symbol", "bucket", "return_1")
    return mk.rolling_risk(rows)


LEADERS = ["click", "view"]


@query("market_proxy", f"""
    WITH r AS (SELECT symbol, bucket, close, CASE WHEN close > 0 AND {PREV} > 0 THEN ln(close / {PREV}) ELSE 0 END AS log_return_1 FROM bars),
         m AS (SELECT bucket AS told, avg(log_return_1) AS market_value, count(*) AS market_members FROM r WHERE symbol IN ('click', 'view') GROUP BY bucket)
    SELECT symbol, bucket, close, log_return_1, CASE WHEN bucket - told <= 3 * {HOUR} THEN market_value END AS market_value,
           CASE WHEN bucket - told <= 3 * {HOUR} THEN market_members END AS market_members,
           CASE WHEN bucket - told <= 3 * {HOUR} THEN log_return_1 - market_value END AS market_excess
    FROM r ASOF LEFT JOIN m ON r.bucket >= m.told""", "close log_return_1 market_value market_excess")
def _(spark, d):
    rows = fe.add_features(t.bars(spark, d)).select("symbol", "bucket", "close", "log_return_1")
    return mk.market_proxy(rows, LEADERS, tolerance=3 * HOUR)


@query("majority_vote", """
    WITH v AS (SELECT step, CAST(trunc(greatest(0, least(a1, 4))) AS INTEGER) AS symbol, CAST(trunc(greatest(0, least(a0_legacy, 2))) AS INTEGER) AS action FROM decisions),
         c AS (SELECT step, symbol, action, count(*) AS k FROM v GROUP BY step, symbol, action),
         r AS (SELECT *, row_number() OVER (PARTITION BY step, symbol ORDER BY k DESC, action) AS r, sum(k) OVER (PARTITION BY step, symbol)::BIGINT AS votes FROM c),
         b AS (SELECT step, symbol, votes, max(CASE WHEN r = 1 THEN action END) AS leading_action, max(CASE WHEN r = 1 THEN k END) AS leading_votes,
                      coalesce(max(CASE WHEN r = 2 THEN k END), 0) AS runner_up FROM r GROUP BY step, symbol, votes)
    SELECT *, 10 * leading_votes >= 6 * votes AS agreed, CASE WHEN 10 * leading_votes >= 6 * votes THEN leading_action ELSE 0 END AS action FROM b""")
def _(spark, d):
    rows = od.decode_legacy(t.decisions(spark, d).withColumn("a0", F.col("a0_legacy")), 5)
    return mk.majority_vote(rows.select("step", F.col("symbol_idx").alias("symbol"), "action"))


GROWN = ["log_close", "return_1", "range_pct", "volume_log", "volume_z"]


@query("growing_bars", f"""
    SELECT symbol, bucket, open_time, open, high, low, close, volume, ln(1 + greatest(close, 1e-9)) AS log_close,
           coalesce(close / nullif({PREV}, 0) - 1, 0) AS return_1, coalesce((high - low) / nullif(close, 0), 0) AS range_pct, ln(1 + greatest(volume, 0)) AS volume_log,
           CASE WHEN count(*) OVER w >= 3 AND stddev_pop(volume) OVER w > 1e-9 THEN (volume - avg(volume) OVER w) / stddev_pop(volume) OVER w ELSE 0 END AS volume_z
    FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bucket ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""", f"{OHLCV} {' '.join(GROWN)}")
def _(spark, d):
    """Three deliveries of candle files: three weeks, then a few late rows with the next days, then the rest."""
    root = scratch(spark, "growing")
    rows = t.ticks(spark, d)
    day = t.div(F.col("open_time") - 1_704_067_200_000_000, DAY_US)
    late = (day == 20) & (F.col("seq") % 97 == 0)
    part = F.when(day < 21, F.when(late, 1).otherwise(0)).when(day < 25, 1).otherwise(2)
    for i in range(3):
        rows.where(part == i).write.mode("append").parquet(f"{root}/in")
        grown = growing_bars(spark, f"{root}/in", f"{root}/kept", 60, GROWN, "seq")
    return grown
