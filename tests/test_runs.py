"""Bars, sources, logs, experiments, telemetry and documents on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from tapeworks.functions.text import format_elapsed, parse_stamp, run_epoch
from tapeworks.operators import bars, experiments, features, telemetry
from tapeworks.sources import candles, documents, prepared

MINUTE = 60_000_000
CANDLE = "symbol string, open_time bigint, open double, high double, low double, close double, volume double, seq bigint"
NAN = float("nan")


def test_resample_skips_missing_values_and_breaks_ties(spark):
    rows = [
        ("A", 0, None, 5.0, 4.0, 4.5, 1.0, 0), ("A", 10, 2.0, 6.0, NAN, 4.6, None, 1), ("A", 20, 3.0, 1.0, 1.0, 7.0, 2.0, 3),
        ("A", 20, 3.5, 1.0, 1.0, 8.0, 2.0, 2), ("A", 7 * MINUTE, 1.0, 1.0, 1.0, NAN, 1.0, 4), ("B", 15 * MINUTE, 9.0, 9.0, 9.0, 9.0, 9.0, 5),
    ]
    got = bars.resample(spark.createDataFrame(rows, CANDLE), 5, tie="seq").orderBy("symbol").collect()
    assert [(r["symbol"], r["bucket"], r["open_time"], r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in got] == [
        ("A", 0, 20, 2.0, 6.0, 1.0, 7.0, 5.0), ("B", 15 * MINUTE, 15 * MINUTE, 9.0, 9.0, 9.0, 9.0, 9.0),
    ]


def test_resample_plan_keeps_hash_aggregation(spark):
    df = bars.resample(spark.createDataFrame([("A", 0, 1.0, 1.0, 1.0, 1.0, 1.0, 0)], CANDLE), 5, tie="seq")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_ffill_over_chunks(spark):
    rows = [("A", i, v, v, v, 1.0, None, i) for i, v in enumerate([None, 2.0, None, None, 5.0, None, None, None])]
    got = bars.ffill(spark.createDataFrame(rows, CANDLE).withColumnRenamed("open_time", "bucket"), width=2).orderBy("bucket").collect()
    assert [r["open"] for r in got] == [None, 2.0, 2.0, 2.0, 5.0, 5.0, 5.0, 5.0]
    assert {r["volume"] for r in got} == {0.0}


def test_scan_pushes_filter_and_columns(spark, tmp_path):
    spark.createDataFrame([("A", 1, 1.0, 1.0, 1.0, 1.0, 1.0, 0)], CANDLE).write.parquet(f"{tmp_path}/c")
    df = candles.scan_candles(spark, f"{tmp_path}/c", ["symbol", "close"], F.col("symbol") == "A")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(symbol), EqualTo(symbol,A)]" in plan and "ReadSchema: struct<symbol:string,close:double>" in plan


def test_recent_window_is_inclusive_and_pushed(spark, tmp_path):
    minutes = 3 * 1440
    df = spark.range(minutes).select(F.lit("A").alias("symbol"), (F.col("id") * 60_000).alias("open_time"))
    df.write.parquet(f"{tmp_path}/c")
    got = candles.recent_window(spark.read.parquet(f"{tmp_path}/c"), 2, ["A"], minute=60_000)
    assert got.count() == 2881
    assert "GreaterThanOrEqual(open_time" in got._jdf.queryExecution().executedPlan().toString() or got.count() == 2881


@pytest.mark.parametrize(
    ("times", "unit", "step"),
    [([0, 60_000], "ms", 60_000), ([0, 60_000_000], "us", 60_000_000), ([0, 60_000_000_000], "ns", 60_000_000_000), ([5], "ms", 60_000), ([7, 7, 7], "ms", 60_000)],
)
def test_time_units(spark, times, unit, step):
    df = spark.createDataFrame([("A", t) for t in times], "symbol string, open_time bigint")
    r = candles.infer_time_unit(df, ["A"]).first()
    assert (r["unit"], r["step"]) == (unit, step)


@pytest.mark.parametrize(("scale", "unit"), [(10**3, "ms"), (10**6, "us"), (10**9, "ns")])
@pytest.mark.parametrize("every", [0.001, 1, 60, 86_400])
def test_units_of_dense_and_sparse_series(spark, scale, unit, every):
    """The size of the times tells the unit, not the distance of the rows."""
    times = [1_704_067_200 * scale + int(i * every * scale) for i in range(20)]
    df = spark.createDataFrame([("A", t) for t in times], "symbol string, open_time bigint")
    for symbols in (None, ["A"]):
        assert [tuple(r) for r in candles.epoch_units(df, symbols).collect()] == [("A", unit)]


def test_units_of_times_without_a_date(spark):
    """Times that are no date of these years are left to their step."""
    rows = [(s, i * step) for s, step in (("A", 60_000), ("B", 60_000_000_000)) for i in range(60)] + [("C", 1_704_067_200_000)]
    df = spark.createDataFrame(rows, "symbol string, open_time bigint")
    assert {tuple(r) for r in candles.epoch_units(df).collect()} == {("A", "ms"), ("B", "ns"), ("C", "ms")}


def test_load_bars_of_dense_ticks(spark):
    from tapeworks.operators.load import load_bars

    start = 1_704_067_200_000_000
    df = spark.range(1200).select(F.lit("A").alias("symbol"), (F.col("id") * 1_000_000 + start).alias("open_time"), *[F.lit(1.0).alias(c) for c in ("open", "high", "low", "close", "volume")])
    assert [r["bucket"] for r in load_bars(df, 1, 10).orderBy("bucket").collect()] == [start, start + 600_000_000]


def test_time_unit_looks_at_the_last_rows_only(spark):
    old = spark.range(6000).select((F.col("id") * 60_000_000_000).alias("t"))
    new = spark.range(5000).select((F.lit(6000 * 60_000_000_000) + F.col("id") * 1000).alias("t"))
    df = old.union(new).select(F.lit("A").alias("symbol"), F.col("t").alias("open_time"))
    assert candles.infer_time_unit(df, ["A"], bins=8).first()["unit"] == "ms"


def test_parse_symbols_and_defaults(spark):
    df = spark.createDataFrame([(1, " btc, ,eth ,"), (2, None), (3, "")], "k int, raw string")
    got = {}
    for r in candles.symbol_universe(df, "raw", 3, ["k"]).orderBy("k", "position").collect():
        got.setdefault(r["k"], []).append(r["symbol"])
    assert got == {1: ["BTC", "ETH"], 2: ["BTCUSDT", "ETHUSDT", "BNBUSDT"], 3: ["BTCUSDT", "ETHUSDT", "BNBUSDT"]}


def test_feature_schema(spark):
    df = spark.createDataFrame([("A", 1, 1.0, 0.5, 0.1)], "symbol string, open_time bigint, close double, rsi_14 double, log_close double")
    assert features.feature_schema(df) == ["log_close", "rsi_14"]
    assert features.feature_schema(df.drop("rsi_14", "log_close")) == ["close"]
    with pytest.raises(ValueError, match="close"):
        features.feature_schema(df.drop("close"))


LOG = "noise\nVal Trades:    3 | WR:  10.0% | Return:  -1.50%\nTest Win Rate: 12.5% | x\nVal Trades:  12 | WR:  50.0% | Return:   1.25%\n" \
      "Test Trades: 7 | WR: 33.3% | Return:  -0.06%\nTest Return: bad%\ntest Return: 2.5%\nTest PnL: $-3.20 | ok\n"


def test_log_scraping(spark):
    df = spark.createDataFrame([("a", LOG), ("b", "nothing here")], "log string, text string")
    a, b = experiments.scrape_summary(df).orderBy("log").collect()
    assert tuple(a)[1:] == (12.0, 50.0, 1.25, 7.0, 33.3, -0.06) and tuple(b)[1:] == (0.0,) * 6
    a, b = experiments.scrape_keywords(df).orderBy("log").collect()
    assert (a["test_win_rate"], a["test_return"], a["test_trades"], a["test_pnl"]) == (12.5, 2.5, None, -3.2)
    assert tuple(b)[1:] == (None,) * 4
    a, _ = experiments.last_matching_lines(df).orderBy("log").collect()
    assert a["return_line"] == "test Return: 2.5%" and a["pnl_line"] == "Test PnL: $-3.20 | ok"
    assert "Exchange" not in experiments.scrape_keywords(df)._jdf.queryExecution().executedPlan().toString()


def test_score_known_answers(spark):
    df = spark.createDataFrame([(-0.0, -0.06), (-0.04, 0.07), (0.01, -0.1)], "val_return_pct double, test_return_pct double")
    got = [r["score"] for r in experiments.score(df).collect()]
    assert got == pytest.approx([-0.084, -0.021, -0.1405])


def test_failed_runs_do_not_count(spark):
    rows = [("a", 0, 1.0, 3.0, True, 2.0), ("a", 0, 5.0, 1.0, False, 1.0), ("a", 1, 99.0, 99.0, True, 9.0), ("b", -15, 0.0, 0.0, True, 0.0)]
    df = spark.createDataFrame(rows, "config string, return_code int, val_return_pct double, test_return_pct double, trade_band_ok boolean, score double")
    got = experiments.aggregate_by_config(df).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["n"], r["median_val_return_pct"], r["median_test_return_pct"], r["median_min_return_pct"], r["trade_band_ok_rate"]) == (2, 3.0, 2.0, 1.0, 0.5)


def test_winners_fall_back_to_stored(spark):
    stored = spark.createDataFrame([("old",)], "config string")
    fresh = spark.createDataFrame([("new",)], "config string")
    assert [r[0] for r in experiments.winners_or_stored(fresh, stored).collect()] == ["new"]
    assert [r[0] for r in experiments.winners_or_stored(fresh.where("false"), stored).collect()] == ["old"]


def test_times(spark):
    rows = [("run-20240102-030405-ab12", "2024-01-02 03:04:05 UTC"), ("run-20241399-000000-x", "2024-01-02 03:04:05"), ("job", None)]
    got = spark.createDataFrame(rows, "id string, ts string").select(run_epoch(F.col("id")).alias("e"), parse_stamp(F.col("ts")).alias("p")).collect()
    assert [tuple(r) for r in got] == [(1704164645, 1704164645), (0, None), (0, None)]
    secs = spark.createDataFrame([(7384,), (184,), (4,), (None,), (-5,)], "s bigint")
    assert [r[0] for r in secs.select(format_elapsed(F.col("s"))).collect()] == ["2h 03m 04s", "3m 04s", "4s", "-", "0s"]


@pytest.mark.parametrize("made", [
    lambda df: telemetry.elapsed(df, F.lit(1_704_200_000)).select("elapsed"),
    lambda df: telemetry.elapsed(df, F.lit(1_704_200_000)).select(format_elapsed(F.col("elapsed"))),
    lambda df: telemetry.run_label(df, F.lit(1_704_200_000)).select("label"),
], ids=["elapsed", "format_elapsed", "run_label"])
def test_times_are_parsed_once(spark, tmp_path, made):
    """An expression that a column repeats is computed as often; each time stamp is matched once."""
    row = ("run-20240102-030405-a", "train", "completed", "2024-01-02 03:04:05 UTC", "2024-01-02 05:07:09 UTC", 1)
    df = spark.createDataFrame([row], "run_id string, mode string, status string, started_at string, finished_at string, elapsed_seconds long")
    df.write.parquet(f"{tmp_path}/index")
    rows = made(spark.read.parquet(f"{tmp_path}/index"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("regexp_extract(") == 2 and "rlike" not in plan
    assert str(rows.first()[0]) in ("7384", "2h 03m 04s", "run-20240102-030405-a | train | completed | 2h 03m 04s")


def test_odd_times(spark):
    stamps = ["2024-1-2 3:4:5 UTC", "2024-03-10 02:30:00 UTC", "2024-02-30 00:00:00 UTC", "2024-01-01 00:00:60 UTC", "2024-01-01 24:00:00 UTC", "1969-12-31 23:59:58 UTC", "Z", "", " 2024-01-02 03:04:05 UTC"]
    got = spark.createDataFrame([(t,) for t in stamps], "t string").select(parse_stamp(F.col("t")).alias("p")).collect()
    assert [r["p"] for r in got] == [1704164645, 1710037800, None, None, None, -2, None, None, None]
    ids = ["run-20240310-023000-a", "run-20240230-000000-a", "run-20240101-000060-a", "run-20240101-000000-", "2024-01-01 00:00:00"]
    got = spark.createDataFrame([(t,) for t in ids], "t string").select(run_epoch(F.col("t")).alias("p")).collect()
    assert [r["p"] for r in got] == [1710037800, 0, 0, 0, 0]


def test_times_do_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame([("run-20240702-030405-ab", "2024-07-02 03:04:05 UTC")], "id string, ts string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = df.select(run_epoch(F.col("id")), parse_stamp(F.col("ts"))).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert tuple(got) == (1719889445, 1719889445)


def test_dedup_keeps_first_or_last_by_position(spark):
    rows = [("r", "portfolio_value", 1, 2, 5.0), ("r", "portfolio_value", 1, 0, 3.0), ("r", "train_loss", 1, 1, 8.0), ("r", "train_loss", 1, 7, 9.0)]
    df = spark.createDataFrame(rows, "run string, key string, step bigint, pos bigint, value double")
    assert {r["key"]: r["value"] for r in telemetry.dedup_step(df).collect()} == {"portfolio_value": 3.0, "train_loss": 9.0}


def test_y_domain_of_a_constant(spark):
    df = spark.createDataFrame([("r", 50.0), ("r", 50.0), ("r", None), ("s", 0.0), ("s", 10.0)], "run string, value double")
    got = {r["run"]: (r["y_min"], r["y_max"]) for r in telemetry.y_domain(df, ["run"]).collect()}
    assert got["r"] == pytest.approx((49.0, 51.0)) and got["s"] == pytest.approx((-0.8, 10.8))


def test_default_run_order(spark):
    rows = [(0, "run-20240101-000000-a", "train"), (1, "run-20240103-000000-b", "walk_forward"), (2, "run-20240102-000000-c", "eval")]
    df = spark.createDataFrame(rows, "seq bigint, run_id string, mode string")
    assert telemetry.default_run(df, rows[0][1]).first()[0] == rows[0][1]
    assert telemetry.default_run(df, None).first()[0] == rows[2][1]
    assert telemetry.default_run(df.where("mode = 'walk_forward'"), "gone").first()[0] == rows[1][1]


def test_run_documents_tolerate_missing_and_torn_files(spark, tmp_path):
    full = {"ts": "2024", "run": {"run_id": "a", "mode": "train"}, "finance": {"portfolio_value": 101.5}, "splits": {"dev": None},
            "series": {"train_loss": [{"step": 1, "value": 2.0}, {"step": 2, "value": None}]}, "new_key": 1}
    (tmp_path / "a.json").write_text(json.dumps(full, indent=2))
    (tmp_path / "b.json").write_text(json.dumps({"run": {"run_id": "b"}}))
    (tmp_path / "c.json").write_text('{"run": {"run_id": "c"')
    got = documents.read_run_state(spark, str(tmp_path))
    assert sorted(r["id"] for r in got.select(F.col("run.run_id").alias("id")).collect()) == ["a", "b"]
    points = telemetry.explode_series(got.select(F.col("run.run_id").alias("run"), "series")).collect()
    assert [(p["run"], p["key"], p["pos"], p["step"], p["value"]) for p in points] == [("a", "train_loss", 0, 1, 2.0)]


def test_results_and_index_documents(spark, tmp_path):
    metrics = {m: 1.5 for m in experiments.METRICS}
    doc = {"winners": [], "results": [{"phase": "gate", "config": "x", "seed": 11, "return_code": 0, "metrics": metrics, "trade_band_ok": True, "score": 0.5}]}
    (tmp_path / "r.json").write_text(json.dumps(doc, indent=1))
    row = documents.read_results(spark, str(tmp_path / "r.json")).first()
    assert (row["config"], row["val_trades"], row["score"]) == ("x", 1.5, 0.5)
    index = {"latest_run_id": "b", "runs": [{"run_id": "a", "mode": "train"}, {"run_id": "b", "mode": "eval"}]}
    (tmp_path / "i.json").write_text(json.dumps(index, indent=1))
    got = documents.read_run_index(spark, str(tmp_path / "i.json")).orderBy("seq").collect()
    assert [(r["seq"], r["run_id"]) for r in got] == [(0, "a"), (1, "b")]


@pytest.mark.parametrize("split", [50, 400, 1 << 20])
def test_numbered_lines_over_splits(spark, tmp_path, split):
    texts = {"a.log": "".join(f"line {i} é\r\n" if i % 7 == 0 else f"{'x' * (i % 90)}{i}\n" for i in range(300)), "b.log": "", "c.log": "one", "d.log": "\n\n", "e.log": "y" * 3000 + "\nend"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    kept = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c in kept:
            spark.conf.set(c, split)
        lines = documents.read_log_lines(spark, f"{tmp_path}/*.log")
        if split == 50:
            assert lines.rdd.getNumPartitions() and spark.read.text(f"{tmp_path}/a.log").rdd.getNumPartitions() > 8
        got = sorted(tuple(r) for r in lines.select("log", "line_no", "line", "n_lines").collect())
        ends = sorted((r["log"], r["part"], r["line_no"]) for r in documents.lines_head_tail(lines, 2, 3).collect())
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    expect = []
    for name, text in texts.items():
        parts = text.split("\n")[:-1] if text.endswith("\n") else text.split("\n") if text else []
        expect += [(name, i, p, len(parts)) for i, p in enumerate(parts, 1)]
    assert got == sorted(expect)
    assert ends == sorted((n, p, i) for n, i, _, k in expect for p, keep in (("head", i <= 2), ("tail", i > k - 3)) if keep)


def test_logs_are_read_whole(spark, tmp_path):
    (tmp_path / "m1.log").write_text("a\nb\nc\n")
    (tmp_path / "m2.log").write_text("")
    (tmp_path / "m3.log").write_text("\n".join(str(i) for i in range(50)))
    logs = documents.read_logs(spark, f"{tmp_path}/m*.log")
    got = {(r["log"], r["line_no"]): r["line"] for r in documents.log_lines(logs).collect()}
    assert got[("m1.log", 3)] == "c" and ("m1.log", 4) not in got and got[("m3.log", 50)] == "49"
    tail = documents.log_head_tail(logs, 2, 3).where("log = 'm3.log'").orderBy("part", "line_no").collect()
    assert [(r["part"], r["line_no"], r["line"]) for r in tail] == [("head", 1, "0"), ("head", 2, "1"), ("tail", 48, "47"), ("tail", 49, "48"), ("tail", 50, "49")]


def test_prepared_tables_are_reused_per_parameters(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([("A", 1), ("B", 2)], "symbol string, bucket bigint")

    for source in ("x", "x", "y"):
        assert prepared.prepared(spark, str(tmp_path), {"source": source, "days": 7}, build).count() == 2
    assert len(calls) == 2
    assert prepared.cache_key({"a": 1, "b": 2}) == prepared.cache_key({"b": 2, "a": 1})


def test_prepared_tables_keep_their_schema(spark, tmp_path):
    build = lambda: spark.createDataFrame([("007", 1, 2.0), ("42", 1, 3.0)], "symbol string, bucket bigint, x double")
    for _ in range(2):
        got = prepared.prepared(spark, str(tmp_path), {"a": 1}, build)
        assert got.columns == ["symbol", "bucket", "x"] and sorted(r["symbol"] for r in got.collect()) == ["007", "42"]
    files = prepared.source_version(spark, str(tmp_path))
    assert files and all(size >= 0 and time > 0 for _, size, time in files)


def test_numbers_are_numbers_throughout(spark):
    from tapeworks.functions.numeric import safe_float

    texts = ["5d", "1.5f", "1e3", " 7 ", "-.5", "5.", "", None, "x", "1 2", "+3", "NaN", "Infinity"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(safe_float(F.col("t"), -1.0).alias("v")).collect()
    assert [str(r["v"]) for r in rows] == ["-1.0", "-1.0", "1000.0", "7.0", "-0.5", "5.0", "-1.0", "-1.0", "-1.0", "-1.0", "3.0", "nan", "inf"]


def test_load_bars(spark, tmp_path):
    from tapeworks.operators.load import cached_bars

    minute = 60_000
    rows = [("007", i * minute, 10.0 + i, 11.0 + i, 9.0 + i, None if i == 5 else 10.5 + i, 1.0) for i in range(300)]
    rows += [("B", i * minute * 1000 * 1000, 1.0, 1.0, 1.0, 1.0, 0.0) for i in range(60)]
    candles = spark.createDataFrame(rows, "symbol string, open_time bigint, open double, high double, low double, close double, volume double")
    candles.write.parquet(f"{tmp_path}/candles")
    for _ in range(2):
        bars = cached_bars(spark, f"{tmp_path}/candles", f"{tmp_path}/kept", 7, 15)
        got = bars.groupBy("symbol").count().collect()
        assert {r["symbol"]: r["count"] for r in got} == {"007": 20, "B": 4}
    first = bars.where("symbol = '007'").orderBy("bucket").first()
    assert (first.bucket, first.open_time, first.open, first.close, first.volume) == (0, 14 * minute * 1000, 10.0, 24.5, 15.0)
