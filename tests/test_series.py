"""Chunked series helpers against plain loops, with chunks of a few rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import cube, features, splits
from tapeworks.operators.equity import trade_rate
from tapeworks.operators.orders import audit_cooldown, audit_window_cap
from tapeworks.operators.telemetry import interpolate
from tapeworks.plans.medians import medians
from tapeworks.plans.series import Fold, number_rows, running, settle, top_k, with_halo


@pytest.fixture(scope="module")
def walk(spark):
    rng = np.random.default_rng(5)
    rows = []
    for run, n in (("a", 60), ("b", 9), ("c", 1)):
        for step in np.sort(rng.choice(200, n, replace=False)):
            v = None if rng.random() < 0.3 else float(np.round(rng.normal(), 3))
            rows.append((run, int(step), v))
    pdf = pd.DataFrame(rows, columns=["run", "step", "v"]).astype({"v": object})
    df = spark.createDataFrame(rows, "run string, step bigint, v double").repartition(5)
    pdf["v"] = pd.to_numeric(pdf["v"])
    return df, pdf


def test_number_rows(walk):
    df, pdf = walk
    got = number_rows(df, ["run"], "step", width=7, total="n").toPandas().sort_values(["run", "step"])
    expect = pdf.sort_values(["run", "step"])
    assert list(got["rn"]) == list(expect.groupby("run").cumcount() + 1)
    assert list(got["n"]) == list(expect.groupby("run")["step"].transform("size"))


def test_number_rows_without_key(spark):
    names = spark.createDataFrame([(s,) for s in ("BTC", "ADA", "BNB", "ABC", "ZZ", "BNBX")], "symbol string")
    got = {r["symbol"]: r["idx"] for r in cube.symbol_index(names.union(names)).collect()}
    assert got == {"ABC": 0, "ADA": 1, "BNB": 2, "BNBX": 3, "BTC": 4, "ZZ": 5}


@pytest.mark.parametrize("reverse", [False, True])
def test_running(walk, reverse):
    df, pdf = walk
    v = F.col("v")
    folds = {
        "s": Fold("sum", v), "c": Fold("count", v), "mx": Fold("max", v), "mn": Fold("min", v, False),
        "last": Fold("last", v), "prev": Fold("last", v, False), "p": Fold("product", v, False),
    }
    folds = {n: Fold(f.kind, f.value, f.inclusive, reverse) for n, f in folds.items()}
    got = running(df, ["run"], "step", folds, width=7).toPandas().sort_values(["run", "step"])
    for run, part in pdf.groupby("run"):
        part = part.sort_values("step", ascending=not reverse)
        g = got[got["run"] == run].set_index("step").loc[part["step"]]
        seen = []
        for x, (_, row) in zip(part["v"], g.iterrows(), strict=True):
            before = [y for y in seen if not np.isnan(y)]
            seen.append(x)
            now = [y for y in seen if not np.isnan(y)]
            assert row["s"] == pytest.approx(sum(now))
            assert row["c"] == len(now)
            assert row["p"] == pytest.approx(np.prod(before))
            for name, values, pick in (("mx", now, max), ("mn", before, min), ("last", now, lambda z: z[-1]), ("prev", before, lambda z: z[-1])):
                assert (np.isnan(row[name]) and not values) or row[name] == pick(values)


def test_halo_gives_complete_frames(walk):
    df, pdf = walk
    rows = number_rows(df, ["run"], "step", width=7)
    rows = with_halo(rows, "rn", 8, 5)
    counts = rows.groupBy("_halo").count().collect()
    assert {r["_halo"]: r["count"] for r in counts}[False] == len(pdf)


def test_top_k_is_exact_and_total(walk):
    df, pdf = walk
    got = top_k(df, ["run"], [F.desc("step")], 4, ["step"], rank="rank").toPandas()
    expect = pdf.sort_values("step").groupby("run").tail(4)
    assert sorted(zip(got["run"], got["step"])) == sorted(zip(expect["run"], expect["step"]))
    assert set(got["rank"]) == {1, 2, 3, 4}


@pytest.mark.parametrize("upper", [False, True])
def test_medians(spark, upper):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"g": rng.integers(0, 6, 500), "x": np.round(rng.lognormal(0, 3, 500), 2), "y": rng.integers(-2, 3, 500) * 1.0})
    frame = pd.concat([frame, pd.DataFrame({"g": [7, 8, 8], "x": [1.5, -3.0, 9.0], "y": [0.0, 0.0, 0.0]})])
    got = medians(spark.createDataFrame(frame), ["g"], {"x": "x", "y": "y"}, upper).toPandas().set_index("g")
    for g, part in frame.groupby("g"):
        for c in ("x", "y"):
            values = np.sort(part[c])
            expect = values[len(values) // 2] if upper else np.median(values)
            assert got.loc[g, c] == pytest.approx(expect)


def test_medians_with_few_bins(spark):
    from tapeworks.plans.medians import ranked_values

    frame = pd.DataFrame({"g": 1, "x": np.r_[np.arange(100) / 100, 1e9, -1e9]})
    ranks = F.array(F.lit(1), F.lit(51), F.lit(102))
    got = ranked_values(spark.createDataFrame(frame), ["g"], "x", ranks, bins=3).toPandas().set_index("r")["value"]
    assert got[1] == -1e9 and got[102] == 1e9 and got[51] == pytest.approx(0.49)


def test_features_over_many_blocks(spark):
    rng = np.random.default_rng(3)
    frames = []
    for symbol, n in (("A", 2500), ("B", 300), ("C", 2), ("D", 1)):
        close = 100 + np.cumsum(rng.normal(size=n))
        frames.append(pd.DataFrame({
            "symbol": symbol, "bucket": np.sort(rng.choice(20_000, n, replace=False)) * 60_000_000, "close": close,
            "open": close, "high": close + 1, "low": close - 1, "volume": rng.integers(0, 50, n) * 1.0,
        }))
    pdf = pd.concat(frames)
    pdf["open_time"] = pdf["bucket"]
    got = features.add_features(spark.createDataFrame(pdf), width=900 * 60_000_000, block=768).toPandas()
    got = got.sort_values(["symbol", "bucket"])
    assert len(got) == len(pdf)
    for symbol, part in pdf.groupby("symbol"):
        g = got[got["symbol"] == symbol].reset_index(drop=True)
        for name, values in replayed(part["close"].tolist(), part["volume"].tolist()).items():
            np.testing.assert_allclose(g[name], values, atol=1e-9, err_msg=f"{symbol} {name}")


def replayed(closes, volumes):
    """The features of one symbol, bar after bar."""
    out = {n: [] for n in ("return_1", "volume_z", "ema_fast_gap", "ema_slow_gap", "macd_hist_pct", "rsi_14")}
    state = {}

    def smooth(name, value, weight):
        state[name] = value if name not in state else state[name] + weight * (value - state[name])
        return state[name]

    for i, close in enumerate(closes):
        fast, slow = smooth("fast", close, 2 / 13), smooth("slow", close, 2 / 27)
        signal = smooth("signal", fast - slow, 2 / 10)
        out["ema_fast_gap"].append((close - fast) / close)
        out["ema_slow_gap"].append((close - slow) / close)
        out["macd_hist_pct"].append((fast - slow - signal) / close)
        change = close - closes[i - 1] if i else None
        out["return_1"].append(change / closes[i - 1] if i else 0.0)
        strength = 50.0
        if i:
            up, down = smooth("up", max(change, 0.0), 1 / 14), smooth("down", max(-change, 0.0), 1 / 14)
            strength = 100 * up / (up + down) if down else 50.0
        out["rsi_14"].append(strength / 100)
        seen = volumes[max(0, i - 19) : i + 1]
        mean = sum(seen) / len(seen)
        spread = (sum((x - mean) ** 2 for x in seen) / len(seen)) ** 0.5
        out["volume_z"].append((seen[-1] - mean) / spread if len(seen) >= 3 and spread else 0.0)
    return out


@pytest.mark.parametrize("alpha", [2 / 13, 2 / 27, 2 / 201, 2 / 501, 2 / 1001, 0.95, 0.999999, 1.0])
def test_exponential_average_of_any_weight(spark, alpha):
    rng = np.random.default_rng(8)
    values = 1e3 + np.cumsum(rng.normal(size=5000))
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "bucket": np.arange(5000), "x": values}))
    got = features.ema(df, "x", alpha, "y", width=700, block=1024).toPandas().sort_values("bucket")["y"]
    expect, last = [], values[0]
    for x in values:
        last += alpha * (x - last)
        expect.append(last)
    np.testing.assert_allclose(got, expect, rtol=1e-12)


def test_rsi_is_half_without_losses(spark):
    rows = [("A", i, float(10 + i), 5.0) for i in range(30)]
    df = spark.createDataFrame(rows, "symbol string, bucket bigint, close double, volume double")
    got = features.add_features(df, ["rsi_14", "volume_z"], width=7).toPandas()
    assert set(got["rsi_14"]) == {0.5} and set(got["volume_z"]) == {0.0}


def test_lookback_pads_and_crosses_blocks(spark):
    cube_rows = spark.createDataFrame([(i, [float(i), -float(i)]) for i in range(25)], "step bigint, vector array<double>")
    got = {r["step"]: [v[0] for v in r["window"]] for r in cube.lookback(cube_rows, 4, size=5).collect()}
    assert got == {i: [float(max(0, i - 3 + j)) for j in range(4)] for i in range(25)}


def test_split_bounds(spark):
    def sizes(fn, n):
        df = spark.range(n).select(F.lit("A").alias("symbol"), F.col("id").alias("bucket"))
        return {r["split"]: r["count"] for r in fn(df).groupBy("split").count().collect()}

    assert sizes(lambda d: splits.split_3way(d, width=50), 20161) == {"train": 12096, "val": 4032, "test": 4033}
    assert sizes(splits.split_3way, 1) == {"train": 1}
    assert sizes(splits.split_3way, 2) == {"train": 1, "val": 1}
    assert sizes(splits.split_3way, 3) == {"train": 1, "val": 1, "test": 1}
    assert sizes(splits.split_2way, 2) == {"train": 1, "test": 1}


def test_walk_forward_folds(spark):
    df = spark.range(230).select(F.when(F.col("id") < 130, "A").otherwise("B").alias("symbol"), F.col("id").alias("bucket"))
    got = splits.walk_forward(df, 0.5, 0.15, 0.15, 0.1, 9, width=16)
    folds = got.groupBy("symbol", "fold", "start", "split").agg(F.count("*").alias("n"), F.min("bucket").alias("lo")).toPandas()
    assert sorted(folds["start"].unique()) == [0, 10, 20]
    for split, n, at in (("train", 50, 0), ("val", 15, 50), ("test", 15, 65)):
        part = folds[folds["split"] == split]
        assert len(part) == 6 and set(part["n"]) == {n}
        offset = part["symbol"].map({"A": 0, "B": 130})
        assert ((part["lo"] - offset) == part["start"] + at).all()
    with pytest.raises(ValueError):
        splits.walk_forward(df, 0.9, 0.2, 0.2, 0.1, 3)


def test_trade_rate_over_blocks(spark):
    rows = [("r", i * 3, i % 3 == 0 or i > 60) for i in range(100)]
    df = spark.createDataFrame(rows, "run string, step bigint, executed boolean")
    got = trade_rate(df, 12, 0.5, 2.0, width=20, size=16).toPandas().sort_values("step").reset_index(drop=True)
    done = pd.Series([float(r[2]) for r in rows])
    rate = done.rolling(12, min_periods=1).mean()
    np.testing.assert_allclose(got["trade_rate"], rate)
    cost = np.where((np.arange(100) >= 9) & (rate > 0.5), 2 * (rate - 0.5), 0)
    np.testing.assert_allclose(got["rate_penalty"], cost)


def test_audits_over_blocks(spark):
    steps = [1, 2, 5, 6, 7, 9, 14, 15, 16, 17, 18, 30]
    df = spark.createDataFrame([("r", s) for s in steps], "run string, step bigint")
    got = audit_cooldown(audit_window_cap(df, 2, 4, size=5), 2, width=5).toPandas().sort_values("step")
    assert list(got["recent_trades"]) == [sum(s - 4 < x < s for x in steps) for s in steps]
    assert list(got["in_cooldown"]) == [any(x == s - 1 for x in steps) for s in steps]


def test_interpolate_known_answer(spark):
    rows = [("r", 0, None), ("r", 1, 1.0), ("r", 2, None), ("r", 10, 3.0), ("r", 20, None)]
    df = spark.createDataFrame(rows, "run string, step bigint, v double")
    got = interpolate(df, ["v"], width=3).orderBy("step").toPandas()["v"]
    np.testing.assert_allclose(got, [1, 1, 1 + 2 / 9, 3, 3])


def test_settle_cuts_the_lineage(spark):
    df = settle(spark.range(3).withColumn("x", F.col("id") * 2))
    assert "Scan ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()
    assert [r["x"] for r in df.orderBy("id").collect()] == [0, 2, 4]


@pytest.mark.parametrize("values", [
    np.exp(10 * np.random.default_rng(0).normal(size=20_000)), np.r_[np.random.default_rng(1).random(20_000), 1e300, -1e300],
    1e9 + np.arange(20_000) * 1e-6, np.r_[np.full(10_000, 3.0), np.arange(10_001)],
])
def test_medians_of_heavy_tails_leave_little_to_sort(spark, values):
    from tapeworks.plans.medians import narrowed

    df = spark.createDataFrame(pd.DataFrame({"g": 1, "x": values})).repartition(4)
    assert medians(df, ["g"], {"m": "x"}).first()["m"] == pytest.approx(np.median(values), rel=1e-15)
    left, _ = narrowed(df, ["g"], "x", F.array(F.call_function("div", F.col("n") + 1, F.lit(2))))
    assert left.count() <= 200


def test_medians_of_finite_values(spark):
    rows = [(1, x) for x in (1.0, 2.0, 4.0, float("nan"), float("inf"), float("-inf"), None)] + [(2, float("nan"))]
    got = {r["g"]: r["m"] for r in medians(spark.createDataFrame(rows, "g int, x double"), ["g"], {"m": "x"}).collect()}
    assert got == {1: 2.0}


def test_walk_forward_needs_room(spark):
    df = spark.range(2).select(F.lit("A").alias("symbol"), F.col("id").alias("bucket"))
    with pytest.raises(Exception, match="not enough rows"):
        splits.walk_forward(df, 0.5, 0.2, 0.2, 0.1, 3).collect()


def test_configs_without_a_median_rank_last(spark):
    from tapeworks.operators.experiments import RANKING, rank_configs

    rows = [("a", None, None, 1.0, None), ("b", -3.0, 1.0, 1.0, 0.0), ("c", 2.0, 1.0, 0.5, 0.0), ("d", None, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "config string, " + ", ".join(f"{c} double" for c in RANKING))
    got = {r["config"]: r["rank"] for r in rank_configs(df).collect()}
    assert (got["c"], got["b"]) == (1, 2) and {got["a"], got["d"]} == {3, 4}


def test_null_keys_and_orderings_are_errors(spark):
    schema = "run string, step bigint, v double"
    for bad in ((None, 1, 1.0), ("a", None, 1.0)):
        df = spark.createDataFrame([("a", 1, 1.0), bad], schema)
        for plan in (number_rows(df, ["run"], "step"), running(df, ["run"], "step", {"s": Fold("sum", F.col("v"))})):
            with pytest.raises(Exception, match="a series needs keys and an ordering"):
                plan.collect()
