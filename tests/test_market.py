"""Trailing risk, market values, bars of several widths, votes and growing tables against plain replays."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tapeworks.operators import bars, load, market
from tapeworks.operators.features import FEATURES, add_features
from tapeworks.plans.rolling import asof_join
from tapeworks.sources import appended as ap
from tapeworks.sources import manifests as mf

MINUTE = bars.MINUTE


def returns(seed, n):
    rnd = random.Random(seed)
    out = []
    for s in ("A", "B", "C"):
        at = rnd.randint(-50, 50)
        for _ in range(n):
            at += rnd.choice([1, 1, 1, 2, 5, 70])
            out.append((s, at * MINUTE, rnd.choice([None, float("nan"), 0.0, *[rnd.gauss(0.001, 0.01) for _ in range(9)]])))
    return out


@pytest.mark.parametrize("size", [60, 500])
def test_rolling_risk(spark, size):
    rows = returns(size, 150)
    df = spark.createDataFrame(rows, "symbol string, bucket bigint, return_1 double")
    got = {(r["symbol"], r["bucket"]): r for r in market.rolling_risk(df, span=60 * MINUTE, target=0.001, size=size * MINUTE).collect()}
    assert len(got) == len(rows)
    for s, at, _ in rows:
        known = [v for q, b, v in rows if q == s and at - 60 * MINUTE < b <= at and v is not None and not math.isnan(v)]
        r, n = got[(s, at)], len(known)
        assert r["n"] == n
        if n < 2:
            assert r["mean_return"] is None and r["sharpe"] is None and r["sortino"] is None
            continue
        mean, std = statistics.fmean(known), statistics.stdev(known)
        down = math.sqrt(sum(min(v - 0.001, 0) ** 2 for v in known) / n)
        assert r["mean_return"] == pytest.approx(mean, abs=1e-12)
        for name, by in (("sharpe", std), ("sortino", down)):
            if by == 0:
                assert r[name] is None
            else:
                assert r[name] == pytest.approx((mean - 0.001) / by, rel=1e-6, abs=1e-9)


def test_constant_returns_have_no_ratio(spark):
    df = spark.range(200).select(F.lit("A").alias("symbol"), (F.col("id") * MINUTE).alias("bucket"), F.when(F.col("id") < 20, F.col("id") * 0.3).otherwise(0.1).alias("return_1"))
    last = market.rolling_risk(df, span=10 * MINUTE, size=300 * MINUTE).where(F.col("bucket") >= 40 * MINUTE)
    assert last.where("sharpe IS NOT NULL OR sortino IS NOT NULL").isEmpty() and last.where("n <> 10 OR abs(mean_return - 0.1) > 1e-9").isEmpty()


@pytest.mark.parametrize("keys,salts", [(["symbol"], 1), ([], 5)])
def test_asof_join(spark, keys, salts):
    rnd = random.Random(salts)
    left = [(rnd.choice("AB"), rnd.randint(-400, 400), i) for i in range(300)]
    right = sorted({(rnd.choice("AB") if keys else "A", rnd.randint(-300, 400)) for _ in range(60)})
    right = [(s, at, rnd.choice([None, float(at)])) for s, at in right]
    ldf = spark.createDataFrame(left, "symbol string, bucket bigint, n int").repartition(3)
    rdf = spark.createDataFrame(right, "symbol string, bucket bigint, worth double")
    rdf = rdf if keys else rdf.drop("symbol")
    got = asof_join(ldf, rdf, keys, "bucket", ["worth"], 90, 37, salts, ["symbol"])
    assert got.columns == ["symbol", "bucket", "n", "worth"]
    expect = []
    for s, at, n in left:
        seen = [(b, w) for q, b, w in right if (q == s or not keys) and b <= at]
        last = max(seen, key=lambda x: x[0], default=None)
        expect.append((s, at, n, last[1] if last and at - last[0] <= 90 else None))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expect, key=repr)


def test_market_proxy_without_own_leaders(spark):
    rows = [("L", 0, 0.1), ("M", 0, 0.3), ("X", 1, 0.5), ("L", 2, float("nan")), ("M", 3, None), ("X", 3, 0.7), ("Y", -1, 0.2)]
    df = spark.createDataFrame(rows, "symbol string, bucket bigint, log_return_1 double")
    got = {(r["symbol"], r["bucket"]): (r["market_value"], r["market_members"]) for r in market.market_proxy(df, ["L", "M"]).collect()}
    assert got[("X", 1)] == got[("X", 3)] == (0.2, 2) and got[("Y", -1)] == (None, None)


def candles(spark, n=4000):
    price = (F.col("id") * 37 % 101).cast("double")
    return spark.range(n).select(
        F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("id") % 3 + 1).cast("int")).alias("symbol"),
        (F.col("id") * 47_000_000 + (F.col("id") % 11) * 900_000_000 + 5 * MINUTE).alias("open_time"), F.col("id").alias("seq"),
        F.when(F.col("id") % 5 != 0, price).alias("open"), price.alias("high"), (price - 3).alias("low"),
        F.when(F.col("id") % 4 != 0, price).otherwise(float("nan")).alias("close"), F.when(F.col("id") % 6 != 0, price).alias("volume"),
    )


def test_bars_of_many_widths(spark):
    df = candles(spark)
    many = bars.resample_many(df, [15, 60, 7, 240, 1440, 7], "seq")
    assert many.select("minutes").distinct().count() == 5
    for m in (7, 15, 60, 240, 1440):
        one, part = bars.resample(df, m, "seq"), many.where(F.col("minutes") == m).drop("minutes")
        assert part.count() == one.count() > 0 and part.select(one.columns).exceptAll(one).isEmpty()
    with pytest.raises(ValueError):
        bars.resample_many(df, [])


def test_many_widths_read_once(spark, tmp_path):
    candles(spark).write.parquet(f"{tmp_path}/c")
    many = bars.resample_many(spark.read.parquet(f"{tmp_path}/c"), [15, 60, 240], "seq")
    assert many._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_majority_vote(spark):
    rows = [(1, "A", a) for a in (1, 1, 1, 2, 0)] + [(1, "B", a) for a in (2, 1, 0, None)] + [(2, "A", a) for a in (2, 2, 1, 1)] + [(3, "A", None)]
    got = {(r["step"], r["symbol"]): tuple(r)[2:] for r in market.majority_vote(spark.createDataFrame(rows, "step int, symbol string, action int")).collect()}
    assert got == {(1, "A"): (5, 1, 3, 1, True, 1), (1, "B"): (3, 0, 1, 1, False, 0), (2, "A"): (4, 1, 2, 2, False, 0)}


def same_bars(got, expect):
    columns = ["symbol", "bucket", "close", "volume", *FEATURES]
    a, b = (x.select(columns).orderBy("symbol", "bucket").toPandas() for x in (got, expect))
    assert list(a["symbol"]) == list(b["symbol"]) and list(a["bucket"]) == list(b["bucket"])
    for c in columns[2:]:
        assert (a[c] - b[c]).abs().max() < 1e-9, c


def test_growing_bars_equal_a_rebuild(spark, tmp_path):
    df = candles(spark, 9000)
    full = bars.sanitize(add_features(bars.resample(df, 15, "seq")))
    last = df.agg(F.max("open_time")).first()[0]
    day, root, folder = bars.DAY, f"{tmp_path}/kept", f"{tmp_path}/in"
    late = (F.col("seq") % 500 == 3) & (F.col("symbol") != "C")
    build = lambda: load.growing_bars(spark, folder, root, 15, tie="seq")
    df.where((F.col("open_time") < last - day // 2) & ~late).write.mode("append").parquet(folder)
    build()
    kept = next(p for p in (tmp_path / "kept").iterdir())
    first = {p.name for p in (kept / "data").iterdir()}
    df.where((F.col("open_time") >= last - day // 2) & (F.col("open_time") < last - day // 4) & ~late).write.mode("append").parquet(folder)
    got = build()
    same_bars(got, bars.sanitize(add_features(bars.resample(df.where((F.col("open_time") < last - day // 4) & ~late), 15, "seq"))))
    number, manifest = mf.newest_manifest(spark, f"{kept}/manifests")
    assert number == 2 and len(set(manifest["blocks"].values())) <= 2
    df.where((F.col("open_time") >= last - day // 4) | late).write.mode("append").parquet(folder)
    same_bars(build(), full)
    spark.createDataFrame([], df.schema).write.mode("append").parquet(folder)
    same_bars(build(), full)
    assert mf.newest_manifest(spark, f"{kept}/manifests")[0] == 4
    (kept / "manifests" / "000000005").write_text('{"files": {')  # a writer that died
    same_bars(build(), full)
    assert mf.newest_manifest(spark, f"{kept}/manifests")[0] == 5
    assert not mf.commit(spark, f"{kept}/manifests", 4, {})
    assert first and isinstance(build().count(), int)


def test_old_blocks_stay_and_old_versions_go(spark, tmp_path):
    rows = spark.range(4000).select(
        F.lit("A").alias("symbol"), (F.col("id") * 30 * MINUTE).alias("open_time"), F.col("id").alias("seq"),
        *[(F.col("id") % 97 + 1).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")],
    )
    folder, root = f"{tmp_path}/in", f"{tmp_path}/kept"
    for lo, hi in ((0, 3800), (3800, 3900), (3900, 4000)):
        rows.where(F.col("seq").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(folder)
        got = load.growing_bars(spark, folder, root, 60, tie="seq")
    kept = next(p for p in (tmp_path / "kept").iterdir())
    _, manifest = mf.newest_manifest(spark, f"{kept}/manifests")
    versions = list(manifest["blocks"].values())
    assert max(versions.count(v) for v in set(versions)) >= 10 and 1 < len(set(versions)) <= 3
    same_bars(got, bars.sanitize(add_features(bars.resample(rows, 60, "seq"))))
    (tmp_path / "in" / "notes.txt").unlink(missing_ok=True)
    assert ap.vacuum(spark, str(kept), keep=1) is not None and got.count() == 2000
    files = sorted(p for p in (tmp_path / "in").iterdir() if p.name.startswith("part-"))
    files[-1].unlink()
    (tmp_path / "in" / f".{files[-1].name}.crc").unlink(missing_ok=True)
    assert load.growing_bars(spark, folder, root, 60, tie="seq").count() < 2000
