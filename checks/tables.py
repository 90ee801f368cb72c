"""The library's input tables as Spark views over the given tables.

Each is a projection, join or aggregate of the given files, so its size grows
with them.  ``checks.views`` states the same tables in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.operators import equity as eq
from tapeworks.operators import experiments as ex
from tapeworks.operators.bars import MINUTE, resample
from tapeworks.operators.cube import tail_align
from tapeworks.operators.fills import lots as rebuild_lots
from tapeworks.operators.fills import realized, size_buy
from tapeworks.operators.telemetry import align_series, dedup_step
from tapeworks.plans.medians import medians
from tapeworks.plans.series import CHUNK, number_rows

FEE = 0.001
TRADE_FEE = 1 / 900
BAR_CHUNK = CHUNK * MINUTE


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp without time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def props_k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def ticks(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("value")
    return table(spark, d, "events").select(
        F.col("event_type").alias("symbol"),
        micros(F.col("ts")).alias("open_time"),
        *[price.alias(c) for c in ("open", "high", "low", "close")],
        props_k().cast("double").alias("volume"),
        F.col("event_id").alias("seq"),
    )


def ticks_epoch(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("open_time")
    scaled = (
        F.when(F.col("symbol").isin("click", "view"), div(t, 1000))
        .when(F.col("symbol") == "error", t * 1000)
        .otherwise(t)
    )
    return ticks(spark, d).withColumn("open_time", scaled)


def bars(spark: SparkSession, d: str) -> DataFrame:
    return resample(ticks(spark, d), 60, tie="seq")


def nbars(spark: SparkSession, d: str) -> DataFrame:
    return number_rows(bars(spark, d), ["symbol"], "bucket", BAR_CHUNK)


def aligned(spark: SparkSession, d: str) -> DataFrame:
    return tail_align(bars(spark, d))


def entries(spark: SparkSession, d: str) -> DataFrame:
    mid = medians(bars(spark, d), ["symbol"], {"_mid": "volume"})
    rows = nbars(spark, d).join(mid, "symbol").where((F.col("volume") > F.col("_mid")) & (F.col("close") > 0))
    return rows.select("symbol", F.col("rn").alias("entry_step"), F.col("close").alias("entry_price"))


def prices(spark: SparkSession, d: str) -> DataFrame:
    return nbars(spark, d).select("symbol", F.col("rn").alias("step"), "close")


def steps(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(
        F.col("user_id").alias("run"), "event_id", "event_type", "value", props_k().alias("k"), "ts"
    )
    return number_rows(rows, ["run"], "event_id", name="step", total="last_step")


def decisions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    return steps(spark, d).select(
        "run", "step",
        ((k % 31).cast("double") / 10).alias("a0_legacy"),
        ((k - 50).cast("double") / 50).alias("a0"),
        ((k % 6).cast("double") - 0.5).alias("a1"),
        (F.col("value") / 250).alias("a2"),
        (F.col("event_id") % 4).cast("int").alias("n_positions"),
        "k",
    )


def all_fills(spark: SparkSession, d: str) -> DataFrame:
    k, kind = F.col("k"), F.col("event_type")
    side = (
        F.when(kind.isin("purchase", "signup"), "buy").when(kind.isin("error", "click"), "sell").otherwise("none")
    )
    pct = F.when(k % 4 == 0, 1.0).when(k % 4 == 1, 0.25).when(k % 4 == 2, 0.5).otherwise(0.75)
    return steps(spark, d).select(
        "run", "step", "last_step", (k % 3).alias("sym"), side.alias("side"), pct.alias("pct"),
        (F.col("value") + 8 / 7).alias("price"), (4 + k).cast("double").alias("cash"),
    )


def fills(spark: SparkSession, d: str) -> DataFrame:
    sized = size_buy(all_fills(spark, d), FEE)
    wanted = (F.col("side") == "sell") | ((F.col("side") == "buy") & F.col("accepted"))
    return sized.where(wanted).drop("accepted", "fee_paid")


def lots(spark: SparkSession, d: str) -> DataFrame:
    return rebuild_lots(fills(spark, d), carry=["amount", "last_step"])


def lot_pnl(spark: SparkSession, d: str) -> DataFrame:
    """Lot events with profit and fee; buys have no profit and pay on their amount."""
    rows = realized(lots(spark, d), FEE)
    sell = F.col("side") == "sell"
    return (
        rows.withColumn("fee_paid", F.when(sell, F.col("fee_paid")).otherwise(F.col("amount") * FEE))
        .withColumn("realized_pnl", F.when(sell, F.col("realized_pnl")))
        .withColumn("gross", F.when(sell, F.col("gross")))
    )


def cash_delta() -> Column:
    return F.when(F.col("side") == "buy", -F.col("amount")).otherwise(F.col("qty") * F.col("price") * (1 - FEE))


def cash_flow(spark: SparkSession, d: str) -> DataFrame:
    moved = lots(spark, d).select("run", "step", cash_delta().alias("_delta"))
    rows = steps(spark, d).select("run", "step").join(moved, ["run", "step"], "left")
    return rows.select("run", "step", F.coalesce(F.col("_delta"), F.lit(0.0)).alias("cash_delta"))


def run_steps(spark: SparkSession, d: str) -> DataFrame:
    return eq.run_steps(table(spark, d, "events").groupBy(F.col("user_id").alias("run")).agg(F.count(F.lit(1)).alias("last_step")))


def moves(spark: SparkSession, d: str) -> DataFrame:
    return eq.holdings(lots(spark, d), cash_delta())


def run_prices(spark: SparkSession, d: str) -> DataFrame:
    """``sym, step, close``: aligned prices by symbol index."""
    rows = aligned(spark, d)
    names = table(spark, d, "events").agg(F.array_sort(F.collect_set("event_type"))).scalar()
    return rows.select((F.array_position(names, F.col("symbol")) - 1).cast("int").alias("sym"), "step", "close")


def equity(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    return steps(spark, d).select(
        "run", "step", (60 + F.col("value") / 2).alias("portfolio_value"),
        (F.col("event_id") % 4).cast("int").alias("n_positions"),
        (k % 3 == 0).alias("held"), (k % 3 != 0).alias("executed"), (k.cast("double") / 10).alias("notional"),
    )


def drawn(spark: SparkSession, d: str) -> DataFrame:
    return eq.drawdown(equity(spark, d))


def closed_trades(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(
        table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority"),
        F.col("l_orderkey") == F.col("o_orderkey"),
    )
    entry = F.col("l_extendedprice") / F.col("l_quantity")
    origin = F.lit("1995-01-01").cast("date")

    def day(c: Column) -> Column:
        return F.date_diff(c.cast("date"), origin).cast("bigint")

    flag = F.col("l_returnflag")
    rows = rows.select(
        F.col("l_suppkey").alias("run"), F.col("o_orderpriority").alias("symbol"), F.col("l_quantity").alias("qty"),
        entry.alias("entry_price"),
        (entry * (1 + F.col("l_tax") - F.col("l_discount"))).alias("exit_price"),
        day(F.least("o_orderdate", "l_shipdate")).alias("entry_step"),
        day(F.greatest("o_orderdate", "l_shipdate")).alias("exit_step"),
        F.when(flag == "A", "sell").when(flag == "R", "stop_loss").otherwise("time_limit").alias("reason"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_tax", "l_linestatus",
    )
    qty, exit_price, entry_price = F.col("qty"), F.col("exit_price"), F.col("entry_price")
    return rows.withColumn("realized_pnl", qty * exit_price * (1 - TRADE_FEE) - qty * entry_price).withColumn(
        "return_pct", (exit_price - entry_price) / entry_price
    )


TRADE_TIE = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_tax", "l_linestatus",
             "run", "qty", "entry_step", "reason"]


def run_metrics(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    status = F.col("o_orderstatus")

    def number(x: Column) -> Column:
        return x.cast("double")

    return table(spark, d, "orders").select(
        k.alias("run"),
        F.when(status == "F", "gate").when(status == "O", "confirm").otherwise("robust").alias("phase"),
        F.col("o_orderpriority").alias("config"),
        (c % 3).alias("seed"),
        F.when(k % 10 == 0, 1).otherwise(0).alias("return_code"),
        number((k * 7) % 5000).alias("val_trades"),
        (number(k % 1000) / 10).alias("val_win_rate_pct"),
        (number((k * 37) % 1001) / 100 - 5).alias("val_return_pct"),
        number((k * 11 + c) % 5200).alias("test_trades"),
        (number(c % 1000) / 10).alias("test_win_rate_pct"),
        (number((k * 53 + c) % 1103) / 100 - 5).alias("test_return_pct"),
    )


def scored(spark: SparkSession, d: str) -> DataFrame:
    return ex.score(ex.trade_band(run_metrics(spark, d)))


def config_stats(spark: SparkSession, d: str) -> DataFrame:
    return ex.aggregate_by_config(scored(spark, d), ["phase", "config"])


def logs(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    nl = F.lit("\n")

    def text(x: Column) -> Column:
        return x.cast("string")

    def two(x: Column) -> Column:
        return F.lpad(text(x), 2, "0")

    def minus(condition: Column) -> Column:
        return F.when(condition, "-").otherwise("")

    body = F.concat(
        F.lit("Val Trades:    1 | WR:  10.0% | Return:  -0.50%"), nl, F.lit("early test Win Rate: n/a"), nl,
        F.lit("Val Trades:  "), text((k * 7) % 5000), F.lit(" | WR:  "), text(div(k % 1000, 10)), F.lit("."),
        text(k % 10), F.lit("% | Return:   "), minus(k % 2 == 0), text((k * 37) % 13), F.lit("."),
        two((k * 37) % 100), F.lit("%"), nl,
        F.lit("Test Trades: "), text((k * 11) % 5200), F.lit(" | WR:  "), text(div(c % 1000, 10)), F.lit("."),
        text(c % 10), F.lit("% | Return:   "), minus(c % 2 == 0), text(c % 11), F.lit("."), two(c % 100),
        F.lit("%"), nl,
        F.lit("Test Win Rate: "), text(c % 90), F.lit(".5% | all"), nl,
        F.lit("  TEST Return: "), text(k % 17), F.lit(".25%"), nl,
        F.lit("Test PnL: $"), minus(c % 3 == 0), text(k % 29), F.lit(".75 | net  "), nl,
    )
    whole = F.concat(
        F.lit("start of run "), text(k), nl, F.when(k % 7 == 0, F.lit("")).otherwise(body),
        F.lit("done after "), text(c), F.lit(" updates"),
    )
    return table(spark, d, "orders").select(k.alias("log"), whole.alias("text"))


def telemetry(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("k", props_k())
    k = F.col("k")
    value = F.when(k % 10 == 0, F.lit(None)).when(k % 10 == 1, 0.0).otherwise(F.col("value"))
    return rows.select(
        F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run"),
        F.col("event_type").alias("key"),
        F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("step"),
        F.col("event_id").alias("pos"),
        value.alias("value"),
    )


WIDE = ["click", "error", "purchase", "signup", "view"]


def dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup_step(telemetry(spark, d), ["click", "view"])


def wide(spark: SparkSession, d: str) -> DataFrame:
    return align_series(dedup(spark, d), WIDE)


def run_index(spark: SparkSession, d: str) -> DataFrame:
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    origin = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")

    def at(seconds: Column, pattern: str) -> Column:
        return F.date_format(origin + F.make_dt_interval(secs=seconds.cast("decimal(18,6)")), pattern)

    stamp = "yyyy-MM-dd HH:mm:ss 'UTC'"
    run_id = F.concat(
        F.lit("run-"), at(key, "yyyyMMdd-HHmmss"), F.lit("-"), F.lpad(F.hex(key), 6, "0")
    )
    return table(spark, d, "customer").select(
        key.alias("seq"),
        F.when(key % 11 == 0, F.concat(F.lit("job-"), key.cast("string"))).otherwise(run_id).alias("run_id"),
        F.when(segment == "AUTOMOBILE", "train").when(segment == "BUILDING", "backtest")
        .when(segment == "FURNITURE", "walk_forward").when(segment == "HOUSEHOLD", "eval")
        .otherwise("backtest_3way").alias("mode"),
        F.when(key % 4 == 0, "running").when(key % 4 == 1, "completed").when(key % 4 == 2, "failed")
        .otherwise("stopped").alias("status"),
        F.when(key % 13 == 0, "unknown").otherwise(at(key, stamp)).alias("started_at"),
        F.when(key % 4 != 0, at(key * 3 + F.col("c_nationkey") * 700, stamp)).alias("finished_at"),
        F.when(key % 5 != 0, key - 100).alias("elapsed_seconds"),
    )


def payloads(spark: SparkSession, d: str) -> DataFrame:
    sides = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("split")) for i, s in enumerate(("dev", "test"))])
    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal", F.explode(sides).alias("s"))
    rows = rows.select(F.col("c_custkey").alias("run"), F.col("c_acctbal").alias("b"), "s.i", "s.split")
    run, b, i = F.col("run"), F.col("b"), F.col("i")
    rows = rows.where((run % 9 != 4) | (i == 0))
    trades = (run * 3 + i) % 40
    none = run % 6 == 0
    return rows.select(
        "run", "split",
        ((run * 7 + i * 13) % 5 * 100).alias("steps"),
        trades.alias("trades"),
        F.when(none, F.lit(0)).otherwise(div(trades, 3)).alias("winning_trades"),
        F.when(none, F.lit(0)).otherwise(trades - div(trades, 3)).alias("losing_trades"),
        (((run * 17 + i) % 1000).cast("double") / 10).alias("win_rate_pct"),
        (b / (10 + i)).alias("realized_pnl"),
        (100 + b / (20 + i)).alias("final_portfolio_value"),
        (b / (30 + i)).alias("total_return_pct"),
        (b / (40 + i)).alias("unrealized_pnl"),
    )


def finance(spark: SparkSession, d: str) -> DataFrame:
    run, b = F.col("c_custkey"), F.col("c_acctbal")
    return table(spark, d, "customer").select(
        run.alias("run"), (90 + b / 15).alias("portfolio_value"), (b / 25).alias("total_return_pct"),
        F.when(run % 3 != 0, b / 12).alias("realized_pnl"), (b / 35).alias("unrealized_pnl"),
        (run % 50).alias("trades"), div(run % 50, 2).alias("winning_trades"),
        (run % 50 - div(run % 50, 2)).alias("losing_trades"), ((run % 1000).cast("double") / 10).alias("win_rate_pct"),
    )


def variants(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")

    def options(**items) -> Column:
        parts = []
        for name, value in items.items():
            parts += [F.lit("--" + name.replace("_", "-")), value if isinstance(value, Column) else F.lit(value)]
        return F.create_map(*parts)

    base = options(reward_mode="equity_delta", days="14", algo="ppo", quiet="")
    overrides = (
        F.when(k % 4 == 0, options(days=F.col("p_size").cast("string")))
        .when(k % 4 == 1, options(reward_mode="shaped", mode=F.lower("p_type")))
        .when(k % 4 == 2, options(action_mapping_mode="legacy", algo=F.col("p_brand"), quiet=""))
        .otherwise(options(mode=""))
    )
    return table(spark, d, "part").select(
        F.concat(F.lit("v"), k.cast("string")).alias("config"), k.alias("p_partkey"),
        base.alias("base"), overrides.alias("overrides"),
    )
