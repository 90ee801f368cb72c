"""Candle tables: ``symbol, open_time (epoch), open, high, low, close, volume``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.functions.numeric import floor_div
from tapeworks.plans.series import top_k

CANDLE_COLUMNS = ["symbol", "open_time", "open", "high", "low", "close", "volume"]

# The symbols loaded when none are named.
DEFAULT_SYMBOLS = [
    "BTCUSDT", "ETHUSDT", "BNBUSDT", "SOLUSDT", "XRPUSDT",
    "ADAUSDT", "DOGEUSDT", "TRXUSDT", "LINKUSDT", "LTCUSDT",
]

# The smallest median step, in the unit itself, that names a unit,
# and the step assumed for a series without any.
NS_STEP = 10_000_000_000
US_STEP = 10_000_000
DEFAULT_STEP = 60_000
STEP_ROWS = 5000

# Seconds from 1973 to 2072.  Times of these years tell their unit by
# themselves, for the ranges of the three units do not meet.
DATED = (100_000_000, 3_250_000_000)


def scan_candles(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] = CANDLE_COLUMNS,
    where: Column | None = None,
) -> DataFrame:
    """Parquet scan with column pruning and filter pushdown."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns)


def parse_symbols(raw: Column) -> Column:
    """``"btc, eth,"`` -> ``["BTC", "ETH"]``; null or empty text -> null."""
    names = F.transform(F.split(raw, ","), lambda x: F.upper(F.trim(x)))
    return F.when(F.length(raw) > 0, F.filter(names, lambda x: x != ""))


def symbol_universe(df: DataFrame, raw: str, max_symbols: int, keys: Sequence[str] = ()) -> DataFrame:
    """One row per requested symbol with its position in the request."""
    default = F.array(*[F.lit(s) for s in DEFAULT_SYMBOLS])
    parsed = parse_symbols(F.col(raw))
    names = F.slice(F.when(F.size(parsed) > 0, parsed).otherwise(default), 1, max_symbols)
    return df.select(*keys, F.posexplode(names).alias("position", "symbol"))


def only_symbols(df: DataFrame, symbols: Sequence[str] | DataFrame) -> DataFrame:
    """Rows of the requested symbols; requested symbols without rows are skipped.

    A list becomes an IN filter that reaches the Parquet scan.
    """
    if isinstance(symbols, DataFrame):
        return df.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    return df.where(F.col("symbol").isin(list(symbols)))


def require_rows(df: DataFrame) -> DataFrame:
    """Raise when nothing is left; reads one row."""
    if df.isEmpty():
        raise ValueError("no rows left; check the symbols or the path")
    return df


def _per_symbol(df: DataFrame, small: DataFrame, symbols: Sequence[str] | None) -> DataFrame:
    """Attach one row per symbol; broadcast only if a symbol list bounds its size."""
    return df.join(F.broadcast(small) if symbols is not None else small, "symbol")


def _only(df: DataFrame, few: DataFrame, symbols: Sequence[str] | None) -> DataFrame:
    """Rows of the symbols in ``few``; broadcast only if a symbol list bounds its size."""
    return df.join(F.broadcast(few) if symbols is not None else few, "symbol", "left_semi")


def infer_time_unit(df: DataFrame, symbols: Sequence[str] | None = None, bins: int = 4096) -> DataFrame:
    """``symbol, step, unit``: the epoch unit from the median positive step of the last rows.

    A histogram of the times finds where the last ``STEP_ROWS`` rows of each
    symbol begin, so only about that many rows are ever ordered.
    """
    times = (df if symbols is None else only_symbols(df, symbols)).select("symbol", "open_time")
    t = F.col("open_time")
    span = times.groupBy("symbol").agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    cell = floor_div(t - F.col("_lo"), F.greatest(floor_div(F.col("_hi") - F.col("_lo"), bins), F.lit(1)))
    cells = (
        _per_symbol(times, span, symbols)
        .groupBy("symbol", cell.alias("_cell"))
        .agg(F.count(F.lit(1)).alias("_size"), F.min(t).alias("_first"))
    )
    later = Window.partitionBy("symbol").orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        cells.withColumn("_later", F.coalesce(F.sum("_size").over(later), F.lit(0)))
        .where(F.col("_later") < STEP_ROWS)
        .groupBy("symbol")
        .agg(F.min("_first").alias("_cut"))
    )
    tail = _per_symbol(times, cut, symbols).where(t >= F.col("_cut")).drop("_cut")
    tail = top_k(tail, ["symbol"], [t.desc()], STEP_ROWS, ["open_time"])
    gap = t - F.lag(t).over(Window.partitionBy("symbol").orderBy(t))
    steps = tail.select("symbol", gap.alias("_gap")).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("_n"),
        F.floor(F.percentile(F.when(F.col("_gap") > 0, F.col("_gap")), 0.5)).cast("bigint").alias("_median"),
    )
    step = F.coalesce(F.col("_median"), F.lit(DEFAULT_STEP))
    return steps.select("symbol", step.alias("step"), unit_of(step, F.col("_n")).alias("unit"))


def unit_of(step: Column, rows: Column) -> Column:
    return (
        F.when(rows < 2, "ms").when(step >= NS_STEP, "ns").when(step >= US_STEP, "us").otherwise("ms")
    )


def epoch_units(df: DataFrame, symbols: Sequence[str] | None = None) -> DataFrame:
    """``symbol, unit``: the epoch unit from the size of a symbol's last time, whatever the distance of its rows.

    Where no unit puts that time between 1973 and 2072, the step decides, as in
    :func:`infer_time_unit`; a step alone takes dense series for a smaller unit
    and sparse ones for a larger one.
    """
    rows = df if symbols is None else only_symbols(df, symbols)
    units = rows.groupBy("symbol").agg(dated_unit(F.max("open_time")).alias("unit"))
    unknown = units.where(F.col("unit").isNull()).select("symbol")
    stepped = infer_time_unit(_only(rows, unknown, symbols), symbols).select("symbol", "unit")
    return units.where(F.col("unit").isNotNull()).unionByName(stepped)


def dated_unit(t: Column) -> Column:
    """The unit in which an epoch is of the years :data:`DATED`, or null."""
    lo, hi = DATED

    def within(scale: int) -> Column:
        return t.between(lo * scale, hi * scale - 1)

    return F.when(within(10**3), "ms").when(within(10**6), "us").when(within(10**9), "ns")


def minute_in(unit: Column) -> Column:
    """Length of a minute in the unit."""
    return (
        F.when(unit == "ns", F.lit(60_000_000_000))
        .when(unit == "us", F.lit(60_000_000))
        .otherwise(F.lit(60_000))
        .cast("bigint")
    )


def epoch_micros(t: Column, unit: Column) -> Column:
    """Epoch of the given unit as microseconds."""
    return F.when(unit == "ns", floor_div(t, 1000)).when(unit == "us", t).otherwise(t * 1000)


def epoch_to_ts(t: Column, unit: Column) -> Column:
    return F.timestamp_micros(epoch_micros(t, unit))


def with_unit(df: DataFrame, units: DataFrame, symbols: Sequence[str] | None = None) -> DataFrame:
    return _per_symbol(df, units.select("symbol", "unit"), symbols)


def recent_window(
    df: DataFrame,
    days: float,
    symbols: Sequence[str] | None = None,
    units: DataFrame | None = None,
    minute: int = 60_000_000,
) -> DataFrame:
    """Per symbol, rows not older than ``days`` before its last row (bound included).

    The earliest bound over all symbols goes to the scan as a pushed filter, so
    old row groups are not read; the bound per symbol is applied on what is left.
    """
    rows = df if symbols is None else only_symbols(df, symbols)
    last = rows.groupBy("symbol").agg(F.max("open_time").alias("_last"))
    if units is not None:
        last = last.join(units.select("symbol", minute_in(F.col("unit")).alias("_minute")), "symbol")
    else:
        last = last.withColumn("_minute", F.lit(minute).cast("bigint"))
    span = F.col("_minute") * F.lit(int(days) * 1440)
    cuts = last.select("symbol", (F.col("_last") - span).alias("_cut"))
    earliest = cuts.agg(F.min("_cut")).scalar()
    recent = rows.where(F.col("open_time") >= earliest)
    return _per_symbol(recent, cuts, symbols).where(F.col("open_time") >= F.col("_cut")).drop("_cut")
