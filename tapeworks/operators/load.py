"""From raw candles to prepared bars, in the order a training run needs them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.operators.bars import DAY, MINUTE, ffill, resample, sanitize
from tapeworks.operators.features import (
    EMA_FAST, EMA_SIGNAL, EMA_SLOW, FEATURES, RSI_PERIOD, VOLUME_WINDOW, add_features, reach, span_alpha,
)
from tapeworks.sources.appended import appended
from tapeworks.sources.candles import epoch_micros, epoch_units, recent_window, require_rows, scan_candles, with_unit
from tapeworks.sources.prepared import prepared, source_version

#: Weights of the averages that features are made of; the signal line averages an average.
AVERAGES = [span_alpha(EMA_FAST), span_alpha(EMA_SLOW), span_alpha(EMA_SIGNAL), 1.0 / RSI_PERIOD]


def load_bars(
    candles: DataFrame, days: float, minutes: int, symbols: Sequence[str] | None = None, features: Sequence[str] = FEATURES, tie: str | None = None
) -> DataFrame:
    """Recent rows of each symbol in its own time unit, as bars in epoch microseconds with features; gaps filled, numbers finite."""
    units = epoch_units(candles, symbols)
    rows = with_unit(recent_window(candles, days, symbols, units), units, symbols)
    rows = rows.withColumn("open_time", epoch_micros(F.col("open_time"), F.col("unit"))).drop("unit")
    return sanitize(add_features(ffill(resample(rows, minutes, tie)), features))


def cached_bars(
    spark: SparkSession, path: str, root: str, days: float, minutes: int, symbols: Sequence[str] | None = None, features: Sequence[str] = FEATURES
) -> DataFrame:
    """:func:`load_bars` of a candle file, kept below ``root`` under a key of the parameters and the files' version."""
    params = {"source": path, "version": source_version(spark, path), "days": days, "minutes": minutes, "symbols": symbols, "features": list(features)}
    return prepared(spark, root, params, lambda: load_bars(require_rows(scan_candles(spark, path)), days, minutes, symbols, features))


def growing_bars(
    spark: SparkSession, path: str, root: str, minutes: int, features: Sequence[str] = FEATURES, tie: str | None = None
) -> DataFrame:
    """Bars with features of a folder of candle files in epoch microseconds, kept up to date below ``root``.

    Added files cost what they change; the width must divide a day.
    """
    width = int(minutes) * MINUTE
    if DAY % width:
        raise ValueError("the width must divide a day")
    params = {"source": path, "minutes": minutes, "features": list(features), "tie": tie}
    look_back = 2 * max(n * size for size, n in (reach(a) for a in AVERAGES))
    return appended(
        spark, path, root, params, lambda candles: resample(candles, minutes, tie), lambda bars: sanitize(add_features(bars, features)),
        look_back + VOLUME_WINDOW, lambda t: t - F.pmod(t, F.lit(width)),
    )
