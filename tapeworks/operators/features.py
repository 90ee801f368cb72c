"""Technical features of bars, per symbol in time order.

Bars are numbered, cut into blocks of ``BLOCK`` rows with a halo and shuffled
once by ``(symbol, block)``; all windows below then run without a further
shuffle, and no task holds more than one block of a symbol at a time.

The exponential average is a recurrence, which windows cannot state.  Its
solution inside a stretch of rows is a scaled running sum; what earlier stretches
add has decayed by ``(1 - alpha) ** stretch`` each.  :func:`reach` picks the stretch
so that the scale stays a normal number, and so many earlier stretches that what
lies before them is below double precision; the halo of a block holds them.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.numeric import finite_or_zero, floor_div, ratio
from tapeworks.operators.bars import MINUTE
from tapeworks.plans.series import CHUNK, number_rows, with_halo

STRETCH = 256
LOOKBACK = 3
HALO = STRETCH * LOOKBACK
BLOCK = STRETCH * 64

# Spans and window lengths of the indicators, and their output order.
EMA_FAST = 12
EMA_SLOW = 26
EMA_SIGNAL = 9
RSI_PERIOD = 14
VOLUME_WINDOW = 20
VOLUME_MIN_ROWS = 3
FEATURES = [
    "log_close", "return_1", "log_return_1", "range_pct", "volume_log",
    "volume_z", "ema_fast_gap", "ema_slow_gap", "macd_hist_pct", "rsi_14",
]
REQUIRED = {"symbol", "open_time", "close"}


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1)


def reach(alpha: float) -> tuple[int, int]:
    """Rows of a stretch and number of earlier stretches that an average of weight ``alpha`` needs."""
    if not 0 < alpha <= 1:
        raise ValueError("the weight of an average is above 0 and at most 1")
    if alpha == 1:
        return STRETCH, 1
    fade = -log(1 - alpha)
    stretch = STRETCH
    while stretch > 1 and stretch * fade > 600:  # the scale must stay above the smallest double
        stretch //= 2
    return stretch, max(1, ceil(38 / fade / stretch))


def feature_schema(df: DataFrame, preferred: Sequence[str] = FEATURES) -> list[str]:
    """Feature columns present in ``df`` in preferred order, else ``close``."""
    missing = sorted(REQUIRED - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return [c for c in preferred if c in df.columns] or ["close"]


def blocked(
    bars: DataFrame,
    order: str = "bucket",
    width: int = CHUNK * MINUTE,
    key: str = "symbol",
    block: int = BLOCK,
    stretch: int = STRETCH,
    lookback: int = LOOKBACK,
) -> DataFrame:
    """Bars with ``_rn`` (0-based row of the series), ``_block``, ``_halo``, ``_stretch`` and ``_p``."""
    rows = number_rows(bars, [key], order, width, name="_rn").withColumn("_rn", F.col("_rn") - 1)
    halo = stretch * lookback
    rows = with_halo(rows, "_rn", max(block, halo), halo).repartition(F.col(key), F.col("_block"))
    return rows.withColumn("_stretch", floor_div(F.col("_rn"), stretch)).withColumn(
        "_p", F.pmod(F.col("_rn"), F.lit(stretch))
    )


def unblocked(df: DataFrame) -> DataFrame:
    own = df.where(~F.col("_halo"))
    return own.drop(*[c for c in own.columns if c.startswith("_")])


def add_emas(
    df: DataFrame, emas: dict[str, tuple[Column, float, int]], key: str = "symbol", size: int = STRETCH, lookback: int = LOOKBACK
) -> DataFrame:
    """Add exponential averages to a table ``blocked`` with stretches of ``size`` rows and that lookback.

    Each entry is ``(value, alpha, seed)`` where row ``seed`` of the series holds
    the first value and seeds the average; rows before it stay null.
    """
    stretch = Window.partitionBy(key, "_block", "_stretch").orderBy("_rn")
    so_far = stretch.rowsBetween(Window.unboundedPreceding, 0)
    stretches = Window.partitionBy(key, "_block").orderBy("_stretch")
    whole_stretch = Window.partitionBy(key, "_block", "_stretch")
    p = F.col("_p")
    for _, alpha, _s in emas.values():
        rows, back = reach(alpha)
        if rows < size or back * rows > lookback * size:
            raise ValueError(f"an average of weight {alpha} needs other stretches than these")

    def local(value: Column, alpha: float, seed: int) -> Column:
        weight = F.when(F.col("_rn") == seed, 1.0).when(F.col("_rn") > seed, alpha)
        if alpha == 1:
            return F.when(F.col("_rn") >= seed, value)
        decay = F.pow(F.lit(1 - alpha), p)
        return F.sum(weight * value / decay).over(so_far) * decay

    df = df.select("*", *[local(*e).alias(f"_l_{n}") for n, e in emas.items()])

    def ends(name: str) -> Column:
        """What the stretches before a row's own end with, the nearest last; a seed may come late, hence the zeros."""
        last = F.when(p == size - 1, F.coalesce(F.col(f"_l_{name}"), F.lit(0.0)))
        return F.when(p == 0, F.collect_list(last).over(stretches.rangeBetween(-lookback, -1)))

    def carried(name: str, alpha: float) -> Column:
        step = F.lit((1 - alpha) ** size)
        total = F.aggregate(F.col(f"_e_{name}"), F.lit(0.0), lambda sum_, end: sum_ * step + end)
        return F.coalesce(F.max(total).over(whole_stretch), F.lit(0.0))

    df = df.select("*", *[ends(n).alias(f"_e_{n}") for n in emas])
    df = df.select("*", *[carried(n, a).alias(f"_c_{n}") for n, (_, a, _s) in emas.items()])
    values = {
        n: F.when(
            F.col("_rn") >= seed,
            F.coalesce(F.col(f"_l_{n}"), F.lit(0.0)) + F.col(f"_c_{n}") * F.pow(F.lit(1 - a), p + 1),
        )
        for n, (_, a, seed) in emas.items()
    }
    return df.select("*", *[c.alias(n) for n, c in values.items()])


def ema(
    bars: DataFrame, value: str, alpha: float, name: str, order: str = "bucket",
    width: int = CHUNK * MINUTE, key: str = "symbol", block: int = BLOCK,
) -> DataFrame:
    """Recursive exponential average of a column without nulls."""
    size, lookback = reach(alpha)
    rows = blocked(bars, order, width, key, block, size, lookback)
    return unblocked(add_emas(rows, {name: (F.col(value), alpha, 0)}, key, size, lookback))


def add_features(
    bars: DataFrame,
    features: Sequence[str] = FEATURES,
    order: str = "bucket",
    width: int = CHUNK * MINUTE,
    block: int = BLOCK,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Bars plus the named features; ``keep`` also keeps ``ema_fast``, ``macd``, ... as columns."""
    rows = blocked(bars, order, width, block=block)
    close, volume = F.col("close"), F.col("volume")
    by_time = Window.partitionBy("symbol", "_block").orderBy("_rn")
    recent = by_time.rowsBetween(-(VOLUME_WINDOW - 1), 0)
    rows = rows.select(
        "*",
        F.lag(close).over(by_time).alias("_prev"),
        F.avg(volume).over(recent).alias("_vol_mean"),
        F.stddev_pop(volume).over(recent).alias("_vol_std"),
        F.count(volume).over(recent).alias("_vol_rows"),
    )
    change = F.when(F.col("_rn") > 0, close - F.col("_prev"))
    want = set(features) | set(keep)
    averages = {}
    if want & {"ema_fast", "ema_fast_gap", "macd", "macd_signal", "macd_hist_pct"}:
        averages["_ema_fast"] = (close, span_alpha(EMA_FAST), 0)
    if want & {"ema_slow", "ema_slow_gap", "macd", "macd_signal", "macd_hist_pct"}:
        averages["_ema_slow"] = (close, span_alpha(EMA_SLOW), 0)
    if "rsi_14" in want:
        averages["_gain"] = (F.greatest(change, F.lit(0.0)), 1.0 / RSI_PERIOD, 1)
        averages["_loss"] = (F.greatest(-change, F.lit(0.0)), 1.0 / RSI_PERIOD, 1)
    if averages:
        rows = add_emas(rows, averages)
    if want & {"macd_signal", "macd_hist_pct"}:
        rows = rows.withColumn("_macd", F.col("_ema_fast") - F.col("_ema_slow"))
        rows = add_emas(rows, {"_macd_signal": (F.col("_macd"), span_alpha(EMA_SIGNAL), 0)})

    prev = F.col("_prev")
    mean, std = F.col("_vol_mean"), F.col("_vol_std")
    # Rounding noise on a constant volume is not a spread.
    spread = F.when((F.col("_vol_rows") >= VOLUME_MIN_ROWS) & (std > 1e-12 * (1 + F.abs(mean))), std)
    formulas = {
        "log_close": lambda: F.log1p(F.greatest(close, F.lit(1e-9))),
        "return_1": lambda: finite_or_zero(ratio(close, prev) - 1),
        "log_return_1": lambda: finite_or_zero(F.ln(F.nullif(ratio(close, prev), F.lit(0.0)))),
        "range_pct": lambda: finite_or_zero(ratio(F.col("high") - F.col("low"), close)),
        "volume_log": lambda: F.log1p(F.greatest(volume, F.lit(0.0))),
        "volume_z": lambda: finite_or_zero((volume - mean) / spread),
        "ema_fast_gap": lambda: finite_or_zero(ratio(close - F.col("_ema_fast"), close)),
        "ema_slow_gap": lambda: finite_or_zero(ratio(close - F.col("_ema_slow"), close)),
        "macd_hist_pct": lambda: finite_or_zero(ratio(F.col("_macd") - F.col("_macd_signal"), close)),
        "rsi_14": lambda: rsi(F.col("_gain"), F.col("_loss")) / 100.0,
    }
    out = rows.select(
        "*",
        *[formulas[f]().alias(f) for f in features],
        *[F.col(f"_{k}").alias(k) for k in keep],
    )
    return unblocked(out)


def rsi(gain: Column, loss: Column) -> Column:
    """0..100; 50 where there was no loss yet."""
    strength = ratio(gain, loss)
    return F.coalesce(100.0 - 100.0 / (1.0 + strength), F.lit(50.0))
