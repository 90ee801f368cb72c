"""Time bars from ticks or finer candles.

Times are epoch microseconds and buckets are plain integer arithmetic, so no
session time zone enters and the aggregation is a hash aggregate with map-side
combine: a hot symbol or a hot bucket shrinks before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.numeric import double_columns, finite_or_zero, not_nan
from tapeworks.plans.series import CHUNK, Fold, running

MINUTE = 60_000_000
DAY = 1440 * MINUTE


def _order_key(tie: str | None) -> Column:
    """Time, or time followed by the tie-break as one wide decimal.

    A struct would do the same but cannot live in a hash aggregate's buffer.
    """
    t = F.col("open_time")
    if tie is None:
        return t
    wide = t.cast("decimal(19,0)") * F.lit("10000000000000000000").cast("decimal(20,0)")
    return (wide + F.col(tie).cast("decimal(19,0)")).cast("decimal(38,0)")


def resample(candles: DataFrame, minutes: int, tie: str | None = None) -> DataFrame:
    """One row per symbol and ``minutes`` bucket that holds a close.

    ``open_time`` is the last time seen in the bucket; first and last skip
    missing values.  ``tie`` orders rows of equal time.  Buckets start at
    midnight of the symbol's first day, which for widths that divide a day is
    the same as counting from the epoch.  For other widths the raw rows are first
    aggregated into the longest buckets that fit both a day and the width, so that
    only those meet their symbol's first day.  ``minutes <= 1`` leaves rows as they are.
    """
    if int(minutes) <= 1:
        return candles.withColumn("bucket", F.col("open_time"))
    width = int(minutes) * MINUTE
    fine = gcd(width, DAY)
    at = _order_key(tie)

    def value(c: str) -> Column:
        return not_nan(F.col(c))

    def start(t: Column, origin: Column, size: int) -> Column:
        return (t - F.pmod(t - origin, F.lit(size))).alias("bucket")

    opens, closes = F.when(value("open").isNotNull(), at), F.when(value("close").isNotNull(), at)
    bars = candles.groupBy("symbol", start(F.col("open_time"), F.lit(0), fine)).agg(
        F.max("open_time").alias("open_time"),
        F.min_by(value("open"), opens).alias("open"),
        F.max(value("high")).alias("high"),
        F.min(value("low")).alias("low"),
        F.max_by(value("close"), closes).alias("close"),
        F.sum(value("volume")).alias("volume"),
        *([F.min(opens).alias("_opened"), F.max(closes).alias("_closed"), F.min("open_time").alias("_first")] if fine < width else []),
    )
    if fine < width:
        day = F.min("_first") - F.pmod(F.min("_first"), F.lit(DAY))
        origin = bars.groupBy("symbol").agg(day.alias("_origin"))
        bars = bars.join(origin, "symbol").groupBy("symbol", start(F.col("bucket"), F.col("_origin"), width)).agg(
            F.max("open_time").alias("open_time"),
            F.min_by("open", "_opened").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "_closed").alias("close"),
            F.sum("volume").alias("volume"),
        )
    return drop_empty(bars.withColumn("volume", F.coalesce("volume", F.lit(0.0))))


def resample_many(candles: DataFrame, minutes: Sequence[int], tie: str | None = None) -> DataFrame:
    """Bars of several widths at once: :func:`resample` of each, with a column ``minutes``.

    The candles are read and shuffled once, into bars of the greatest width that divides
    all others and a day.  These carry what decides between first and last values, so
    every width is merged from them.
    """
    if not minutes or min(int(m) for m in minutes) < 1:
        raise ValueError("widths are at least one minute")
    widths = sorted({int(m) for m in minutes})
    fine = gcd(DAY, *[m * MINUTE for m in widths])
    at = _order_key(tie)
    opened, closed = not_nan(F.col("open")), not_nan(F.col("close"))
    opens, closes = F.when(opened.isNotNull(), at), F.when(closed.isNotNull(), at)
    base = candles.groupBy("symbol", (F.col("open_time") - F.pmod(F.col("open_time"), F.lit(fine))).alias("_start")).agg(
        F.min_by(opened, opens).alias("open"), F.min(opens).alias("_opens"),
        F.max_by(closed, closes).alias("close"), F.max(closes).alias("_closes"),
        F.max(not_nan(F.col("high"))).alias("high"), F.min(not_nan(F.col("low"))).alias("low"),
        F.sum(not_nan(F.col("volume"))).alias("volume"), F.max("open_time").alias("open_time"),
    )
    whole = [m for m in widths if DAY % (m * MINUTE) == 0]
    odd = [m for m in widths if m not in whole]
    length = F.col("minutes").cast("bigint") * F.lit(MINUTE)

    def merged(rows: DataFrame, sizes: list[int], origin: Column) -> DataFrame:
        wide = rows.withColumn("minutes", F.explode(F.array(*[F.lit(m) for m in sizes])))
        bucket = F.col("_start") - F.pmod(F.col("_start") - origin, length)
        bars = wide.groupBy("symbol", "minutes", bucket.alias("bucket")).agg(
            F.max("open_time").alias("open_time"), F.min_by("open", "_opens").alias("open"), F.max("high").alias("high"),
            F.min("low").alias("low"), F.max_by("close", "_closes").alias("close"), F.sum("volume").alias("volume"),
        )
        return drop_empty(bars.withColumn("volume", F.coalesce("volume", F.lit(0.0))))

    parts = [merged(base, whole, F.lit(0))] if whole else []
    if odd:
        first = base.groupBy("symbol").agg(F.min("_start").alias("_first"))
        day = F.col("_first") - F.pmod(F.col("_first"), F.lit(DAY))
        parts.append(merged(base.join(first, "symbol"), odd, day))
    return union_symbols(*parts)


def drop_empty(bars: DataFrame) -> DataFrame:
    """Buckets without a close go; missing buckets are not filled in."""
    return bars.where(not_nan(F.col("close")).isNotNull())


def ffill(bars: DataFrame, order: str = "bucket", width: int = CHUNK * MINUTE) -> DataFrame:
    """Missing open/high/low/close take the last known value; missing volume is 0."""
    prices = ["open", "high", "low", "close"]
    filled = running(
        bars, ["symbol"], order, {c: Fold("last", not_nan(F.col(c))) for c in prices}, width=width
    )
    return filled.withColumn("volume", F.coalesce(not_nan(F.col("volume")), F.lit(0.0))).select(*bars.columns)


def sanitize(df: DataFrame) -> DataFrame:
    """Every floating column: NaN, infinities and nulls become 0."""
    doubles = set(double_columns(df))
    return df.select(
        *[finite_or_zero(F.col(c)).alias(c) if c in doubles else F.col(c) for c in df.columns]
    )


def union_symbols(*parts: DataFrame) -> DataFrame:
    """Stack tables of the same columns; order only where results are written."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
