"""Sums over a trailing stretch of time, and values as of a time.

Blocks are cut by time, not by row count, so gaps cost nothing: a block of ``size`` is
preceded by copies of the rows of the last ``span`` before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.numeric import floor_div
from tapeworks.plans.series import CHUNK, UNBOUNDED, Fold, running, with_chunk


def with_time_halo(df: DataFrame, keys: list[str], time: str, size: int, span: int) -> DataFrame:
    """Blocks of ``size`` of an integral time, each with copies of the rows less than ``span`` before it.

    Adds ``_block`` and ``_halo``; rows are shuffled by ``(key, _block)``.
    """
    if span > size:
        raise ValueError("the span must not exceed the block size")
    rows = with_chunk(df, keys, floor_div(F.col(time), size))
    late = F.pmod(F.col(time), F.lit(size)) > size - span
    own = F.col("_chunk")
    blocks = F.when(late, F.array(own, own + 1)).otherwise(F.array(own))
    rows = rows.withColumn("_block", F.explode(blocks)).withColumn("_halo", F.col("_block") != own).drop("_chunk")
    return rows.repartition(*[F.col(k) for k in keys], F.col("_block"))


def trailing_sums(rows: DataFrame, keys: list[str], time: str, span: int, sums: dict[str, Column]) -> DataFrame:
    """Add for each row of a table with a time halo the sums over the times after ``t - span`` up to ``t``.

    Every row enters at its time and leaves ``span`` later, as a second row with the
    opposite sign.  A running sum over both is the trailing sum, so the cost per row does
    not depend on the span.  Times are unique per key.
    """
    values = rows.select("*", *[F.coalesce(v, F.lit(0)).alias(f"_v_{n}") for n, v in sums.items()])
    moves = values.withColumn("_sign", F.explode(F.array(F.lit(1), F.lit(-1))))
    moves = moves.withColumn("_at", F.when(F.col("_sign") > 0, F.col(time)).otherwise(F.col(time) + F.lit(span)))
    so_far = Window.partitionBy(*keys, "_block").orderBy("_at", "_sign").rowsBetween(UNBOUNDED, 0)
    summed = moves.select("*", *[F.sum(F.col("_sign") * F.col(f"_v_{n}")).over(so_far).alias(n) for n in sums])
    return summed.where(F.col("_sign") > 0).drop("_sign", "_at", *[f"_v_{n}" for n in sums])


def asof_join(
    left: DataFrame, right: DataFrame, keys: list[str], time: str, values: Sequence[str], tolerance: int | None = None,
    width: int = CHUNK, salts: int = 1, salt_on: Sequence[str] = (),
) -> DataFrame:
    """Rows of ``left`` with the ``values`` of the last row of ``right`` at or before their time.

    ``right`` has one row per key and time.  A value older than ``tolerance`` does not count.
    Both sides are put into one series and the last value is carried along it, in chunks of
    ``width``; nothing is joined by range.  Where the keys leave many rows of ``left`` at one
    time, these are dealt to ``salts`` shares by ``salt_on``, each with its own copy of ``right``.
    """
    none = F.lit(None)
    row, value = F.struct(*left.columns), F.struct(F.col(time).alias("_at"), *values)
    shapes = {"_row": left.select(row.alias("r")).schema["r"].dataType, "_value": right.select(value.alias("v")).schema["v"].dataType}
    salt = F.pmod(F.xxhash64(*salt_on), F.lit(salts)).cast("int") if salts > 1 else F.lit(0)
    # At equal times a right row comes first.
    own = left.select(*keys, salt.alias("_salt"), (F.col(time) * 2 + 1).alias("_order"), row.alias("_row"), none.cast(shapes["_value"]).alias("_value"))
    told = right.select(
        *keys, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"), (F.col(time) * 2).alias("_order"),
        none.cast(shapes["_row"]).alias("_row"), value.alias("_value"),
    )
    carried = running(own.unionByName(told), [*keys, "_salt"], "_order", {"_last": Fold("last", F.col("_value"))}, 2 * width)
    rows = carried.where(F.col("_row").isNotNull()).select("_row.*", "_last")
    fresh = F.col("_last._at") >= F.col(time) - F.lit(tolerance) if tolerance is not None else F.lit(True)
    return rows.select(*left.columns, *[F.when(fresh, F.col(f"_last.{v}")).alias(v) for v in values])
