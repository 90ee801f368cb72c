"""Chronological splits of series.

Positions come from :func:`number_rows`; every split is then arithmetic on
``rn`` and ``n``, without a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.numeric import floor_div, whole
from tapeworks.operators.bars import MINUTE
from tapeworks.operators.cube import shortest
from tapeworks.plans.series import CHUNK, number_rows, top_k

BAR_CHUNK = CHUNK * MINUTE


def _numbered(df: DataFrame, order: str, width: int) -> DataFrame:
    return number_rows(df, ["symbol"], order, width, name="_rn", total="_n")


def split_2way(df: DataFrame, ratio: float = 0.8, order: str = "bucket", width: int = BAR_CHUNK) -> DataFrame:
    """``split`` is train or test; each side keeps at least one row."""
    cut = F.greatest(F.lit(1), F.least(whole(F.col("_n") * F.lit(ratio)), F.col("_n") - 1))
    rows = _numbered(df, order, width)
    return rows.withColumn("split", F.when(F.col("_rn") <= cut, "train").otherwise("test")).drop("_rn", "_n")


def split_3way(
    df: DataFrame, train: float = 0.6, val: float = 0.2, order: str = "bucket", width: int = BAR_CHUNK
) -> DataFrame:
    """``split`` is train, val or test; the lower bounds apply after both cuts are computed."""
    n = F.col("_n")
    first = whole(n * F.lit(train))
    second = first + whole(n * F.lit(val))
    first_cut = F.greatest(F.lit(1), first)
    second_cut = F.greatest(first_cut + 1, second)
    rows = _numbered(df, order, width)
    split = F.when(F.col("_rn") <= first_cut, "train").when(F.col("_rn") <= second_cut, "val").otherwise("test")
    return rows.withColumn("split", split).drop("_rn", "_n")


def walk_forward_lengths(n: Column, train: float, val: float, test: float, step: float) -> dict[str, Column]:
    """Lengths of the three parts, of the window and of the stride, for ``n`` rows per symbol."""
    if min(train, val, test) <= 0:
        raise ValueError("walk-forward ratios must be positive")
    if train + val + test > 1.0 + 1e-9:
        raise ValueError("walk-forward ratios must sum to at most 1")

    def part(r: float) -> Column:
        return F.greatest(F.lit(1), whole(n * F.lit(float(r))))

    a, b, c = part(train), part(val), part(test)
    c = F.when(a + b + c > n, F.greatest(F.lit(1), n - a - b)).otherwise(c)
    return {"train": a, "val": b, "test": c, "window": a + b + c, "stride": part(step)}


def walk_forward(
    df: DataFrame,
    train: float,
    val: float,
    test: float,
    step: float,
    max_folds: int,
    order: str = "bucket",
    width: int = BAR_CHUNK,
) -> DataFrame:
    """Rows tagged with ``fold`` (from 1), ``start`` and ``split``.

    The folds holding a row are a range of numbers known from its position, so
    each row is exploded into exactly its folds; no fold table is joined.  It is an
    error if not even one window fits the shortest symbol.
    """
    rows = number_rows(df, ["symbol"], order, width, name="_rn", scalars={"_n": shortest(df)})
    size = walk_forward_lengths(F.col("_n"), train, val, test, step)
    rows = rows.select("*", *[c.alias(f"_{k}") for k, c in size.items()])
    at = F.col("_rn") - 1
    window, stride = F.col("_window"), F.col("_stride")
    last_fold = F.least(floor_div(F.col("_n") - window, stride), F.lit(max(1, int(max_folds)) - 1))
    low = F.greatest(F.lit(0), floor_div(at - window, stride) + 1)
    high = F.least(floor_div(at, stride), last_fold)
    too_short = F.raise_error(F.lit("not enough rows for one walk-forward window"))
    rows = rows.where((at < F.col("_n")) & F.when(window > F.col("_n"), too_short.cast("boolean")).otherwise(True)).where(low <= high)
    rows = rows.withColumn("_fold", F.explode(F.sequence(low, high)))
    inside = at - F.col("_fold") * stride
    split = (
        F.when(inside < F.col("_train"), "train")
        .when(inside < F.col("_train") + F.col("_val"), "val")
        .otherwise("test")
    )
    out = rows.withColumn("fold", (F.col("_fold") + 1).cast("int"))
    out = out.withColumn("start", F.col("_fold") * stride).withColumn("split", split)
    return out.select(*df.columns, "fold", "start", "split")


def balanced_tail(df: DataFrame, rows: int = 300, order: str = "bucket") -> DataFrame:
    """Last rows of every symbol."""
    return top_k(df, ["symbol"], [F.col(order).desc()], rows, [order])


def align_symbols(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Rows of the required symbols with ``symbol_rank``, their place in the list."""
    names = F.array(*[F.lit(s) for s in required])
    rank = (F.array_position(names, F.col("symbol")) - 1).cast("int")
    return df.where(F.col("symbol").isin(list(required))).withColumn("symbol_rank", rank)


def missing_symbols(df: DataFrame, required: DataFrame, most: int = 10) -> DataFrame:
    """The first required symbols that have no row, in request order (``position, symbol``)."""
    absent = required.join(df.select("symbol").distinct(), "symbol", "left_anti")
    return absent.orderBy("position").limit(most).select("position", "symbol")


def require_symbols(df: DataFrame, required: DataFrame) -> DataFrame:
    names = [r["symbol"] for r in missing_symbols(df, required).collect()]
    if names:
        raise ValueError(f"missing symbols: {names}")
    return df


def split_summary(df: DataFrame, keys: Sequence[str] = ("split",), time: str = "open_time") -> DataFrame:
    """Rows, symbols and time range per split or fold."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("symbol").alias("n_symbols"),
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
    )
