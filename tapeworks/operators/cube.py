"""Alignment of symbols into a step grid, feature cubes and lookback vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.numeric import hash_uniform, whole
from tapeworks.operators.bars import MINUTE
from tapeworks.plans.series import CHUNK, number_rows, with_halo

# Scale of the cash entry of an observation and the position limit.
CASH_SCALE = 1e6
MAX_POSITIONS = 3


def symbol_index(df: DataFrame) -> DataFrame:
    """``symbol, idx``: 0-based rank of each distinct symbol."""
    names = df.select("symbol").distinct()
    ranked = number_rows(names, [], "symbol", name="_rank", chunk=F.substring("symbol", 1, 3))
    return ranked.select("symbol", (F.col("_rank") - 1).cast("int").alias("idx"))


def shortest(df: DataFrame, key: str = "symbol") -> Column:
    """Length of the shortest series, as a scalar subquery."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).agg(F.min("_n")).scalar()


def tail_align(df: DataFrame, order: str = "bucket", width: int = CHUNK * MINUTE) -> DataFrame:
    """Last ``m`` rows of every symbol, ``m`` being the shortest length, with ``step`` 0..m-1.

    Alignment is by position: symbols with gaps are not matched in time.
    """
    rows = number_rows(df, ["symbol"], order, width, name="_rn", total="_n", scalars={"_m": shortest(df)})
    step = F.col("_rn") - (F.col("_n") - F.col("_m")) - 1
    return rows.withColumn("step", step).where(F.col("step") >= 0).drop("_rn", "_n", "_m")


def time_align(df: DataFrame, symbols: Sequence[str], order: str = "bucket") -> DataFrame:
    """Rows at times where every listed symbol has one (alignment by time instead of position)."""
    rows = df.where(F.col("symbol").isin(list(symbols)))
    full = rows.groupBy(order).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(symbols))
    return rows.join(full.select(order), order, "left_semi")


def require_steps(aligned: DataFrame, least: int = 2) -> DataFrame:
    if aligned.where(F.col("step") >= least - 1).isEmpty():
        raise ValueError("not enough aligned rows")
    return aligned


def price_matrix(aligned: DataFrame, symbols: Sequence[str], value: str = "close") -> DataFrame:
    """One row per step, one column per symbol."""
    return aligned.groupBy("step").agg(
        *[F.max(F.when(F.col("symbol") == s, F.col(value))).alias(s) for s in symbols]
    )


def feature_cube(aligned: DataFrame, features: Sequence[str]) -> DataFrame:
    """``step, vector``: features of all symbols, symbols in sorted order."""
    row = F.struct("symbol", F.array(*[F.col(f).cast("double") for f in features]).alias("v"))
    packed = aligned.groupBy("step").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    return packed.select("step", F.flatten(F.transform("_rows", lambda r: r["v"])).alias("vector"))


def lookback(cube: DataFrame, steps: int, size: int = 4096) -> DataFrame:
    """``step, window``: vectors of the last ``steps`` steps, the first one repeated as padding.

    Blocks of steps with a halo copy ``steps - 1`` rows per block instead of
    sending every row to ``steps`` groups.
    """
    size = max(size, steps)
    rows = with_halo(cube, "step", size, steps - 1)
    frame = Window.partitionBy("_block").orderBy("step").rowsBetween(-(steps - 1), 0)
    seen = F.collect_list("vector").over(frame)
    rows = rows.withColumn("_seen", seen).where(~F.col("_halo"))
    lead = F.array_repeat(F.element_at("_seen", 1), F.lit(steps) - F.size("_seen"))
    return rows.select("step", F.concat(lead, F.col("_seen")).alias("window"))


def observations(
    windows: DataFrame, state: DataFrame, initial_cash: float, end_step: Column | int,
    max_positions: int = MAX_POSITIONS,
) -> DataFrame:
    """``run, step, obs``: flattened window and four account entries.

    ``state`` has ``run, step, cash, n_positions, portfolio_value``.
    """
    end = F.lit(end_step) if isinstance(end_step, int) else end_step
    account = F.array(
        F.log1p(F.col("cash") / CASH_SCALE),
        F.col("n_positions") / F.lit(float(max_positions)),
        (F.col("portfolio_value") - initial_cash) / F.lit(float(initial_cash)),
        F.col("step") / F.greatest(F.lit(1), end),
    )
    return state.join(windows, "step").select(
        "run", "step", F.concat(F.flatten("window"), account).alias("obs")
    )


def episodes(
    runs: DataFrame, n_steps: Column, min_len: int, max_len: int, seed: int = 0
) -> DataFrame:
    """Start, end and length of each ``(run, episode)``, drawn from a hash of its keys."""
    longest = n_steps if max_len <= 0 else F.least(n_steps, F.lit(max_len))
    wanted = F.lit(min_len) if min_len > 0 else longest
    lowest = F.least(F.greatest(F.lit(2), wanted), longest)

    def draw(what: str, low: Column, high: Column) -> Column:
        u = hash_uniform(F.col("run"), F.col("episode"), F.lit(what), F.lit(seed))
        return low + whole(u * (high - low + 1))

    rows = runs.withColumn("length", draw("length", lowest, longest).cast("bigint"))
    last = F.greatest(F.lit(0), n_steps - F.col("length"))
    rows = rows.withColumn("start", draw("start", F.lit(0), last).cast("bigint"))
    return rows.withColumn("end", F.col("start") + F.col("length") - 1)


def episode_slices(slices: DataFrame, aligned: DataFrame) -> DataFrame:
    """Rows of ``aligned`` inside each episode: an equi-join on the exploded steps."""
    steps = slices.select("run", "episode", F.explode(F.sequence("start", "end")).alias("step"))
    return steps.join(aligned, "step")
