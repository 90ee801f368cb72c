"""Run telemetry: series reshaping, run index, displayed figures.

Points are ``run, key, step, pos, value``; ``pos`` is the place in the series
and unique in it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.numeric import finite, not_nan
from tapeworks.functions.text import format_elapsed, parse_stamp, run_epoch
from tapeworks.plans.series import CHUNK, Fold, running, top_k

# Series length, index length, modes of model runs, series that keep
# the first point of a step, and the update stride.
MAX_POINTS = 500
MAX_RUNS = 40
MODEL_MODES = ["train", "backtest", "backtest_3way", "eval"]
KEEP_FIRST = ["portfolio_value", "realized_pnl"]
RUNNING = ["initializing", "running"]
MIN_STRIDE = 50
INDEX_STRIDE = 10
TINY = 1e-12
VIEWS = {"Both": ["train", "dev", "test"], "Train": ["train"], "Eval": ["dev", "test"]}


def explode_series(states: DataFrame, series: str = "series", run: str = "run", first: str | None = None) -> DataFrame:
    """``map<key, array<step, value>>`` to points; null values are left out.

    A long series may come in several documents; ``first`` then names the column with
    the position of a document's first points.
    """
    start = F.lit(0) if first is None else F.col(first)
    by_key = states.select(F.col(run).alias("run"), start.alias("_first"), F.explode(series).alias("key", "_points"))
    points = by_key.select("run", "key", "_first", F.posexplode("_points").alias("_pos", "_p"))
    pos = (F.col("_first") + F.col("_pos")).cast("int").alias("pos")
    return points.select("run", "key", pos, "_p.step", "_p.value").where(F.col("value").isNotNull())


def cap_series(points: DataFrame, most: int = MAX_POINTS) -> DataFrame:
    """Last points of every series."""
    rows = points.where(F.col("value").isNotNull())
    return top_k(rows, ["run", "key"], [F.col("pos").desc()], most, ["pos"])


def latest_value(points: DataFrame) -> DataFrame:
    """Last finite value per series."""
    v = finite(F.col("value"))
    return points.where(v.isNotNull()).groupBy("run", "key").agg(F.max_by("value", "pos").alias("value"))


def latest_nonzero(points: DataFrame) -> DataFrame:
    v = finite(F.col("value"))
    return points.where(F.abs(v) > TINY).groupBy("run", "key").agg(F.max_by("value", "pos").alias("value"))


def dedup_step(points: DataFrame, keep_first: Sequence[str] = KEEP_FIRST) -> DataFrame:
    """One value per ``(run, key, step)``: the first for some series, the last for the others.

    Two arg-extrema in one hash aggregate; no series is sorted.
    """
    rows = points.where(F.col("value").isNotNull())
    ends = rows.groupBy("run", "key", "step").agg(
        F.min_by("value", "pos").alias("_first"), F.max_by("value", "pos").alias("_last")
    )
    value = F.when(F.col("key").isin(list(keep_first)), F.col("_first")).otherwise(F.col("_last"))
    return ends.select("run", "key", "step", value.alias("value"))


def align_series(deduped: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per ``(run, step)`` and one column per series (an outer join by step)."""
    wide = deduped.where(F.col("key").isin(list(keys))).groupBy("run", "step")
    return wide.agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys])


def interpolate(aligned: DataFrame, columns: Sequence[str], width: int = CHUNK) -> DataFrame:
    """Fill gaps linearly in the step value; hold the last value after the end and take
    the first one before the start."""
    step = F.col("step")
    folds = {}
    for c in columns:
        known = not_nan(F.col(c))
        at = F.when(known.isNotNull(), step)
        for name, back in (("b", False), ("a", True)):
            folds[f"_{name}s_{c}"] = Fold("last", at, reverse=back)
            folds[f"_{name}v_{c}"] = Fold("last", known, reverse=back)
    rows = running(aligned, ["run"], "step", folds, width)

    def filled(c: str) -> Column:
        s0, v0, s1, v1 = (F.col(f"_{n}_{c}") for n in ("bs", "bv", "as", "av"))
        line = v0 + (v1 - v0) * (step - s0) / F.nullif(s1 - s0, F.lit(0))
        return F.coalesce(not_nan(F.col(c)), line, v0, v1).alias(c)

    rest = [c for c in aligned.columns if c not in columns]
    return rows.select(*rest, *[filled(c) for c in columns])


def view_filter(points: DataFrame, view: str, views: dict[str, list[str]] | None = None) -> DataFrame:
    return points.where(F.col("key").isin((views or VIEWS)[view]))


def melt(aligned: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return aligned.unpivot(list(ids), list(columns), "series", "value")


def y_domain(points: DataFrame, keys: Sequence[str] = (), pad: float = 0.08) -> DataFrame:
    """Axis range with padding; a constant series gets a small band around it."""
    v = finite(F.col("value"))
    ends = points.groupBy(*keys).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    space = F.when(lo == hi, F.greatest(F.abs(lo) * 0.02, F.lit(1e-6))).otherwise((hi - lo) * float(pad))
    return ends.where(lo.isNotNull()).select(*keys, (lo - space).alias("y_min"), (hi + space).alias("y_max"))


def elapsed(index: DataFrame, now: Column) -> DataFrame:
    """``elapsed`` in seconds: running runs up to ``now`` (epoch seconds), finished ones to
    their end, others as stored; never below 0."""
    start, end, seconds = F.col("_start"), F.col("_end"), F.col("_seconds")
    # Each step is a projection of its own, so that no time is parsed twice.
    rows = index.withColumns({"_start": parse_stamp(F.col("started_at")), "_end": parse_stamp(F.col("finished_at"))})
    live = F.lower(F.col("status")).isin(RUNNING) & start.isNotNull()
    found = (
        F.when(live, now - start)
        .when(start.isNotNull() & end.isNotNull(), end - start)
        .otherwise(F.col("elapsed_seconds").cast("bigint"))
    )
    rows = rows.withColumn("_seconds", found)
    return rows.withColumn("elapsed", F.when(seconds.isNotNull(), F.greatest(F.lit(0), seconds))).drop("_start", "_end", "_seconds")


def run_label(index: DataFrame, now: Column) -> DataFrame:
    def known(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("-"))

    rows = elapsed(index, now)
    return rows.withColumn(
        "label", F.concat_ws(" | ", known("run_id"), known("mode"), known("status"), format_elapsed(F.col("elapsed")))
    )


def index_upsert(index: DataFrame, updates: DataFrame, most: int = MAX_RUNS) -> DataFrame:
    """Entries in order of their last ``seq``, one per run id, the newest ``most`` kept.

    ``index`` and ``updates`` carry ``seq``, the order of writing.
    """
    rows = index.unionByName(updates)
    others = [c for c in rows.columns if c not in ("run_id", "seq")]
    newest = rows.groupBy("run_id").agg(F.max("seq").alias("seq"))
    kept = newest.orderBy(F.desc("seq")).limit(most)
    return rows.join(kept, ["run_id", "seq"], "left_semi").select("run_id", *others, "seq")


def latest_by_mode(index: DataFrame) -> DataFrame:
    """Newest run of every mode; ``latest_model`` marks the newest among the model modes."""
    at = F.col("seq")
    newest = index.where(F.length("mode") > 0).groupBy("mode").agg(F.max(at).alias("seq"))
    model = index.where(F.col("mode").isin(MODEL_MODES)).agg(F.max(at)).scalar()
    rows = index.join(newest, ["mode", "seq"], "left_semi")
    return rows.withColumn("latest_model", F.coalesce(at == model, F.lit(False)))


def index_pointers(index: DataFrame) -> DataFrame:
    """One row: the run written last and the newest model run, each with its ``state_file``."""
    model = F.col("mode").isin(MODEL_MODES)
    return index.agg(
        *[F.max_by(c, "seq").alias(f"latest_{c}") for c in ("run_id", "state_file")],
        *[F.max_by(c, F.when(model, F.col("seq"))).alias(f"latest_model_{c}") for c in ("run_id", "state_file", "mode", "status")],
    )


def sort_runs(index: DataFrame) -> DataFrame:
    return index.withColumn("run_epoch", run_epoch(F.col("run_id"))).orderBy(F.desc("run_epoch"), F.desc("run_id"))


def default_run(index: DataFrame, selected: str | None) -> DataFrame:
    """One row ``run_id``: the selected run if present, else the newest model run, else the first."""
    newest_model = index.where(F.col("mode").isin(MODEL_MODES)).agg(F.max_by("run_id", "seq").alias("model_id"))
    first = index.withColumn("_e", run_epoch(F.col("run_id"))).agg(
        F.max(F.struct("_e", "run_id"))["run_id"].alias("first_id"),
        F.max(F.when(F.col("run_id") == F.lit(selected), F.col("run_id"))).alias("selected_id"),
    )
    return first.select(
        F.coalesce(F.col("selected_id"), newest_model.scalar(), F.col("first_id")).alias("run_id")
    )


def resolve_kpis(states: DataFrame, points: DataFrame) -> DataFrame:
    """Displayed figures per run, falling through summary, live finance and series.

    ``states`` has ``run`` and the columns ``sum_*`` and ``fin_*`` for trades,
    realized_pnl, win_rate_pct and portfolio_value; ``step``, ``train_loss``,
    ``train_reward`` and ``fin_*`` for unrealized_pnl, total_return_pct and
    drawdown_pct are 0 where the table lacks them.
    """
    rows = points.where(F.col("value").isNotNull())
    at = F.col("pos")

    def latest(key: str, extra: Column | None = None) -> Column:
        mine = F.col("key") == key
        return F.max_by("value", F.when(mine if extra is None else mine & extra, at))

    seen = rows.groupBy("run").agg(
        F.max(F.when(F.col("key") == "trades", F.col("value").cast("bigint"))).alias("_trades"),
        latest("realized_pnl").alias("_pnl"),
        latest("portfolio_value").alias("_value"),
        latest("unrealized_pnl").alias("_open"),
        latest("win_rate", F.abs("value") > TINY).alias("_rate"),
    )
    joined = states.join(seen, "run", "left")

    def zero(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in joined.columns else F.lit(0.0)

    trades = F.greatest(
        F.coalesce(F.col("fin_trades").cast("bigint"), F.lit(0)),
        F.coalesce(F.col("sum_trades").cast("bigint"), F.lit(0)),
        F.coalesce(F.col("_trades"), F.lit(0)),
    )

    def first_nonzero(*options: Column) -> Column:
        return F.coalesce(*[F.nullif(o, F.lit(0.0)) for o in options], F.lit(0.0))

    start = F.lit(100.0)
    value = zero("sum_portfolio_value")
    live = zero("fin_portfolio_value")
    unset = (value == 0) | (value == start)
    value = F.when(unset & (live != 0) & (live != start), live).otherwise(value)
    return joined.select(
        "run",
        zero("step").cast("bigint").alias("step"),
        zero("train_loss").alias("train_loss"),
        zero("train_reward").alias("train_reward"),
        zero("fin_unrealized_pnl").alias("unrealized_pnl"),
        zero("fin_total_return_pct").alias("total_return_pct"),
        zero("fin_drawdown_pct").alias("drawdown_pct"),
        zero("_pnl").alias("train_realized_pnl"),
        zero("_open").alias("train_unrealized_pnl"),
        zero("_value").alias("train_portfolio_value"),
        trades.alias("trades"),
        first_nonzero(zero("sum_realized_pnl"), zero("fin_realized_pnl"), zero("_pnl")).alias("realized_pnl"),
        first_nonzero(
            zero("sum_win_rate_pct"), zero("fin_win_rate_pct"), F.when(trades > 0, zero("_rate")).otherwise(F.lit(0.0))
        ).alias("win_rate_pct"),
        first_nonzero(value, zero("_value")).alias("portfolio_value"),
    )


def progress(states: DataFrame) -> DataFrame:
    share = F.col("step") / F.greatest(F.lit(1), F.col("total_steps")) * 100
    epoch = F.call_function("div", F.col("n_updates"), F.greatest(F.lit(1), F.col("n_epochs")))
    return states.withColumn("progress_pct", F.least(F.lit(100.0), share)).withColumn("epoch", epoch)


def sampled_updates(points: DataFrame, every: int) -> DataFrame:
    """Updates that are written: each stride-th step; each tenth of them refreshes the index."""
    stride = max(MIN_STRIDE, int(every))
    rows = points.where(F.pmod(F.col("step"), F.lit(stride)) == 0)
    return rows.withColumn("refresh_index", F.pmod(F.col("step"), F.lit(stride * INDEX_STRIDE)) == 0)
