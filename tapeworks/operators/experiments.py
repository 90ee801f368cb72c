"""Log scraping, scoring, aggregation and gating of experiment runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.numeric import parse_double, safe_float
from tapeworks.functions.text import last_line, lines
from tapeworks.plans.medians import medians
from tapeworks.plans.series import number_rows, top_k

# Summary patterns, score weights, trade bands, option names and defaults.
SUMMARY = r"%s Trades:\s*(\d+)\s*\|\s*WR:\s*([\d.]+)%%\s*\|\s*Return:\s*([-\d.]+)%%"
METRICS = [
    "val_trades", "val_win_rate_pct", "val_return_pct",
    "test_trades", "test_win_rate_pct", "test_return_pct",
]
SCORE_WEIGHT = 0.35
GAP_WEIGHT = 0.05
BAND = (100, 4500)
SWEEP_MIN_TRADES = 5
SWEEP_FLOOR = -100.0
SWEEP_WEIGHTS = (0.4, 0.6)
TAG_OPTIONS = {
    "mapping_family": ("--action-mapping-mode", "legacy"),
    "reward_mode": ("--reward-mode", "equity_delta"),
    "algo": ("--algo", "ppo"),
    "eval_mode": ("--mode", "train"),
}


def scrape_summary(logs: DataFrame, text: str = "text") -> DataFrame:
    """Metrics of the last validation and test summary in each log; 0 where there is none.

    One pass over the text lists the summaries; the numbers are cut from the last of each kind.
    """
    kept = [c for c in logs.columns if c != text]
    found = logs.select(*kept, F.regexp_extract_all(F.col(text), F.lit(SUMMARY % "(?:Val|Test)"), F.lit(0)).alias("_found"))

    def last_of(kind: str) -> Column:
        return F.try_element_at(F.filter("_found", lambda x: x.startswith(kind)), F.lit(-1))

    last = {k: last_of(k) for k in ("Val", "Test")}
    found = found.select(*kept, *[c.alias(f"_{k}") for k, c in last.items()])
    numbers = [
        safe_float(F.regexp_extract(f"_{k}", SUMMARY % k, g)).alias(f"{k.lower()}_{name}")
        for k in last for g, name in enumerate(("trades", "win_rate_pct", "return_pct"), 1)
    ]
    return found.select(*kept, *numbers)


def scrape_keywords(logs: DataFrame, text: str = "text") -> DataFrame:
    """Metrics from lines mentioning "test"; the first keyword of a line decides its kind.

    Of each kind the last line that parses counts.  All work is on the array of
    lines inside the row, so nothing is shuffled.
    """
    tests = F.filter(lines(F.col(text)), lambda x: F.lower(x).contains("test"))

    def after(x: Column, mark: str, index: int) -> Column:
        return F.trim(F.try_element_at(F.split(x, mark), F.lit(index)))

    def first_bar(x: Column) -> Column:
        return F.trim(F.substring_index(x, "|", 1))

    kinds = ["Win Rate", "Return", "Trades", "PnL"]

    def is_kind(x: Column, i: int) -> Column:
        earlier = [x.contains(k) for k in kinds[:i]]
        own = x.contains(kinds[i])
        for e in earlier:
            own = own & ~e
        return own

    def number(x: Column) -> Column:
        return parse_double(x)

    tails = [
        lambda x: number(first_bar(F.replace(after(x, ":", -1), F.lit("%"), F.lit("")))),
        lambda x: number(F.replace(after(x, ":", -1), F.lit("%"), F.lit(""))),
        lambda x: first_bar(after(x, ":", 2)).try_cast("bigint").cast("double"),
        lambda x: number(first_bar(after(x, r"\$", -1))),
    ]
    names = ["test_win_rate", "test_return", "test_trades", "test_pnl"]

    def last_number(i: int) -> Column:
        values = F.transform(F.filter(tests, lambda x: is_kind(x, i)), tails[i])
        return F.try_element_at(F.filter(values, lambda v: v.isNotNull()), F.lit(-1))

    return logs.select(
        *[c for c in logs.columns if c != text], *[last_number(i).alias(n) for i, n in enumerate(names)]
    )


def last_matching_lines(logs: DataFrame, text: str = "text") -> DataFrame:
    """Last line naming each metric, trimmed."""
    wanted = {
        "win_rate_line": lambda x: x.contains("Win Rate"),
        "return_line": lambda x: x.contains("Return") & x.contains("%"),
        "trades_line": lambda x: x.contains("Trades"),
        "pnl_line": lambda x: x.contains("PnL") & x.contains("$"),
    }
    return logs.select(
        *[c for c in logs.columns if c != text], *[last_line(F.col(text), w).alias(n) for n, w in wanted.items()]
    )


def trade_band(runs: DataFrame, low: int = BAND[0], high: int = BAND[1]) -> DataFrame:
    ok = F.col("val_trades").between(low, high) & F.col("test_trades").between(low, high)
    return runs.withColumn("trade_band_ok", ok)


def score(runs: DataFrame, weight: float = SCORE_WEIGHT) -> DataFrame:
    v, t = F.col("val_return_pct"), F.col("test_return_pct")
    return runs.withColumn("score", F.least(v, t) + float(weight) * t - GAP_WEIGHT * F.abs(v - t))


def sweep_score(runs: DataFrame) -> DataFrame:
    a, b = SWEEP_WEIGHTS
    value = a * F.col("val_return_pct") + b * F.col("test_return_pct")
    return runs.withColumn("score", F.when(F.col("val_trades") < SWEEP_MIN_TRADES, SWEEP_FLOOR).otherwise(value))


def aggregate_by_config(results: DataFrame, keys: Sequence[str] = ("config",)) -> DataFrame:
    """Successful runs per config: count, medians, share inside the trade band."""
    keys = list(keys)
    ok = results.where(F.col("return_code") == 0)
    counts = ok.groupBy(keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("trade_band_ok").cast("int")).alias("trade_band_ok_rate")
    )
    ok = ok.withColumn("_min", F.least("val_return_pct", "test_return_pct"))
    middle = medians(
        ok,
        keys,
        {
            "median_val_return_pct": "val_return_pct",
            "median_test_return_pct": "test_return_pct",
            "median_min_return_pct": "_min",
            "median_score": "score",
        },
    )
    return counts.join(middle, keys)


RANKING = ["median_min_return_pct", "median_test_return_pct", "trade_band_ok_rate", "median_score"]


def rank_configs(aggregates: DataFrame) -> DataFrame:
    """``rank`` by four figures, best first, the config name as last resort; missing figures rank last."""
    order = [F.col(c).desc() for c in RANKING] + [F.col("config").asc()]
    coarse = F.coalesce(F.floor(-F.col(RANKING[0]) * 100).cast("bigint"), F.lit(1 << 62))
    return number_rows(aggregates, [], order, name="rank", chunk=coarse)


def gate_winners(aggregates: DataFrame, most: int = 3, floor: float = 0.0) -> DataFrame:
    """Best configs that are always in the trade band and not below the floor."""
    good = aggregates.where((F.col("trade_band_ok_rate") >= 1.0) & (F.col("median_min_return_pct") >= floor))
    return good.orderBy(*[F.col(c).desc() for c in RANKING], "config").limit(most)


def phase_merge(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored results of earlier phases followed by this phase's."""
    return stored.unionByName(fresh, allowMissingColumns=True)


def winners_or_stored(winners: DataFrame, stored: DataFrame) -> DataFrame:
    """This phase's winners, or the stored ones if it has none."""
    any_new = winners.agg(F.count(F.lit(1))).scalar()
    return winners.unionByName(stored.where(any_new == 0))


def variant_matrix(variants: DataFrame, seeds: Sequence[int], presets: Sequence[Mapping] = ()) -> DataFrame:
    """Every variant with every seed, and with every dataset preset if given.

    Seeds and presets are literals exploded per row; nothing is joined.
    """
    rows = variants.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    if presets:
        items = [F.struct(*[F.lit(v).alias(k) for k, v in p.items()]) for p in presets]
        rows = rows.withColumn("_p", F.explode(F.array(*items))).select("*", "_p.*").drop("_p")
    return rows


def merge_options(base: Column, overrides: Column) -> Column:
    """Options of ``base`` replaced and extended by ``overrides``; flags without value are kept as ''."""
    return F.map_zip_with(base, overrides, lambda _, a, b: F.coalesce(b, a))


def option(options: Column, name: str, default: str = "") -> Column:
    """Value of an option, the default where it is absent or has no value."""
    return F.coalesce(F.nullif(F.try_element_at(options, F.lit(name)), F.lit("")), F.lit(default))


def experiment_tags(variants: DataFrame, options: str = "options") -> DataFrame:
    return variants.select(
        "*", *[option(F.col(options), o, d).alias(tag) for tag, (o, d) in TAG_OPTIONS.items()]
    )


def winner_cases(winners: DataFrame, variants: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """Winning configs joined back to their variants and expanded by seed."""
    return variant_matrix(variants.join(winners.select("config"), "config"), seeds)


def upper_median(runs: DataFrame, keys: Sequence[str], value: str, where: Column | None = None) -> DataFrame:
    """Element ``n // 2`` of the sorted values."""
    rows = runs if where is None else runs.where(where)
    return medians(rows, list(keys), {f"median_{value}": value}, upper=True)


def best_trial(trials: DataFrame, keys: Sequence[str], trial: str, params: Sequence[str]) -> DataFrame:
    """Trial with the highest score per key, the first one on ties, with its parameters."""
    return top_k(trials, list(keys), [F.desc("score"), F.asc(trial)], 1, [trial]).select(
        *keys, trial, "score", *params
    )


def run_outcomes(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
        F.count_if("timed_out").alias("timeouts"),
    )


def top_experiments(runs: DataFrame, tie: str, k: int = 3) -> DataFrame:
    """Best successful runs by win rate, a missing rate counting as 0."""
    rate = F.coalesce(F.col("test_win_rate"), F.lit(0.0))
    return runs.where("success").orderBy(rate.desc(), F.col(tie).asc()).limit(k)


def stage_gate(stages: DataFrame, min_val: int, min_test: int) -> DataFrame:
    """Outcome of a two-stage run from both return codes and the first stage's trades."""
    passed = (F.col("val_trades").cast("bigint") >= min_val) & (F.col("test_trades").cast("bigint") >= min_test)
    result = (
        F.when(F.col("stage1_code") != 0, "failed_stage1")
        .when(~passed, "blocked_by_trade_gate")
        .when(F.col("stage2_code") != 0, "failed_stage2")
        .otherwise("completed")
    )
    return stages.withColumn("gate_pass", passed).withColumn("result", result)


def seed_list(raw: Column) -> Column:
    """``"11, 23,"`` -> ``[11, 23]``."""
    parts = F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(parts, lambda x: x.cast("int"))
