"""Run documents, result files and text logs: reading, writing, cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.functions.numeric import finite
from tapeworks.functions.text import lines

# Fields of run documents, index entries and results.
_SPLIT = (
    "steps: bigint, total_reward: double, avg_reward_per_step: double, proxy_loss: double, "
    "final_portfolio_value: double, total_return_pct: double, trades: bigint, winning_trades: bigint, "
    "losing_trades: bigint, win_rate_pct: double, realized_pnl: double, unrealized_pnl: double"
)

RUN_STATE = (
    "ts string, "
    "run struct<run_id: string, mode: string, status: string, started_at: string, "
    "started_ts_epoch: bigint, finished_at: string, finished_ts_epoch: bigint, "
    "elapsed_seconds: bigint, state_file: string, total_timesteps: bigint, "
    "current_step: bigint, progress_pct: double, "
    "final_summary: struct<kind: string, mode: string, portfolio_value: double, total_return_pct: double, "
    "realized_pnl: double, unrealized_pnl: double, trades: bigint, winning_trades: bigint, "
    "losing_trades: bigint, win_rate_pct: double, source: string>>, "
    "technical struct<step: bigint, epoch: bigint, n_updates: bigint, n_steps: bigint, "
    "batch_size: bigint, learning_rate: double, num_data_rows: bigint, "
    "memory: struct<device: string, ram_mb: double, vram_allocated_mb: double, "
    "vram_reserved_mb: double, vram_process_mb: double, vram_gpu_used_mb: double>, "
    "loss: struct<train: double, dev: double, test: double, policy: double, value: double, "
    "entropy: double, approx_kl: double, clip_fraction: double>>, "
    "rewards struct<train: double, dev: double, test: double>, "
    "finance struct<initial_cash: double, portfolio_value: double, total_return_pct: double, "
    "realized_pnl: double, unrealized_pnl: double, num_positions: bigint, trades: bigint, "
    "winning_trades: bigint, losing_trades: bigint, win_rate_pct: double, "
    "stop_loss_exits: bigint, fees_paid: double, drawdown_pct: double>, "
    f"splits struct<dev: struct<{_SPLIT}>, test: struct<{_SPLIT}>>, "
    "series map<string, array<struct<step: bigint, value: double>>>"
)

RUN_INDEX = (
    "run_id: string, mode: string, status: string, started_at: string, finished_at: string, "
    "elapsed_seconds: bigint, state_file: string"
)

RESULTS = (
    "results array<struct<phase: string, config: string, days: bigint, max_symbols: bigint, "
    "train_steps: bigint, seed: bigint, return_code: bigint, elapsed_sec: double, "
    "metrics: struct<val_trades: double, val_win_rate_pct: double, val_return_pct: double, "
    "test_trades: double, test_win_rate_pct: double, test_return_pct: double>, "
    "trade_band_ok: boolean, score: double, log_path: string>>"
)


def _read_json(spark: SparkSession, path: str, schema: str, multi_line: bool) -> DataFrame:
    """Documents that parse; missing keys become null, corrupt documents are left out."""
    raw = (
        spark.read.schema(f"{schema}, _corrupt_record string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("multiLine", multi_line)
        .json(path)
    )
    return raw.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def read_run_state(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Run documents, one per file, or one per line with ``multi_line=False``."""
    return _read_json(spark, path, RUN_STATE, multi_line)


def read_run_index(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an index document with ``seq``, their order."""
    docs = _read_json(spark, path, f"runs array<struct<{RUN_INDEX}>>", True)
    return docs.select(F.posexplode("runs").alias("seq", "r")).select("seq", "r.*")


def read_results(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Experiment results, one row per run with its metrics as columns."""
    docs = _read_json(spark, path, RESULTS, multi_line)
    rows = docs.select(F.explode("results").alias("r")).select("r.*")
    return rows.select(*[c for c in rows.columns if c != "metrics"], "metrics.*")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """``log, folder, text``: whole text files."""
    files = spark.read.text(path, wholetext=True)
    place = F.col("_metadata.file_path")
    return files.select(
        F.col("_metadata.file_name").alias("log"), F.regexp_replace(place, "/[^/]*$", "").alias("folder"), F.col("value").alias("text")
    )


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """``log, folder, line_no, line, n_lines``: numbered lines of text files of any size.

    Files are read in splits, several per file where it is long.  A split starts at a byte
    of its file and its lines come in order, so the lines are counted per split, the counts
    are summed along each file, and a line's number is its place in the split plus the lines
    before.  Only that table of splits is shuffled and ordered by file.  A line ends at a
    line feed; an empty file has no rows.
    """
    file, name = F.col("_metadata.file_path"), F.col("_metadata.file_name")
    rows = spark.read.option("lineSep", "\n").text(path).select(
        name.alias("log"), F.regexp_replace(file, "/[^/]*$", "").alias("folder"), file.alias("_file"),
        F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"),
    )
    splits = rows.groupBy("_file", "_split").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_size"))
    whole = Window.partitionBy("_file")
    before = whole.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).withColumn("n_lines", F.sum("_size").over(whole))
    place = F.col("_id") - F.col("_first")
    moved = F.raise_error(F.lit("a log changed while it was read")).cast("bigint")
    number = F.when((place >= 0) & (place < F.col("_size")), place + F.col("_before") + 1).otherwise(moved)
    return rows.join(splits, ["_file", "_split"]).select("log", "folder", number.alias("line_no"), "line", "n_lines")


def lines_head_tail(numbered: DataFrame, head: int = 10, tail: int = 20) -> DataFrame:
    """First and last lines of each log as ``log, part, line_no, line``, from :func:`read_log_lines`: a filter."""
    parts = {"head": F.col("line_no") <= head, "tail": F.col("line_no") > F.col("n_lines") - tail}
    wanted = F.filter(F.array(*[F.when(c, F.lit(p)) for p, c in parts.items()]), lambda p: p.isNotNull())
    return numbered.select("log", F.explode(wanted).alias("part"), "line_no", "line")


def _file_lines(text: Column) -> Column:
    """Lines of a file; a final line break does not start another line."""
    return lines(F.regexp_replace(text, "\n\\z", ""))


def log_lines(logs: DataFrame) -> DataFrame:
    """``log, line_no, line``; line numbers start at 1."""
    rows = logs.select("log", F.posexplode(_file_lines(F.col("text"))).alias("_p", "line"))
    return rows.select("log", (F.col("_p") + 1).alias("line_no"), "line")


def log_head_tail(logs: DataFrame, head: int = 10, tail: int = 20) -> DataFrame:
    """First and last lines of each log as ``log, part, line_no, line``; taken from the
    array of lines in the row, without a shuffle."""
    rows = logs.withColumn("_lines", _file_lines(F.col("text"))).withColumn("_n", F.size("_lines"))
    numbered = F.transform("_lines", lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line")))
    start = F.greatest(F.col("_n") - tail, F.lit(0)) + 1
    parts = F.array(
        F.struct(F.lit("head").alias("part"), F.slice(numbered, 1, head).alias("rows")),
        F.struct(F.lit("tail").alias("part"), F.slice(numbered, start, F.lit(tail)).alias("rows")),
    )
    each = rows.select("log", F.explode(parts).alias("p"))
    return each.select("log", "p.part", F.explode("p.rows").alias("r")).select("log", "part", "r.line_no", "r.line")


def json_clean(df: DataFrame) -> DataFrame:
    """NaN and infinities become null in every floating field, also inside structs, arrays and maps."""
    return df.select(*[_clean(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def _has_float(t: T.DataType) -> bool:
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return True
    if isinstance(t, T.ArrayType):
        return _has_float(t.elementType)
    if isinstance(t, T.MapType):
        return _has_float(t.valueType)
    return isinstance(t, T.StructType) and any(_has_float(f.dataType) for f in t.fields)


def _clean(c: Column, t: T.DataType) -> Column:
    if not _has_float(t):
        return c
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _clean(x, t.elementType))
    if isinstance(t, T.MapType):
        return F.transform_values(c, lambda _, v: _clean(v, t.valueType))
    if isinstance(t, T.StructType):
        fields = F.struct(*[_clean(c[f.name], f.dataType).alias(f.name) for f in t.fields])
        return F.when(c.isNotNull(), fields)
    return finite(c)


def write_run_state(states: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON document per line."""
    json_clean(states).select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)


def write_results(results: DataFrame, path: str, by: str = "phase", mode: str = "overwrite") -> None:
    """Result rows as JSON, one folder per value of ``by``."""
    json_clean(results).write.mode(mode).partitionBy(by).json(path)
