"""Streaming queries: the events table replayed through Structured Streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import tables as t
from checks.registry import query, scratch
from tapeworks.sources import documents as do
from tapeworks.streaming import streams as st

HOUR = 3_600_000_000


DAYS, SLICES = 5, 6
#: Rows that arrive weeks late, long after their windows have closed.
LATE = "epoch_us(ts) < epoch_us(TIMESTAMP '2024-01-06') AND event_id % 97 = 0"


def event_stream(spark, d, root):
    """The events in slices of five days, a micro-batch each; some rows of the first come with the fourth.

    A slice is written by many tasks, each its own file; all slices have the same number of files.
    """
    rows = t.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    day = F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    own = F.greatest(F.lit(0), F.least(F.floor(day / DAYS), F.lit(SLICES - 1)))
    rows = rows.withColumn("_slice", F.when((day < DAYS) & (F.col("event_id") % 97 == 0), 3).otherwise(own))
    least = min(r["count"] for r in rows.groupBy("_slice").count().collect())
    files = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), least // 40))
    for i in range(SLICES):  # rows are dealt in turn, so no file is empty
        rows.where(F.col("_slice") == i).drop("_slice").repartition(files).write.mode("append").parquet(f"{root}/in")
    return st.stream_table(spark, f"{root}/in", files_per_batch=files)


BARS = """
    SELECT * FROM (SELECT symbol, open_time - (open_time - 1704067200000000) % {width} AS bucket, max(open_time) AS open_time,
             first(open ORDER BY open_time, seq) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY open_time, seq) AS close, sum(volume) AS volume
      FROM ticks WHERE NOT (open_time < 1704499200000000 AND seq % 97 = 0) GROUP BY symbol, open_time - (open_time - 1704067200000000) % {width})"""


@query("stream_bars", f"""
    {BARS.format(width=HOUR)} WHERE bucket + {HOUR} <= (SELECT max(open_time) FROM ticks) - 2 * {HOUR}""", "open high low close volume")
def _(spark, d):
    return bars(spark, d, 60)


@query("stream_bars_7min", f"""
    {BARS.format(width=7 * HOUR // 60)} WHERE bucket + {7 * HOUR // 60} <= (SELECT max(open_time) FROM ticks) - 2 * {HOUR}""", "open high low close volume")
def _(spark, d):
    return bars(spark, d, 7)


def bars(spark, d, minutes):
    price = F.col("value")
    root = scratch(spark, "stream-bars")
    ticks = event_stream(spark, d, root).select(
        F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), *[price.alias(c) for c in ("open", "high", "low", "close")],
        t.props_k().cast("double").alias("volume"),
    )
    return st.replay(st.stream_bars(ticks, minutes, "2 hours", "seq", 1_704_067_200), f"{root}/out", f"{root}/checkpoint")


@query("stream_trade_rate", f"""
    SELECT run, window_start, steps, trade_rate, steps >= 10 AND trade_rate > 0.71 AS alert FROM (
      SELECT user_id AS run, epoch_us(ts) - epoch_us(ts) % (24 * {HOUR}) - i * 24 * {HOUR} AS window_start, count(*) AS steps,
             avg(CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 <> 0 THEN 1 ELSE 0 END) AS trade_rate
      FROM events, range(4) AS r(i) WHERE NOT ({LATE}) GROUP BY user_id, window_start)
    WHERE window_start + 96 * {HOUR} <= (SELECT max(epoch_us(ts)) FROM events) - 2 * {HOUR}""", "trade_rate")
def _(spark, d):
    root = scratch(spark, "stream-rate")
    steps = event_stream(spark, d, root).select(F.col("user_id").alias("run"), "ts", (t.props_k() % 3 != 0).alias("executed"))
    rates = st.stream_trade_rate(steps, "96 hours", "24 hours", "2 hours", 0.71)
    return st.replay(rates, f"{root}/out", f"{root}/checkpoint")


def finish(writer, root):
    writer.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def capped_series(spark, d, run, most):
    root = scratch(spark, "stream-series")
    k = t.props_k()
    value = F.when(k % 10 == 0, F.lit(None)).when(k % 10 == 1, 0.0).otherwise(F.col("value"))
    points = event_stream(spark, d, root).select(
        run.alias("run"), F.col("event_type").alias("key"),
        F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("step"),
        F.col("event_id").alias("pos"), value.alias("value"),
    )
    finish(st.stream_series_cap(points, f"{root}/changes", most, compact_every=2), root)
    return st.read_series(spark, f"{root}/changes", most)


def user_run():
    return F.concat(F.lit("run-"), F.col("user_id").cast("string"))


@query("stream_series_cap", """
    SELECT run, key, step, pos, value FROM (SELECT *, row_number() OVER (PARTITION BY run, key ORDER BY pos DESC) AS r FROM telemetry
    WHERE value IS NOT NULL) WHERE r <= 8""", "value")
def _(spark, d):
    return capped_series(spark, d, user_run(), 8)


@query("stream_series_hot", """
    SELECT run, key, step, pos, value FROM (
      SELECT * REPLACE (CASE WHEN pos % 3 = 0 THEN 'hot' ELSE run END AS run), row_number() OVER (PARTITION BY CASE WHEN pos % 3 = 0 THEN 'hot' ELSE run END, key ORDER BY pos DESC) AS r
      FROM telemetry WHERE value IS NOT NULL) WHERE r <= 500""", "value")
def _(spark, d):
    """One run holds a third of all points."""
    return capped_series(spark, d, F.when(F.col("event_id") % 3 == 0, "hot").otherwise(user_run()), 500)


def state_files(spark, d, root):
    """Three generations of run documents, each a set of new files."""
    for generation in range(3):
        docs = t.run_index(spark, d).where(F.pmod("seq", F.lit(3)) >= generation).select(
            F.format_string("2024-02-0%d 00:00:00 UTC", F.lit(generation + 1)).alias("ts"),
            F.struct("run_id", "mode", "status", F.lit(generation * 100).cast("bigint").alias("current_step")).alias("run"),
        )
        do.write_run_state(docs, f"{root}/in", "append")


STATES = """
    SELECT run_id AS run, mode, status, seq % 3 * 100 AS current_step, '2024-02-0' || (seq % 3 + 1) || ' 00:00:00 UTC' AS ts FROM run_index"""


@query("stream_run_files", "SELECT run_id AS run, count(*) AS documents FROM run_index, range(3) AS r(g) WHERE seq % 3 >= g GROUP BY run_id")
def _(spark, d):
    root = scratch(spark, "stream-files")
    state_files(spark, d, root)
    docs = st.stream_run_files(spark, f"{root}/in", multi_line=False).select(F.col("run.run_id").alias("run"), "ts")
    return st.replay(docs, f"{root}/out", f"{root}/checkpoint").groupBy("run").agg(F.count(F.lit(1)).alias("documents"))


@query("stream_latest_state", STATES)
def _(spark, d):
    root = scratch(spark, "stream-state")
    state_files(spark, d, root)
    docs = st.stream_run_files(spark, f"{root}/in", files_per_batch=8, multi_line=False).select(
        F.col("run.run_id").alias("run"), "run.mode", "run.status", "run.current_step", "ts", "file"
    )
    finish(st.stream_latest_state(docs, f"{root}/changes", ("ts", "current_step", "file")), root)
    return st.read_changes(spark, f"{root}/changes", docs.schema, ["run"]).drop("file")
