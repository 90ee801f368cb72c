"""Queries for experiment results, logs, telemetry and run documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import tables as t
from checks.registry import query, scratch
from tapeworks.functions.numeric import safe_float
from tapeworks.functions.text import format_elapsed, parse_stamp, run_epoch
from tapeworks.operators import experiments as ex
from tapeworks.operators import telemetry as te
from tapeworks.plans.series import number_rows
from tapeworks.sources import documents as do

# ---------------------------------------------------------------- logs

PATTERN = r"%s Trades:\s*(\d+)\s*\|\s*WR:\s*([\d.]+)%%\s*\|\s*Return:\s*([-\d.]+)%%"


def scraped(split, group):
    return f"coalesce(CAST(regexp_extract_all(text, '{PATTERN % split}', {group})[-1] AS DOUBLE), 0)"


@query("scrape_summary", "SELECT log, " + ", ".join(
    f"{scraped(s, g)} AS {s.lower()}_{n}" for s in ("Val", "Test") for g, n in enumerate(("trades", "win_rate_pct", "return_pct"), 1))
    + " FROM logs", " ".join(ex.METRICS))
def _(spark, d):
    return ex.scrape_summary(t.logs(spark, d))


TEST_LINES = """
    SELECT log, i, line, CASE WHEN contains(line, 'Win Rate') THEN 'w' WHEN contains(line, 'Return') THEN 'r'
                              WHEN contains(line, 'Trades') THEN 't' WHEN contains(line, 'PnL') THEN 'p' END AS kind
    FROM (SELECT log, unnest(string_split(text, E'\\n')) AS line, generate_subscripts(string_split(text, E'\\n'), 1) AS i FROM logs)
    WHERE contains(lower(line), 'test')"""


@query("scrape_keywords", f"""
    WITH parsed AS (SELECT log, i, kind, TRY_CAST(trim(CASE kind
        WHEN 'w' THEN string_split(replace(string_split(line, ':')[-1], '%', ''), '|')[1]
        WHEN 'r' THEN replace(string_split(line, ':')[-1], '%', '')
        WHEN 't' THEN string_split(string_split(line, ':')[2], '|')[1]
        WHEN 'p' THEN string_split(string_split(line, '$')[-1], '|')[1] END) AS DOUBLE) AS v FROM ({TEST_LINES}))
    SELECT o_orderkey AS log, arg_max(v, i) FILTER (kind = 'w' AND v IS NOT NULL) AS test_win_rate,
           arg_max(v, i) FILTER (kind = 'r' AND v IS NOT NULL) AS test_return, arg_max(v, i) FILTER (kind = 't' AND v IS NOT NULL) AS test_trades,
           arg_max(v, i) FILTER (kind = 'p' AND v IS NOT NULL) AS test_pnl
    FROM orders LEFT JOIN parsed ON o_orderkey = log GROUP BY o_orderkey""", "test_win_rate test_return test_trades test_pnl")
def _(spark, d):
    return ex.scrape_keywords(t.logs(spark, d))


@query("last_matching_line", """
    WITH rows AS (SELECT log, unnest(string_split(text, E'\\n')) AS line, generate_subscripts(string_split(text, E'\\n'), 1) AS i FROM logs)
    SELECT log, trim(arg_max(line, i) FILTER (contains(line, 'Win Rate'))) AS win_rate_line,
           trim(arg_max(line, i) FILTER (contains(line, 'Return') AND contains(line, '%'))) AS return_line,
           trim(arg_max(line, i) FILTER (contains(line, 'Trades'))) AS trades_line,
           trim(arg_max(line, i) FILTER (contains(line, 'PnL') AND contains(line, '$'))) AS pnl_line
    FROM rows GROUP BY log""")
def _(spark, d):
    return ex.last_matching_lines(t.logs(spark, d))


HEAD_TAIL = """
    WITH rows AS (SELECT log, text, unnest(string_split(text, E'\\n')) AS line, generate_subscripts(string_split(text, E'\\n'), 1) AS i,
                         len(string_split(text, E'\\n')) AS n FROM logs)
    SELECT log, 'head' AS part, CAST(i AS INTEGER) AS line_no, line FROM rows WHERE i <= 3
    UNION ALL SELECT log, 'tail', CAST(i AS INTEGER), line FROM rows WHERE i > n - 5"""


@query("log_head_tail", HEAD_TAIL)
def _(spark, d):
    return do.log_head_tail(t.logs(spark, d), 3, 5)


@query("read_logs", """
    SELECT phase, count(*) AS n_lines, max(i) AS longest, sum(strlen(line))::BIGINT AS n_bytes
    FROM (SELECT CAST(o_orderkey % 20 AS INTEGER) AS phase, unnest(string_split(text, E'\\n')) AS line,
                 generate_subscripts(string_split(text, E'\\n'), 1)::INTEGER AS i FROM logs JOIN orders ON log = o_orderkey) GROUP BY phase""")
def _(spark, d):
    """Logs are gathered into one text file per share, a form feed closing each."""
    root = scratch(spark, "logs")
    logs = t.logs(spark, d).select((F.col("log") % 20).cast("int").alias("phase"), F.concat("text", F.lit("\f")).alias("text"))
    logs.write.partitionBy("phase").text(root)
    files = do.read_logs(spark, f"{root}/phase=*").select(
        F.regexp_extract(F.col("folder"), r"phase=(\d+)$", 1).cast("int").alias("phase"), F.explode(F.split("text", "\f\n?")).alias("text")
    )
    rows = do.log_lines(files.where(F.length("text") > 0).select(F.col("phase").alias("log"), "text"))
    return rows.groupBy(F.col("log").alias("phase")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.max("line_no").alias("longest"), F.sum(F.octet_length("line")).alias("n_bytes")
    )


def phase_files(spark, d):
    """Numbered lines of one text file per share of the logs, in the order of the logs."""
    root = scratch(spark, "log-files")
    logs = t.logs(spark, d).select((F.col("log") % 20).cast("int").alias("phase"), "log", "text")
    logs.repartition("phase").sortWithinPartitions("phase", "log").drop("log").write.partitionBy("phase").text(root)
    rows = do.read_log_lines(spark, f"{root}/phase=*")
    return rows.withColumn("log", F.regexp_extract("folder", r"phase=(\d+)$", 1).cast("int"))


PHASE_LINES = """
    SELECT CAST(log % 20 AS INTEGER) AS phase, line, row_number() OVER (PARTITION BY log % 20 ORDER BY log, i) AS line_no, count(*) OVER (PARTITION BY log % 20) AS n
    FROM (SELECT log, unnest(string_split(text, E'\\n')) AS line, generate_subscripts(string_split(text, E'\\n'), 1) AS i FROM logs)"""


@query("read_log_lines", f"""
    SELECT phase, count(*) AS n_lines, max(line_no) AS last_line, sum(strlen(line))::BIGINT AS n_bytes, sum(line_no * strlen(line))::BIGINT AS placed,
           sum(line_no) FILTER (contains(line, 'start of run'))::BIGINT AS starts FROM ({PHASE_LINES}) GROUP BY phase""")
def _(spark, d):
    size = F.octet_length("line").cast("bigint")
    return phase_files(spark, d).groupBy(F.col("log").alias("phase")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.max("line_no").alias("last_line"), F.sum(size).alias("n_bytes"), F.sum(F.col("line_no") * size).alias("placed"),
        F.sum(F.when(F.col("line").contains("start of run"), F.col("line_no"))).alias("starts"),
    )


@query("log_files_head_tail", f"""
    SELECT phase AS log, 'head' AS part, line_no, line FROM ({PHASE_LINES}) WHERE line_no <= 10
    UNION ALL SELECT phase, 'tail', line_no, line FROM ({PHASE_LINES}) WHERE line_no > n - 35""")
def _(spark, d):
    return do.lines_head_tail(phase_files(spark, d), 10, 35)


# ---------------------------------------------------------------- experiments


@query("trade_band", "SELECT run, trade_band_ok FROM scored")
def _(spark, d):
    return ex.trade_band(t.run_metrics(spark, d)).select("run", "trade_band_ok")


@query("score", "SELECT run, score FROM scored", "score")
def _(spark, d):
    return ex.score(t.run_metrics(spark, d)).select("run", "score")


SWEEP = """SELECT *, CASE WHEN val_trades < 5 THEN -100 ELSE 0.4::DOUBLE * val_return_pct + 0.6::DOUBLE * test_return_pct END AS sweep FROM run_metrics"""


@query("sweep_score", f"SELECT run, sweep AS score FROM ({SWEEP})", "score")
def _(spark, d):
    return ex.sweep_score(t.run_metrics(spark, d)).select("run", "score")


STATS = ["median_val_return_pct", "median_test_return_pct", "median_min_return_pct", "median_score", "trade_band_ok_rate"]


@query("aggregate_by_config", "SELECT * FROM config_stats", " ".join(STATS))
def _(spark, d):
    return t.config_stats(spark, d)


BY_CUST = """
    SELECT concat('c', run % 400) AS config, count(*) AS n, median(val_return_pct) AS median_val_return_pct,
           median(test_return_pct) AS median_test_return_pct, median(least(val_return_pct, test_return_pct)) AS median_min_return_pct,
           median(score) AS median_score, avg(trade_band_ok::INTEGER) AS trade_band_ok_rate
    FROM scored WHERE return_code = 0 GROUP BY concat('c', run % 400)"""
FEW_RUNS = BY_CUST.replace("run % 400", "run % 6000")


def many_configs(spark, d, n=400):
    rows = t.scored(spark, d).withColumn("config", F.concat(F.lit("c"), (F.col("run") % n).cast("string")))
    return ex.aggregate_by_config(rows)


RANK = "median_min_return_pct DESC, median_test_return_pct DESC, trade_band_ok_rate DESC, median_score DESC, config"


@query("rank_configs", f"SELECT *, row_number() OVER (ORDER BY {RANK}) AS rank FROM ({BY_CUST})", " ".join(STATS))
def _(spark, d):
    return ex.rank_configs(many_configs(spark, d))


@query("gate_winners", f"""
    SELECT config, median_min_return_pct FROM ({FEW_RUNS}) WHERE trade_band_ok_rate >= 1 AND median_min_return_pct >= -2
    ORDER BY {RANK} LIMIT 3""", "median_min_return_pct")
def _(spark, d):
    return ex.gate_winners(many_configs(spark, d, 6000), 3, -2.0).select("config", "median_min_return_pct")


@query("phase_merge", """
    SELECT run, phase, config, return_code, trade_band_ok FROM scored""")
def _(spark, d):
    rows = t.scored(spark, d).select("run", "phase", "config", "return_code", "trade_band_ok")
    early = ex.phase_merge(rows.where("phase = 'gate'"), rows.where("phase = 'confirm'"))
    return ex.phase_merge(early, rows.where("phase = 'robust'"))


@query("winners_or_stored", """
    SELECT 'none new' AS case_, phase, config, count(*) AS n FROM scored GROUP BY phase, config
    UNION ALL SELECT 'some new', phase, config, count(*) FROM scored WHERE phase = 'robust' GROUP BY phase, config""")
def _(spark, d):
    """Both ways: a phase without winners keeps the stored ones, one with winners replaces them."""
    rows = t.scored(spark, d).groupBy("phase", "config").agg(F.count(F.lit(1)).alias("n"))
    none = ex.winners_or_stored(rows.where("phase = 'rerun'"), rows).select(F.lit("none new").alias("case_"), "phase", "config", "n")
    some = ex.winners_or_stored(rows.where("phase = 'robust'"), rows).select(F.lit("some new").alias("case_"), "phase", "config", "n")
    return none.unionByName(some)


@query("variant_matrix", """
    SELECT config, seed, days, max_symbols FROM variants, (VALUES (11), (23), (47)) AS s(seed), (VALUES (14, 3), (30, 5)) AS p(days, max_symbols)""")
def _(spark, d):
    presets = [{"days": 14, "max_symbols": 3}, {"days": 30, "max_symbols": 5}]
    return ex.variant_matrix(t.variants(spark, d), [11, 23, 47], presets).select("config", "seed", "days", "max_symbols")


def opt(name, default):
    return f"coalesce(nullif(coalesce(element_at(overrides, '{name}')[1], element_at(base, '{name}')[1]), ''), '{default}')"


def merged(spark, d):
    rows = t.variants(spark, d)
    return rows.withColumn("options", ex.merge_options(F.col("base"), F.col("overrides")))


@query("config_overrides", f"""
    SELECT config, {opt('--days', '7')} AS days, {opt('--algo', 'ppo')} AS algo, {opt('--seed', '42')} AS seed, {opt('--quiet', 'off')} AS quiet,
           len(list_distinct(map_keys(base) || map_keys(overrides)))::INTEGER AS n_options FROM variants""")
def _(spark, d):
    o = F.col("options")
    return merged(spark, d).select(
        "config", ex.option(o, "--days", "7").alias("days"), ex.option(o, "--algo", "ppo").alias("algo"),
        ex.option(o, "--seed", "42").alias("seed"), ex.option(o, "--quiet", "off").alias("quiet"), F.size(o).alias("n_options"),
    )


@query("experiment_tags", f"""
    SELECT config, {opt('--action-mapping-mode', 'legacy')} AS mapping_family, {opt('--reward-mode', 'equity_delta')} AS reward_mode,
           {opt('--algo', 'ppo')} AS algo, {opt('--mode', 'train')} AS eval_mode FROM variants""")
def _(spark, d):
    return ex.experiment_tags(merged(spark, d)).select("config", "mapping_family", "reward_mode", "algo", "eval_mode")


@query("winner_join", f"""
    SELECT v.config, days, seed FROM (SELECT config, {opt('--days', '7')} AS days FROM variants) v
    JOIN (SELECT concat('v', config[2:]) AS config FROM ({BY_CUST.replace('run % 400', 'run % 150')}) ORDER BY {RANK} LIMIT 3) w USING (config), (VALUES (11), (23)) AS s(seed)""")
def _(spark, d):
    ranked = ex.rank_configs(many_configs(spark, d, 150)).where("rank <= 3")
    winners = ranked.select(F.concat(F.lit("v"), F.substring("config", 2, 20)).alias("config"))
    rows = ex.winner_cases(winners, merged(spark, d), [11, 23])
    return rows.select("config", ex.option(F.col("options"), "--days", "7").alias("days"), "seed")


@query("upper_median", f"""
    SELECT config, a AS median_test_return_pct, b AS robust_median FROM (
      SELECT config, list_sort(list(test_return_pct))[count(*) // 2 + 1] AS a,
             list_sort(list(test_return_pct) FILTER (phase = 'robust'))[(count(*) FILTER (phase = 'robust')) // 2 + 1] AS b
      FROM run_metrics WHERE return_code = 0 GROUP BY config)""", "median_test_return_pct robust_median")
def _(spark, d):
    rows = t.run_metrics(spark, d).where("return_code = 0")
    robust = ex.upper_median(rows, ["config"], "test_return_pct", F.col("phase") == "robust")
    robust = robust.withColumnRenamed("median_test_return_pct", "robust_median")
    return ex.upper_median(rows, ["config"], "test_return_pct").join(robust, "config")


@query("best_trial", f"""
    SELECT config, run, sweep AS score, val_trades, seed FROM (
      SELECT *, row_number() OVER (PARTITION BY config ORDER BY sweep DESC, run) AS r FROM ({SWEEP})) WHERE r = 1""", "score val_trades")
def _(spark, d):
    return ex.best_trial(ex.sweep_score(t.run_metrics(spark, d)), ["config"], "run", ["val_trades", "seed"])


@query("run_outcomes", """
    SELECT config, count(*) AS total, count(*) FILTER (return_code = 0) AS successful, count(*) FILTER (return_code <> 0) AS failed,
           count(*) FILTER (run % 20 = 0) AS timeouts FROM run_metrics GROUP BY config""")
def _(spark, d):
    rows = t.run_metrics(spark, d).withColumn("success", F.col("return_code") == 0)
    return ex.run_outcomes(rows.withColumn("timed_out", F.col("run") % 20 == 0), ["config"])


@query("top_experiments", """
    SELECT run, CASE WHEN run % 3 = 0 THEN NULL ELSE test_win_rate_pct END AS test_win_rate FROM run_metrics WHERE return_code = 0
    ORDER BY coalesce(CASE WHEN run % 3 = 0 THEN NULL ELSE test_win_rate_pct END, 0) DESC, run LIMIT 3""", "test_win_rate")
def _(spark, d):
    rows = t.run_metrics(spark, d).withColumn("success", F.col("return_code") == 0)
    rows = rows.withColumn("test_win_rate", F.when(F.col("run") % 3 != 0, F.col("test_win_rate_pct")))
    return ex.top_experiments(rows, "run").select("run", "test_win_rate")


@query("stage_gate", """
    SELECT run, val_trades >= 1000 AND test_trades >= 800 AS gate_pass,
           CASE WHEN return_code <> 0 THEN 'failed_stage1' WHEN NOT (val_trades >= 1000 AND test_trades >= 800) THEN 'blocked_by_trade_gate'
                WHEN run % 7 = 0 THEN 'failed_stage2' ELSE 'completed' END AS result FROM run_metrics""")
def _(spark, d):
    rows = t.run_metrics(spark, d).withColumnRenamed("return_code", "stage1_code")
    rows = rows.withColumn("stage2_code", F.when(F.col("run") % 7 == 0, 1).otherwise(0))
    return ex.stage_gate(rows, 1000, 800).select("run", "gate_pass", "result")


@query("seed_list", """
    SELECT p_partkey, CAST(i AS INTEGER) AS pos, CAST(CASE i WHEN 0 THEN p_partkey ELSE p_size END AS INTEGER) AS seed FROM part, range(2) AS r(i)""")
def _(spark, d):
    raw = F.concat(F.lit(" "), F.col("p_partkey").cast("string"), F.lit(", ,"), F.col("p_size").cast("string"), F.lit(" ,"))
    rows = t.table(spark, d, "part").select("p_partkey", ex.seed_list(raw).alias("seeds"))
    return rows.select("p_partkey", F.posexplode("seeds").alias("pos", "seed"))


# ---------------------------------------------------------------- telemetry

POINTS = "SELECT run, key, step, pos, value FROM telemetry WHERE value IS NOT NULL"


def states(spark, d):
    """Run documents: the series as maps of arrays, in parts of at most 500 points of each; ``first`` is a part's first position."""
    points = number_rows(t.telemetry(spark, d).where("value IS NOT NULL"), ["run", "key"], "pos", name="n")
    points = points.withColumn("first", ((F.col("n") - 1) - (F.col("n") - 1) % te.MAX_POINTS).cast("int"))
    series = points.groupBy("run", "first", "key").agg(F.array_sort(F.collect_list(F.struct("n", "step", "value"))).alias("p"))
    short = F.transform("p", lambda x: F.struct(x["step"].alias("step"), x["value"].alias("value")))
    return series.groupBy("run", "first").agg(F.map_from_entries(F.collect_list(F.struct("key", short))).alias("series"))


@query("explode_series", """
    SELECT run, key, CAST(row_number() OVER (PARTITION BY run, key ORDER BY pos) - 1 AS INTEGER) AS pos, step, value
    FROM telemetry WHERE value IS NOT NULL""", "value")
def _(spark, d):
    return te.explode_series(states(spark, d), first="first")


@query("cap_series", f"SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY run, key ORDER BY pos DESC) AS r FROM ({POINTS})) WHERE r <= 8", "value")
def _(spark, d):
    return te.cap_series(t.telemetry(spark, d), 8)


@query("latest_value", f"SELECT run, key, arg_max(value, pos) AS value FROM ({POINTS}) GROUP BY run, key", "value")
def _(spark, d):
    return te.latest_value(t.telemetry(spark, d))


@query("latest_nonzero", f"SELECT run, key, arg_max(value, pos) AS value FROM ({POINTS}) WHERE abs(value) > 1e-12 GROUP BY run, key", "value")
def _(spark, d):
    return te.latest_nonzero(t.telemetry(spark, d))


@query("dedup_step", "SELECT run, key, step, value FROM dedup", "value")
def _(spark, d):
    return t.dedup(spark, d)


@query("align_series", "SELECT * FROM wide", " ".join(t.WIDE))
def _(spark, d):
    return t.wide(spark, d)


def filled(c):
    before = f"last_value(CASE WHEN {c} IS NOT NULL THEN {{}} END IGNORE NULLS) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    after = f"first_value(CASE WHEN {c} IS NOT NULL THEN {{}} END IGNORE NULLS) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    s0, v0, s1, v1 = before.format("step"), before.format(c), after.format("step"), after.format(c)
    return f"coalesce({c}, {v0} + ({v1} - {v0}) * (step - {s0}) / nullif({s1} - {s0}, 0), {v0}, {v1}) AS {c}"


FILLED = "SELECT run, step, " + ", ".join(filled(c) for c in t.WIDE) + " FROM wide"


@query("interpolate_index", FILLED, " ".join(t.WIDE))
def _(spark, d):
    return te.interpolate(t.wide(spark, d), t.WIDE)


@query("view_filter", "SELECT run, key, step, value FROM dedup WHERE key IN ('purchase', 'view')", "value")
def _(spark, d):
    return te.view_filter(t.dedup(spark, d), "Eval", {"Train": ["click"], "Eval": ["purchase", "view"]})


@query("melt", "SELECT run, step, key AS series, value FROM dedup", "value")
def _(spark, d):
    return te.melt(t.wide(spark, d), ["run", "step"], t.WIDE).where(F.col("value").isNotNull())


@query("y_domain", f"""
    SELECT run, lo - pad AS y_min, hi + pad AS y_max FROM (
      SELECT *, CASE WHEN lo = hi THEN greatest(abs(lo) * 0.02, 1e-6) ELSE (hi - lo) * 0.08 END AS pad
      FROM (SELECT run, min(value) AS lo, max(value) AS hi FROM ({POINTS}) GROUP BY run))""", "y_min y_max")
def _(spark, d):
    return te.y_domain(t.telemetry(spark, d), ["run"])


# ---------------------------------------------------------------- run index

NOW = 1_704_080_000
EPOCH = "CAST(CASE WHEN run_id LIKE 'run-%' THEN epoch(strptime(run_id[5:19], '%Y%m%d-%H%M%S')) ELSE 0 END AS BIGINT)"


def stamp(c):
    return f"CAST(epoch(try_strptime({c}, '%Y-%m-%d %H:%M:%S UTC')) AS BIGINT)"


@query("run_epoch", f"SELECT seq, {EPOCH} AS run_epoch FROM run_index")
def _(spark, d):
    return t.run_index(spark, d).select("seq", run_epoch(F.col("run_id")).alias("run_epoch"))


@query("parse_ts", f"SELECT seq, {stamp('started_at')} AS started, {stamp('finished_at')} AS finished FROM run_index")
def _(spark, d):
    return t.run_index(spark, d).select(
        "seq", parse_stamp(F.col("started_at")).alias("started"), parse_stamp(F.col("finished_at")).alias("finished")
    )


ELAPSED = f"""
    SELECT *, CASE WHEN e IS NOT NULL THEN greatest(0, e) END AS elapsed FROM (
      SELECT *, CASE WHEN status = 'running' AND s IS NOT NULL THEN {NOW} - s WHEN s IS NOT NULL AND f IS NOT NULL THEN f - s
                     ELSE elapsed_seconds END AS e
      FROM (SELECT *, {stamp('started_at')} AS s, {stamp('finished_at')} AS f FROM run_index))"""


@query("elapsed", f"SELECT seq, elapsed FROM ({ELAPSED})")
def _(spark, d):
    return te.elapsed(t.run_index(spark, d), F.lit(NOW)).select("seq", "elapsed")


CLOCK = """CASE WHEN elapsed IS NULL THEN '-' WHEN elapsed >= 3600 THEN printf('%dh %02dm %02ds', elapsed // 3600, elapsed % 3600 // 60, elapsed % 60)
    WHEN elapsed >= 60 THEN printf('%dm %02ds', elapsed // 60, elapsed % 60) ELSE printf('%ds', elapsed) END"""


@query("format_elapsed", f"SELECT seq, {CLOCK} AS label FROM ({ELAPSED})")
def _(spark, d):
    rows = te.elapsed(t.run_index(spark, d), F.lit(NOW))
    return rows.select("seq", format_elapsed(F.col("elapsed")).alias("label"))


@query("run_label", f"SELECT seq, concat_ws(' | ', run_id, mode, status, {CLOCK}) AS label FROM ({ELAPSED})")
def _(spark, d):
    return te.run_label(t.run_index(spark, d), F.lit(NOW)).select("seq", "label")


@query("index_upsert", """
    WITH u AS (SELECT * REPLACE ('completed' AS status, seq + 1000000 AS seq) FROM run_index WHERE seq % 10 = 3),
    everything AS (SELECT * FROM run_index UNION ALL SELECT * FROM u)
    SELECT run_id, status, seq FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS r FROM everything)
    WHERE r = 1 ORDER BY seq DESC LIMIT 40""")
def _(spark, d):
    index = t.run_index(spark, d)
    updates = index.where("seq % 10 = 3").withColumn("status", F.lit("completed")).withColumn("seq", F.col("seq") + 1_000_000)
    return te.index_upsert(index, updates).select("run_id", "status", "seq")


@query("latest_by_mode", """
    SELECT mode, run_id, status, seq = (SELECT max(seq) FROM run_index WHERE mode <> 'walk_forward') AS latest_model
    FROM run_index WHERE seq IN (SELECT max(seq) FROM run_index GROUP BY mode)""")
def _(spark, d):
    return te.latest_by_mode(t.run_index(spark, d)).select("mode", "run_id", "status", "latest_model")


@query("index_pointers", """
    WITH i AS (SELECT *, concat('runs/', run_id, '.json') AS state_file FROM run_index), m AS (SELECT * FROM i WHERE mode <> 'walk_forward' ORDER BY seq DESC LIMIT 1),
         l AS (SELECT * FROM i ORDER BY seq DESC LIMIT 1)
    SELECT l.run_id AS latest_run_id, l.state_file AS latest_state_file, m.run_id AS latest_model_run_id, m.state_file AS latest_model_state_file,
           m.mode AS latest_model_mode, m.status AS latest_model_status FROM l, m""")
def _(spark, d):
    return te.index_pointers(t.run_index(spark, d).withColumn("state_file", F.concat(F.lit("runs/"), "run_id", F.lit(".json"))))


@query("sort_runs", f"SELECT run_id, mode, {EPOCH} AS run_epoch FROM run_index ORDER BY run_epoch DESC, run_id DESC")
def _(spark, d):
    return te.sort_runs(t.run_index(spark, d)).select("run_id", "mode", "run_epoch")


@query("default_run", f"""
    SELECT 'gone' AS selected, arg_max(run_id, seq) AS run_id FROM run_index WHERE mode <> 'walk_forward'
    UNION ALL SELECT 'present', min(run_id) FROM run_index
    UNION ALL SELECT 'no model', arg_max(run_id, struct_pack(e := {EPOCH}, i := run_id)) FROM run_index WHERE mode = 'walk_forward'""")
def _(spark, d):
    """A selection that is gone, one that is present, and an index without a model run."""
    index = t.run_index(spark, d)
    present = index.agg(F.min("run_id")).first()[0]
    cases = {"gone": (index, "run-gone"), "present": (index, present), "no model": (index.where("mode = 'walk_forward'"), None)}
    parts = [te.default_run(rows, chosen).select(F.lit(name).alias("selected"), "run_id") for name, (rows, chosen) in cases.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


KPI_STATE = """
    SELECT concat('run-', c_custkey) AS run, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 9 END AS sum_trades,
           CASE WHEN c_custkey % 3 = 0 THEN c_acctbal / 10 END AS sum_realized_pnl, CASE WHEN c_custkey % 5 = 0 THEN 41.5::DOUBLE END AS sum_win_rate_pct,
           CASE c_custkey % 4 WHEN 0 THEN 100.0::DOUBLE WHEN 1 THEN c_acctbal END AS sum_portfolio_value, c_custkey % 11 AS fin_trades,
           CASE WHEN c_custkey % 7 = 0 THEN c_acctbal / 20 ELSE 0 END AS fin_realized_pnl,
           CASE WHEN c_custkey % 13 = 0 THEN 12.5::DOUBLE ELSE 0 END AS fin_win_rate_pct,
           CASE c_custkey % 6 WHEN 0 THEN 100.0::DOUBLE WHEN 2 THEN c_acctbal / 2 ELSE 0 END AS fin_portfolio_value,
           c_custkey * 3 AS step, CASE WHEN c_custkey % 3 <> 1 THEN c_acctbal / 7 END AS train_loss, CASE WHEN c_custkey % 5 <> 1 THEN c_acctbal / 9 END AS train_reward,
           CASE WHEN c_custkey % 4 <> 1 THEN c_acctbal / 30 END AS fin_unrealized_pnl, c_acctbal / 50 AS fin_total_return_pct, c_acctbal / 70 AS fin_drawdown_pct FROM customer"""


@query("resolve_kpis", f"""
    WITH p AS (SELECT run, CASE key WHEN 'click' THEN 'realized_pnl' WHEN 'view' THEN 'win_rate' WHEN 'signup' THEN 'trades' WHEN 'error' THEN 'unrealized_pnl' ELSE 'portfolio_value' END AS key,
                      pos, value FROM ({POINTS})),
    s AS (SELECT run, CAST(max(trunc(value)) FILTER (key = 'trades') AS BIGINT) AS tr, arg_max(value, pos) FILTER (key = 'realized_pnl') AS pnl,
                 arg_max(value, pos) FILTER (key = 'portfolio_value') AS pv, arg_max(value, pos) FILTER (key = 'unrealized_pnl') AS upnl, arg_max(value, pos) FILTER (key = 'win_rate' AND abs(value) > 1e-12) AS wr
          FROM p GROUP BY run),
    j AS (SELECT k.*, greatest(fin_trades, coalesce(sum_trades, 0), coalesce(tr, 0)) AS trades, pnl, pv, wr, upnl,
                 CASE WHEN coalesce(sum_portfolio_value, 0) IN (0, 100) AND fin_portfolio_value NOT IN (0, 100) THEN fin_portfolio_value
                      ELSE coalesce(sum_portfolio_value, 0) END AS pv0
          FROM ({KPI_STATE}) k LEFT JOIN s ON k.run = s.run)
    SELECT run, trades, coalesce(nullif(sum_realized_pnl, 0), nullif(fin_realized_pnl, 0), nullif(pnl, 0), 0) AS realized_pnl,
           coalesce(nullif(sum_win_rate_pct, 0), nullif(fin_win_rate_pct, 0), CASE WHEN trades > 0 THEN wr END, 0) AS win_rate_pct,
           coalesce(nullif(pv0, 0), pv, 0) AS portfolio_value, step, coalesce(train_loss, 0) AS train_loss, coalesce(train_reward, 0) AS train_reward,
           coalesce(fin_unrealized_pnl, 0) AS unrealized_pnl, fin_total_return_pct AS total_return_pct, fin_drawdown_pct AS drawdown_pct,
           coalesce(pnl, 0) AS train_realized_pnl, coalesce(upnl, 0) AS train_unrealized_pnl, coalesce(pv, 0) AS train_portfolio_value
    FROM j""", "realized_pnl win_rate_pct portfolio_value train_loss train_reward unrealized_pnl total_return_pct drawdown_pct "
       "train_realized_pnl train_unrealized_pnl train_portfolio_value")
def _(spark, d):
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    docs = t.table(spark, d, "customer").select(
        F.concat(F.lit("run-"), k.cast("string")).alias("run"),
        F.when(k % 2 == 0, k % 9).alias("sum_trades"), F.when(k % 3 == 0, b / 10).alias("sum_realized_pnl"),
        F.when(k % 5 == 0, 41.5).alias("sum_win_rate_pct"), F.when(k % 4 == 0, 100.0).when(k % 4 == 1, b).alias("sum_portfolio_value"),
        (k % 11).alias("fin_trades"), F.when(k % 7 == 0, b / 20).otherwise(0.0).alias("fin_realized_pnl"),
        F.when(k % 13 == 0, 12.5).otherwise(0.0).alias("fin_win_rate_pct"),
        F.when(k % 6 == 0, 100.0).when(k % 6 == 2, b / 2).otherwise(0.0).alias("fin_portfolio_value"),
        (k * 3).alias("step"), F.when(k % 3 != 1, b / 7).alias("train_loss"), F.when(k % 5 != 1, b / 9).alias("train_reward"),
        F.when(k % 4 != 1, b / 30).alias("fin_unrealized_pnl"), (b / 50).alias("fin_total_return_pct"), (b / 70).alias("fin_drawdown_pct"),
    )
    name = (
        F.when(F.col("key") == "click", "realized_pnl").when(F.col("key") == "view", "win_rate")
        .when(F.col("key") == "signup", "trades").when(F.col("key") == "error", "unrealized_pnl").otherwise("portfolio_value")
    )
    return te.resolve_kpis(docs, t.telemetry(spark, d).withColumn("key", name))


@query("progress", """
    SELECT o_orderkey AS run, least(100, o_orderkey % 3000 / greatest(1, o_custkey % 900)::DOUBLE * 100) AS progress_pct,
           o_orderkey % 700 // greatest(1, o_custkey % 6) AS epoch FROM orders""", "progress_pct")
def _(spark, d):
    rows = t.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("run"), (F.col("o_orderkey") % 3000).alias("step"), (F.col("o_custkey") % 900).alias("total_steps"),
        (F.col("o_orderkey") % 700).alias("n_updates"), (F.col("o_custkey") % 6).alias("n_epochs"),
    )
    return te.progress(rows).select("run", "progress_pct", "epoch")


@query("safe_float", """
    SELECT p_partkey, coalesce(TRY_CAST(CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_retailprice::VARCHAR WHEN 2 THEN concat(' ', p_size, '.5 ') END AS DOUBLE), -1) AS v
    FROM part""", "v")
def _(spark, d):
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.col("p_name")).when(k == 1, F.col("p_retailprice").cast("string")).when(
        k == 2, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(".5 "))
    )
    return t.table(spark, d, "part").select("p_partkey", safe_float(raw, -1.0).alias("v"))


@query("sampled_updates", "SELECT run, key, pos, pos % 1000 = 0 AS refresh_index FROM telemetry WHERE pos % 100 = 0")
def _(spark, d):
    rows = t.telemetry(spark, d).withColumn("step", F.col("pos"))
    return te.sampled_updates(rows, 100).select("run", "key", "pos", "refresh_index")


# ---------------------------------------------------------------- documents


@query("json_sanitize", """
    SELECT symbol, seq, CASE WHEN volume = 0 OR volume < 50 THEN NULL ELSE close END AS a, CASE WHEN volume = 0 THEN NULL ELSE close END AS b,
           CASE WHEN volume < 50 THEN NULL ELSE volume END AS c FROM ticks""", "a b c")
def _(spark, d):
    v = F.col("volume")
    bad = F.when(v == 0, F.lit(float("inf"))).when(v < 50, F.lit(float("nan"))).otherwise(F.col("close"))
    rows = t.ticks(spark, d).select(
        "symbol", "seq", bad.alias("a"),
        F.struct(F.array(F.when(v == 0, F.lit(float("-inf"))).otherwise(F.col("close"))).alias("x")).alias("nested"),
        F.create_map(F.lit("k"), F.when(v < 50, F.lit(float("nan"))).otherwise(v)).alias("m"),
    )
    clean = do.json_clean(rows)
    return clean.select("symbol", "seq", "a", F.col("nested")["x"][0].alias("b"), F.col("m")["k"].alias("c"))


def documents(spark, d):
    """Run documents as written: identity, latest figures and series."""
    rows = states(spark, d)
    last = te.latest_value(t.telemetry(spark, d)).where("key = 'click'").select("run", F.col("value").alias("v"))
    rows = rows.join(last, "run", "left")
    return rows.select(
        F.lit("2024-01-31 00:00:00 UTC").alias("ts"),
        F.struct(F.col("run").alias("run_id"), F.lit("train").alias("mode"), F.lit(100).cast("bigint").alias("total_timesteps")).alias("run"),
        F.struct(F.col("v").alias("portfolio_value"), F.lit(float("nan")).alias("drawdown_pct")).alias("finance"),
        "series",
    )


DOC_SQL = """
    SELECT run, count(*) AS points, sum(value) AS total, max(step) AS last_step, any_value(pv) AS portfolio_value, 0::BIGINT AS missing
    FROM (SELECT run, step, value FROM telemetry WHERE value IS NOT NULL) LEFT JOIN (
      SELECT run AS r, arg_max(value, pos) AS pv FROM telemetry WHERE value IS NOT NULL AND key = 'click' GROUP BY run) ON run = r
    GROUP BY run"""


def doc_summary(read):
    points = te.explode_series(read.select(F.col("run.run_id").alias("run"), "series"))
    sums = points.groupBy("run").agg(F.count(F.lit(1)).alias("points"), F.sum("value").alias("total"), F.max("step").alias("last_step"))
    heads = read.select(
        F.col("run.run_id").alias("run"), "finance.portfolio_value",
        F.when(F.col("finance.drawdown_pct").isNotNull(), 1).otherwise(0).cast("bigint").alias("missing"),
    )
    return sums.join(heads.distinct(), "run")


@query("read_run_state", DOC_SQL, "total portfolio_value")
def _(spark, d):
    root = scratch(spark, "states")
    do.write_run_state(documents(spark, d), root)
    return doc_summary(do.read_run_state(spark, root, multi_line=False))


@query("write_run_state", DOC_SQL, "total portfolio_value")
def _(spark, d):
    """Documents beside a torn one and one without series: both leave the others readable."""
    root = scratch(spark, "states")
    do.write_run_state(documents(spark, d), f"{root}/good")
    spark.range(1).select(F.lit('{"ts": "2024", "run": {"run_id"').alias("value")).write.text(f"{root}/torn")
    return doc_summary(do.read_run_state(spark, f"{root}/*", multi_line=False))


def results(spark, d):
    rows = t.scored(spark, d)
    metrics = F.struct(*[F.col(m) for m in ex.METRICS])
    return rows.select("run", "phase", "config", "seed", F.col("return_code").cast("bigint").alias("return_code"), metrics.alias("metrics"), "trade_band_ok", "score")


RESULT_SQL = """SELECT phase, config, seed, CAST(return_code AS BIGINT) AS return_code, trade_band_ok, score, val_trades, val_win_rate_pct, val_return_pct, test_trades,
    test_win_rate_pct, test_return_pct FROM scored"""


@query("read_results", RESULT_SQL, "score " + " ".join(ex.METRICS))
def _(spark, d):
    """Documents of at most 1000 runs each, with a ``results`` array."""
    root = scratch(spark, "results")
    docs = results(spark, d).withColumn("doc", F.floor(F.col("run") / 1000)).drop("run")
    docs.groupBy("doc").agg(F.collect_list(F.struct(*[c for c in docs.columns if c != "doc"])).alias("results")).write.json(root)
    rows = do.read_results(spark, root, multi_line=False)
    return rows.select("phase", "config", "seed", "return_code", "trade_band_ok", "score", *ex.METRICS)


@query("write_results", RESULT_SQL, "score " + " ".join(ex.METRICS))
def _(spark, d):
    root = scratch(spark, "results")
    rows = results(spark, d).drop("run")
    do.write_results(rows, root)
    read = spark.read.schema(T.StructType([*rows.schema.fields])).json(root)
    return read.select("phase", "config", "seed", "return_code", "trade_band_ok", "score", "metrics.*")
