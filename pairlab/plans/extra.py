"""Further registered queries: windows of varying length, sensitivity variants and small report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.checkpoints import materialized
from pairlab.fixtures import F2_SQL
from pairlab.operators import backtest, calendars, grid, intraday, reports, screen, signals, two_regime
from pairlab.plans import intraday as bars
from pairlab.plans.daily import f2, metrics_sql, num, query, rounded
from pairlab.plans.intraday import BANDS, KEYS, PS_B, SB_SQL, TR_B, W_SQL, spread_bars


@query(f"""WITH {F2_SQL}, d AS (SELECT DISTINCT date FROM f2), r AS (SELECT date FROM d ORDER BY date DESC LIMIT 504) SELECT min(date) AS start, max(date) AS end FROM r""")
def last_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.last_days(f2(spark, sf_dir))


@query(f"""WITH {F2_SQL}, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM f2)),
f AS (SELECT ((s - 100) // 20)::INT AS fold_id, s FROM (SELECT unnest(range(100, (SELECT count(*) FROM d) - 20 + 1, 20)) AS s))
SELECT fold_id, g.date AS test_start, h.date AS test_end FROM f JOIN d g ON g.i = s JOIN d h ON h.i = s + 19 WHERE h.date >= DATE '1995-07-01' AND g.date <= DATE '1995-12-31'""")
def overlapping_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = calendars.build_folds(f2(spark, sf_dir), prior=50, train=50, test=20)
    return calendars.overlapping_folds(folds, "1995-07-01", "1995-12-31").select("fold_id", "test_start", "test_end")


VZ_SQL = SB_SQL + """, pw AS (SELECT y_sym, x_sym, 5 + (row_number() OVER (ORDER BY y_sym, x_sym))::INT AS w FROM (SELECT DISTINCT y_sym, x_sym FROM sb)),
ls AS MATERIALIZED (SELECT y_sym, x_sym, list(spread ORDER BY t) AS s FROM sb GROUP BY 1, 2),
fr AS (SELECT sb.y_sym, sb.x_sym, sb.session, sb.bar, sb.spread, list_slice(ls.s, sb.t + 2 - w, sb.t + 1) AS f, w, sb.t FROM sb JOIN pw USING (y_sym, x_sym) JOIN ls USING (y_sym, x_sym))"""


@query("WITH " + VZ_SQL + """SELECT y_sym, x_sym, session, bar, CASE WHEN t + 1 >= w AND len(list_filter(f, lambda v: v IS NULL)) = 0 AND list_stddev_samp(f) > 0 THEN round((spread - list_avg(f)) / list_stddev_samp(f), 4) END AS z FROM fr""")
def variable_window_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread_bars(spark, sf_dir)
    order = F.dense_rank().over(signals.Window.partitionBy(F.lit(1)).orderBy(*KEYS))  # a row for each pair of five symbols
    windows = rows.select(*KEYS).distinct().withColumn("w", (5 + order).cast("int"))
    scored = signals.variable_rolling_z(rows.join(windows, KEYS), KEYS, "t", "w")
    return scored.select(*KEYS, "session", "bar", num("z", 4).alias("z"))


def _entries_sql(w: int) -> str:
    frame = W_SQL.replace("11 PRECEDING", f"{w - 1} PRECEDING")
    full = f"count(*) OVER w >= {w} AND count(spread) OVER w = count(*) OVER w"
    return f"""SELECT {w} AS window_bars, y_sym, x_sym, count(z) AS n_z, count_if(abs(z) > 1.5)::BIGINT AS n_beyond, round(avg(abs(z)), 5) AS mean_abs_z
  FROM (SELECT y_sym, x_sym, CASE WHEN {full} AND stddev_samp(spread) OVER w > 0 THEN (spread - avg(spread) OVER w) / stddev_samp(spread) OVER w END AS z FROM sb WINDOW w AS ({frame})) GROUP BY y_sym, x_sym"""


@query("WITH " + SB_SQL + " UNION ALL ".join(_entries_sql(w) for w in (12, 36, 60)))
def window_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of one, three and five sessions side by side."""
    rows = materialized(spread_bars(spark, sf_dir))
    out = None
    for w in (12, 36, 60):
        z = F.when(~F.isnan("z"), F.abs("z"))
        part = signals.rolling_z(rows, KEYS, "t", window=w).groupBy(*KEYS).agg(F.count(z).alias("n_z"), F.count_if(z > 1.5).alias("n_beyond"), F.avg(z).alias("mean_abs_z"))
        part = part.withColumn("window_bars", F.lit(w))
        out = part if out is None else out.unionByName(part)
    return rounded(out, 5)


@query(TR_B + """, n AS (SELECT y_sym, x_sym, ((t.entry_t // 12) // 10)::INT AS fold, count(*) AS n FROM tr t GROUP BY 1, 2, 3) SELECT y_sym || '~' || x_sym AS pair, arg_max(fold, (n, -fold)) AS fold FROM n GROUP BY 1""")
def representative_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = bars._closed(materialized(bars.rolling_run(spark, sf_dir, "B"))).select(F.concat_ws("~", *KEYS).alias("pair"), F.floor(F.floor(F.col("entry_t") / 12) / 10).cast("int").alias("fold"))
    return reports.representative(closed, "pair", "fold")


@query(TR_B + """SELECT y_sym, x_sym, entry_t::INT AS entry_t, CASE exit_reason WHEN 'mean_revert' THEN 'mean_revert' WHEN 'stop' THEN 'z_stop' WHEN 'time' THEN 'time_stop' WHEN 'session_close' THEN 'eod_squareoff' WHEN 'fold_boundary' THEN 'fold_close' ELSE '__OTHER__' END AS exit_name FROM tr""")
def trade_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = bars._closed(materialized(bars.rolling_run(spark, sf_dir, "B")))
    return closed.select(*KEYS, "entry_t", grid.exit_name().alias("exit_name"))


@query(PS_B + """, v AS (SELECT 'all' AS variant, session, net FROM ps UNION ALL SELECT 'ex_listed', session, net FROM ps WHERE y_sym <> 'click')
SELECT variant, session, round(avg(net), 6) AS net FROM v GROUP BY 1, 2""")
def portfolio_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = bars._sessions(materialized(bars.rolling_run(spark, sf_dir, "B")))
    both = reports.excluding(sums, sums.filter("y_sym = 'click'"), KEYS)
    return rounded(both.groupBy("variant", "session").agg(F.avg("net").alias("net")))


@query(PS_B + """, ax AS (SELECT DISTINCT session FROM ps), act AS (SELECT y_sym, x_sym, session, net FROM ps WHERE active), sp2 AS (SELECT y_sym, x_sym, ax.session FROM (SELECT DISTINCT y_sym, x_sym FROM act), ax)
SELECT y_sym, x_sym, session, round(coalesce(last_value(net IGNORE NULLS) OVER (PARTITION BY y_sym, x_sym ORDER BY session ROWS UNBOUNDED PRECEDING), 0), 6) AS net FROM sp2 LEFT JOIN act USING (y_sym, x_sym, session)""")
def forward_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = materialized(bars._sessions(materialized(bars.rolling_run(spark, sf_dir, "B"))))
    return rounded(reports.forward_filled(sums.filter("active").select(*KEYS, "session", "net"), sums, KEYS, "session", "net"))


@query("WITH " + SB_SQL + """, nb AS (SELECT y_sym, x_sym, session, spread AS y, lag(spread) OVER (PARTITION BY y_sym, x_sym, session ORDER BY t) AS x FROM sb),
ph AS (SELECT y_sym, x_sym, session, regr_slope(y, x) AS phi FROM nb WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 8),
h AS (SELECT y_sym, x_sym, session, round(ln(2::DOUBLE) / -ln(phi) / 12, 6) AS hl FROM ph WHERE phi > 0 AND phi < 1), w AS (SELECT *, least(greatest(round_even(hl * 375, 0)::INT, 375), 1875) AS m FROM h)
SELECT y_sym, x_sym, session, round(hl, 4) AS hl, m AS window_minutes, greatest(round_even(greatest(m, least(22500, round_even(hl * 1125, 0)::INT)) / 5.0::DOUBLE, 0)::INT, 1) AS bars_5 FROM w""")
def holding_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows and holding limits of the half-lives that each pair has in each session."""
    own = [*KEYS, "session"]
    fits = intraday.fit_ou(spread_bars(spark, sf_dir), own, "t", least=8).filter("fit_ok")
    h = fits.select(*own, F.round(F.col("half_life_bars") / 12, 6).alias("hl"))
    return h.select(*own, num("hl", 4).alias("hl"), intraday.window_minutes(F.col("hl")).alias("window_minutes"), intraday.max_holding_bars(F.col("hl"), 5).alias("bars_5"))


@query("WITH " + SB_SQL + f""", f AS (SELECT unnest([1, 5, 15])::INT AS freq_min), r AS (SELECT unnest(['A', 'B']) AS regime),
c AS (SELECT freq_min, regime, c AS spread_bps, 'none' AS stop_mode FROM f, r, (SELECT unnest([1.0, 3.0, 5.0, 8.0])::DOUBLE AS c) UNION ALL SELECT freq_min, regime, 3.0::DOUBLE, 'hard' FROM f, r)
SELECT y_sym, x_sym, freq_min, regime, spread_bps, stop_mode, round((1 + beta) * (spread_bps + {bars.DEFAULTS.fixed_cost_bps}) / 1e4, 8) AS cost_log FROM fit, c WHERE beta >= 0""")
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid's cells for each pair, with what a round trip costs there."""
    betas = spread_bars(spark, sf_dir).select(*KEYS, "beta").distinct().filter("beta >= 0")
    each = betas.crossJoin(F.broadcast(grid.cells(spark)))  # thirty cells
    cost = backtest.pair_cost(F.col("beta"), backtest.leg_bps(F.col("spread_bps")))
    return each.select(*KEYS, "freq_min", "regime", "spread_bps", "stop_mode", num(cost, 8).alias("cost_log"))


@query(bars.EXCLUDED_SQL + """, st AS (SELECT cell_id, unnest([0, 1, 2, 3, 4]) AS stage_no, unnest(['n_total', 'n_excluded_no_reversion', 'n_excluded_hl_band', 'n_excluded_infeasible', 'n_survivors']) AS stage,
  unnest([n_total, n_excluded_no_reversion, n_excluded_hl_band, n_excluded_infeasible, n_survivors]) AS n FROM ec) SELECT * FROM st""")
def stage_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialized(spread_bars(spark, sf_dir))
    counts = grid.exclusion_counts(bars._plans(spark, sf_dir, rows)[1], ["cell_id"])
    return reports.stage_funnel(counts, ["cell_id"], ["n_total", "n_excluded_no_reversion", "n_excluded_hl_band", "n_excluded_infeasible", "n_survivors"])


def _regime_sql(regime: str) -> str:
    """Metrics of one regime in DuckDB: windows of 24 bars, the first bar of a session without z, tests from session 10 on, 72 bars at most."""
    a = regime == "A"
    z = bars.z_sql("PARTITION BY y_sym, x_sym ORDER BY t ROWS 23 PRECEDING", 10, 24)
    scored = SB_SQL + f""", zb AS MATERIALIZED (
  SELECT * REPLACE (CASE WHEN place > 1 THEN z END AS z) FROM (SELECT *, {z} AS z, row_number() OVER (PARTITION BY y_sym, x_sym, session ORDER BY t) AS place FROM sb) WHERE session_no >= 10 AND beta >= 0
)"""
    machine = bars.machine_sql("zb", bars.A_GROUP if a else bars.B_GROUP, "1.5", bars.ROLL_EXITS.replace("h >= 20", "h >= 72"), 1, "h + 1", True).replace("greatest(h, since)", "h")
    run = scored + machine + (bars.CLOSE_A if a else bars.CLOSE_B) + bars.trade_sql(not a, a) + bars.RS_SQL.removeprefix(TR_B)
    port = run + f", pt AS (SELECT '{regime}' AS regime, spread_bps, session, avg(net) AS net FROM rs GROUP BY 2, 3) "
    return "SELECT * FROM (WITH RECURSIVE " + port + metrics_sql("pt", "regime, spread_bps", "session", "net", 6) + ")"


@query(_regime_sql("A") + " UNION ALL " + _regime_sql("B"))
def two_regime_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialized(spread_bars(spark, sf_dir).withColumn("in_test", F.col("session_no") >= 10))
    folds = rows.select(*KEYS, "beta").distinct().filter("beta >= 0").drop("beta").join(rows.select(*KEYS, "beta").distinct(), KEYS).withColumn("half_life", F.lit(2.0))
    sized = two_regime.bar_windows(folds, bars=12, freq=1)
    run = two_regime.run(rows.drop("beta"), sized, KEYS, "t", "session", ladder=backtest.cost_ladder(spark), warmup=1, entry=1.5)
    return rounded(run["metrics"])


def _cell_sql(regime: str, hard: bool) -> str:
    """Cells of one regime and stop in DuckDB, with thresholds of 1.2 deviations, 20 bars at most and a stop at 1.8."""
    a = regime == "A"
    kept = bars.ZOU_SQL + ", zk AS MATERIALIZED (SELECT * FROM zo WHERE beta >= 0)"
    machine = bars.machine_sql("zk", bars.A_GROUP if a else bars.B_GROUP, "1.2", bars.OU_HARD if hard else bars.OU_EXITS, 0, "since + 1", False)
    run = kept + machine + (bars.OU_CLOSE_A if a else bars.CLOSE_B) + bars.trade_sql(not a, a) + bars.RS_SQL.removeprefix(TR_B)
    port = ", pt AS MATERIALIZED (SELECT spread_bps, session, avg(gross) AS gross, avg(net) AS net FROM rs GROUP BY 1, 2)"
    gross, net = (f"({metrics_sql('pt', 'spread_bps', 'session', v, 6)})" for v in ("gross", "net"))
    exits = ", ".join(f"count_if(exit_reason = '{k}')::BIGINT AS exit_{v}" for k, v in (("mean_revert", "mean_revert"), ("z_stop", "z_stop"), ("time_stop", "time_stop"), ("session_close", "eod_squareoff"), ("fold_boundary", "fold_close")))
    counts = f"(SELECT count(*) AS n_trades, {exits}, (SELECT count(*) FROM (SELECT DISTINCT y_sym, x_sym FROM rs)) AS n_pairs FROM tr)"
    return f"""SELECT * FROM (WITH RECURSIVE {run}{port} SELECT '{regime}' AS regime, g.spread_bps, '{'hard' if hard else 'none'}' AS stop_mode, c.*, g.n AS n_sessions,
      g.total_pct AS gross_total_pct, n.total_pct AS net_total_pct, n.sharpe AS net_sharpe, n.max_drawdown_pct AS net_max_drawdown_pct
    FROM {gross} g JOIN {net} n ON g.spread_bps = n.spread_bps, {counts} c{' WHERE g.spread_bps = 3' if hard else ''})"""


@query(" UNION ALL ".join(_cell_sql(r, h) for h in (False, True) for r in ("A", "B")))
def grid_fixed_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid's cells with given thresholds in place of solved ones."""
    rows = materialized(bars.ou_bars(spark, sf_dir).filter("beta >= 0"))
    cells = grid.cells(spark, freqs=(1,))
    plans = rows.select(*KEYS, "beta").distinct().crossJoin(F.broadcast(cells))  # ten cells
    cost = backtest.pair_cost(F.col("beta"), backtest.leg_bps(F.col("spread_bps")))
    plans = plans.select(*KEYS, "cell_id", "regime", "stop_mode", F.lit(1.2).alias("a_z"), F.lit(20).alias("max_holding"), cost.alias("cost_log"), F.lit(None).cast("string").alias("exclusion_reason"))
    trades, sessions = grid.run_cells(rows, plans, KEYS, "t", "session", hard_stop=1.8)
    table = grid.cell_metrics(cells, trades, sessions.withColumn("pair", F.concat_ws("~", *KEYS)), grid.exclusion_counts(plans, ["cell_id"]), "session")
    exits = [f"exit_{e}" for e in grid.EXIT_ORDER[:-1]]
    return rounded(table.select("regime", "spread_bps", "stop_mode", "n_trades", *exits, "n_pairs", "n_sessions", "gross_total_pct", "net_total_pct", "net_sharpe", "net_max_drawdown_pct"))


@query(bars.ROLL_B + bars.SIG_OUT)
def signals_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overnight machine with each session in a task of its own."""
    return bars._states(signals.rolling_signals_in_parts(bars.z_bars(spark, sf_dir), KEYS, "t", "session", entry=1.5, max_holding=20))
