"""Registered queries on intraday bars, costs, thresholds and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlab import fixtures
from pairlab.checkpoints import materialized
from pairlab.operators import backtest, calendars, cycles, grid, intraday, reports, signals
from pairlab.params import DEFAULTS
from pairlab.plans.daily import metrics_sql, num, query, rounded

KEYS = ["y_sym", "x_sym"]
#: Bars of two hours: twelve a session; windows and bands below are in bars.
BAR, PER_SESSION, WINDOW = 120, 12, 12
BANDS = {"A": (2.0, 6.0), "B": (4.0, 30.0)}


def bars(spark: SparkSession, sf_dir: str, minutes: int = BAR) -> DataFrame:
    return fixtures.intraday_panel(spark, sf_dir, bar_minutes=minutes)


def all_pairs(panel: DataFrame) -> DataFrame:
    """Unordered pairs of the panel's few symbols; they form one sector."""
    s = panel.select("symbol").distinct().withColumn("sector", F.lit("S0"))
    a, b = (s.select("sector", F.col("symbol").alias(n)) for n in KEYS)
    return a.join(b, "sector").filter("y_sym < x_sym").select(*KEYS)


def aligned(spark: SparkSession, sf_dir: str, minutes: int = BAR) -> DataFrame:
    panel = bars(spark, sf_dir, minutes)
    return intraday.align_pairs(panel, all_pairs(panel), ["session", "bar"])


def spread_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair keys, session, session_no, bar, t, tradeable, beta, spread), NaN where a leg lacks."""
    rows = aligned(spark, sf_dir)
    both = rows.filter("tradeable").select(*KEYS, F.ln("close_y").alias("ly"), F.ln("close_x").alias("lx"))
    fit = both.groupBy(*KEYS).agg(F.covar_pop("lx", "ly").alias("c"), F.var_pop("lx").alias("v"), F.avg("ly").alias("my"), F.avg("lx").alias("mx"))
    fit = fit.withColumn("beta", F.round(F.try_divide("c", "v"), 10)).withColumn("alpha", F.round(F.col("my") - F.try_divide("c", "v") * F.col("mx"), 10)).select(*KEYS, "alpha", "beta")
    value = F.when(F.col("tradeable"), F.round(F.ln("close_y") - F.col("beta") * F.ln("close_x") - F.col("alpha"), 10)).otherwise(F.lit(float("nan")))
    t = F.row_number().over(Window.partitionBy(*KEYS).orderBy("session", "bar")) - 1
    return rows.join(fit, KEYS).select(*KEYS, "session", intraday.session_number(KEYS, "session").alias("session_no"), "bar", t.alias("t"), "tradeable", "beta", value.alias("spread"))


F3 = fixtures.f3_sql(BAR)
AL_SQL = F3 + """, pr AS (SELECT a.symbol AS y_sym, b.symbol AS x_sym FROM (SELECT DISTINCT symbol FROM f3) a JOIN (SELECT DISTINCT symbol FROM f3) b ON a.symbol < b.symbol),
ly AS (SELECT y_sym, x_sym, session, bar, close, volume FROM pr JOIN f3 ON symbol = y_sym), lx AS (SELECT y_sym, x_sym, session, bar, close, volume FROM pr JOIN f3 ON symbol = x_sym),
al AS (
  SELECT coalesce(ly.y_sym, lx.y_sym) AS y_sym, coalesce(ly.x_sym, lx.x_sym) AS x_sym, coalesce(ly.session, lx.session) AS session, coalesce(ly.bar, lx.bar) AS bar,
    ly.close AS close_y, lx.close AS close_x, coalesce(ly.volume, 0) AS volume_y, coalesce(lx.volume, 0) AS volume_x, ly.close IS NOT NULL AND lx.close IS NOT NULL AS tradeable
  FROM ly FULL JOIN lx ON ly.y_sym = lx.y_sym AND ly.x_sym = lx.x_sym AND ly.session = lx.session AND ly.bar = lx.bar
)"""
SB_SQL = AL_SQL + """, fit AS (
  SELECT y_sym, x_sym, round(regr_slope(ln(close_y), ln(close_x)), 10) AS beta, round(regr_intercept(ln(close_y), ln(close_x)), 10) AS alpha FROM al WHERE tradeable GROUP BY 1, 2
), sb AS MATERIALIZED (
  SELECT al.y_sym, al.x_sym, session, dense_rank() OVER (PARTITION BY al.y_sym, al.x_sym ORDER BY session) - 1 AS session_no, bar,
    row_number() OVER (PARTITION BY al.y_sym, al.x_sym ORDER BY session, bar) - 1 AS t, tradeable, beta,
    CASE WHEN tradeable THEN round(ln(close_y) - beta * ln(close_x) - alpha, 10) END AS spread FROM al JOIN fit ON al.y_sym = fit.y_sym AND al.x_sym = fit.x_sym
)"""
W_SQL = "PARTITION BY y_sym, x_sym ORDER BY t ROWS 11 PRECEDING"


def z_sql(window: str = W_SQL, digits: int = 8, least: int = 12) -> str:
    """z as in the engine: none unless the whole window has a spread."""
    return f"CASE WHEN count(*) OVER ({window}) >= {least} AND count(spread) OVER ({window}) = count(*) OVER ({window}) AND stddev_samp(spread) OVER ({window}) > 0 THEN round((spread - avg(spread) OVER ({window})) / stddev_samp(spread) OVER ({window}), {digits}) END"


@query("""WITH b AS (SELECT event_type AS symbol, ts::DATE AS date, ts FROM events) SELECT symbol, date, count(*) AS n, count(*) < 60 AS partial_day_flag FROM b GROUP BY 1, 2""")
def partial_day_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("symbol"), F.to_date("ts").alias("date"))
    flagged = intraday.partial_day_flag(ticks, full=60)
    return flagged.groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("n"), F.bool_or("partial_day_flag").alias("partial_day_flag"))


@query("SELECT event_id, ((hour(ts) - 9) * 60 + minute(ts) - 15)::INT AS bar FROM events")
def bar_of_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", calendars.bar_of_session(F.col("ts")).alias("bar"))


@query("SELECT TIMESTAMP '2020-01-02 09:15:00' + to_minutes(i) AS ts, i::INT AS bar FROM range(375) t(i)")
def session_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendars.session_grid(spark, "2020-01-02")


@query("WITH " + AL_SQL + "SELECT y_sym, x_sym, session, bar, round(close_y, 6) AS close_y, round(close_x, 6) AS close_x, volume_y::BIGINT AS volume_y, volume_x::BIGINT AS volume_x, tradeable FROM al")
def align_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aligned(spark, sf_dir))


def _resample_sql(freq: int) -> str:
    return "WITH " + AL_SQL + f""", g AS (
  SELECT y_sym, x_sym, session, (bar // {freq})::INT AS bar, arg_max(close_y, al.bar) FILTER (close_y IS NOT NULL) AS close_y, arg_max(close_x, al.bar) FILTER (close_x IS NOT NULL) AS close_x,
    sum(volume_y)::BIGINT AS volume_y, sum(volume_x)::BIGINT AS volume_x, bool_or(tradeable) AS a FROM al GROUP BY y_sym, x_sym, session, al.bar // {freq}
) SELECT y_sym, x_sym, session, bar, round(close_y, 6) AS close_y, round(close_x, 6) AS close_x, volume_y, volume_x, a AND close_y IS NOT NULL AND close_x IS NOT NULL AS tradeable FROM g"""


def _resampled(spark: SparkSession, sf_dir: str, freq: int) -> DataFrame:
    return rounded(intraday.resample(aligned(spark, sf_dir), KEYS, "session", "bar", freq))


@query(_resample_sql(2))
def resample_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resampled(spark, sf_dir, 2)


@query(_resample_sql(4))
def resample_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resampled(spark, sf_dir, 4)


@query("WITH " + SB_SQL + f"SELECT y_sym, x_sym, session, bar, {z_sql('PARTITION BY y_sym, x_sym, session ORDER BY t ROWS 5 PRECEDING', 5, 6)} AS z FROM sb")
def sessionized_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = signals.session_z(spread_bars(spark, sf_dir), KEYS, "session", "t", window=6)
    return scored.select(*KEYS, "session", "bar", num("z", 5).alias("z"))


@query("WITH " + SB_SQL + f""", z AS (SELECT *, {z_sql(digits=5)} AS z, row_number() OVER (PARTITION BY y_sym, x_sym, session ORDER BY t) AS place FROM sb)
SELECT y_sym, x_sym, session, bar, CASE WHEN place > 2 THEN z END AS z FROM z""")
def intraday_z_warmup(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = signals.warmed_z(spread_bars(spark, sf_dir), KEYS, "session", "t", window=WINDOW, warmup=2)
    return scored.select(*KEYS, "session", "bar", num("z", 5).alias("z"))


TOD_SQL = SB_SQL + f""", inn AS MATERIALIZED (
  SELECT *, CASE WHEN count(*) OVER w >= 12 AND count(spread) OVER w = count(*) OVER w THEN spread - avg(spread) OVER w END AS i,
    CASE WHEN count(*) OVER w >= 12 AND count(spread) OVER w = count(*) OVER w THEN stddev_samp(spread) OVER w END AS sd FROM sb WINDOW w AS ({W_SQL})
), sg AS (SELECT y_sym, x_sym, bar, stddev_samp(i) AS sigma FROM inn WHERE i IS NOT NULL GROUP BY 1, 2, 3),
spine AS (SELECT y_sym, x_sym, b::INT AS bar FROM (SELECT DISTINCT y_sym, x_sym FROM sb), range(12) t(b)),
tod AS (SELECT y_sym, x_sym, bar, avg(sigma) OVER (PARTITION BY y_sym, x_sym ORDER BY bar ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS sigma_tod FROM spine LEFT JOIN sg USING (y_sym, x_sym, bar))"""


@query("WITH " + TOD_SQL + "SELECT y_sym, x_sym, bar, round(sigma_tod, 6) AS sigma_tod FROM tod")
def tod_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals.tod_profile(spread_bars(spark, sf_dir), KEYS, "bar", "t", window=WINDOW, bars=PER_SESSION))


@query("WITH " + TOD_SQL + """SELECT y_sym, x_sym, session, bar, CASE WHEN i IS NOT NULL AND (sigma_tod > 1e-12 OR sd > 1e-12) THEN round(i / CASE WHEN sigma_tod > 1e-12 THEN sigma_tod ELSE sd END, 5) END AS z_tod
FROM inn LEFT JOIN tod USING (y_sym, x_sym, bar)""")
def tod_adjusted_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread_bars(spark, sf_dir)
    profile = signals.tod_profile(rows, KEYS, "bar", "t", window=WINDOW, bars=PER_SESSION)
    scored = signals.tod_adjusted_z(rows, profile, KEYS, "bar", "t", window=WINDOW)
    return scored.select(*KEYS, "session", "bar", num("z_tod", 5).alias("z_tod"))


def z_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = signals.warmed_z(spread_bars(spark, sf_dir), KEYS, "session", "t", window=WINDOW, warmup=1)
    return scored.withColumn("z", F.round("z", 8))


ZB_SQL = SB_SQL + f""", zb AS MATERIALIZED (
  SELECT * REPLACE (CASE WHEN place > 1 THEN z END AS z) FROM (SELECT *, {z_sql()} AS z, row_number() OVER (PARTITION BY y_sym, x_sym, session ORDER BY t) AS place FROM sb)
)"""


def machine_sql(source: str, group: str, entry: str, exits: str, held_entry: int, held_next: str, strict: bool) -> str:
    """A position machine over ``source(y_sym, x_sym, session, t, z, ...)`` as a recursion over places in each group."""
    op = ">" if strict else ">="
    return f""", mk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY t) AS k FROM {source}),
ml AS MATERIALIZED (SELECT {group}, any_value({entry}) AS a, list(z ORDER BY k) AS zs FROM mk GROUP BY {group}),
st AS (
  SELECT {group}, 0::BIGINT AS k, 0 AS position, 0 AS held, 0 AS since, NULL::VARCHAR AS why FROM ml
  UNION ALL
  SELECT {group}, k, CASE WHEN z IS NULL THEN p WHEN p = 0 THEN CASE WHEN z {op} a THEN -1 WHEN z {op[0].replace('>', '<')}{op[1:]} -a THEN 1 ELSE 0 END WHEN why IS NULL THEN p ELSE 0 END,
    CASE WHEN z IS NULL THEN greatest(h, since) WHEN p = 0 THEN CASE WHEN abs(z) {op} a THEN {held_entry} ELSE 0 END WHEN why IS NULL THEN {held_next} ELSE 0 END,
    CASE WHEN z IS NULL THEN since WHEN p = 0 THEN CASE WHEN abs(z) {op} a THEN 1 ELSE 0 END WHEN why IS NULL THEN since + 1 ELSE 0 END, why
  FROM (SELECT *, CASE WHEN z IS NULL OR p = 0 THEN NULL {exits} END AS why
    FROM (SELECT {', '.join('st.' + g.strip() for g in group.split(','))}, st.k + 1 AS k, ml.zs[st.k + 1] AS z, ml.a, st.position AS p, st.held AS h, st.since FROM st JOIN ml USING ({group}) WHERE st.k < len(ml.zs)))
), raw AS MATERIALIZED (SELECT mk.*, st.position, st.held, st.why AS exit_reason FROM mk JOIN st USING ({group}, k))"""


ROLL_EXITS = "WHEN z * p <= -3.5 THEN 'stop' WHEN z * p >= -0.5 THEN 'mean_revert' WHEN h >= 20 THEN 'time'"
CLOSE_A = """, lt AS (SELECT y_sym, x_sym, session, max(t) FILTER (tradeable) AS last_t FROM raw GROUP BY 1, 2, 3),
cl AS MATERIALIZED (
  SELECT raw.* REPLACE (CASE WHEN t = last_t THEN 0 ELSE position END AS position, CASE WHEN t = last_t AND position <> 0 THEN 0 ELSE held END AS held,
    CASE WHEN t = last_t AND position <> 0 THEN coalesce(exit_reason, 'session_close') ELSE exit_reason END AS exit_reason) FROM raw JOIN lt USING (y_sym, x_sym, session)
)"""
CLOSE_B = ", cl AS (SELECT * FROM raw)"
OU_CLOSE_A = """, lt AS (SELECT y_sym, x_sym, session, max(t) FILTER (tradeable) AS last_t, arg_max(position, t) AS end_p FROM raw GROUP BY 1, 2, 3),
cl AS MATERIALIZED (
  SELECT raw.* REPLACE (CASE WHEN end_p <> 0 AND t >= last_t THEN 0 ELSE position END AS position, CASE WHEN end_p <> 0 AND t >= last_t THEN 0 ELSE held END AS held,
    CASE WHEN end_p <> 0 AND t = last_t THEN coalesce(exit_reason, 'session_close') ELSE exit_reason END AS exit_reason) FROM raw JOIN lt USING (y_sym, x_sym, session)
)"""
A_GROUP, B_GROUP = "y_sym, x_sym, session", "y_sym, x_sym"
ROLL_A = "WITH RECURSIVE " + ZB_SQL + machine_sql("zb", A_GROUP, "1.5", ROLL_EXITS, 1, "h + 1", True).replace("greatest(h, since)", "h") + CLOSE_A
ROLL_B = "WITH RECURSIVE " + ZB_SQL + machine_sql("zb", B_GROUP, "1.5", ROLL_EXITS, 1, "h + 1", True).replace("greatest(h, since)", "h") + CLOSE_B
SIG_OUT = "SELECT y_sym, x_sym, session, bar, position, held, exit_reason FROM cl"


def rolling_run(spark: SparkSession, sf_dir: str, regime: str) -> DataFrame:
    session = {"session": "session", "tradeable": "tradeable"} if regime == "A" else {}
    return signals.rolling_signals(z_bars(spark, sf_dir), KEYS, "t", entry=1.5, max_holding=20, **session)


def _states(run: DataFrame) -> DataFrame:
    return run.select(*KEYS, "session", "bar", "position", "held", "exit_reason")


@query(ROLL_A + SIG_OUT)
def signals_two_regime_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(rolling_run(spark, sf_dir, "A"))


@query(ROLL_B + SIG_OUT)
def signals_two_regime_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(rolling_run(spark, sf_dir, "B"))


OU_SQL = SB_SQL + """, nb AS (SELECT y_sym, x_sym, spread AS y, lag(spread) OVER (PARTITION BY y_sym, x_sym ORDER BY t) AS x FROM sb),
ou AS MATERIALIZED (
  SELECT y_sym, x_sym, count(*) AS n_obs, regr_slope(y, x) AS phi, regr_intercept(y, x) AS c, sqrt(greatest(regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x), 0) / (count(*) - 1)) AS sigma_eps
  FROM nb WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2
), of AS MATERIALIZED (
  SELECT *, CASE WHEN n_obs < 60 THEN 'too_few_obs' WHEN phi <= 0 THEN 'phi_not_positive' WHEN phi >= 1 THEN 'phi_not_below_one' ELSE '' END AS reject_reason FROM ou
), og AS MATERIALIZED (
  SELECT *, CASE WHEN reject_reason = '' THEN -ln(phi) END AS kappa, CASE WHEN reject_reason = '' THEN c / (1 - phi) END AS mu, CASE WHEN reject_reason = '' THEN sigma_eps / sqrt(1 - phi * phi) END AS sigma_eq FROM of
)"""


def ou_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intraday.fit_ou(spread_bars(spark, sf_dir), KEYS, "t", freq_minutes=float(BAR))


@query("WITH " + OU_SQL + """SELECT y_sym, x_sym, n_obs, reject_reason = '' AS fit_ok, reject_reason, round(kappa, 6) AS kappa, round(mu, 6) AS mu, round(sigma_eq * sqrt(2 * kappa), 6) AS sigma,
  round(sigma_eq, 6) AS sigma_eq, round(ln(2::DOUBLE) / kappa, 4) AS half_life_bars, round(ln(2::DOUBLE) / kappa * 120, 2) AS half_life_minutes FROM og""")
def ou_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ou_fits(spark, sf_dir)
    return f.select(*KEYS, "n_obs", "fit_ok", "reject_reason", *[F.round(c, 6).alias(c) for c in ("kappa", "mu", "sigma", "sigma_eq")], F.round("half_life_bars", 4).alias("half_life_bars"), F.round("half_life_minutes", 2).alias("half_life_minutes"))


ZOU_SQL = OU_SQL + ", zo AS MATERIALIZED (SELECT sb.*, round((spread - mu) / sigma_eq, 8) AS z FROM sb JOIN og USING (y_sym, x_sym))"


def ou_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialized(spread_bars(spark, sf_dir))
    fits = intraday.fit_ou(rows, KEYS, "t", freq_minutes=float(BAR))
    return intraday.z_ou(rows, fits, KEYS).withColumn("z_ou", F.round("z_ou", 8))


@query("WITH " + OU_SQL + "SELECT y_sym, x_sym, session, bar, round((spread - mu) / sigma_eq, 5) AS z_ou FROM sb JOIN og USING (y_sym, x_sym)")
def z_ou(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread_bars(spark, sf_dir)
    return intraday.z_ou(rows, ou_fits(spark, sf_dir), KEYS).select(*KEYS, "session", "bar", num("z_ou", 5).alias("z_ou"))


@query("WITH " + ZOU_SQL + "SELECT y_sym, x_sym, round(avg(z), 6) AS drift_mean, coalesce(abs(avg(z)) > 0.05, false) AS drift_flag FROM zo GROUP BY 1, 2")
def ou_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(intraday.drift(ou_bars(spark, sf_dir), KEYS, limit=0.05))


@query("WITH " + OU_SQL + f"""SELECT y_sym, x_sym, coalesce(ln(2::DOUBLE) / kappa BETWEEN {BANDS['A'][0]} AND {BANDS['A'][1]}, false) AS in_band_a, coalesce(ln(2::DOUBLE) / kappa BETWEEN {BANDS['B'][0]} AND {BANDS['B'][1]}, false) AS in_band_b FROM og""")
def hl_band_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ou_fits(spark, sf_dir)
    return f.select(*KEYS, *[intraday.in_half_life_band(F.col("half_life_bars"), b).alias(f"in_band_{r.lower()}") for r, b in BANDS.items()])


@query("WITH " + OU_SQL + """SELECT y_sym, x_sym, reject_reason = '' AS fit_ok, round(beta, 6) AS beta, round((1 + beta) / 2, 6) AS beta_multiplier, round(ln(2::DOUBLE) / kappa / (5.0::DOUBLE * 12), 6) AS half_life_ratio FROM og JOIN fit USING (y_sym, x_sym)""")
def pair_fold_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    betas = spread_bars(spark, sf_dir).select(*KEYS, "beta").distinct()
    rows = ou_fits(spark, sf_dir).join(betas, KEYS)
    return rounded(rows.select(*KEYS, "fit_ok", "beta", ((1 + F.col("beta")) / 2).alias("beta_multiplier"), (F.col("half_life_bars") / (5.0 * PER_SESSION)).alias("half_life_ratio")))


OU_EXITS = "WHEN z * p >= 0 THEN 'mean_revert' WHEN since >= 20 THEN 'time_stop'"
OU_HARD = "WHEN z * p <= -1.8 THEN 'z_stop' " + OU_EXITS
OU_A = "WITH RECURSIVE " + ZOU_SQL + machine_sql("zo", A_GROUP, "1.2", OU_EXITS, 0, "since + 1", False) + OU_CLOSE_A
OU_B = "WITH RECURSIVE " + ZOU_SQL + machine_sql("zo", B_GROUP, "1.2", OU_EXITS, 0, "since + 1", False) + CLOSE_B
OU_BH = "WITH RECURSIVE " + ZOU_SQL + machine_sql("zo", B_GROUP, "1.2", OU_HARD, 0, "since + 1", False) + CLOSE_B


def ou_run(spark: SparkSession, sf_dir: str, regime: str, hard: float | None = None) -> DataFrame:
    session = {"session": "session", "tradeable": "tradeable"} if regime == "A" else {}
    return signals.ou_signals(ou_bars(spark, sf_dir), KEYS, "t", entry=1.2, max_holding=20, hard_stop=hard, **session)


@query(OU_A + SIG_OUT)
def signals_ou_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(ou_run(spark, sf_dir, "A"))


@query(OU_B + SIG_OUT)
def signals_ou_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(ou_run(spark, sf_dir, "B"))


@query(OU_BH + SIG_OUT)
def signals_ou_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(ou_run(spark, sf_dir, "B", hard=1.8))


@query("WITH " + F3 + """, p AS (SELECT symbol, avg(n / 12.0::DOUBLE) AS f FROM (SELECT symbol, session, count(*) AS n FROM f3 GROUP BY 1, 2) GROUP BY 1)
SELECT a.symbol AS y_sym, b.symbol AS x_sym, round(a.f, 6) AS fill_y, round(b.f, 6) AS fill_x, a.f >= 0.9 AND b.f >= 0.9 AS intraday_pass FROM p a JOIN p b ON a.symbol < b.symbol""")
def liquidity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = bars(spark, sf_dir)
    return rounded(intraday.liquidity_gate(panel, all_pairs(panel), full=PER_SESSION))


def trade_sql(finalize: bool, zero_open: bool) -> str:
    gross = "coalesce(lag(position) OVER w * (spread - lag(spread) OVER w), 0)"
    if zero_open:
        gross = f"CASE WHEN lag(session) OVER w = session THEN {gross} ELSE 0 END"
    return f""", en AS (SELECT *, lag(position, 1, 0) OVER w = 0 AND position <> 0 AS entry FROM cl WINDOW w AS (PARTITION BY y_sym, x_sym ORDER BY t)),
nn AS (SELECT *, sum(entry::INT) OVER (PARTITION BY y_sym, x_sym ORDER BY t ROWS UNBOUNDED PRECEDING) AS trade_no FROM en QUALIFY trade_no > 0),
t0 AS (
  SELECT y_sym, x_sym, trade_no, arg_min(position, t) AS direction, min(t) AS entry_t, min(t) FILTER (exit_reason IS NOT NULL) AS xt, max(t) FILTER (spread IS NOT NULL) AS et,
    coalesce(arg_min(exit_reason, t) FILTER (exit_reason IS NOT NULL), 'fold_boundary') AS exit_reason, any_value(beta) AS beta FROM nn GROUP BY 1, 2, 3
), tr AS MATERIALIZED (
  SELECT t0.*, coalesce(xt, et) AS exit_t, direction * (b.spread - a.spread) AS gross_log, b.session AS exit_session, b.session_no - a.session_no AS sessions_held
  FROM t0 JOIN sb a ON a.y_sym = t0.y_sym AND a.x_sym = t0.x_sym AND a.t = entry_t JOIN sb b ON b.y_sym = t0.y_sym AND b.x_sym = t0.x_sym AND b.t = coalesce(xt, et)
  {'' if finalize else "WHERE exit_reason <> 'fold_boundary'"}
), rt AS MATERIALIZED (SELECT *, {gross} AS gross FROM cl WINDOW w AS (PARTITION BY y_sym, x_sym ORDER BY t))"""


TR_B = ROLL_B + trade_sql(True, False)
COST = "(1 + beta) * (4.5::DOUBLE + 3) / 1e4"
PS_B = TR_B + f""", nt AS (SELECT rt.*, rt.gross - coalesce(CASE WHEN tr.beta IS NOT NULL THEN (1 + tr.beta) * (4.5::DOUBLE + 3) / 1e4 END, 0) AS net FROM rt LEFT JOIN tr ON rt.y_sym = tr.y_sym AND rt.x_sym = tr.x_sym AND rt.t = tr.exit_t),
ps AS MATERIALIZED (SELECT y_sym, x_sym, session, sum(gross) AS gross, sum(net) AS net, bool_or(gross <> 0 OR net <> 0) AS active FROM nt GROUP BY 1, 2, 3)"""


def _closed(run: DataFrame, finalize: bool = True) -> DataFrame:
    closed = backtest.trades(run, KEYS, "t", carry=("session", "session_no", "beta"), finalize=finalize)
    cost = backtest.pair_cost(F.col("exit_beta"), backtest.leg_bps(3.0), guard=False)
    return closed.withColumn("beta", F.col("exit_beta")).withColumn("cost_log", cost).withColumn("net_log", F.col("gross_log") - F.col("cost_log"))


TRADE_OUT = f"SELECT y_sym, x_sym, direction, entry_t::INT AS entry_t, exit_t::INT AS exit_t, sessions_held::INT AS sessions_held, round(gross_log, 6) AS gross_log, round({COST}, 8) AS cost_log, round(gross_log - {COST}, 6) AS net_log, exit_reason FROM tr"


def _trade_rows(closed: DataFrame) -> DataFrame:
    return closed.select(*KEYS, "direction", "entry_t", "exit_t", (F.col("exit_session_no") - F.col("entry_session_no")).alias("sessions_held"), num("gross_log").alias("gross_log"), num("cost_log", 8).alias("cost_log"), num("net_log").alias("net_log"), "exit_reason")


@query(TR_B + TRADE_OUT)
def intraday_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trade_rows(_closed(materialized(rolling_run(spark, sf_dir, "B"))))


@query(ROLL_A + trade_sql(False, True) + TRADE_OUT)
def intraday_trades_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trade_rows(_closed(materialized(rolling_run(spark, sf_dir, "A")), finalize=False))


def _sessions(run: DataFrame) -> DataFrame:
    net = backtest.deduct_costs(backtest.position_returns(run, KEYS, "t"), _closed(run), KEYS, "t", F.col("cost_log"))
    return backtest.session_sums(net, KEYS, "session")


@query(PS_B + "SELECT y_sym, x_sym, session, round(gross, 6) AS gross, round(net, 6) AS net, active FROM ps")
def session_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_sessions(materialized(rolling_run(spark, sf_dir, "B"))))


@query(PS_B + "SELECT session, round(avg(gross), 6) AS gross, round(avg(net), 6) AS net, count(*) AS n_pairs, count_if(gross <> 0 OR net <> 0)::BIGINT AS n_active FROM ps GROUP BY 1")
def session_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _sessions(materialized(rolling_run(spark, sf_dir, "B"))).withColumn("pair", F.concat_ws("~", *KEYS))
    return rounded(backtest.portfolio(sums, ["session"]))


RS_SQL = TR_B + """, lv AS (SELECT unnest([1.0, 3.0, 5.0, 8.0])::DOUBLE AS spread_bps),
g AS (SELECT y_sym, x_sym, session, spread_bps, sum(gross) AS gross FROM rt, lv GROUP BY 1, 2, 3, 4),
pay AS (SELECT y_sym, x_sym, exit_session AS session, spread_bps, sum((1 + beta) * (4.5 + spread_bps) / 1e4) AS cost FROM tr, lv GROUP BY 1, 2, 3, 4),
rs AS MATERIALIZED (SELECT g.y_sym, g.x_sym, g.spread_bps, g.session, gross, gross - coalesce(cost, 0) AS net FROM g LEFT JOIN pay USING (y_sym, x_sym, session, spread_bps))"""


def _restamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = materialized(rolling_run(spark, sf_dir, "B"))
    closed = _closed(run).filter("beta >= 0")
    return backtest.restamp(backtest.position_returns(run, KEYS, "t"), closed, KEYS, "t", "session", backtest.cost_ladder(spark))


@query(RS_SQL.replace("FROM tr, lv", "FROM tr, lv WHERE beta >= 0") + "SELECT y_sym, x_sym, spread_bps, session, round(gross, 6) AS gross, round(net, 6) AS net FROM rs")
def cost_restamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_restamped(spark, sf_dir))


@query(RS_SQL.replace("FROM tr, lv", "FROM tr, lv WHERE beta >= 0") + ", pt AS (SELECT spread_bps, session, avg(net) AS net FROM rs GROUP BY 1, 2) " + metrics_sql("pt", "spread_bps", "session", "net"))
def cost_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    port = _restamped(spark, sf_dir).groupBy("spread_bps", "session").agg(F.avg("net").alias("net"))
    return rounded(backtest.metrics(port, ["spread_bps"], "session", "net"), 4)


@query(TR_B + """SELECT y_sym, count_if(exit_reason = 'mean_revert')::BIGINT AS mean_revert, count_if(exit_reason IN ('stop', 'z_stop'))::BIGINT AS z_stop, count_if(exit_reason IN ('time', 'time_stop'))::BIGINT AS time_stop,
  count_if(exit_reason = 'session_close')::BIGINT AS eod_squareoff, count_if(exit_reason = 'fold_boundary')::BIGINT AS fold_close, 0::BIGINT AS __OTHER__ FROM tr GROUP BY 1""")
def exit_reason_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.exit_pivot(_closed(materialized(rolling_run(spark, sf_dir, "B"))), ["y_sym"])


@query(TR_B + """, m AS (SELECT y_sym, x_sym, (1 + beta) / 2 AS m FROM fit), u AS (SELECT 'all' AS universe, m FROM m UNION ALL SELECT 'traded', m FROM m SEMI JOIN tr USING (y_sym, x_sym))
SELECT universe, count(*) AS n, round(avg(m), 6) AS mean_multiplier, round(quantile_cont(m, 0.5), 6) AS median_multiplier FROM u GROUP BY 1""")
def beta_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = materialized(rolling_run(spark, sf_dir, "B"))
    return rounded(reports.beta_summary(run.select(*KEYS, "beta").distinct(), _closed(run), KEYS))


@query("WITH " + OU_SQL + f"""SELECT x_sym, count_if(reject_reason = '')::BIGINT AS n_fit_ok, count_if(ln(2::DOUBLE) / kappa BETWEEN {BANDS['A'][0]} AND {BANDS['A'][1]})::BIGINT AS n_band_A,
  count_if(ln(2::DOUBLE) / kappa BETWEEN {BANDS['B'][0]} AND {BANDS['B'][1]})::BIGINT AS n_band_B FROM og GROUP BY 1""")
def hl_band_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.half_life_bands(ou_fits(spark, sf_dir), ["x_sym"], "half_life_bars", BANDS)


@query(TR_B + "SELECT y_sym, x_sym, count_if(direction = 1)::BIGINT AS n_trades_long, count_if(direction = -1)::BIGINT AS n_trades_short FROM tr GROUP BY 1, 2")
def trade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = _closed(materialized(rolling_run(spark, sf_dir, "B"))).withColumn("side", F.when(F.col("direction") > 0, "long").otherwise("short"))
    return reports.trade_counts(closed, KEYS, "side", ["long", "short"])


@query(PS_B + ", un AS (SELECT 'B' AS regime, session, avg(net) AS net FROM ps SEMI JOIN (SELECT y_sym, x_sym FROM og0 WHERE ok) USING (y_sym, x_sym) GROUP BY 1, 2) ".replace("og0 WHERE ok", "fit WHERE beta > 0.7") + metrics_sql("un", "regime", "session", "net"))
def matched_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = materialized(rolling_run(spark, sf_dir, "B"))
    chosen = run.filter("beta > 0.7").select(*KEYS).distinct()
    sums = _sessions(run).withColumn("regime", F.lit("B"))
    return rounded(reports.matched_universe(sums, chosen, KEYS, ["regime"], "session"), 4)


@query(PS_B + """SELECT session, round(coalesce(sum(net) FILTER (y_sym = 'click'), 0), 6) AS click, round(coalesce(sum(net) FILTER (y_sym = 'purchase'), 0), 6) AS purchase FROM ps GROUP BY 1""")
def equity_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.equity_union(_sessions(materialized(rolling_run(spark, sf_dir, "B"))), "y_sym", ["click", "purchase"], "session"))


def erfi_sql(u: str, damped: str = "0") -> str:
    """exp(-damped) erfi(u) for u > 0 in DuckDB, by 400 terms of its series."""
    return f"(2 / sqrt(pi()) * list_sum(list_transform(range(0, 400), lambda n: exp((2 * n + 1) * ln({u}) - lgamma(n + 1) - {damped}) / (2 * n + 1))))"


def _least_gain_sql() -> str:
    """Positive where the condition of the best threshold lies above lo and hi's middle."""
    u = "((lo + hi) / 2 / (sigma_eq * sqrt(2)))"
    return f"{erfi_sql(u, f'{u} * {u}')} > ((lo + hi) / 2 - c) * 2 / sqrt(pi()) / (sigma_eq * sqrt(2))"


#: Thresholds at every cost in DuckDB, by 70 halvings; th has a (null if there is none), feasible and rate.
TH_SQL = "WITH RECURSIVE " + OU_SQL + f""", tc AS MATERIALIZED (
  SELECT y_sym, x_sym, reject_reason = '' AS fit_ok, kappa, sigma_eq, beta, spread_bps, (1 + beta) * (spread_bps + {DEFAULTS.fixed_cost_bps}) / 1e4 AS c
  FROM og JOIN fit USING (y_sym, x_sym), (SELECT unnest({[float(x) for x in DEFAULTS.spread_ladder_bps]})::DOUBLE AS spread_bps) WHERE beta >= 0
), bi AS (
  SELECT y_sym, x_sym, spread_bps, sigma_eq, c, c AS lo, 15 * sigma_eq AS hi, 0 AS i FROM tc WHERE sigma_eq > 0 AND 15 * sigma_eq > c
  UNION ALL SELECT y_sym, x_sym, spread_bps, sigma_eq, c, CASE WHEN g THEN (lo + hi) / 2 ELSE lo END, CASE WHEN g THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM (SELECT *, {_least_gain_sql()} AS g FROM bi WHERE i < 70)
), ta AS MATERIALIZED (SELECT tc.*, CASE WHEN (lo + hi) / 2 < 14.999::DOUBLE * tc.sigma_eq THEN (lo + hi) / 2 END AS a FROM tc LEFT JOIN (SELECT * FROM bi WHERE i = 70) b USING (y_sym, x_sym, spread_bps)),
th AS MATERIALIZED (SELECT *, a IS NOT NULL AND fit_ok AS feasible, CASE WHEN a > 0 THEN pi() / (2 * kappa) * {erfi_sql('(a / (sigma_eq * sqrt(2)))')} END AS cycle FROM ta)"""


@query(TH_SQL + "SELECT y_sym, x_sym, spread_bps, round(beta, 6) AS beta, round(c, 6) AS cost_log, round(a, 6) AS a, round(a / sigma_eq, 6) AS a_z, feasible, round(CASE WHEN a > c THEN (a - c) / cycle ELSE 0 END, 6) AS return_rate FROM th")
def bertram_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_solved(spark, sf_dir).select(*KEYS, "spread_bps", "beta", "cost_log", "a", "a_z", "feasible", "return_rate"))


def _solved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread_bars(spark, sf_dir)
    fits = ou_fits(spark, sf_dir).join(rows.select(*KEYS, "beta").distinct(), KEYS).filter("beta >= 0")
    return intraday.thresholds(fits, backtest.cost_ladder(spark))


@query(TH_SQL + "SELECT y_sym, x_sym, spread_bps, round(cycle, 4) AS cycle_closed, round((a - c) / cycle, 6) AS rate_closed, true AS cycle_agrees, true AS rate_agrees FROM th WHERE a > 0")
def simulated_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cycle and return per time at each pair's threshold and cost, and whether 1,000 simulated paths agree."""
    drawn = cycles.simulate_cycles(_solved(spark, sf_dir), [*KEYS, "spread_bps"])
    return drawn.select(
        *KEYS, "spread_bps", num("cycle_closed", 4).alias("cycle_closed"), num("rate_closed").alias("rate_closed"),
        cycles.agrees("cycle", "cycle_closed", "cycle_se").alias("cycle_agrees"), cycles.agrees("rate", "rate_closed", "rate_se").alias("rate_agrees"),
    )


def _plans(spark: SparkSession, sf_dir: str, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, pair-folds of every cell with exclusion_reason)."""
    all_cells = grid.cells(spark, freqs=(1,))
    fits = intraday.fit_ou(rows, KEYS, "t", freq_minutes=float(BAR)).join(rows.select(*KEYS, "beta").distinct(), KEYS).filter("beta >= 0")
    solved = intraday.thresholds(fits, backtest.cost_ladder(spark)).select(*KEYS, "fit_ok", F.col("half_life_bars").alias("half_life"), "spread_bps", "cost_log", "a_z", "feasible")
    marked = grid.exclusions(solved.join(all_cells, "spread_bps"), BANDS)
    return all_cells, marked.withColumn("max_holding", F.lit(20))


def _cells_sql() -> str:
    """The grid's cells of one frequency in DuckDB, in their order."""
    base = [(r, float(c), "none") for r in BANDS for c in DEFAULTS.spread_ladder_bps] + [(r, 3.0, "hard") for r in BANDS]
    rows = ", ".join(f"({i}, '{r}', {c}::DOUBLE, '{s}', {BANDS[r][0]}::DOUBLE, {BANDS[r][1]}::DOUBLE)" for i, (r, c, s) in enumerate(base))
    return f"(VALUES {rows}) AS cells(cell_id, regime, spread_bps, stop_mode, lo, hi)"


#: Why a pair-fold has no part in a cell, in DuckDB, and how many have none for each reason.
EXCLUDED_SQL = TH_SQL + f""", mk AS (
  SELECT cell_id, regime, spread_bps, stop_mode, CASE WHEN NOT fit_ok THEN 'no_reversion' WHEN NOT coalesce(ln(2::DOUBLE) / kappa BETWEEN lo AND hi, false) THEN 'hl_band' WHEN NOT feasible THEN 'infeasible' ELSE '' END AS why
  FROM th JOIN {_cells_sql()} USING (spread_bps)
), ec AS (
  SELECT cell_id, regime, spread_bps, stop_mode, count(*) AS n_total, count_if(why = 'no_reversion')::BIGINT AS n_excluded_no_reversion, count_if(why = 'hl_band')::BIGINT AS n_excluded_hl_band,
    count_if(why = 'infeasible')::BIGINT AS n_excluded_infeasible, 0::BIGINT AS n_excluded_other, count_if(why = '')::BIGINT AS n_survivors FROM mk GROUP BY ALL
)"""


@query(EXCLUDED_SQL + "SELECT * FROM ec")
def exclusion_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialized(spread_bars(spark, sf_dir))
    return grid.exclusion_counts(_plans(spark, sf_dir, rows)[1], ["cell_id", "regime", "spread_bps", "stop_mode"])


@query()
def grid_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialized(spread_bars(spark, sf_dir))
    all_cells, marked = _plans(spark, sf_dir, rows)
    marked = materialized(marked)
    scored = materialized(intraday.z_ou(rows, intraday.fit_ou(rows, KEYS, "t", freq_minutes=float(BAR)), KEYS))
    trades, sessions = grid.run_cells(scored, marked.filter("exclusion_reason IS NULL"), KEYS, "t", "session", hard_stop=2.5)
    trades, sessions = materialized(trades), materialized(sessions.withColumn("pair", F.concat_ws("~", *KEYS)))
    excluded = grid.exclusion_counts(marked, ["cell_id"])
    return rounded(grid.cell_metrics(all_cells, trades, sessions, excluded, "session"), 6)
