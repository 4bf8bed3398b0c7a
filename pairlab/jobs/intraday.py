"""Whole jobs on minute bars: the two-regime engine, the threshold grid and its report tables.

Pair-folds are rows ``(fold_id, y_sym, x_sym, alpha, beta, half_life, train_start, test_start, test_end)``; half_life
is in days. Spreads use the coefficients of the fold; fits see training sessions only, machines test
sessions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlab.checkpoints import materialized
from pairlab.jobs.daily import per_pair_table, stored
from pairlab.operators import backtest, calendars, cards, cointegration, grid, intraday, liquidity, reports, signals, two_regime
from pairlab.params import DEFAULTS
from pairlab.sources import tables
from pairlab.sources.foldstore import FoldStore

KEYS = ["fold_id", "y_sym", "x_sym"]
NAN = float("nan")


def session_bars(minute: DataFrame, *, zone: str = "Asia/Kolkata", open_minute: int = 9 * 60 + 15, bars: int = DEFAULTS.bars_per_session) -> DataFrame:
    """(symbol, session, bar, close, volume) of the minutes within a session."""
    local = F.from_utc_timestamp(F.to_utc_timestamp("timestamp", F.current_timezone()), zone)
    return minute.select("symbol", F.col("date").alias("session"), calendars.bar_of_session(local, open_minute=open_minute).alias("bar"), "close", F.col("volume").cast("long").alias("volume")).filter(F.col("bar").between(0, bars - 1))


def pair_folds(candidates: DataFrame, folds: DataFrame, gate: DataFrame | None = None) -> DataFrame:
    """The tradeable candidates of a walk-forward run with their folds' windows; pairs with a negative beta are left out.

    With ``gate`` (the table of liquidity.gate_by_fold), pair-folds that don't pass it are left out too.
    """
    chosen = candidates.filter(cointegration.is_tradeable() & (F.col("beta") >= 0)).select("fold_id", "y_sym", "x_sym", "alpha", "beta", "half_life")
    found = chosen.join(folds.select("fold_id", "train_start", "test_start", "test_end"), "fold_id")
    return found if gate is None else found.join(gate.filter("intraday_pass"), KEYS, "left_semi")


def liquid_pair_folds(spark: SparkSession, bars: DataFrame, candidates: DataFrame, folds: DataFrame, out: str, **gate) -> DataFrame:
    """pair_folds that pass the liquidity gate of their fold; the gate's table is kept, as Parquet and as a CSV file."""
    found = stored(spark, out, {"liquidity_filter": liquidity.gate_by_fold(bars, pair_folds(candidates, folds), folds, **gate)})["liquidity_filter"]
    tables.write_csv(found.orderBy(*KEYS), f"{out}/liquidity_filter_csv")
    return pair_folds(candidates, folds, found)


def spread_grid(bars: DataFrame, chosen: DataFrame, freq: int) -> DataFrame:
    """(fold keys, session, session_no, bar, t, tradeable, in_test, spread) on bars of ``freq`` minutes, NaN where a leg lacks."""
    pairs = chosen.select("y_sym", "x_sym").distinct()
    aligned = intraday.align_pairs(bars, pairs, ["session", "bar"])
    coarse = intraday.resample(aligned, ["y_sym", "x_sym"], "session", "bar", freq) if freq > 1 else aligned
    rows = coarse.join(chosen, ["y_sym", "x_sym"]).filter(F.col("session").between(F.col("train_start"), F.col("test_end")))
    value = F.when(F.col("tradeable"), signals.spread(F.col("close_y"), F.col("close_x"), F.col("beta"), F.col("alpha"))).otherwise(F.lit(NAN))
    t = F.row_number().over(Window.partitionBy(*KEYS).orderBy("session", "bar")) - 1
    return rows.select(*KEYS, "session", intraday.session_number(KEYS, "session").alias("session_no"), "bar", t.alias("t"), "tradeable", (F.col("session") >= F.col("test_start")).alias("in_test"), value.alias("spread"))


def diagnostics(fits: DataFrame, chosen: DataFrame, drifts: DataFrame, freq: int, *, bars: int = DEFAULTS.bars_per_session, bands: dict[str, tuple[float, float]] = DEFAULTS.half_life_minutes) -> DataFrame:
    """One row a pair-fold: its fit, its half-life against the daily one, bands, and the drift over the test."""
    facts = chosen.select(*KEYS, "beta", F.col("half_life").alias("daily_half_life_days"), "train_start", "test_start", "test_end")
    rows = fits.join(facts, KEYS).join(drifts, KEYS, "left")
    return rows.select(
        *KEYS, F.lit(freq).alias("freq_min"), "n_obs", "fit_ok", "reject_reason", "phi", "kappa", "mu", "sigma", "sigma_eq", "sigma_eps", "half_life_bars", "half_life_minutes",
        (F.col("daily_half_life_days") * bars).alias("daily_half_life_minutes"), F.try_divide(F.col("half_life_minutes"), F.col("daily_half_life_days") * bars).alias("half_life_ratio"),
        *[intraday.in_half_life_band(F.col("half_life_minutes"), b).alias(f"in_band_{r.lower()}") for r, b in bands.items()],
        "beta", ((1 + F.col("beta")) / 2).alias("beta_multiplier"), "drift_mean", "drift_flag",
    )


def ou_grid(
    spark: SparkSession, bars: DataFrame, chosen: DataFrame, out: str, *, cells: DataFrame | None = None, hard_stop: float = 4.0, per_session: int = DEFAULTS.bars_per_session, bands: dict[str, tuple[float, float]] = DEFAULTS.half_life_minutes
) -> dict[str, DataFrame]:
    """Every cell of the threshold grid: metrics, trades, session sums, exclusions, thresholds, diagnostics and the funnel.

    A frequency's spreads and fits are computed once for all its cells.
    """
    cells = grid.cells(spark) if cells is None else cells
    chosen = materialized(chosen)
    ladder = cells.select("spread_bps").distinct()
    parts: dict[str, list[DataFrame]] = {k: [] for k in ("trades", "sessions", "marked", "thresholds", "diagnostics")}
    for freq in sorted(r.freq_min for r in cells.select("freq_min").distinct().collect()):  # a handful
        rows = materialized(spread_grid(bars, chosen, freq))
        fits = materialized(intraday.fit_ou(rows.filter("NOT in_test"), KEYS, "t", freq_minutes=float(freq)))
        scored = materialized(intraday.z_ou(rows.filter("in_test"), fits, KEYS))
        drifts = intraday.drift(scored, KEYS)
        solved = materialized(intraday.thresholds(fits.join(chosen.select(*KEYS, "beta", F.col("half_life").alias("days")), KEYS), ladder))
        own = cells.filter(F.col("freq_min") == freq)
        plans = grid.exclusions(solved.withColumn("half_life", F.col("half_life_minutes")).join(own, "spread_bps"), bands)
        plans = materialized(plans.withColumn("max_holding", intraday.max_holding_bars(F.col("days"), freq, bars=per_session)))
        trades, sessions = grid.run_cells(scored, plans.filter("exclusion_reason IS NULL"), KEYS, "t", "session", hard_stop=hard_stop)
        for name, df in (("trades", trades), ("sessions", sessions), ("marked", plans.select(*KEYS, "cell_id", "exclusion_reason", "a_z", "max_holding")), ("thresholds", solved.select(*KEYS, F.lit(freq).alias("freq_min"), "spread_bps", "cost_log", "a", "a_z", (F.col("a") * 1e4).alias("a_bps"), "feasible", "return_rate")), ("diagnostics", diagnostics(fits, chosen, drifts, freq, bars=per_session, bands=bands))):
            parts[name].append(df)
    found = stored(spark, out, {name: reduce(DataFrame.unionByName, dfs) for name, dfs in parts.items()})
    excluded = grid.exclusion_counts(found["marked"], ["cell_id"])
    pair = F.concat_ws("~", *[F.col(k).cast("string") for k in KEYS])
    more = {
        "metrics": grid.cell_metrics(cells, found["trades"], found["sessions"].withColumn("pair", pair), excluded, "session"),
        "funnel": reports.stage_funnel(excluded, ["cell_id"], ["n_total", "n_excluded_no_reversion", "n_excluded_hl_band", "n_excluded_infeasible", "n_survivors"]),
        "trade_export": trade_export(found["trades"].join(cells.drop("regime", "stop_mode"), "cell_id")),
        "half_life_bands": reports.half_life_bands(found["diagnostics"], ["freq_min"], "half_life_minutes", bands),
    }
    found |= stored(spark, out, more)
    tables.write_csv(found["metrics"].orderBy("cell_id"), f"{out}/metrics_csv")
    return found


def trade_export(trades: DataFrame) -> DataFrame:
    """Trades in the export's columns and names of exits, with percentages."""
    net = (F.expm1("net_log") * 100).alias("net_pct")
    return trades.select(
        "engine", "freq_min", "regime", "spread_bps", "stop_mode", *KEYS, "trade_no", F.when(F.col("direction") > 0, "long").otherwise("short").alias("direction"), "entry_t", "exit_t",
        "entry_session", "exit_session", F.col("entry_z_ou").alias("entry_z"), F.col("exit_z_ou").alias("exit_z"), grid.exit_name().alias("exit_reason"), "held", F.col("gross_log").alias("gross_log_pnl"), "cost_log", F.col("net_log").alias("net_log_pnl"), net,
    )


def two_regimes(spark: SparkSession, bars: DataFrame, chosen: DataFrame, out: str, *, freq: int = 1, table_bps: float = 3.0, per_session: int = DEFAULTS.bars_per_session, warmup: int = DEFAULTS.warmup_bars, entry: float = DEFAULTS.entry_z) -> dict[str, DataFrame]:
    """The rolling-z engine in both regimes at all costs, with the tables of pairs and of trades by pair-fold."""
    rows = materialized(spread_grid(bars, chosen, freq))
    sized = materialized(two_regime.bar_windows(chosen, bars=per_session, freq=freq))
    run = two_regime.run(rows, sized, KEYS, "t", "session", ladder=backtest.cost_ladder(spark), warmup=max(1, warmup // freq), entry=entry)
    found = stored(spark, out, run | {"windows": sized.select(*KEYS, "window", "max_holding")})
    trades = found["trades"].withColumn("cost_log", backtest.pair_cost(F.col("beta"), backtest.leg_bps(table_bps))).withColumn("net_log", F.col("gross_log") - F.col("cost_log"))
    at_table = found["sessions"].filter(F.col("spread_bps") == table_bps)
    by = ["regime", *KEYS]
    # A session counts as deployed if something moved in it.
    moved = at_table.withColumn("position", ((F.col("gross") != 0) | (F.col("net") != 0)).cast("int"))
    more = {"pair_metrics": per_pair_table(moved, trades, by, "session"), "trade_counts": reports.trade_counts(found["trades"], KEYS, "regime", ["A", "B"])}
    return found | stored(spark, out, more)


def kept_regimes(spark: SparkSession, bars: DataFrame, chosen: DataFrame, store: str, *, freq: int = 1, per_session: int = DEFAULTS.bars_per_session, warmup: int = DEFAULTS.warmup_bars, entry: float = DEFAULTS.entry_z) -> dict[str, DataFrame]:
    """Trades, sessions and windows of the rolling-z engine from a store by fold, frequency and pair; only pair-folds that it lacks are run.

    A pair-fold is run again if its coefficients, windows or the engine's settings are others than those stored.
    """
    kept = FoldStore(spark, store, [*KEYS, "freq_min"])
    wanted = chosen.withColumn("freq_min", F.lit(freq)).withColumn("settings", F.concat_ws(" ", *[F.lit(str(v)) for v in (per_session, warmup, entry)]))

    def compute(new: DataFrame) -> dict[str, DataFrame]:
        pairs = new.drop("freq_min", "settings")
        rows = materialized(spread_grid(bars, pairs, freq))
        sized = materialized(two_regime.bar_windows(pairs, bars=per_session, freq=freq))
        run = two_regime.run(rows, sized, KEYS, "t", "session", ladder=backtest.cost_ladder(spark), warmup=max(1, warmup // freq), entry=entry)
        found = {"trades": run["trades"], "sessions": run["sessions"], "windows": sized.select(*KEYS, "window", "max_holding")}
        return {name: df.withColumn("freq_min", F.lit(freq)) for name, df in found.items()}

    found = kept.fill(wanted, compute)
    pair = F.concat_ws("~", *KEYS)
    port = backtest.portfolio(found["sessions"].withColumn("pair", pair), ["regime", "spread_bps", "session"])
    return found | {"portfolio": port, "metrics": backtest.metrics(port, ["regime", "spread_bps"], "session", "net")}


def pair_cards(
    spark: SparkSession, bars: DataFrame, chosen: DataFrame, run: dict[str, DataFrame], out: str, *, sectors: DataFrame | None = None, freq: int = 1, table_bps: float = 3.0, per_session: int = DEFAULTS.bars_per_session, warmup: int = DEFAULTS.warmup_bars
) -> dict[str, DataFrame]:
    """What a card of each pair shows: curves of both regimes on one axis, fold spans, totals, and the representative fold's spread, z and trades.

    ``run`` are the tables of two_regimes or kept_regimes. z runs over the test window alone.
    """
    pair = F.concat_ws("~", "y_sym", "x_sym").alias("pair")
    regimes = ["A", "B"]
    chosen = materialized(chosen)
    spans = chosen.select(pair, "y_sym", "x_sym", "fold_id", "test_start", "test_end")
    net = run["sessions"].filter(F.col("spread_bps") == table_bps).select(pair, "regime", "fold_id", "session", "net")
    axis = cards.on_union_axis(cards.stitched_curves(net, ["pair", "regime"], "fold_id", "session"), ["pair"], "regime", regimes, "session")
    trades = run["trades"].withColumn("pair", pair)
    found = stored(spark, out, {"card_curves": axis, "card_spans": spans, "card_folds": cards.representative_folds(spans, trades.filter("regime = 'A'"))})
    totals = cards.totals(spans, trades, found["card_curves"], regimes, "session")
    if sectors is not None:
        own = sectors.select(F.col("symbol").alias("y"), "sector").dropDuplicates(["y"])
        totals = totals.withColumn("y", F.split("pair", "~")[0]).join(own, "y", "left").drop("y")
    best = found["card_folds"].join(spans, ["pair", "fold_id"]).select("fold_id", "y_sym", "x_sym")
    shown = chosen.join(best, KEYS, "left_semi")
    sized = two_regime.bar_windows(shown, bars=per_session, freq=freq).select(*KEYS, "window")
    rows = spread_grid(bars, shown.withColumn("train_start", F.col("test_start")), freq).join(sized, KEYS)
    scored = signals.variable_rolling_z(rows, KEYS, "t", "window")
    place = F.row_number().over(Window.partitionBy(*KEYS, "session").orderBy("t"))
    series = scored.withColumn("z", F.when(place <= max(1, warmup // freq), F.lit(NAN)).otherwise(F.coalesce("z", F.lit(NAN)))).select(pair, *KEYS, "session", "bar", F.coalesce("spread", F.lit(NAN)).alias("spread"), "z")
    marked = trades.join(best, KEYS, "left_semi").select(*KEYS, "pair", "regime", "trade_no", "direction", "entry_session", "exit_session", "entry_t", "exit_t", "held", grid.exit_name().alias("exit_reason"), "gross_log")
    found |= stored(spark, out, {"card_totals": totals, "card_series": series, "card_trades": marked})
    tables.write_csv(found["card_totals"].withColumn("folds", F.concat_ws(" ", F.transform("folds", lambda f: f.cast("string")))).orderBy("pair"), f"{out}/card_totals_csv")
    return found


def rolling_baseline(spark: SparkSession, bars: DataFrame, chosen: DataFrame, out: str, *, freqs: tuple[int, ...] = (5, 15), per_session: int = DEFAULTS.bars_per_session, warmup: int = DEFAULTS.warmup_bars, entry: float = DEFAULTS.entry_z) -> DataFrame:
    """The rolling-z engine on coarse bars: one row a frequency, regime and cost, with the windows' median and extremes."""
    parts = []
    for freq in freqs:
        run = two_regimes(spark, bars, chosen, f"{out}/freq_{freq}", freq=freq, per_session=per_session, warmup=warmup, entry=entry)
        sizes = run["windows"].agg(F.percentile("window", F.lit(0.5)).alias("window_p50"), F.min("window").alias("window_min"), F.max("window").alias("window_max"))
        n = run["trades"].groupBy("regime").agg(F.count(F.lit(1)).alias("n_trades"))
        gross = backtest.metrics(run["portfolio"], ["regime", "spread_bps"], "session", "gross").select("regime", "spread_bps", F.col("sharpe").alias("gross_sharpe"), F.col("total_pct").alias("gross_total_pct"))
        net = run["metrics"].select("regime", "spread_bps", F.col("n").alias("n_sessions"), F.col("total_pct").alias("net_total_pct"), F.col("ann_pct").alias("net_ann_pct"), F.col("sharpe").alias("net_sharpe"), F.col("max_drawdown_pct").alias("net_max_drawdown_pct"))
        cells = backtest.cost_ladder(spark).crossJoin(spark.sql("SELECT * FROM VALUES ('A'), ('B') AS r(regime)"))  # eight rows
        table = cells.join(net, ["regime", "spread_bps"], "left").join(gross, ["regime", "spread_bps"], "left").join(n, "regime", "left").crossJoin(sizes)  # one row of sizes
        parts.append(table.select(F.lit("rolling").alias("engine"), F.lit(freq).alias("freq_min"), "*").na.fill(0, ["n_trades", "n_sessions"]))
    found = stored(spark, out, {"metrics_rolling_baseline": reduce(DataFrame.unionByName, parts)})["metrics_rolling_baseline"]
    tables.write_csv(found.orderBy("freq_min", "regime", "spread_bps"), f"{out}/metrics_rolling_baseline_csv")
    return found


def sensitivity(
    rows: DataFrame, keys: list[str], order: str, *, bar: str = "bar", sessions: tuple[int, ...] = (1, 3, 5), per_session: int = DEFAULTS.bars_per_session, entry: float = DEFAULTS.entry_z
) -> DataFrame:
    """(keys, variant, window_bars, n_z, n_beyond, mean_abs_z): z over windows of some sessions, flat and adjusted for the time of day."""
    parts = []
    for k in sessions:
        window = k * per_session
        profile = signals.tod_profile(rows, keys, bar, order, window=window, bars=per_session)
        tod = signals.tod_adjusted_z(rows, profile, keys, bar, order, window=window).withColumn("z", F.col("z_tod"))
        for name, scored in (("flat", signals.rolling_z(rows, keys, order, window=window)), ("tod", tod)):
            z = F.when(~F.isnan("z"), F.abs("z"))
            per = scored.groupBy(*keys).agg(F.count(z).alias("n_z"), F.count_if(z > entry).alias("n_beyond"), F.avg(z).alias("mean_abs_z"))
            parts.append(per.select(*keys, F.lit(name).alias("variant"), F.lit(window).alias("window_bars"), "n_z", "n_beyond", "mean_abs_z"))
    return reduce(DataFrame.unionByName, parts)


def rollups(found: dict[str, DataFrame], rolling: DataFrame, chosen: DataFrame, *, freq: int = 5, regime: str = "B", spread_bps: float = 3.0) -> dict[str, DataFrame]:
    """The roll-ups of a finished grid: the whole metrics, the best cell, one cell's attribution by pair, and coarse and fine rolling rows.

    ``found`` are the tables of ou_grid, ``rolling`` those of rolling_baseline.
    """
    metrics = found["metrics"]
    best = metrics.filter("n_trades > 0").orderBy(F.col("net_sharpe").desc_nulls_last(), "cell_id").limit(1)
    cell = metrics.filter((F.col("freq_min") == freq) & (F.col("regime") == regime) & (F.col("spread_bps") == spread_bps) & (F.col("stop_mode") == "none")).select("cell_id")
    own = found["trades"].join(cell, "cell_id", "left_semi")
    total = own.agg(F.sum("net_log").alias("total"))  # one row
    attribution = own.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_trades"), F.sum("gross_log").alias("gross_log"), F.sum("cost_log").alias("cost_log"), F.sum("net_log").alias("net_log")).crossJoin(total)
    attribution = attribution.withColumn("share", F.try_divide("net_log", "total")).drop("total").join(chosen.select(*KEYS, "beta"), KEYS)
    return {
        "grid": reports.union_metrics([metrics, rolling]), "best_cell": best, "attribution": attribution,
        "rolling_coarse": rolling.filter("freq_min > 1"), "rolling_fine": rolling.filter("freq_min = 1"),
        "ladder": metrics.select("engine", "freq_min", "regime", "stop_mode", "spread_bps", "net_sharpe", "net_total_pct").orderBy("engine", "freq_min", "regime", "stop_mode", "spread_bps"),
        "drift": found["diagnostics"].select("freq_min", *KEYS, "drift_mean", "drift_flag").orderBy("freq_min", "drift_mean"),
    }


def matched_engines(found: dict[str, DataFrame], rolling: dict[int, dict[str, DataFrame]], *, freq: int = 5, regime: str = "B", spread_bps: float = 3.0) -> DataFrame:
    """The cost ladders of both engines over the pair-folds that the threshold engine trades in its headline cell, without a hard stop.

    ``found`` are the tables of ou_grid, ``rolling`` those of two_regimes or kept_regimes by frequency.
    """
    by = ["engine", "freq_min", "regime", "spread_bps", "stop_mode"]
    cells = found["metrics"].select("cell_id", *by)
    headline = (F.col("freq_min") == freq) & (F.col("regime") == regime) & (F.col("spread_bps") == spread_bps) & (F.col("stop_mode") == "none")
    universe = found["marked"].filter("exclusion_reason IS NULL").join(cells.filter(headline).select("cell_id"), "cell_id", "left_semi").select(*KEYS)
    own = cells.filter((F.col("regime") == regime) & (F.col("stop_mode") == "none") & F.col("freq_min").isin(*rolling))
    sessions = [found["sessions"].select("cell_id", *KEYS, "session", "gross", "net").join(own, "cell_id").drop("cell_id")]
    trades = [found["trades"].select("cell_id", *KEYS).join(own, "cell_id").drop("cell_id")]
    for f, run in rolling.items():  # a handful of frequencies
        marks = {"engine": F.lit("rolling"), "freq_min": F.lit(f), "stop_mode": F.lit("none")}
        sums = run["sessions"].filter(F.col("regime") == regime).withColumns(marks)
        sessions.append(sums.select(*KEYS, "session", "gross", "net", *by))
        # A rolling trade doesn't depend on the cost: it counts at each.
        each = run["trades"].filter(F.col("regime") == regime).withColumns(marks).drop("spread_bps")
        trades.append(each.crossJoin(F.broadcast(backtest.cost_ladder(run["trades"].sparkSession))).select(*KEYS, *by))
    return reports.matched_ladder(reduce(DataFrame.unionByName, sessions), reduce(DataFrame.unionByName, trades), universe, KEYS, by, "session")
