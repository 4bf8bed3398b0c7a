"""Whole jobs on daily bars, from readers to sinks: each reads tables, composes operators and writes its results.

A job returns what it wrote as a dictionary of tables that are read from the folder again, so that a job
that follows starts from stored data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from pairlab.checkpoints import materialized
from pairlab.operators import actions, backtest, calendars, cards, clean, cointegration, screen, signals, universe, walkforward
from pairlab.params import DEFAULTS
from pairlab.sources import csv_bars, tables


def stored(spark: SparkSession, out: str, found: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Each table written to a folder of ``out`` under its name, and read again."""
    for name, df in found.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/{name}")
    return {name: spark.read.schema(df.schema).parquet(f"{out}/{name}") for name, df in found.items()}


def ingest_daily(spark: SparkSession, source: str, out: str) -> DataFrame:
    """Daily CSV files to Parquet by year; raises if there are no rows."""
    tables.write_daily(csv_bars.require_rows(csv_bars.read_daily(spark, source), "daily bars"), out)
    return spark.read.parquet(out)


def ingest_minute(spark: SparkSession, source: str, daily: DataFrame, out: str, *, drop_dates: tuple[str, ...] = (), start: str | None = None, end: str | None = None) -> dict[str, DataFrame]:
    """Minute CSV files to Parquet by symbol and year; raises unless symbols are those of ``daily`` and the gates hold."""
    bars = csv_bars.require_universe(csv_bars.read_minute(spark, source, drop_dates=drop_dates), daily)
    tables.write_minute(bars, out)
    back = csv_bars.require_gates(spark.read.parquet(out), start=start, end=end)
    return {"minute": back, "stats": csv_bars.ingest_stats(back)}


def map_sectors(spark: SparkSession, daily: DataFrame, sectors: DataFrame, out: str, *, other: DataFrame | None = None) -> dict[str, DataFrame]:
    """The sector table of the traded symbols, and the symbols without one."""
    known = sectors if other is None else tables.with_second_industry(sectors, other)
    traded = known.join(daily.select("symbol").distinct(), "symbol", "left_semi")
    return stored(spark, out, {"sectors": traded, "unmapped": tables.unmapped(daily, known)})


def fetch_actions(spark: SparkSession, daily: DataFrame, fetch, out: str, **options) -> dict[str, DataFrame]:
    """The actions of every traded symbol as fetched, flattened, and their coverage; what was fetched is kept, so nothing is asked for twice."""
    fetched = stored(spark, out, {"fetched": actions.fetch_actions(daily.select("symbol"), fetch, **options)})["fetched"]
    return {"fetched": fetched} | stored(spark, out, {"actions": actions.flatten_actions(fetched).sort("symbol", "ex_date", "action_type"), "coverage": actions.coverage(fetched)})


def adjust(spark: SparkSession, daily: DataFrame, fetched: DataFrame, out: str, *, reference: DataFrame | None = None) -> dict[str, DataFrame]:
    """Corporate actions flattened, split audit, and prices with residual splits adjusted; raises if a split still shows.

    ``reference(symbol, date, ref_close, ref_adj_close)`` adds the adjustment flavour.
    """
    listed = actions.flatten_actions(fetched)
    splits = listed.filter("action_type = 'split'").select("symbol", "ex_date", "value")
    audit = materialized(actions.split_audit(daily, splits))
    residual = audit.filter("status = 'residual_jump'").select("symbol", "ex_date", F.col("split_ratio").alias("ratio"))
    adjusted = clean.adjust_residual_splits(daily, residual)
    found = {"actions": listed.sort("symbol", "ex_date", "action_type"), "coverage": actions.coverage(fetched), "audit": audit, "daily_adjusted": adjusted}
    if reference is not None:
        found["flavor"] = actions.adjustment_flavor(daily, reference)
    found = stored(spark, out, found)
    rough = clean.split_smoothness(found["daily_adjusted"], residual).filter("NOT smooth").count()
    if rough:
        raise ValueError(f"{rough} adjusted splits still show a jump")
    return found


def clean_daily(
    spark: SparkSession, daily: DataFrame, out: str, *, events: DataFrame, keep: DataFrame, dividends: DataFrame, windows: DataFrame, blind: DataFrame, excused: DataFrame | None = None,
    min_symbols: int = DEFAULTS.min_symbols_per_day, min_days: int = DEFAULTS.min_history_days, floor: float = DEFAULTS.liquidity_floor, start: str = DEFAULTS.calendar_start, end: str = DEFAULTS.calendar_end,
) -> dict[str, DataFrame]:
    """Rules 1 to 5, then contiguity before the least history, and the gate.

    All rules run in one pass with one write; each rule's report is counted on the way.
    ``events(symbol, event_date)``, ``keep(symbol, date)``, ``dividends(symbol, date)``, ``windows(start, end)``, ``blind(symbol)``.
    """
    calendar = materialized(calendars.trading_calendar(daily, start=start, end=end, min_symbols=min_symbols))
    seen: list[tuple[str, Observation]] = []

    def counted(name: str, df: DataFrame) -> DataFrame:
        """df, whose rows and symbols are counted as they pass."""
        seen.append((name, Observation(name)))
        return df.observe(seen[-1][1], F.count(F.lit(1)).alias("n_rows"), F.size(F.collect_set("symbol")).cast("long").alias("n_symbols"))

    passing = counted("input", daily)
    for name, rule in (
        ("calendar", lambda df: calendars.calendar_filter(df, calendar)),
        ("prices", clean.drop_bad_prices),
        ("phantoms", lambda df: clean.trim_phantoms(df, excused)),
        ("events", lambda df: clean.after_structural_events(df, events)),
        ("liquidity", lambda df: clean.liquidity_filter(df, floor=floor)),
        ("contiguity", clean.contiguity_filter),
        ("history", lambda df: clean.min_history(df, days=min_days)),
    ):
        passing = counted(name, rule(passing))
    cleaned = stored(spark, out, {"daily_clean": passing})["daily_clean"]
    counts = [(i, name, told.get["n_rows"], told.get["n_symbols"]) for i, (name, told) in enumerate(seen)]
    report = spark.createDataFrame(counts, "step int, rule string, n_rows long, n_symbols long")
    left = materialized(clean.gate_survivors(cleaned, keep, dividends, windows))
    found = {"calendar": calendar, "days_per_year": calendars.days_per_year(calendar), "report": report, "survivors": left, "gate": clean.validation_gate(left, blind)}
    return {"daily_clean": cleaned} | stored(spark, out, found)


def repair(
    spark: SparkSession, cleaned: DataFrame, out: str, *, keep: DataFrame, dividends: DataFrame, windows: DataFrame, blind: DataFrame, crash_windows: DataFrame, min_days: int = DEFAULTS.min_history_days
) -> dict[str, DataFrame]:
    """What fails the gate classified and trimmed, the least history again, and the gate with the crash excused; raises if it fails."""
    left = clean.gate_survivors(cleaned, keep, dividends, windows).filter("NOT excused")
    classified = materialized(clean.classify_survivors(left, keep))
    repaired = materialized(clean.min_history(clean.apply_repair(cleaned, classified), days=min_days))
    again = materialized(clean.gate_survivors(repaired, keep, dividends, windows.unionByName(crash_windows)))
    found = stored(spark, out, {"classification": classified, "daily_clean": repaired, "survivors": again, "gate": clean.validation_gate(again, blind)})
    if not found["gate"].first().passed:
        raise ValueError("the repaired bars don't pass the gate")
    return found


def summarise_universe(spark: SparkSession, daily: DataFrame, sectors: DataFrame, out: str) -> dict[str, DataFrame]:
    """The five universe tables."""
    symbols = daily.select("symbol").distinct().join(sectors.select("symbol", "sector"), "symbol", "left")
    return stored(spark, out, {
        "symbols_per_sector": universe.symbols_per_sector(symbols), "history_length": universe.history_length(daily), "coverage": universe.coverage(daily),
        "returns": universe.return_distribution(daily), "turnover": universe.turnover_distribution(daily),
    })


def correlate(spark: SparkSession, daily: DataFrame, sectors: DataFrame, out: str, *, days: int = DEFAULTS.correlation_days, threshold: float = DEFAULTS.correlation_threshold) -> DataFrame:
    """Ranked same-sector pairs over the last ``days`` days, as Parquet and as a CSV file."""
    span = screen.last_days(daily, days).first()
    pairs = screen.ranked_pairs(screen.screen_pairs(daily, sectors, span.start, span.end, threshold=threshold))
    found = stored(spark, out, {"correlated_pairs": pairs})["correlated_pairs"]
    tables.write_csv(found.orderBy("sector", "rank"), f"{out}/correlated_pairs_csv")
    return found


def cointegrate_last(spark: SparkSession, daily: DataFrame, sectors: DataFrame, out: str, *, target: int = DEFAULTS.train_days, least: int = DEFAULTS.min_train_days, **screening) -> dict[str, DataFrame]:
    """Candidates of the last training window with all flags, ranked, and the funnel of their stages."""
    window = calendars.resolve_windows(daily, target=target, least=least).withColumn("fold_id", F.lit(0))
    tested = materialized(cointegration.cointegrate(daily, sectors, window, **screening))
    found = stored(spark, out, {"cointegrated_pairs": cointegration.ranked(tested), "funnel": cointegration.funnel(tested)})
    tables.write_csv(found["cointegrated_pairs"].orderBy("fold_id", "rank"), f"{out}/cointegrated_pairs_csv")
    tables.write_json(found["funnel"], f"{out}/funnel_json")
    return found


def spread_signals(spark: SparkSession, daily: DataFrame, tested: DataFrame, out: str, *, window: int = DEFAULTS.z_window) -> DataFrame:
    """In-sample signal diagnostics of the tradeable pairs, with their parameters."""
    keys = ["y_sym", "x_sym"]
    chosen = tested.filter(cointegration.is_tradeable()).select(*keys, "sector", "alpha", "beta", "half_life")
    rows = cointegration.aligned_pairs(daily, chosen).withColumn("spread", signals.spread(F.col("y"), F.col("x"), F.col("beta"), F.col("alpha")))
    rows = rows.withColumn("max_holding", backtest.max_holding_days(F.col("half_life")))
    scored = signals.rolling_z(rows.select(*keys, "date", "spread", "max_holding"), keys, "date", window=window)
    run = signals.rolling_signals(scored, keys, "date", max_holding="max_holding")
    facts = chosen.select(*keys, "sector", "beta", "half_life", backtest.max_holding_days(F.col("half_life")).alias("max_holding_limit"), F.lit(window).alias("rolling_window"))
    return stored(spark, out, {"spread_signal_diagnostics": facts.join(signals.signal_diagnostics(run, keys, "date"), keys)})["spread_signal_diagnostics"]


def per_pair_table(per_pair: DataFrame, trades: DataFrame, keys: list[str], date: str) -> DataFrame:
    """(keys, gross and net metrics, n_trades, win_rate, deployed_pct, rank): one row a pair-fold, the best annual net result first.

    deployed_pct is the share of dates with a position.
    """
    gross, net = (backtest.metrics(per_pair, keys, date, v) for v in ("gross", "net"))
    both = gross.select(*keys, "n", *[F.col(c).alias(f"gross_{c}") for c in ("total_pct", "ann_pct", "sharpe")]).join(net.drop("n").select(*keys, *[F.col(c).alias(f"net_{c}") for c in ("total_pct", "ann_pct", "sharpe", "max_drawdown_pct")]), keys)
    held = per_pair.groupBy(*keys).agg((F.avg(F.when(F.col("position") != 0, 1.0).otherwise(0.0)) * 100).alias("deployed_pct"))
    stats = backtest.trade_stats(trades, keys).select(*keys, "n_trades", "win_rate", "avg_held")
    table = both.join(held, keys).join(stats, keys, "left").na.fill(0, ["n_trades"])
    return table.withColumn("rank", F.row_number().over(Window.orderBy(F.col("net_ann_pct").desc_nulls_last(), *keys)))  # a row a pair-fold


def backtest_daily(
    spark: SparkSession, daily: DataFrame, sectors: DataFrame, out: str, *, prior: int = DEFAULTS.train_days, train: int = DEFAULTS.train_days, test: int = DEFAULTS.test_days,
    window: int = DEFAULTS.z_window, cost_bps: float = DEFAULTS.cost_bps_per_leg, **screening,
) -> dict[str, DataFrame]:
    """The walk-forward backtest: folds, candidates, trades, pair and portfolio series, metrics and the funnel by fold."""
    daily = materialized(daily)
    folds = materialized(calendars.build_folds(daily, prior=prior, train=train, test=test))
    run = walkforward.walk_forward(daily, sectors, folds, window=window, cost_bps=cost_bps, **screening)
    found = stored(spark, out, {"folds": folds, "candidates": cointegration.ranked(run["candidates"]), "trades": run["trades"], "per_pair": run["per_pair"], "portfolio": run["portfolio"]})
    sides = F.explode(F.array(*[F.struct(F.lit(v).alias("side"), F.col(v).alias("v")) for v in ("gross", "net")])).alias("s")
    more = {
        "metrics": backtest.metrics(found["portfolio"].select("date", sides).select("s.side", "date", "s.v"), ["side"], "date", "v"),
        "pair_metrics": per_pair_table(found["per_pair"], found["trades"], ["fold_id", "pair"], "date"),
        "trade_stats": backtest.trade_stats(found["trades"].withColumn("side", F.when(F.col("direction") > 0, "long").otherwise("short")), ["side"]),
        "concentration": backtest.concentration(found["trades"], ["fold_id"]),
        "funnel": cointegration.funnel(found["candidates"]),
    }
    found |= stored(spark, out, more)
    tables.write_json(found["funnel"].orderBy("fold_id"), f"{out}/funnel_json")
    tables.write_csv(found["metrics"], f"{out}/metrics_csv")
    return found


def pair_report(spark: SparkSession, daily: DataFrame, sectors: DataFrame, run: dict[str, DataFrame], out: str, *, window: int = DEFAULTS.z_window, width: float = 2.0) -> dict[str, DataFrame]:
    """Each pair of a walk-forward run on its own: its summary, the best first, its curve, its folds' spreads with bands, its positions as intervals and its legs.

    ``run`` are the tables of backtest_daily.
    """
    daily = materialized(daily)
    per_pair = run["per_pair"]
    selected = run["candidates"].filter(cointegration.is_tradeable()).select("fold_id", "y_sym", "x_sym", "alpha", "beta", "half_life")
    found = stored(spark, out, {"pair_summary": cards.per_pair_summary(per_pair, run["trades"], sectors), "pair_bands": cards.fold_bands(daily, selected, run["folds"], window=window, width=width)})
    segments = cards.position_segments(per_pair.select("fold_id", "pair", "date", "position"), ["fold_id", "pair"], "date")
    spans = found["pair_summary"].select("pair", F.split("pair", "~")[0].alias("y_sym"), F.split("pair", "~")[1].alias("x_sym"), "first_active", "last_active")
    found |= stored(spark, out, {
        "pair_curves": cards.stitched_curves(per_pair, ["pair"], "fold_id", "date"), "pair_segments": cards.banded_segments(segments, found["pair_bands"], ["fold_id", "pair"], "date"),
        "pair_legs": cards.leg_levels(daily, spans),
    })
    tables.write_csv(found["pair_summary"].orderBy(F.col("net_total_pct").desc(), "pair"), f"{out}/pair_summary_csv")
    return found
