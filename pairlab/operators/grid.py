"""Grids of engine, frequency, regime, cost and stop, run as rows of one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlab.checkpoints import materialized
from pairlab.operators import backtest, signals
from pairlab.params import DEFAULTS

#: The order of exits in tables, and their names in exports.
EXIT_NAMES = {"mean_revert": "mean_revert", "stop": "z_stop", "z_stop": "z_stop", "time": "time_stop", "time_stop": "time_stop", "session_close": "eod_squareoff", "fold_boundary": "fold_close"}
EXIT_ORDER = ("mean_revert", "z_stop", "time_stop", "eod_squareoff", "fold_close", "__OTHER__")


def cells(spark: SparkSession, *, freqs=(1, 5, 15), costs=DEFAULTS.spread_ladder_bps, regimes=("A", "B"), hard_stop: float | None = 4.0, stop_cost: float = 3.0) -> DataFrame:
    """(cell_id, engine, freq_min, regime, spread_bps, stop_mode): the full grid, and the stop ablation at one cost."""
    base = [("ou", int(f), r, float(c), "none") for f in freqs for r in regimes for c in costs]
    stops = [("ou", int(f), r, float(stop_cost), "hard") for f in freqs for r in regimes] if hard_stop else []
    rows = ", ".join(f"({i}, '{e}', {f}, '{r}', double('{c}'), '{s}')" for i, (e, f, r, c, s) in enumerate(base + stops))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS cells(cell_id, engine, freq_min, regime, spread_bps, stop_mode)")


def smoke_cells(spark: SparkSession) -> DataFrame:
    """The one cell of a first trial."""
    return cells(spark, freqs=(5,), costs=(3.0,), regimes=("A",), hard_stop=None)


def reduced_cells(spark: SparkSession) -> DataFrame:
    """The eight cells of one frequency, without the stop ablation."""
    return cells(spark, freqs=(5,), hard_stop=None)


def rolling_cells(spark: SparkSession, *, freqs=(5, 15), costs=DEFAULTS.spread_ladder_bps) -> DataFrame:
    """The sixteen cells of the rolling baseline."""
    return cells(spark, freqs=freqs, costs=costs, hard_stop=None).withColumn("engine", F.lit("rolling"))


def exit_name(reason="exit_reason"):
    """The export name of an exit reason; unknown ones are __OTHER__."""
    names = F.create_map(*[F.lit(x) for kv in EXIT_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.col(reason)), F.lit("__OTHER__"))


def exclusions(fits: DataFrame, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """fits (with freq_min, regime, spread_bps, feasible) and exclusion_reason, the first that applies; null for survivors."""
    lo = F.coalesce(*[F.when(F.col("regime") == r, F.lit(float(b[0]))) for r, b in bands.items()])
    hi = F.coalesce(*[F.when(F.col("regime") == r, F.lit(float(b[1]))) for r, b in bands.items()])
    outside = ~F.coalesce(F.col("half_life").between(lo, hi), F.lit(False))
    reason = F.when(F.col("fit_ok").isNull(), "no_cache").when(~F.col("fit_ok"), "no_reversion").when(outside, "hl_band").when(~F.col("feasible"), "infeasible_at_cost")
    return fits.withColumn("exclusion_reason", reason)


def exclusion_counts(marked: DataFrame, by: list[str]) -> DataFrame:
    n = lambda c, name: F.count_if(c).alias(name)
    r = F.col("exclusion_reason")
    return marked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_total"), n(r == "no_reversion", "n_excluded_no_reversion"), n(r == "hl_band", "n_excluded_hl_band"),
        n(r == "infeasible_at_cost", "n_excluded_infeasible"), n(r == "no_cache", "n_excluded_other"), n(r.isNull(), "n_survivors"),
    )


def run_cells(bars: DataFrame, plans: DataFrame, keys: list[str], order: str, date: str, *, hard_stop: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """(trades, pair_sessions) of all surviving pair-folds of all cells.

    ``bars`` has keys, order, session, date, tradeable, spread and z_ou; ``plans`` has keys, cell_id, regime,
    stop_mode, a_z, max_holding and cost_log. Pair-folds meet their cells in a join, so one pass of the machine runs the grid.
    """
    each = bars.select(*keys, order, "session", *([date] if date != "session" else []), "tradeable", "spread", "z_ou").join(
        plans.select(*keys, "cell_id", "regime", "stop_mode", "a_z", "max_holding", "cost_log"), keys
    )
    own = ["cell_id", *keys]
    run = materialized(signals.ou_cells(each, own, order, "session", hard_stop=hard_stop))  # trades and returns both read it
    done = backtest.trades(run, own, order, carry=tuple(dict.fromkeys(("z_ou", date, "cost_log", "regime", "stop_mode"))))
    done = done.filter((F.col("exit_regime") != "A") | (F.col("exit_reason") != "fold_boundary"))
    done = done.withColumn("regime", F.col("exit_regime")).withColumn("stop_mode", F.col("exit_stop_mode")).drop("entry_regime", "exit_regime", "entry_stop_mode", "exit_stop_mode")
    overnight = F.col("regime") == "A"
    same = F.coalesce(F.lag("session").over(Window.partitionBy(*own).orderBy(order)) == F.col("session"), F.lit(False))
    moved = backtest.position_returns(run, own, order).withColumn("gross", F.when(overnight & ~same, 0.0).otherwise(F.col("gross")))
    net = backtest.deduct_costs(moved, done, own, order, F.col("exit_cost_log"))
    trades = done.withColumn("cost_log", F.col("exit_cost_log")).withColumn("net_log", F.col("gross_log") - F.col("exit_cost_log"))
    return trades, backtest.session_sums(net, own, date)


def cell_metrics(all_cells: DataFrame, trades: DataFrame, sessions: DataFrame, excluded: DataFrame, date: str, *, pair: str = "pair") -> DataFrame:
    """One row a cell, cells without trades too: portfolio metrics, exits and exclusions."""
    port = backtest.portfolio(sessions, ["cell_id", date], pair=pair)
    gross, net = (backtest.metrics(port, ["cell_id"], date, v) for v in ("gross", "net"))
    n_pairs = sessions.groupBy("cell_id").agg(F.count_distinct(pair).alias("n_pairs"))
    named = trades.withColumn("exit_name", exit_name())
    exits = named.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_trades"), F.avg("held").alias("avg_bars_held"), *[F.count_if(F.col("exit_name") == e).alias(f"exit_{e}") for e in EXIT_ORDER[:-1]])
    named_metrics = gross.select("cell_id", F.col("n").alias("n_sessions"), F.col("total_pct").alias("gross_total_pct"), F.col("ann_pct").alias("gross_ann_pct"), F.col("sharpe").alias("gross_sharpe"))
    net = net.select("cell_id", F.col("total_pct").alias("net_total_pct"), F.col("ann_pct").alias("net_ann_pct"), F.col("sharpe").alias("net_sharpe"), F.col("max_drawdown_pct").alias("net_max_drawdown_pct"))
    out = all_cells
    for t in (named_metrics, net, n_pairs, exits, excluded):
        out = out.join(t, "cell_id", "left")
    return out.na.fill(0, ["n_pairs", "n_trades", "n_sessions"])
