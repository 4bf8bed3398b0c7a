"""The rolling-z engine on intraday bars, in both regimes and at all costs, for all pair-folds at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlab.checkpoints import materialized
from pairlab.operators import backtest, signals
from pairlab.operators.intraday import window_minutes
from pairlab.params import DEFAULTS


def bar_windows(pair_folds: DataFrame, *, freq: int = 1, bars: int = DEFAULTS.bars_per_session, cap_days: int = DEFAULTS.max_holding, multiplier: float = DEFAULTS.holding_multiplier) -> DataFrame:
    """pair_folds (with half_life in days) and, in bars of ``freq`` minutes, window (2 at least) and max_holding.

    max_holding is at least the window, and at most cap_days sessions.
    """
    minutes = window_minutes(F.col("half_life"), bars=bars)
    longest = F.greatest(minutes, F.least(F.lit(cap_days * bars), F.bround(F.col("half_life") * bars * multiplier).cast("int")))
    each = lambda c, least: F.greatest(F.bround(c / freq).cast("int"), F.lit(least))
    return pair_folds.withColumn("window", each(minutes, 2)).withColumn("max_holding", each(longest, 1))


def run(bars: DataFrame, pair_folds: DataFrame, keys: list[str], order: str, session: str, *, ladder: DataFrame, warmup: int = DEFAULTS.warmup_bars, entry: float = DEFAULTS.entry_z, exit_: float = DEFAULTS.exit_z, stop: float = DEFAULTS.stop_z) -> dict[str, DataFrame]:
    """Trades, session sums by regime and cost, and portfolio metrics.

    ``bars`` has keys, order, session, in_test, tradeable and spread over training and test; ``pair_folds``
    has keys, beta, window and max_holding. z runs over both parts and its first ``warmup`` bars of each
    session are NaN; pair-folds whose test has fewer rows than the window are left out.
    """
    rows = bars.join(pair_folds.select(*keys, "beta", "window", "max_holding"), keys)
    scored = signals.variable_rolling_z(rows, keys, order, "window")
    place = F.row_number().over(Window.partitionBy(*keys, session).orderBy(order))
    scored = scored.withColumn("z", F.when(place <= warmup, F.lit(float("nan"))).otherwise(F.col("z"))).filter("in_test")
    enough = scored.withColumn("n__", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter(F.col("n__") >= F.col("window")).drop("n__")
    enough = materialized(enough)  # both regimes read it
    trades, sums = [], []
    for regime in ("A", "B"):
        own = {"session": session, "tradeable": "tradeable"} if regime == "A" else {}
        states = materialized(signals.rolling_signals(enough, keys, order, entry=entry, exit_=exit_, stop=stop, max_holding="max_holding", **own))
        closed = backtest.trades(states, keys, order, carry=(session, "z", "beta"), finalize=regime == "B").withColumn("beta", F.col("exit_beta"))
        moved = backtest.position_returns(states, keys, order, session=session if regime == "A" else None)
        trades.append(closed.withColumn("regime", F.lit(regime)))
        sums.append(backtest.restamp(moved, closed, keys, order, session, ladder).withColumn("regime", F.lit(regime)))
    sessions = sums[0].unionByName(sums[1])
    pair = F.concat_ws("~", *[F.col(k).cast("string") for k in keys])
    port = backtest.portfolio(sessions.withColumn("pair", pair), ["regime", "spread_bps", session])
    return {"trades": trades[0].unionByName(trades[1]), "sessions": sessions, "portfolio": port, "metrics": backtest.metrics(port, ["regime", "spread_bps"], session, "net")}
