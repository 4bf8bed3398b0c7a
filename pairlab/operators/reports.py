"""Roll-ups behind report tables and figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlab.checkpoints import materialized, small
from pairlab.operators.backtest import metrics
from pairlab.operators.blocks import running_sums
from pairlab.operators.grid import EXIT_ORDER, exit_name


def equity_curve(returns: DataFrame, keys: list[str], date: str, values: tuple[str, ...] = ("gross", "net"), *, part: str | None = None) -> DataFrame:
    """Cumulative percentages of log returns by date; ``part`` may name a column that rises with it, for sums in blocks."""
    if part is not None:
        summed = running_sums(returns.select(*keys, date, part, *values), keys, date, part, {f"sum__{v}": v for v in values})
        return summed.select(*keys, date, *[(F.expm1(F.col(f"sum__{v}")) * 100).alias(f"cum_{v}_pct") for v in values])
    w = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return returns.select(*keys, date, *[(F.expm1(F.sum(v).over(w)) * 100).alias(f"cum_{v}_pct") for v in values])


def equity_union(returns: DataFrame, variant: str, names: list[str], date: str, value: str = "net") -> DataFrame:
    """One row a date of any variant and a column a variant, 0 where it has no row."""
    return returns.groupBy(date).pivot(variant, names).agg(F.sum(value)).na.fill(0.0, names)


def forward_filled(curves: DataFrame, axis: DataFrame, keys: list[str], date: str, value: str) -> DataFrame:
    """Curves on all dates of ``axis``, the last value carried on, 0 before the first."""
    w = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    spine = curves.select(*keys).distinct().crossJoin(small(axis.select(date).distinct())) if axis is not None else curves
    joined = spine.join(curves, [*keys, date], "left")
    return joined.select(*keys, date, F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(0.0)).alias(value))


def exit_pivot(trades: DataFrame, by: list[str]) -> DataFrame:
    """(by, one column an exit in fixed order): counts, 0 where there are none."""
    named = trades.withColumn("exit_name", exit_name())
    return named.groupBy(*by).agg(*[F.count_if(F.col("exit_name") == e).alias(e) for e in EXIT_ORDER])


def beta_summary(rows: DataFrame, traded: DataFrame, keys: list[str]) -> DataFrame:
    """(universe, n, mean, median) of (1 + beta) / 2 over all pairs and over those traded."""
    all_, some = rows.withColumn("universe", F.lit("all")), rows.join(traded.select(*keys).distinct(), keys, "left_semi").withColumn("universe", F.lit("traded"))
    m = (1 + F.col("beta")) / 2
    return all_.unionByName(some).groupBy("universe").agg(F.count(F.lit(1)).alias("n"), F.avg(m).alias("mean_multiplier"), F.percentile(m, F.lit(0.5)).alias("median_multiplier"))


def half_life_bands(fits: DataFrame, by: list[str], half_life: str, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """(by, n_fit_ok, n in each band)."""
    return fits.groupBy(*by).agg(F.count_if("fit_ok").alias("n_fit_ok"), *[F.count_if(F.col(half_life).between(*b)).alias(f"n_band_{name}") for name, b in bands.items()])


def trade_counts(trades: DataFrame, by: list[str], pivot: str, names: list[str]) -> DataFrame:
    """(by, n_trades_<name>): counts by the values of ``pivot``."""
    return trades.groupBy(*by).agg(*[F.count_if(F.col(pivot) == n).alias(f"n_trades_{n}") for n in names])


def matched_universe(sessions: DataFrame, universe: DataFrame, keys: list[str], by: list[str], date: str, value: str = "net") -> DataFrame:
    """Portfolio metrics by ``by`` over the pair-folds of ``universe`` only."""
    chosen = sessions.join(universe.select(*keys).distinct(), keys, "left_semi")
    port = chosen.groupBy(*by, date).agg(F.avg(value).alias(value))
    return metrics(port, by, date, value)


def matched_ladder(sessions: DataFrame, trades: DataFrame, universe: DataFrame, keys: list[str], by: list[str], date: str) -> DataFrame:
    """(by, n_trades, gross and net total_pct and sharpe): portfolios and trades of all ``by`` over the same pair-folds, those of ``universe``.

    ``sessions(keys, by, date, gross, net)``; a row a trade in ``trades(keys, by)``. What has no session of the universe has no row.
    """
    chosen = sessions.join(small(universe.select(*keys).distinct()), keys, "left_semi")
    port = materialized(chosen.groupBy(*by, date).agg(F.avg("gross").alias("gross"), F.avg("net").alias("net")))  # a row a session and variant
    sides = [metrics(port, by, date, v).select(*by, F.col("total_pct").alias(f"{v}_total_pct"), F.col("sharpe").alias(f"{v}_sharpe")) for v in ("gross", "net")]
    n = trades.join(small(universe.select(*keys).distinct()), keys, "left_semi").groupBy(*by).agg(F.count(F.lit(1)).alias("n_trades"))
    return sides[0].join(sides[1], by).join(n, by, "left").na.fill(0, ["n_trades"])


def excluding(sessions: DataFrame, excluded: DataFrame, keys: list[str]) -> DataFrame:
    """sessions twice, as variant ``all`` and, without the excluded pairs, ``ex_listed``."""
    rest = sessions.join(excluded.select(*keys).distinct(), keys, "left_anti")
    return sessions.withColumn("variant", F.lit("all")).unionByName(rest.withColumn("variant", F.lit("ex_listed")))


def representative(trades: DataFrame, pair: str, fold: str) -> DataFrame:
    """(pair, fold): the fold with most trades of each pair, the first on ties."""
    n = trades.groupBy(pair, fold).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(pair).agg(F.max_by(fold, F.struct("n", -F.col(fold))).alias(fold))


def stage_funnel(counts: DataFrame, by: list[str], stages: list[str]) -> DataFrame:
    """(by, stage_no, stage, n): counts by column as rows in order."""
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("stage_no"), F.lit(s).alias("stage"), F.col(s).cast("long").alias("n")) for i, s in enumerate(stages)])).alias("r")
    return counts.select(*by, rows).select(*by, "r.stage_no", "r.stage", "r.n")


def union_metrics(tables: list[DataFrame]) -> DataFrame:
    """Tables of metrics one under another; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def with_markers(rows: DataFrame, trades: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows with entry_direction, exit_reason_at and trade_no where a trade begins or ends, null elsewhere.

    A bar on which one trade ends and another begins has one row, with both.
    """
    begins = trades.select(*keys, F.col(f"entry_{order}").alias(order), F.col("direction").alias("entry_direction"), F.col("trade_no").alias("entry_trade"))
    ends = trades.select(*keys, F.col(f"exit_{order}").alias(order), exit_name().alias("exit_reason_at"), F.col("trade_no").alias("exit_trade"))
    return rows.join(begins, [*keys, order], "left").join(ends, [*keys, order], "left")


def latest(cached: DataFrame, key: list[str], written: str) -> DataFrame:
    """Of the rows of each key the one that was written last."""
    order = Window.partitionBy(*key).orderBy(F.col(written).desc())
    return cached.withColumn("n__", F.row_number().over(order)).filter("n__ = 1").drop("n__")


def density(histogram: DataFrame, width: float) -> DataFrame:
    """A histogram (bin, n) with its density: shares divided by the bins' width."""
    total = histogram.agg(F.sum("n").alias("total"))  # one row
    return histogram.crossJoin(F.broadcast(total)).withColumn("density", F.try_divide(F.col("n") / width, F.col("total"))).drop("total")
