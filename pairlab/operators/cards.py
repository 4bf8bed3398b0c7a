"""One card a pair: curves stitched over folds, totals, the spread of a representative fold, and segments with bands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlab.checkpoints import materialized
from pairlab.functions import kernels
from pairlab.operators import backtest, signals, walkforward
from pairlab.params import DEFAULTS


def stitched_curves(returns: DataFrame, keys: list[str], fold: str, date: str, value: str = "net") -> DataFrame:
    """(keys, fold, date, carry, cum_pct): cumulative percentage of log returns over all folds of ``keys``, in order of fold and date.

    Each fold sums its own returns; what earlier folds ended with is carried over to the next, so folds are summed apart.
    """
    inside = Window.partitionBy(*keys, fold).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    # One row a fold.
    totals = returns.groupBy(*keys, fold).agg(F.sum(value).alias("total__"))
    earlier = Window.partitionBy(*keys).orderBy(fold).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, fold, F.coalesce(F.sum("total__").over(earlier), F.lit(0.0)).alias("carry"))
    own = returns.select(*keys, fold, date, F.sum(value).over(inside).alias("own__"))
    return own.join(carried, [*keys, fold]).select(*keys, fold, date, "carry", (F.expm1(F.col("carry") + F.col("own__")) * 100).alias("cum_pct"))


def on_union_axis(curves: DataFrame, keys: list[str], variant: str, names: list[str], date: str, value: str = "cum_pct") -> DataFrame:
    """(keys, date, <value>_<name>): a column a variant on the dates of any of them, the last value carried on, 0 before the first.

    Where a variant has a date twice (folds that overlap), the last fold's value counts.
    """
    wide = curves.groupBy(*keys, date).agg(*[F.max_by(value, F.when(F.col(variant) == n, F.struct("fold_id"))).alias(f"{value}_{n}") for n in names])
    w = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return wide.select(*keys, date, *[F.coalesce(F.last(f"{value}_{n}", ignorenulls=True).over(w), F.lit(0.0)).alias(f"{value}_{n}") for n in names])


def representative_folds(pair_folds: DataFrame, trades: DataFrame, pair: str = "pair") -> DataFrame:
    """(pair, fold_id, n_trades): of the folds that a pair was selected in the one with most trades, the first on ties and without trades."""
    n = trades.groupBy(pair, "fold_id").agg(F.count(F.lit(1)).alias("n_trades"))
    both = pair_folds.select(pair, "fold_id").distinct().join(n, [pair, "fold_id"], "left").na.fill(0, ["n_trades"])
    return both.groupBy(pair).agg(F.max_by(F.struct("fold_id", "n_trades"), F.struct("n_trades", -F.col("fold_id"))).alias("best")).select(pair, "best.fold_id", "best.n_trades")


def totals(pair_folds: DataFrame, trades: DataFrame, axis: DataFrame, names: list[str], date: str, pair: str = "pair") -> DataFrame:
    """(pair, folds, n_folds, n_trades_<name>, cum_net_pct_<name>): totals over all folds of a pair; ``axis`` is from on_union_axis."""
    folds = pair_folds.groupBy(pair).agg(F.sort_array(F.collect_set("fold_id")).alias("folds"))
    n = trades.groupBy(pair).agg(*[F.count_if(F.col("regime") == r).alias(f"n_trades_{r}") for r in names])
    ends = axis.groupBy(pair).agg(*[F.max_by(f"cum_pct_{r}", date).alias(f"cum_net_pct_{r}") for r in names])
    joined = folds.join(n, pair, "left").join(ends, pair, "left").na.fill(0)
    return joined.select(pair, "folds", F.size("folds").alias("n_folds"), *[f"n_trades_{r}" for r in names], *[f"cum_net_pct_{r}" for r in names])


def position_segments(states: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, segment_no, direction, start, end, n): the runs of bars with one position, as intervals; flat bars have none."""
    w = Window.partitionBy(*keys).orderBy(order)
    begins = (F.col("position") != 0) & (F.col("position") != F.lag("position", 1, 0).over(w))
    numbered = states.withColumn("segment_no", F.sum(begins.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("position <> 0")
    return numbered.groupBy(*keys, "segment_no").agg(F.min_by("position", order).alias("direction"), F.min(order).alias("start"), F.max(order).alias("end"), F.count(F.lit(1)).alias("n"))


def banded_segments(segments: DataFrame, bands: DataFrame, keys: list[str], order: str) -> DataFrame:
    """segments with the spread and bands where they begin and end, and how many of their bars lie outside the bands.

    ``bands`` is from signals.rolling_bands; each bar lies in one segment at most, the last that began by then,
    so no bar is compared with all segments.
    """
    own = ["segment_no", "direction", "start", "end", "n"]
    bars = bands.select(*keys, order, "spread", "lower", "roll_mean", "upper", F.lit(1).alias("bar__"))
    begins = segments.select(*keys, F.col("start").alias(order), F.struct(*own).alias("segment__"), F.lit(0).alias("bar__"))
    so_far = Window.partitionBy(*keys).orderBy(order, "bar__").rowsBetween(Window.unboundedPreceding, 0)
    met = bars.unionByName(begins, allowMissingColumns=True).withColumn("segment__", F.last("segment__", ignorenulls=True).over(so_far))
    inside = met.filter((F.col("bar__") == 1) & (F.col(order) <= F.col("segment__.end"))).select(*keys, order, "spread", "lower", "roll_mean", "upper", "segment__.*")
    here = F.struct("spread", "lower", "roll_mean", "upper")
    outside = (F.col("spread") > F.col("upper")) | (F.col("spread") < F.col("lower"))
    found = inside.groupBy(*keys, "segment_no", "direction", "start", "end", "n").agg(F.min_by(here, order).alias("a"), F.max_by(here, order).alias("b"), F.count_if(outside & ~F.isnan("upper")).alias("n_outside"))
    each = [F.col(f"{s}.{c}").alias(f"{name}_{c}") for s, name in (("a", "start"), ("b", "end")) for c in ("spread", "lower", "roll_mean", "upper")]
    return found.select(*keys, "segment_no", "direction", "start", "end", "n", *each, "n_outside")


def segments_in_blocks(blocked: DataFrame, keys: list[str], *, window: int = DEFAULTS.z_window, width: float = 2.0, **limits) -> DataFrame:
    """banded_segments of the positions of groups that are cut into blocks, with start and end by place; ``blocked`` and ``limits`` are those of signals.signals_in_blocks.

    A block gives its runs of bars with one position, the first as the rest of a segment if that began before; only these
    rows meet, never bars.
    """
    limits = {"entry": DEFAULTS.entry_z, "exit_": DEFAULTS.exit_z, "stop": DEFAULTS.stop_z, "max_holding": DEFAULTS.max_holding} | limits
    ready = signals.states_in_blocks(blocked, keys, window=window, **limits)
    machine = [limits[k] for k in ("entry", "exit_", "stop", "max_holding")]
    ends = [f"{side}_{c}" for side in ("start", "end") for c in ("spread", "lower", "roll_mean", "upper")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lead, x, z = (signals._series(batch[c][i]) for c in ("lead", "spread", "z"))
                side, bars = kernels.machine_state(batch["state"][i].as_py(), machine[3])
                position = kernels.rolling_machine(z, *machine, side, bars)[0].astype(np.int32)
                mean, deviation = (v[len(lead) :] for v in signals.rolled(np.r_[lead, x], window))
                lower, upper = mean - width * deviation, mean + width * deviation
                outside = ((x > upper) | (x < lower)).astype(np.int64)
                first = np.flatnonzero(np.r_[True, position[1:] != position[:-1]])
                last = np.r_[first[1:], len(x)] - 1
                beyond = np.add.reduceat(outside, first)
                kept = position[first] != 0
                first, last, beyond = first[kept], last[kept], beyond[kept]
                begun = np.cumsum((first > 0) | (position[first] != side))
                begin = batch["begin"][i].as_py()
                found = [begun, position[first], begin + first, begin + last, last - first + 1, *[v[at] for at in (first, last) for v in (x, lower, mean, upper)], beyond]
                same = [pa.repeat(batch[k][i], len(first)) for k in (*keys, "block")]
                yield pa.RecordBatch.from_arrays([*same, *[pa.array(f) for f in found]], names=[*keys, "block", *names])

    names = ["begun", "direction", "start", "end", "n", *ends, "n_outside"]
    schema = signals._fields(blocked, [*keys, "block"]) + ", begun long, direction int, start long, end long, n long, " + ", ".join(f"{c} double" for c in ends) + ", n_outside long"
    pieces = materialized(ready.mapInArrow(run, schema))  # a row a segment and block
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = pieces.groupBy(*keys, "block").agg(F.max("begun").alias("begun"))
    carried = counts.select(*keys, "block", F.coalesce(F.sum("begun").over(earlier), F.lit(0)).alias("carried"))
    numbered = pieces.join(F.broadcast(carried), [*keys, "block"]).withColumn("segment_no", F.col("carried") + F.col("begun"))
    here = [F.min_by(c, "start").alias(c) if c.startswith("start") else F.max_by(c, "start").alias(c) for c in ends]
    return numbered.groupBy(*keys, "segment_no").agg(F.min_by("direction", "start").alias("direction"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), *here, F.sum("n_outside").alias("n_outside"))


def fold_bands(daily: DataFrame, selected: DataFrame, folds: DataFrame, *, window: int = DEFAULTS.z_window, width: float = 2.0) -> DataFrame:
    """(fold_id, pair, date, spread, lower, roll_mean, upper) over the test windows, with each fold's coefficients and days before the test so that bands are there from its first day."""
    rows = walkforward.fold_prices(daily, selected, folds, window=window).withColumn("pair", F.concat_ws("~", "y_sym", "x_sym"))
    rows = rows.select("fold_id", "pair", "date", "in_test", signals.spread(F.col("y"), F.col("x"), F.col("beta"), F.col("alpha")).alias("spread"))
    return signals.rolling_bands(rows, ["fold_id", "pair"], "date", window=window, width=width).filter("in_test").drop("in_test")


def leg_levels(daily: DataFrame, spans: DataFrame) -> DataFrame:
    """(pair, date, y_level, x_level): closes on common dates within ``spans(pair, y_sym, x_sym, first_active, last_active)``, divided by the first."""
    y = daily.select(F.col("symbol").alias("y_sym"), "date", F.col("close").alias("y"))
    x = daily.select(F.col("symbol").alias("x_sym"), "date", F.col("close").alias("x"))
    both = spans.join(y, "y_sym").filter(F.col("date").between(F.col("first_active"), F.col("last_active"))).join(x, ["x_sym", "date"])
    both = materialized(both.filter("y IS NOT NULL AND x IS NOT NULL").select("pair", "date", "y", "x"))  # first closes and levels both read it
    # A row a pair each.
    start = both.groupBy("pair").agg(F.min("date").alias("date"))
    first = both.join(F.broadcast(start), ["pair", "date"]).groupBy("pair").agg(F.first("y").alias("y_first"), F.first("x").alias("x_first"))
    return both.join(F.broadcast(first), "pair").select("pair", "date", *[F.try_divide(c, f"{c}_first").alias(f"{c}_level") for c in ("y", "x")])


#: The columns of per_pair_summary, in the order of its file.
SUMMARY = [
    "pair", "sector", "n_trades", "first_active", "last_active", "n_obs", "gross_total_pct", "net_total_pct", "gross_ann_pct", "net_ann_pct", "gross_sharpe", "net_sharpe", "net_max_drawdown_pct",
    "win_rate_net", "avg_holding_days", "n_exits_mean_revert", "n_exits_stop", "n_exits_time", "n_exits_fold_boundary", "top1_pos_pnl_share", "top2_pos_pnl_share",
]


def per_pair_summary(per_pair: DataFrame, trades: DataFrame, sectors: DataFrame, *, part: str | None = None) -> DataFrame:
    """One row a pair over all its folds, with the columns SUMMARY; ``per_pair(pair, date, gross, net)``, ``trades(pair, net_log, held, exit_reason)``.

    A pair's sector is that of its first leg; a pair without trades has zeros in their columns.
    ``part`` as in backtest.metrics.
    """
    gross, net = (backtest.metrics(per_pair, ["pair"], "date", v, part=part) for v in ("gross", "net"))
    gross = gross.select("pair", *[F.col(c).alias(f"gross_{c}") for c in ("total_pct", "ann_pct", "sharpe")])
    net = net.select("pair", *[F.col(c).alias(f"net_{c}") for c in ("total_pct", "ann_pct", "sharpe", "max_drawdown_pct")])
    active = per_pair.groupBy("pair").agg(F.min("date").alias("first_active"), F.max("date").alias("last_active"), F.count(F.lit(1)).alias("n_obs"))
    done = trades.groupBy("pair").agg(
        F.count(F.lit(1)).alias("n_trades"), F.avg(F.when(F.col("net_log") > 0, 1.0).otherwise(0.0)).alias("win_rate_net"), F.avg("held").cast("double").alias("avg_holding_days"),
        *[F.count_if(F.col("exit_reason") == e).alias(f"n_exits_{e}") for e in ("mean_revert", "stop", "time", "fold_boundary")],
    )
    best = backtest.concentration(trades, ["pair"]).select("pair", F.col("top1_share").alias("top1_pos_pnl_share"), F.col("top2_share").alias("top2_pos_pnl_share"))
    own = sectors.select(F.col("symbol").alias("y_sym"), "sector").dropDuplicates(["y_sym"])
    whole = active.join(gross, "pair", "left").join(net, "pair", "left").join(done, "pair", "left").join(best, "pair", "left")
    whole = whole.withColumn("y_sym", F.split("pair", "~")[0]).join(own, "y_sym", "left")
    counted = ["n_trades", "win_rate_net", "avg_holding_days", *[f"n_exits_{e}" for e in ("mean_revert", "stop", "time", "fold_boundary")], "top1_pos_pnl_share", "top2_pos_pnl_share"]
    return whole.na.fill(0, counted).na.fill("", ["sector"]).select(*SUMMARY)
