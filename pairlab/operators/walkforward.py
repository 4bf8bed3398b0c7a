"""Walk-forward backtest on daily bars: all folds in one plan, no row of a test window before selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pairlab.checkpoints import materialized
from pairlab.functions import kernels
from pairlab.operators import backtest, signals, spans
from pairlab.operators.calendars import numbered_days, within
from pairlab.operators.cointegration import cointegrate, is_tradeable
from pairlab.params import DEFAULTS


def _warm_starts(days: DataFrame, folds: DataFrame, window: int) -> DataFrame:
    """(fold_id, warm_start, test_start, test_end): the day window - 1 days before each test window; ``days`` is from numbered_days."""
    starts = folds.select("fold_id", "test_start", "test_end").join(days.withColumnRenamed("date", "test_start"), "test_start").withColumn("i", F.greatest(F.col("i") - (window - 1), F.lit(0)))
    return starts.join(days.withColumnRenamed("date", "warm_start"), "i").select("fold_id", "warm_start", "test_start", "test_end")


def fold_prices(daily: DataFrame, selected: DataFrame, folds: DataFrame, *, window: int = DEFAULTS.z_window) -> DataFrame:
    """Aligned closes y, x of each selected pair from window - 1 days before its test window to its end; in_test marks the test."""
    wanted = selected.join(_warm_starts(numbered_days(daily), folds, window), "fold_id")
    y = daily.select(F.col("symbol").alias("y_sym"), "date", F.col("close").alias("y"))
    x = daily.select(F.col("symbol").alias("x_sym"), "date", F.col("close").alias("x"))
    rows = within(y, wanted, "warm_start", "test_end", by=("y_sym",)).join(x, ["x_sym", "date"])
    return rows.withColumn("in_test", F.col("date") >= F.col("test_start"))


_BARS = "date date, spread double, z double, position int, held int, exit_reason string, position_before int, held_before int, gross double, ends boolean"
_BAR_NAMES = [f.split()[0] for f in _BARS.split(", ")]
_BAR_TYPES = [pa.date32(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.bool_()]


def _bars(y: tuple[np.ndarray, np.ndarray], x: tuple[np.ndarray, np.ndarray], p: dict, axis: np.ndarray, window: int, limits: tuple[float, float, float]) -> list | None:
    """The columns _BARS of a pair on the days of axis, flat where it has no bar; None without any."""
    days, a, b = spans.aligned(*(spans.cut(leg, p["lo"], p["hi"]) for leg in (y, x)))
    if (a <= 0).any() or (b <= 0).any():
        raise ValueError("prices must be positive")
    value = np.log(a) - p["beta"] * np.log(b) - p["alpha"]
    mean, deviation = signals.rolled(value, window)
    z, ok = np.full(len(value), np.nan), deviation > 0
    z[ok] = (value[ok] - mean[ok]) / deviation[ok]
    test = np.searchsorted(days, p["start"])
    days, value, z = days[test:], value[test:], z[test:]
    if not len(days):
        return None
    position, held, reason = kernels.rolling_machine(z, *limits, p["limit"])
    before, move = np.r_[0, position[:-1]], np.diff(np.r_[np.nan, value])
    gross, ends = before * np.where(np.isnan(move), 0.0, move), np.array([r is not None for r in reason])
    if position[-1]:
        ends[np.flatnonzero(~np.isnan(value))[-1]] = True
    found = [value, z, position, held, np.array(reason, object), before, np.r_[0, held[:-1]], gross, ends]
    if len(axis) == len(days):
        return [days, *found]
    at = np.searchsorted(axis, days)
    wide = [np.full(len(axis), None if f.dtype == object else np.nan if i < 2 else 0, f.dtype) for i, f in enumerate(found)]
    for w, f in zip(wide, found):
        w[at] = f
    return [axis, *wide]


def _run(daily: DataFrame, days: DataFrame, selected: DataFrame, folds: DataFrame, window: int, limits: tuple[float, float, float]) -> DataFrame:
    """(fold_id, pair, beta, and _BARS) of the selected pairs on every day of their test windows; units of pairs of neighbouring folds run in tasks of their own."""
    held, many = spans.in_chunks(_warm_starts(days, folds, window), "warm_start")
    named = selected.select("y_sym").union(selected.select("x_sym")).distinct().withColumnRenamed("y_sym", "symbol")
    reach = held.select("chunk", F.col("warm_start").alias("lo"), F.col("test_end").alias("hi"))
    met = spans.legs(daily.join(named, "symbol", "left_semi"), reach)
    ends = reach.groupBy("chunk").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    axis = within(days.select("date"), ends, "lo", "hi").groupBy("chunk").agg(F.sort_array(F.collect_list(F.unix_date("date"))).alias("axis"))
    day = lambda c, name: F.unix_date(c).alias(name)
    asked = selected.join(F.broadcast(held), "fold_id").select(
        "chunk", "fold_id", "y_sym", "x_sym", "alpha", "beta", backtest.max_holding_days(F.col("half_life")).alias("limit"), day("warm_start", "lo"), day("test_start", "start"), day("test_end", "hi")
    )
    fold = to_arrow_type(selected.schema["fold_id"].dataType)
    names, types = ["fold_id", "pair", "beta", *_BAR_NAMES], [fold, pa.string(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                closes, dates, unit = spans.series(batch["legs"][i]), batch["axis"][i].values.to_numpy(), []
                for p in batch["asked"][i].as_py():
                    if p["y_sym"] not in closes or p["x_sym"] not in closes:
                        continue
                    own = dates[np.searchsorted(dates, p["start"]) : np.searchsorted(dates, p["hi"], "right")]
                    found = _bars(closes[p["y_sym"]], closes[p["x_sym"]], p, own, window, limits)
                    if found is not None:
                        same = [pa.repeat(pa.scalar(v, t), len(own)) for v, t in zip((p["fold_id"], f"{p['y_sym']}~{p['x_sym']}", p["beta"]), types)]
                        first = pa.array(found[0].astype(np.int32)).view(pa.date32())
                        unit.append(pa.RecordBatch.from_arrays([*same, first, *[pa.array(c if t != pa.int32() else c.astype(np.int32), t) for c, t in zip(found[1:], _BAR_TYPES[1:])]], names=names))
                if unit:
                    yield from pa.Table.from_batches(unit).combine_chunks().to_batches()  # one for all pairs

    rows = spans.units(met, asked, ("y_sym", "x_sym"), ["fold_id", "y_sym", "x_sym"], many).join(F.broadcast(axis), "chunk").select("asked", "legs", "axis")
    return rows.mapInArrow(run, f"fold_id {selected.schema['fold_id'].dataType.simpleString()}, pair string, beta double, {_BARS}")


def run_selected(daily: DataFrame, selected: DataFrame, folds: DataFrame, *, window: int = DEFAULTS.z_window, cost_bps: float = DEFAULTS.cost_bps_per_leg, entry: float = DEFAULTS.entry_z, exit_: float = DEFAULTS.exit_z, stop: float = DEFAULTS.stop_z, keep: bool = True) -> dict[str, DataFrame]:
    """Trades, per-pair and portfolio series of ``selected(fold_id, y_sym, x_sym, alpha, beta, half_life)``.

    Coefficients are frozen; z uses the warm-up rows, the machine starts flat at the test window. Each bar knows the one before
    and whether a trade ends there, so series, costs and trades need not meet. ``keep`` computes the bars once for the three tables; without it they are
    computed with each table that is read, and take no disk.
    """
    if min(entry, exit_, stop) <= 0 or exit_ >= entry or stop <= entry:
        raise ValueError("needs 0 < exit < entry < stop")
    signals._check(window, window)
    days = materialized(numbered_days(daily))  # a row a day
    run = _run(daily, days, selected, folds, window, (entry, exit_, stop))
    run = materialized(run) if keep else run
    cost = lambda beta: backtest.pair_cost(F.col(beta), cost_bps, guard=False)
    keys = ["fold_id", "pair"]
    events = run.filter(F.col("ends") | ((F.col("position_before") == 0) & (F.col("position") != 0)))
    closed = backtest.trades(events, keys, "date", carry=("z", "beta"), before="held_before").withColumn("cost_log", cost("exit_beta"))
    closed = closed.withColumn("net_log", F.col("gross_log") - F.col("cost_log"))
    per_pair = run.select(*keys, "date", "gross", (F.col("gross") - F.when(F.col("ends"), cost("beta")).otherwise(0.0)).alias("net"), "position")
    axis = within(days.select("date"), folds.select("fold_id", "test_start", "test_end"), "test_start", "test_end").select("fold_id", "date")
    n = selected.groupBy("fold_id").agg(F.count(F.lit(1)).alias("n_selected_pairs"))
    port = per_pair.groupBy("fold_id", "date").agg(F.avg("gross").alias("gross"), F.avg("net").alias("net"), F.count_if(F.col("position") != 0).alias("n_active_pairs"))
    port = axis.join(port, ["fold_id", "date"], "left").join(n, "fold_id", "left").na.fill(0)
    return {"trades": closed, "per_pair": per_pair, "portfolio": port}


def walk_forward(daily: DataFrame, sectors: DataFrame, folds: DataFrame, *, window: int = DEFAULTS.z_window, cost_bps: float = DEFAULTS.cost_bps_per_leg, keep: bool = True, **screening) -> dict[str, DataFrame]:
    """Selection on every fold's training window, then run_selected; also the candidate table. ``keep`` as in run_selected."""
    tested = materialized(cointegrate(daily, sectors, folds, **screening))
    selected = tested.filter(is_tradeable()).select("fold_id", "y_sym", "x_sym", "alpha", "beta", "half_life")
    return {"candidates": tested, **run_selected(daily, selected, folds, window=window, cost_bps=cost_bps, keep=keep)}
