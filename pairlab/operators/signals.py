"""Spreads, rolling z-scores and position state machines.

Everything at a row depends on rows up to it. NaN, not null, marks bars without a spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.checkpoints import materialized
from pairlab.functions import kernels
from pairlab.operators.blocks import BLOCK_ROWS
from pairlab.params import DEFAULTS

NAN = float("nan")


def spread(y: Column, x: Column, beta: Column, alpha: Column | float = 0.0) -> Column:
    """ln y - beta ln x - alpha; prices that are not positive raise."""
    a = alpha if isinstance(alpha, Column) else F.lit(alpha)
    bad = (y <= 0) | (x <= 0)
    return F.when(bad, F.raise_error(F.lit("prices must be positive")).cast("double")).otherwise(F.ln(y) - beta * F.ln(x) - a)


def _check(window: int, least: int) -> None:
    if window < 2 or not 2 <= least <= window:
        raise ValueError("window must be at least 2 and min_periods from 2 to window")


def rolled(x: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and sample deviations of the full trailing windows, NaN before the first."""
    mean, deviation = np.full(len(x), NAN), np.full(len(x), NAN)
    every = np.lib.stride_tricks.sliding_window_view(x, window) if len(x) >= window else np.empty((0, window))
    for at in range(0, len(every), 512):  # as many as a core's cache holds
        frames = every[at : at + 512]
        moved = frames - frames[:, :1]  # from its first value, so that a flat window deviates by 0 exactly
        middle = moved.mean(axis=1)
        here = slice(at + window - 1, at + window - 1 + len(frames))
        mean[here] = frames[:, 0] + middle
        moved -= middle[:, None]
        deviation[here] = np.sqrt(np.einsum("ij,ij->i", moved, moved) / (window - 1))
    return mean, deviation


def _stats_in_blocks(rows: DataFrame, keys: list[str], place: str, value: str, window: int, block_rows: int) -> DataFrame:
    """rolling_stats over full windows of groups that are cut into blocks, each with the window - 1 rows before it."""
    if block_rows < window:
        raise ValueError("a block must hold a window")
    own = F.floor(F.col(place) / block_rows)
    late = F.pmod(F.col(place), F.lit(block_rows)) >= block_rows - (window - 1)
    cut = rows.withColumn("block__", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
    names = rows.columns

    def run(table: pa.Table) -> pa.Table:
        at = table[place].to_numpy()
        order = np.argsort(at, kind="stable")
        at, x = at[order], table[value].cast(pa.float64()).to_numpy()[order]
        mean, deviation = rolled(x, window)
        kept = np.flatnonzero(at // block_rows == table["block__"][0].as_py())
        out = table.select(names).take(pa.array(order[kept]))
        return pa.table([*out.columns, pa.array(mean[kept]), pa.array(deviation[kept])], names=[*names, "roll_mean", "roll_std"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + ["roll_mean double", "roll_std double"])
    return cut.groupBy(*keys, "block__").applyInArrow(run, schema)


def rolling_stats(
    rows: DataFrame, keys: list[str], order: str, value: str = "spread", *, window: int = DEFAULTS.z_window, least: int | None = None, place: str | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """rows with roll_mean and roll_std (sample) over the trailing window; NaN until ``least`` rows.

    ``place`` may name a column that counts a group's rows in order, without gaps. With it long groups are
    cut into blocks of ``block_rows`` with tasks of their own; windows are full there.
    """
    least = window if least is None else least
    _check(window, least)
    if place is not None:
        if least != window:
            raise ValueError("blocks take full windows")
        return _stats_in_blocks(rows, keys, place, value, window, block_rows)
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(window - 1), 0)
    ready = F.count(value).over(frame) >= least
    nan = F.lit(NAN)
    return rows.withColumn("roll_mean", F.when(ready, F.avg(value).over(frame)).otherwise(nan)).withColumn("roll_std", F.when(ready, F.stddev_samp(value).over(frame)).otherwise(nan))


def z_score(value: str = "spread") -> Column:
    """(value - roll_mean) / roll_std; NaN where the deviation is 0 or not finite."""
    ok = ~F.isnan("roll_std") & (F.col("roll_std") > 0)
    return F.when(ok, F.try_divide(F.col(value) - F.col("roll_mean"), F.col("roll_std"))).otherwise(F.lit(NAN))


def rolling_z(
    rows: DataFrame, keys: list[str], order: str, value: str = "spread", *, window: int = DEFAULTS.z_window, least: int | None = None, place: str | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """rows with z, the rolling z-score of value within keys; ``place`` as in rolling_stats."""
    return rolling_stats(rows, keys, order, value, window=window, least=least, place=place, block_rows=block_rows).withColumn("z", z_score(value)).drop("roll_mean", "roll_std")


def session_z(rows: DataFrame, keys: list[str], session: str, order: str, value: str = "spread", *, window: int, least: int | None = None) -> DataFrame:
    """z over windows that begin anew at each session."""
    return rolling_z(rows, [*keys, session], order, value, window=window, least=least)


def warmed_z(rows: DataFrame, keys: list[str], session: str, order: str, value: str = "spread", *, window: int, warmup: int = DEFAULTS.warmup_bars, least: int | None = None) -> DataFrame:
    """z over the whole chronology, NaN in the first ``warmup`` bars of every session, counted by place."""
    scored = rolling_z(rows, keys, order, value, window=window, least=least)
    place = F.row_number().over(Window.partitionBy(*keys, session).orderBy(order))
    return scored.withColumn("z", F.when(place <= warmup, F.lit(NAN)).otherwise(F.col("z")))


def rolling_bands(
    rows: DataFrame, keys: list[str], order: str, value: str = "spread", *, window: int = DEFAULTS.z_window, width: float = 2.0, place: str | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """rows with lower, roll_mean and upper band; ``place`` as in rolling_stats."""
    s = rolling_stats(rows, keys, order, value, window=window, place=place, block_rows=block_rows)
    return s.withColumn("lower", F.col("roll_mean") - width * F.col("roll_std")).withColumn("upper", F.col("roll_mean") + width * F.col("roll_std")).drop("roll_std")


def variable_rolling_z(rows: DataFrame, keys: list[str], order: str, window: str, value: str = "spread") -> DataFrame:
    """rows with z over a window whose length is a column, one length a group; NaN until it is full or if it holds a NaN.

    A frame's bounds must be literals, so each group runs on its own in pandas.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        w = int(pdf[window].iloc[0])
        _check(w, w)
        rolled = pdf[value].rolling(w, min_periods=w)
        sd = rolled.std(ddof=1)
        return pdf.assign(z=((pdf[value] - rolled.mean()) / sd.where(sd > 0)).to_numpy(float))

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + ["z double"])
    return rows.groupBy(*keys).applyInPandas(run, schema)


def tod_profile(rows: DataFrame, keys: list[str], bar: str, order: str, value: str = "spread", *, window: int, bars: int = DEFAULTS.bars_per_session, radius: int = 2, least: int | None = None) -> DataFrame:
    """(keys, bar, sigma_tod): deviation by bar of session of the spread from its rolling mean, smoothed over 2 radius + 1 bars.

    Every bar from 0 to bars - 1 has a row; null where no neighbour has two observations.
    """
    s = rolling_stats(rows, keys, order, value, window=window, least=least)
    innovation = F.col(value) - F.col("roll_mean")
    seen = s.select(*keys, F.col(bar).alias("bar"), innovation.alias("i")).filter(~F.isnan("i"))
    per = seen.groupBy(*keys, "bar").agg(F.stddev_samp("i").alias("sigma"))
    spine = rows.select(*keys).distinct().withColumn("bar", F.explode(F.sequence(F.lit(0), F.lit(bars - 1))))
    box = Window.partitionBy(*keys).orderBy("bar").rowsBetween(-radius, radius)
    return spine.join(per, [*keys, "bar"], "left").select(*keys, "bar", F.avg("sigma").over(box).alias("sigma_tod"))


def tod_adjusted_z(rows: DataFrame, profile: DataFrame, keys: list[str], bar: str, order: str, value: str = "spread", *, window: int, least: int | None = None, eps: float = 1e-12) -> DataFrame:
    """rows with z_tod: the innovation over its bar's profile, or over the rolling deviation where that is missing or tiny."""
    s = rolling_stats(rows, keys, order, value, window=window, least=least).join(profile.withColumnRenamed("bar", bar), [*keys, bar], "left")
    usable = F.col("sigma_tod").isNotNull() & (F.col("sigma_tod") > eps)
    divisor = F.when(usable, F.col("sigma_tod")).otherwise(F.col("roll_std"))
    innovation = F.col(value) - F.col("roll_mean")
    ok = ~F.isnan(innovation) & ~F.isnan(divisor) & (divisor > eps)
    return s.withColumn("z_tod", F.when(ok, innovation / divisor).otherwise(F.lit(NAN))).drop("roll_mean", "roll_std", "sigma_tod")


_STATE = "position int, held int, exit_reason string"


def _schema(rows: DataFrame) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + [_STATE])


def _of(pdf: pd.DataFrame, value):
    """A parameter that is a column's name is read from the group's first row."""
    return pdf[value].iloc[0] if isinstance(value, str) else value


def _close_session(position, held, reason, tradeable, *, all_after: bool) -> None:
    """Flat at the last tradeable bar of a session that is still open there."""
    last = np.flatnonzero(tradeable)
    if not len(last):
        return
    last = int(last[-1])
    if (position[-1] if all_after else position[last]) != 0:
        position[last:] = 0 if all_after else np.r_[0, position[last + 1 :]]
        held[last:] = 0 if all_after else np.r_[0, held[last + 1 :]]
        reason[last] = reason[last] or "session_close"


def rolling_signals(
    rows: DataFrame, keys: list[str], order: str, *, z: str = "z", entry: float = DEFAULTS.entry_z, exit_: float = DEFAULTS.exit_z, stop: float = DEFAULTS.stop_z, max_holding: int | str = DEFAULTS.max_holding, session: str | None = None, tradeable: str | None = None
) -> DataFrame:
    """rows with position, held and exit_reason of the rolling-z machine.

    Without ``session`` the machine runs on over each group. With it each session is a group of its
    own, flat again at its last tradeable bar. A group is one pair in one window or session.
    """
    if min(entry, exit_, stop) <= 0 or exit_ >= entry or stop <= entry or not isinstance(max_holding, str) and max_holding < 1:
        raise ValueError("needs 0 < exit < entry < stop and max_holding of at least 1")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        position, held, reason = kernels.rolling_machine(pdf[z].to_numpy(float), entry, exit_, stop, int(_of(pdf, max_holding)))
        if session:
            _close_session(position, held, reason, pdf[tradeable].to_numpy(bool) if tradeable else np.ones(len(pdf), bool), all_after=False)
        return pdf.assign(position=position.astype(np.int32), held=held, exit_reason=reason)

    return rows.groupBy(*keys, *([session] if session else [])).applyInPandas(run, _schema(rows))


def rolling_signals_in_parts(
    rows: DataFrame, keys: list[str], order: str, part: str, *, z: str = "z", entry: float = DEFAULTS.entry_z, exit_: float = DEFAULTS.exit_z, stop: float = DEFAULTS.stop_z, max_holding: int | str = DEFAULTS.max_holding
) -> DataFrame:
    """rolling_signals without sessions, where a long group runs in many tasks, one for each value of ``part``, which must not fall in ``order``.

    First each part tells which state it ends in for every state that it may begin in; these tables, 2 * max_holding + 1
    numbers a part, are chained along each group; then each part runs from the state that it begins in.
    """
    if min(entry, exit_, stop) <= 0 or exit_ >= entry or stop <= entry or not isinstance(max_holding, str) and max_holding < 1:
        raise ValueError("needs 0 < exit < entry < stop and max_holding of at least 1")
    rows = materialized(rows)  # read by both passes
    by = [*keys, part]

    def schema(names: list[str], more: str) -> str:
        return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in names] + [more])

    named = [f.name for f in rows.schema.fields if f.name in by]

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        most = int(_of(pdf, max_holding))
        return pdf[named].iloc[:1].assign(most__=most, ends__=[kernels.rolling_transitions(pdf[z].to_numpy(float), entry, exit_, stop, most).tolist()])

    def chained(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(part)
        begins, state = [], 0
        for ends in pdf["ends__"]:
            begins.append(state)
            state = int(ends[state])
        return pdf[named].assign(begin__=begins)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        most = int(_of(pdf, max_holding))
        side, bars = kernels.machine_state(int(pdf["begin__"].iloc[0]), most)
        position, held, reason = kernels.rolling_machine(pdf[z].to_numpy(float), entry, exit_, stop, most, side, bars)
        return pdf.drop(columns="begin__").assign(position=position.astype(np.int32), held=held, exit_reason=reason)

    tables = rows.groupBy(*by).applyInPandas(summary, schema(by, "most__ int, ends__ array<int>"))
    begins = tables.groupBy(*keys).applyInPandas(chained, schema(by, "begin__ int"))
    return rows.join(begins, by).select(*rows.columns, "begin__").groupBy(*by).applyInPandas(run, _schema(rows))


def _series(row) -> np.ndarray:
    return row.values.to_numpy(zero_copy_only=False).astype(float)


def _fields(rows: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)


def states_in_blocks(
    blocked: DataFrame, keys: list[str], *, carry: tuple[str, ...] = (), window: int = DEFAULTS.z_window, digits: int = 8, entry: float = DEFAULTS.entry_z, exit_: float = DEFAULTS.exit_z, stop: float = DEFAULTS.stop_z, max_holding: int = DEFAULTS.max_holding
) -> DataFrame:
    """(keys, block, begin, carry, lead, spread, z, state, spread_before, closing), a row a block of ``blocked`` as in signals_in_blocks.

    ``lead`` are the spreads before the block, ``state`` is the numbered state that it begins in, and ``closing`` marks a group's last block with a spread
    if a trade is open at the end.
    """
    if min(entry, exit_, stop) <= 0 or exit_ >= entry or stop <= entry or max_holding < 1:
        raise ValueError("needs 0 < exit < entry < stop and max_holding of at least 1")
    _check(window, window)
    type_of = lambda names: _fields(blocked, names)
    held_over, arrays = [*keys, "block", "begin", *carry], "lead array<double>, spread array<double>, z array<double>"

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, before = _series(batch["spreads"][i]), batch["n_before"][i].as_py()
                mean, deviation = rolled(x, window)
                ok = deviation > 0
                z = np.full(len(x), NAN)
                z[ok] = (x[ok] - mean[ok]) / deviation[ok]
                lists = [pa.array([v], pa.list_(pa.float64())) for v in (x[:before], x[before:], z[before:])]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).select(held_over).columns, *lists], names=[*held_over, "lead", "spread", "z"])

    scored = blocked.select(*held_over, "n_before", "spreads").mapInArrow(scores, f"{type_of(held_over)}, {arrays}")
    scored = scored.withColumn("z", F.transform("z", lambda v: F.round(v, digits)))

    def transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, z = _series(batch["spread"][i]), _series(batch["z"][i])
                more = [pa.array([kernels.rolling_transitions(z, entry, exit_, stop, max_holding)], pa.list_(pa.int32())), pa.array([x[-1]]), pa.array([not np.isnan(x).all()])]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, *more], names=[*batch.schema.names, "goes", "last", "seen"])

    tables = materialized(scored.mapInArrow(transitions, f"{type_of(held_over)}, {arrays}, goes array<int>, last double, seen boolean"))

    def chained(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        states = [0]
        for goes in pdf["goes"]:
            states.append(int(goes[states[-1]]))
        closing = pdf["seen"] & (pdf["seen"][::-1].cumsum()[::-1] == 1) & (states[-1] != 0)
        return pdf[[*keys, "block"]].assign(state=states[:-1], spread_before=pdf["last"].shift(), closing=closing)

    # A row of a few numbers for each block.
    begins = tables.select(*keys, "block", "goes", "last", "seen").groupBy(*keys).applyInPandas(chained, type_of([*keys, "block"]) + ", state int, spread_before double, closing boolean")
    return tables.drop("goes", "last", "seen").join(F.broadcast(begins), [*keys, "block"])


def signals_in_blocks(
    blocked: DataFrame, keys: list[str], *, carry: tuple[str, ...] = (), window: int = DEFAULTS.z_window, digits: int = 8, entry: float = DEFAULTS.entry_z, exit_: float = DEFAULTS.exit_z, stop: float = DEFAULTS.stop_z, max_holding: int = DEFAULTS.max_holding
) -> DataFrame:
    """(keys, place, carry, spread, z, position, held, exit_reason, position_before, held_before, gross, ends) of groups that are cut into blocks.

    ``blocked(keys, block, begin, n_before, spreads, carry)`` has a row a block: the place of its first bar, and its spreads after those
    of n_before bars, which are window - 1 or all that there are. Rolling z, rounded to ``digits``, and states are those of rolling_z and rolling_signals over
    the whole group; only a block's states and last spread go on to the next. position_before and held_before are those of the
    bar before, gross is that of backtest.position_returns, and ``ends`` marks the bars where trades end: exits, and a group's
    last bar with a spread if a trade is open at its end.
    """
    ready = states_in_blocks(blocked, keys, carry=carry, window=window, digits=digits, entry=entry, exit_=exit_, stop=stop, max_holding=max_holding)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = lambda c: batch[c][i]  # noqa: E731, B023
                x, z = _series(row("spread")), _series(row("z"))
                side, bars = kernels.machine_state(row("state").as_py(), max_holding)
                position, held, reason = kernels.rolling_machine(z, entry, exit_, stop, max_holding, side, bars)
                before, last = np.r_[side, position[:-1]].astype(np.int32), row("spread_before").as_py()
                move = np.diff(np.r_[NAN if last is None else last, x])
                ends = np.array([r is not None for r in reason])
                if row("closing").as_py():
                    ends[np.flatnonzero(~np.isnan(x))[-1]] = True
                same = [pa.repeat(row(c), len(x)) for c in (*keys, *carry)]
                places = pa.array(row("begin").as_py() + np.arange(len(x)), pa.int64())
                found = [x, z, position.astype(np.int32), held.astype(np.int32), pa.array(reason, pa.string()), before, np.r_[bars, held[:-1]].astype(np.int32), before * np.where(np.isnan(move), 0.0, move), ends]
                yield pa.RecordBatch.from_arrays([*same, places, *[pa.array(c) for c in found]], names=[*keys, *carry, "place", *names])

    names = ["spread", "z", "position", "held", "exit_reason", "position_before", "held_before", "gross", "ends"]
    schema = _fields(blocked, [*keys, *carry]) + ", place long, spread double, z double, position int, held int, exit_reason string, position_before int, held_before int, gross double, ends boolean"
    return ready.mapInArrow(run, schema)


def ou_signals(
    rows: DataFrame, keys: list[str], order: str, *, z: str = "z_ou", entry: float | str, max_holding: int | str, hard_stop: float | None = None, session: str | None = None, tradeable: str | None = None
) -> DataFrame:
    """rows with position, held and exit_reason of the threshold machine; ``entry`` and ``max_holding`` may name columns."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        at = float(_of(pdf, entry))
        if not np.isfinite(at) or at <= 0:
            raise ValueError(f"the entry threshold must be positive and finite, not {at}")
        position, held, reason = kernels.ou_machine(pdf[z].to_numpy(float), at, hard_stop, int(_of(pdf, max_holding)))
        if session:
            _close_session(position, held, reason, pdf[tradeable].to_numpy(bool) if tradeable else np.ones(len(pdf), bool), all_after=True)
        return pdf.assign(position=position.astype(np.int32), held=held, exit_reason=reason)

    return rows.groupBy(*keys, *([session] if session else [])).applyInPandas(run, _schema(rows))


def ou_cells(rows: DataFrame, keys: list[str], order: str, session: str, *, z: str = "z_ou", hard_stop: float) -> DataFrame:
    """rows with position, held and exit_reason of the threshold machine, each group by its own a_z, max_holding, regime and stop_mode.

    Groups of regime A are flat again at the last tradeable bar of each session; those with stop_mode hard have the stop.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        at, limit = float(pdf["a_z"].iloc[0]), int(pdf["max_holding"].iloc[0])
        if not np.isfinite(at) or at <= 0:
            raise ValueError(f"the entry threshold must be positive and finite, not {at}")
        stop = hard_stop if pdf["stop_mode"].iloc[0] == "hard" else None
        values, tradeable = pdf[z].to_numpy(float), pdf["tradeable"].to_numpy(bool)
        if pdf["regime"].iloc[0] != "A":
            position, held, reason = kernels.ou_machine(values, at, stop, limit)
        else:
            parts = []
            for places in pdf.groupby(session, sort=False).indices.values():
                part = kernels.ou_machine(values[places], at, stop, limit)
                _close_session(*part, tradeable[places], all_after=True)
                parts.append((places, *part))
            order_, position, held = (np.concatenate([p[i] for p in parts]) for i in range(3))
            reason = [x for p in parts for x in p[3]]
            back = np.argsort(order_, kind="stable")
            position, held, reason = position[back], held[back], [reason[i] for i in back]
        return pdf.assign(position=position.astype(np.int32), held=held, exit_reason=reason)

    return rows.groupBy(*keys).applyInPandas(run, _schema(rows))


def signal_diagnostics(signals: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """Counts of bars, trips, exits by reason, and holding times of each group.

    Without ``order`` the rows are those of signals_in_blocks, which know the bar before, and only sums meet.
    """
    if order is None:
        s = signals.withColumnsRenamed({"position_before": "prev__", "held_before": "before__"}).withColumn("last__", F.col("ends") & F.col("exit_reason").isNull())
    else:
        w = Window.partitionBy(*keys).orderBy(order)
        s = signals.withColumn("prev__", F.lag("position", 1, 0).over(w)).withColumn("before__", F.lag("held", 1, 0).over(w)).withColumn("last__", F.lead("position").over(w).isNull())
    entry = (F.col("prev__") == 0) & (F.col("position") != 0)
    out = F.col("exit_reason").isNotNull()
    n = lambda c, name: F.count_if(c).alias(name)
    return s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_obs"), n(out, "n_round_trips"), n(F.col("last__") & (F.col("position") != 0), "n_open_at_end"),
        F.avg(F.when(out, F.col("before__"))).alias("avg_holding"), F.max(F.when(out, F.col("before__"))).alias("max_holding"),
        F.avg(F.when(F.col("position") != 0, 1.0).otherwise(0.0)).alias("pct_time_in_position"),
        n(entry & (F.col("position") > 0), "n_long_entries"), n(entry & (F.col("position") < 0), "n_short_entries"),
        n(F.col("exit_reason") == "mean_revert", "n_mean_revert"), n(F.col("exit_reason") == "stop", "n_stop"), n(F.col("exit_reason") == "time", "n_time"),
    )
