"""Streaming forms of resampling, of the two-leg alignment and of the position machine (extensions)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pairlab.params import DEFAULTS


def resample_stream(ticks: DataFrame, *, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(symbol, bar_start, close, volume): the last price of each bar; a bar is final once the watermark has passed it."""
    bars = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", every).alias("w"))
    return bars.agg(F.max_by("price", "ts").alias("close"), F.count(F.lit(1)).alias("volume")).select("symbol", F.col("w.start").alias("bar_start"), "close", "volume")


def _moved(z: float, side: int, bars: int, limits: tuple) -> tuple[int, int, str | None]:
    """(side, bars, exit reason) after a bar with z, from the state before it; a NaN carries the state."""
    entry, exit_, stop, max_holding = limits
    if z != z:
        return side, bars, None
    if side == 0:
        side = -1 if z > entry else 1 if z < -entry else 0
        return side, 1 if side else 0, None
    toward = z * side
    why = "stop" if toward <= -stop else "mean_revert" if toward >= -exit_ else "time" if bars >= max_holding else None
    return (0, 0, why) if why else (side, bars + 1, None)


_OUT = "pair string, ts timestamp, z double, position int, held int, exit_reason string"


def align_stream(y_bars: DataFrame, x_bars: DataFrame, pairs: DataFrame, *, late: str = "10 minutes") -> DataFrame:
    """(y_sym, x_sym, ts, close_y, close_x, volume_y, volume_x, tradeable): both legs of each pair on the union of their bars, as intraday.align_pairs gives them.

    ``y_bars`` and ``x_bars`` are streams of (symbol, ts, close, volume), ``pairs(y_sym, x_sym)`` is a table. A bar whose other leg lacks is
    given once the watermark has passed it, with NaN and no volume there; until then the other leg may still come. A leg that comes
    later than ``late`` is dropped, as if it were missing.
    """
    legs = []
    for bars, leg, other in ((y_bars, "y", "x"), (x_bars, "x", "y")):
        own = bars.withWatermark("ts", late).join(F.broadcast(pairs.select("y_sym", "x_sym")), F.col("symbol") == F.col(f"{leg}_sym"))  # a table of pairs
        legs.append(own.select(F.col("y_sym").alias(f"{leg}_y_sym"), F.col("x_sym").alias(f"{leg}_x_sym"), F.col("ts").alias(f"{leg}_ts"), F.col("close").alias(f"{leg}_close"), F.col("volume").alias(f"{leg}_volume")))
    both = legs[0].join(legs[1], (F.col("y_y_sym") == F.col("x_y_sym")) & (F.col("y_x_sym") == F.col("x_x_sym")) & (F.col("y_ts") == F.col("x_ts")), "full_outer")
    either = lambda c: F.coalesce(f"y_{c}", f"x_{c}").alias(c)
    price = lambda leg: F.coalesce(f"{leg}_close", F.lit(float("nan"))).alias(f"close_{leg}")
    volume = lambda leg: F.coalesce(f"{leg}_volume", F.lit(0)).cast("long").alias(f"volume_{leg}")
    there = F.col("y_ts").isNotNull() & F.col("x_ts").isNotNull()
    return both.select(either("y_sym"), either("x_sym"), either("ts"), price("y"), price("x"), volume("y"), volume("x"), there.alias("tradeable"))


_SESSION_OUT = "pair string, session date, ts timestamp, z double, position int, held int, exit_reason string"
_SESSION_STATE = "times binary, zs binary, open binary, side int, bars int"


class _Waiting:
    """A session's bars that aren't final yet, in order of time, and the machine's state before them."""

    def __init__(self, held: tuple | None):
        times, zs, tradeable, self.side, self.bars = held or (b"", b"", b"", 0, 0)
        self.ts, self.z, self.tradeable = np.frombuffer(times, np.int64), np.frombuffer(zs, np.float64), np.frombuffer(tradeable, np.bool_)

    def add(self, rows: pd.DataFrame) -> None:
        ts = rows["ts"].to_numpy("datetime64[us]").astype(np.int64)
        self.ts, self.z, self.tradeable = (np.concatenate(x) for x in ((self.ts, ts), (self.z, rows["z"].to_numpy(float)), (self.tradeable, rows["tradeable"].to_numpy(bool))))
        order = np.argsort(self.ts, kind="stable")
        self.ts, self.z, self.tradeable = self.ts[order], self.z[order], self.tradeable[order]

    def take(self, n: int, limits: tuple, *, closing: bool = False) -> list[tuple]:
        """The first n bars with their positions, taken out; flat at the last tradeable of them if the session is closing."""
        out = []
        for ts, z in zip(self.ts[:n].tolist(), self.z[:n].tolist()):
            self.side, self.bars, why = _moved(z, self.side, self.bars, limits)
            out.append([ts, z, self.side, self.bars, why])
        last = np.flatnonzero(self.tradeable[:n])
        if closing and len(last) and out[last[-1]][2] != 0:
            end = out[last[-1]]
            end[2:] = [0, 0, end[4] or "session_close"]
        self.ts, self.z, self.tradeable = self.ts[n:], self.z[n:], self.tradeable[n:]
        return out

    def final_before(self, watermark_us: int) -> int:
        """How many bars are final: those before the watermark and before the last tradeable one so far, on which the session may end."""
        tradeable = np.flatnonzero(self.tradeable)
        return min(int(np.searchsorted(self.ts, watermark_us)), int(tradeable[-1]) if len(tradeable) else len(self.ts))

    def state(self) -> tuple:
        return self.ts.tobytes(), self.z.tobytes(), self.tradeable.tobytes(), self.side, self.bars


def session_stream(scored: DataFrame, *, late: str = "10 minutes", entry: float = DEFAULTS.entry_z, exit_: float = DEFAULTS.exit_z, stop: float = DEFAULTS.stop_z, max_holding: int = DEFAULTS.max_holding) -> DataFrame:
    """The rolling-z machine by session on a stream of (pair, session, closes, ts, z, tradeable), equal to the machine on all rows at once.

    Bars wait until the watermark has passed them, so their order of arrival doesn't matter; bars later than ``late`` are dropped.
    When it passes ``closes``, the session's last instant, the rest is given, flat at the last tradeable bar, and the
    session's state goes. The last tradeable bar so far waits until then, since the session may end on it.
    """
    limits = (entry, exit_, stop, max_holding)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = _Waiting(state.get if state.exists else None)
        if state.hasTimedOut:
            out = waiting.take(len(waiting.ts), limits, closing=True)
            state.remove()
        else:
            rows = pd.concat(list(batches))
            waiting.add(rows)
            now = state.getCurrentWatermarkMs()
            out = waiting.take(waiting.final_before(now * 1000), limits)
            state.update(waiting.state())
            closes = int(rows["closes"].to_numpy("datetime64[us]").astype(np.int64).max()) // 1000
            state.setTimeoutTimestamp(max(closes, now) + 1)
        if out:
            ts, z, position, held, why = zip(*out)
            yield pd.DataFrame({"pair": key[0], "session": key[1], "ts": np.array(ts, "datetime64[us]"), "z": z, "position": position, "held": held, "exit_reason": why})

    return scored.withWatermark("ts", late).groupBy("pair", "session").applyInPandasWithState(step, _SESSION_OUT, _SESSION_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def signal_stream(scored: DataFrame, *, entry: float = DEFAULTS.entry_z, exit_: float = DEFAULTS.exit_z, stop: float = DEFAULTS.stop_z, max_holding: int = DEFAULTS.max_holding) -> DataFrame:
    """The rolling-z machine on a stream of (pair, ts, z); a pair's state is its position and holding time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        side, bars = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        out = []
        for ts, z in zip(rows["ts"], rows["z"].to_numpy(float)):
            side, bars, why = _moved(z, side, bars, (entry, exit_, stop, max_holding))
            out.append((key[0], ts, z, side, bars, why))
        state.update((side, bars))
        yield pd.DataFrame(out, columns=["pair", "ts", "z", "position", "held", "exit_reason"])

    return scored.groupBy("pair").applyInPandasWithState(step, _OUT, "side int, bars int", "append", GroupStateTimeout.NoTimeout)
