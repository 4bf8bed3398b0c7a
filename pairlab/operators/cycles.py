"""Simulated cycles of mean-reverting spreads, to hold the closed form of the mean cycle against."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.operators.intraday import mean_cycle, return_rate


def count_cycles(entry: float, paths: int, rng: np.random.Generator, *, step: float, burn: float, horizon: float) -> np.ndarray:
    """Cycles that each path ends within the horizon, after the burn-in.

    The process has unit stationary deviation and unit speed. A cycle begins at the mean, enters at ``entry`` on either side and
    ends back at the mean. Moves over a step are exact; that a path touched a level between two steps on one side of it
    is drawn with the probability of a bridge. A path changes its state once a step at most, so long steps lose cycles:
    under half a percent at 0.02 and an entry of one deviation, about four percent at 0.1.
    """
    shrink = np.exp(-step)
    variance = 1.0 - shrink * shrink
    noise = np.sqrt(variance)
    x, side, ended = np.zeros(paths), np.zeros(paths, np.int8), np.zeros(paths, np.int64)
    first = round(burn / step)
    for i in range(first + round(horizon / step)):
        new = shrink * x + noise * rng.standard_normal(paths)
        u = rng.random(paths)
        # exp of at least 0 is at least 1: both ends on the level's far side count as touched.
        up = u < np.exp(np.minimum(-2.0 * np.maximum(entry - x, 0.0) * (entry - new) / variance, 0.0))
        down = 1.0 - u < np.exp(np.minimum(-2.0 * np.maximum(entry + x, 0.0) * (entry + new) / variance, 0.0))
        home = u < np.exp(np.minimum(-2.0 * np.maximum(side * x, 0.0) * (side * new) / variance, 0.0))
        out = (side != 0) & home
        enters = np.where(up & down, np.where(new >= 0, 1, -1), up.astype(np.int8) - down.astype(np.int8))
        side = np.where(side == 0, enters, np.where(out, 0, side)).astype(np.int8)
        if i >= first:
            ended += out
        x = new
    return ended


def simulate_cycles(
    fits: DataFrame, keys: list[str], *, a: str = "a", cost: str = "cost_log", paths: int = 1000, per_task: int = 500, step: float = 0.02, burn: float = 20.0, horizon: float = 40.0, seed: int = 1, tasks: int | None = None
) -> DataFrame:
    """(keys, n_paths, n_cycles, cycle, cycle_se, cycle_closed, rate, rate_se, rate_closed, settled) of each row of fits.

    ``fits`` has keys, kappa, sigma_eq, the entry distance and the log cost; rows that lack one, are NaN or have an entry that is
    not above 0 don't appear. Equal rows of one key are simulated once. ``step``, ``burn`` and ``horizon`` are in units of
    1 / kappa, the results in bars. Paths are cut into pieces of ``per_task``, each with a seed of its key and number, so a lost
    piece is drawn again as it was and the result doesn't depend on the layout. ``settled`` tells that the burn-in holds
    two mean cycles; without it rates are too low or too high by what the start adds. No cycle at all gives a null length.
    """
    number = [F.col(c).cast("double").alias(n) for c, n in (("kappa", "kappa"), ("sigma_eq", "sigma_eq"), (a, "a"), (cost, "cost_log"))]
    good = fits.select(*keys, *number).filter("kappa > 0 AND sigma_eq > 0 AND a > 0 AND NOT isnan(kappa) AND NOT isnan(sigma_eq) AND NOT isnan(a) AND cost_log IS NOT NULL AND NOT isnan(cost_log)").distinct()
    pieces = max(1, -(-paths // per_task))
    tasks = tasks or 2 * fits.sparkSession.sparkContext.defaultParallelism
    split = good.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    split = split.withColumn("seed", F.xxhash64(*keys, "a", "sigma_eq", "piece", F.lit(seed))).withColumn("n", F.least(F.lit(per_task), paths - F.col("piece") * per_task).cast("long"))
    own = [*keys, "kappa", "sigma_eq", "a", "cost_log"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sums = []
            for entry, n, s in zip(pdf["a"] / pdf["sigma_eq"], pdf["n"], pdf["seed"]):
                ended = count_cycles(float(entry), int(n), np.random.default_rng(int(s) % 2**64), step=step, burn=burn, horizon=horizon)
                sums.append((ended.sum(), (ended * ended).sum()))
            found = pdf[[*own, "n"]].copy()
            found["s1"], found["s2"] = [v[0] for v in sums], [v[1] for v in sums]
            yield found

    shape = split.select(*own, "n", F.lit(0).cast("long").alias("s1"), F.lit(0).cast("long").alias("s2")).schema
    drawn = split.repartition(tasks, *keys, "piece").mapInPandas(run, shape)
    s = drawn.groupBy(*own).agg(F.sum("n").alias("n_paths"), F.sum("s1").alias("n_cycles"), F.sum("s2").alias("s2"))
    time = F.lit(horizon) / F.col("kappa")
    mean = F.col("n_cycles") / F.col("n_paths")
    s = s.withColumn("per_path_se", F.sqrt(F.greatest(F.col("s2") / F.col("n_paths") - mean * mean, F.lit(0.0)) / F.col("n_paths")))
    s = s.withColumn("cycle", F.try_divide(time, mean)).withColumn("cycle_se", F.try_divide(F.col("cycle") * F.col("per_path_se"), mean))
    s = s.withColumn("cycle_closed", mean_cycle("a", "kappa", "sigma_eq")).withColumn("rate_closed", return_rate("a", "cost_log", "kappa", "sigma_eq"))
    gain = F.col("a") - F.col("cost_log")
    s = s.withColumn("rate", gain * mean / time).withColumn("rate_se", F.abs(gain) * F.col("per_path_se") / time)
    settled = F.col("cycle_closed") * F.col("kappa") * 2 <= burn
    return s.select(*keys, "n_paths", "n_cycles", "cycle", "cycle_se", "cycle_closed", "rate", "rate_se", "rate_closed", settled.alias("settled"))


def agrees(value: str, closed: str, error: str, *, errors: float = 5.0, relative: float = 0.01) -> F.Column:
    """Whether a simulated value is the closed form's within some standard errors and a part of it; false without a value."""
    return F.coalesce(F.abs(F.col(value) - F.col(closed)) <= errors * F.col(error) + relative * F.abs(F.col(closed)), F.lit(False))
