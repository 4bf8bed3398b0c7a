"""The liquidity gate by fold: how full the sessions of both legs were in each fold's probe window.

Presence is counted once a symbol and session. The counts become running sums, and each window is the
difference of two looked-up sums, so that overlapping windows of many folds don't read the bars again.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.params import DEFAULTS

SPAN = ["symbol", "probe_start", "probe_end"]


def probe_windows(folds: DataFrame, panel_start: date | str | Column, *, days: int = DEFAULTS.probe_days, forward: int = DEFAULTS.probe_forward_days) -> DataFrame:
    """(fold_id, probe_start, probe_end): the last ``days`` of the training window.

    A training window that ends before the minute bars begin has none; its probe is the first ``forward`` days of the
    bars, up to the end of the test window.
    """
    first = panel_start if isinstance(panel_start, Column) else F.lit(panel_start).cast("date")
    before = F.col("train_end") < first
    start = F.when(before, first).otherwise(F.greatest(F.date_sub("train_end", days), F.col("train_start")))
    end = F.when(before, F.least(F.col("test_end"), F.date_add(first, forward))).otherwise(F.col("train_end"))
    return folds.select("fold_id", start.alias("probe_start"), end.alias("probe_end"))


def presence(bars: DataFrame) -> DataFrame:
    """(symbol, session, n): bars of each symbol and session."""
    return bars.groupBy("symbol", "session").agg(F.count(F.lit(1)).alias("n"))


def window_fill(counts: DataFrame, spans: DataFrame, *, full: int = DEFAULTS.bars_per_session) -> DataFrame:
    """(symbol, probe_start, probe_end, n_sessions, fill_rate): mean share of bars present over the symbol's sessions in each window, 0 without any."""
    by = Window.partitionBy("symbol").orderBy("session")
    sums = counts.select("symbol", F.col("session").alias("at"), F.sum("n").over(by).alias("bars"), F.row_number().over(by).alias("sessions"), F.lit(0).alias("asks"))
    asked = spans.select("symbol", F.explode(F.array(F.date_sub("probe_start", 1), "probe_end")).alias("at")).distinct()
    asked = asked.select("symbol", "at", F.lit(None).cast("long").alias("bars"), F.lit(None).cast("int").alias("sessions"), F.lit(1).alias("asks"))
    # A symbol's sessions and windows: thousands of rows in a group.
    so_far = Window.partitionBy("symbol").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.lit(0))
    told = sums.unionByName(asked).select("symbol", "at", "asks", last("bars").alias("bars"), last("sessions").alias("sessions")).filter("asks = 1")
    ends = [told.select("symbol", F.col("at").alias(name), F.col("bars").alias(f"bars_{k}"), F.col("sessions").alias(f"sessions_{k}")) for k, name in ((0, "before__"), (1, "probe_end"))]
    both = spans.select(*SPAN).distinct().withColumn("before__", F.date_sub("probe_start", 1)).join(ends[0], ["symbol", "before__"]).join(ends[1], ["symbol", "probe_end"])
    # A window that ends before it starts has no sessions.
    n = F.greatest(F.col("sessions_1") - F.col("sessions_0"), F.lit(0))
    share = F.try_divide((F.col("bars_1") - F.col("bars_0")).cast("double"), (n * full).cast("double"))
    return both.select(*SPAN, n.alias("n_sessions"), F.when(n > 0, share).otherwise(F.lit(0.0)).alias("fill_rate"))


def window_medians(bars: DataFrame, counts: DataFrame, spans: DataFrame) -> DataFrame:
    """(symbol, probe_start, probe_end, median_min_rupee): median traded value of a bar in each window; bars without a close or volume don't count."""
    each = spans.select(*SPAN).distinct().join(counts.select("symbol", "session"), "symbol").filter(F.col("session").between(F.col("probe_start"), F.col("probe_end")))
    value = F.nanvl(F.col("close").cast("double"), F.lit(None).cast("double")) * F.col("volume")
    valued = bars.select("symbol", "session", value.alias("v")).filter("v IS NOT NULL").join(each, ["symbol", "session"])
    return valued.groupBy(*SPAN).agg(F.percentile("v", F.lit(0.5)).alias("median_min_rupee"))


def gate_by_fold(
    bars: DataFrame, chosen: DataFrame, folds: DataFrame, *, panel_start: date | str | Column | None = None, days: int = DEFAULTS.probe_days, forward: int = DEFAULTS.probe_forward_days,
    full: int = DEFAULTS.bars_per_session, fill: float = DEFAULTS.liquidity_fill,
) -> DataFrame:
    """(fold_id, y_sym, x_sym, probe_start, probe_end, y_ and x_ n_sessions, fill_rate and med_min_rupee, intraday_pass).

    One row a pair-fold of ``chosen(fold_id, y_sym, x_sym)``. It passes if both legs' fill rates reach ``fill``; the median
    traded value is told, not asked for. ``panel_start`` is the first session of the bars if not given.
    """
    first = bars.agg(F.min("session")).first()[0] if panel_start is None else panel_start
    pairs = chosen.select("fold_id", "y_sym", "x_sym").distinct().join(probe_windows(folds, first, days=days, forward=forward), "fold_id")
    legs = pairs.select(F.explode(F.array("y_sym", "x_sym")).alias("symbol"), "probe_start", "probe_end").distinct()
    own = bars.join(legs.select("symbol").distinct(), "symbol", "left_semi")
    counts = presence(own)
    known = window_fill(counts, legs, full=full).join(window_medians(own, counts, legs), SPAN, "left")
    for leg in ("y", "x"):
        side = known.select(F.col("symbol").alias(f"{leg}_sym"), "probe_start", "probe_end", F.col("n_sessions").alias(f"{leg}_n_sessions"), F.col("fill_rate").alias(f"{leg}_fill_rate"), F.col("median_min_rupee").alias(f"{leg}_med_min_rupee"))
        pairs = pairs.join(side, [f"{leg}_sym", "probe_start", "probe_end"], "left")
    passed = (F.coalesce("y_fill_rate", F.lit(0.0)) >= fill) & (F.coalesce("x_fill_rate", F.lit(0.0)) >= fill)
    return pairs.select(
        "fold_id", "y_sym", "x_sym", "probe_start", "probe_end", *[f"{leg}_{c}" for c in ("n_sessions", "fill_rate", "med_min_rupee") for leg in ("y", "x")], passed.alias("intraday_pass")
    )
