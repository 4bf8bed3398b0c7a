"""Cleaning rules on daily bars, the validation gate and the repair of what fails it.

Tables are long, keyed by (symbol, date). Windows are partitioned by symbol; per-symbol and event
tables are joined back and left to the optimizer to broadcast where they are small.
"""

from __future__ import annotations

from datetime import date
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.params import DEFAULTS

PRICES = ("open", "high", "low", "close")


def by_symbol() -> Window:
    return Window.partitionBy("symbol").orderBy("date")


def simple_return(close: str = "close") -> Column:
    """close / previous close - 1; null at a symbol's first row or after a zero."""
    return F.try_divide(F.col(close), F.lag(close).over(by_symbol())) - 1


def days_since_previous() -> Column:
    """Calendar days since the symbol's previous row, 0 for the first."""
    return F.coalesce(F.date_diff("date", F.lag("date").over(by_symbol())), F.lit(0))


def drop_bad_prices(rows: DataFrame, prices: tuple[str, ...] = PRICES) -> DataFrame:
    """Rows with no null and no negative price; zero stays."""
    bad = reduce(or_, [F.col(c).isNull() | (F.col(c) < 0) for c in prices])
    return rows.filter(~bad)


def zero_volume_flag(rows: DataFrame) -> DataFrame:
    """Null volume as 0, and zero_volume_flag."""
    volume = F.coalesce(F.col("volume"), F.lit(0).cast(rows.schema["volume"].dataType))
    return rows.withColumn("volume", volume).withColumn("zero_volume_flag", F.col("volume") == 0)


def deduplicate(rows: DataFrame, keys: list[str], order: list[Column], *, keep: str = "last") -> DataFrame:
    """One row a key: the first or the last in ``order``."""
    sort = order if keep == "first" else [c.desc() for c in order]
    return rows.withColumn("n__", F.row_number().over(Window.partitionBy(*keys).orderBy(*sort))).filter("n__ = 1").drop("n__")


def adjust_residual_splits(daily: DataFrame, splits: DataFrame) -> DataFrame:
    """Prices before each split's ex-date divided by its ratio; volume stays.

    ``splits(symbol, ex_date, ratio)``; several splits multiply.
    """
    s = splits.filter(F.col("ratio") > 0).select(F.col("symbol").alias("s_symbol"), "ex_date", "ratio")
    on = (F.col("symbol") == F.col("s_symbol")) & (F.col("ex_date") > F.col("date"))
    factors = daily.select("symbol", "date").join(s, on).groupBy("symbol", "date").agg(F.product(1 / F.col("ratio")).alias("factor"))
    joined = daily.join(factors, ["symbol", "date"], "left")
    factor = F.coalesce(F.col("factor"), F.lit(1.0))
    prices = [c for c in PRICES if c in daily.columns]
    return joined.select(*[(F.col(c) * factor).alias(c) if c in prices else F.col(c) for c in daily.columns])


def split_smoothness(daily: DataFrame, splits: DataFrame, *, tolerance: float = DEFAULTS.smooth_tolerance) -> DataFrame:
    """(symbol, ex_date, ret, smooth): whether the return on the ex-date is within tolerance; no row there is not smooth."""
    returns = daily.select("symbol", F.col("date").alias("ex_date"), simple_return().alias("ret"))
    joined = splits.select("symbol", "ex_date").join(returns, ["symbol", "ex_date"], "left")
    return joined.withColumn("smooth", F.coalesce(F.abs("ret") < tolerance, F.lit(False)))


def smooth_at(daily: DataFrame, symbol: str, day: date | str, *, tolerance: float = DEFAULTS.smooth_tolerance) -> bool:
    """Whether one symbol's return on a day is within tolerance; no row there, or none before it, is not smooth."""
    one = daily.sparkSession.range(1).select(F.lit(symbol).alias("symbol"), F.lit(day).cast("date").alias("ex_date"))
    return split_smoothness(daily.filter(F.col("symbol") == symbol), one, tolerance=tolerance).first().smooth


def trim_phantoms(daily: DataFrame, excused: DataFrame | None = None, *, jump: float = DEFAULTS.phantom_jump) -> DataFrame:
    """History from each symbol's latest unexcused jump on; ``excused(symbol, date)``."""
    marked = daily.withColumn("ret__", simple_return())
    jumped = F.abs("ret__") > jump
    if excused is not None:
        marked = marked.join(excused.select("symbol", "date", F.lit(True).alias("excused__")).distinct(), ["symbol", "date"], "left")
        jumped = jumped & F.col("excused__").isNull()
    seam = F.max(F.when(jumped, F.col("date"))).over(Window.partitionBy("symbol"))
    return marked.withColumn("seam__", seam).filter(F.col("seam__").isNull() | (F.col("date") >= F.col("seam__"))).select(*daily.columns)


def after_structural_events(daily: DataFrame, events: DataFrame) -> DataFrame:
    """Rows strictly after a symbol's latest event; ``events(symbol, event_date)``."""
    last = events.groupBy("symbol").agg(F.max("event_date").alias("last_event"))
    return daily.join(last, "symbol", "left").filter(F.col("last_event").isNull() | (F.col("date") > F.col("last_event"))).select(*daily.columns)


def rolling_median_turnover(daily: DataFrame, *, window: int = DEFAULTS.liquidity_window, least: int = DEFAULTS.liquidity_min_periods) -> DataFrame:
    """daily with adv (close * volume) and its trailing median adv_median, null under ``least`` rows."""
    frame = by_symbol().rowsBetween(-(window - 1), 0)
    priced = daily.withColumn("adv", F.col("close") * F.col("volume"))
    median = F.when(F.count("adv").over(frame) >= least, F.percentile("adv", F.lit(0.5)).over(frame))
    return priced.withColumn("adv_median", median)


def liquidity_filter(daily: DataFrame, *, window: int = DEFAULTS.liquidity_window, least: int = DEFAULTS.liquidity_min_periods, floor: float = DEFAULTS.liquidity_floor) -> DataFrame:
    """Rows whose trailing median turnover reaches the floor."""
    return rolling_median_turnover(daily, window=window, least=least).filter(F.col("adv_median") >= floor).select(*daily.columns)


def segments(daily: DataFrame, *, max_gap: int = DEFAULTS.max_gap_days) -> DataFrame:
    """daily with gap_days and segment_id, which rises at each gap of more than ``max_gap`` days."""
    running = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    gapped = daily.withColumn("gap_days", days_since_previous())
    return gapped.withColumn("segment_id", F.sum(F.when(F.col("gap_days") > max_gap, 1).otherwise(0)).over(running))


def _in_window(window_start: str | None, window_end: str | None, start: Column, end: Column) -> Column:
    """Whether [start, end] meets the window."""
    met = F.lit(True)
    if window_start:
        met = met & (end >= F.lit(window_start).cast("date"))
    if window_end:
        met = met & (start <= F.lit(window_end).cast("date"))
    return met


def segment_detail(daily: DataFrame, *, window_start: str | None = None, window_end: str | None = None, max_gap: int = DEFAULTS.max_gap_days) -> DataFrame:
    """(symbol, segment_id, n_rows, seg_start, seg_end, max_gap, in_window) of every segment.

    ``in_window`` tells whether the segment meets the window; the gap that begins a segment is no gap inside it.
    """
    cut = segments(daily, max_gap=max_gap)
    inside = F.when(F.col("gap_days") <= max_gap, F.col("gap_days")).otherwise(0)
    stats = cut.groupBy("symbol", "segment_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("seg_start"), F.max("date").alias("seg_end"), F.max(inside).alias("max_gap"))
    return stats.withColumn("in_window", _in_window(window_start, window_end, F.col("seg_start"), F.col("seg_end")))


def contiguity_filter(daily: DataFrame, *, window_start: str | None = None, window_end: str | None = None, max_gap: int = DEFAULTS.max_gap_days) -> DataFrame:
    """Each symbol's best segment: one that meets the window, then the longest, then the latest."""
    own = Window.partitionBy("symbol", "segment_id")
    # A symbol's rows are together from the first rule on, so this costs no further shuffle.
    cut = segments(daily, max_gap=max_gap).withColumn("n__", F.count(F.lit(1)).over(own)).withColumn("from__", F.min("date").over(own)).withColumn("to__", F.max("date").over(own))
    place = F.struct(_in_window(window_start, window_end, F.col("from__"), F.col("to__")).alias("in_window"), "n__", "to__", "segment_id")
    best = cut.withColumn("best__", F.max(place).over(Window.partitionBy("symbol")))
    return best.filter(F.col("segment_id") == F.col("best__.segment_id")).select(*daily.columns)


def max_internal_gap(daily: DataFrame) -> DataFrame:
    """(symbol, max_gap): each symbol's longest calendar gap."""
    return daily.select("symbol", days_since_previous().alias("gap")).groupBy("symbol").agg(F.max("gap").alias("max_gap"))


def min_history(daily: DataFrame, *, days: int = DEFAULTS.min_history_days) -> DataFrame:
    """Rows of symbols with at least so many rows."""
    return daily.withColumn("n__", F.count(F.lit(1)).over(Window.partitionBy("symbol"))).filter(F.col("n__") >= days).drop("n__")


def gate_survivors(
    daily: DataFrame, keep: DataFrame, dividends: DataFrame, windows: DataFrame, *, jump: float = DEFAULTS.gate_jump, since: str = DEFAULTS.gate_from
) -> DataFrame:
    """(symbol, date, ret, excused): jumps since a date, less kept events and dividend ex-dates.

    ``keep(symbol, date)``, ``dividends(symbol, date)``, ``windows(start, end)``; excused tells that
    the date lies in a window, ends included. Unexcused rows are what the gate lets through.
    """
    jumps = daily.select("symbol", "date", simple_return().alias("ret")).filter((F.abs("ret") > jump) & (F.col("date") >= F.lit(since).cast("date")))
    rest = jumps.join(keep, ["symbol", "date"], "left_anti").join(dividends, ["symbol", "date"], "left_anti")
    days = windows.select(F.explode(F.sequence("start", "end")).alias("date")).distinct()
    inside = rest.join(days, "date", "left_semi").withColumn("excused", F.lit(True))
    outside = rest.join(days, "date", "left_anti").withColumn("excused", F.lit(False))
    return outside.unionByName(inside)


def validation_gate(survivors: DataFrame, blind: DataFrame) -> DataFrame:
    """One row (n_survivors, n_excused_window, n_blind, passed); ``blind(symbol)`` have no action data."""
    marked = survivors.join(blind.select("symbol", F.lit(True).alias("is_blind")), "symbol", "left")
    live = ~F.col("excused")
    return marked.agg(
        F.count_if(live).alias("n_survivors"), F.count_if(F.col("excused")).alias("n_excused_window"), F.count_if(live & F.col("is_blind")).alias("n_blind")
    ).withColumn("passed", F.col("n_survivors") == 0)


def classify_survivors(survivors: DataFrame, keep: DataFrame, *, crash_start: str = "2020-02-24", crash_end: str = "2020-04-03") -> DataFrame:
    """survivors with action: KEEP_HARDCODED, KEEP_COVID or TRIM, in this order."""
    listed = keep.select("symbol", "date", F.lit(True).alias("listed"))
    crash = F.col("date").between(F.lit(crash_start).cast("date"), F.lit(crash_end).cast("date"))
    return survivors.join(listed, ["symbol", "date"], "left").withColumn(
        "action", F.when(F.col("listed"), "KEEP_HARDCODED").when(crash, "KEEP_COVID").otherwise("TRIM")
    ).drop("listed")


def trim_bounds(classified: DataFrame) -> DataFrame:
    """(symbol, left_cut, right_cut): without a KEEP the latest TRIM; else the nearest TRIM on each side of the KEEPs."""
    kept, trim = F.col("action").startswith("KEEP"), F.col("action") == "TRIM"
    ends = classified.groupBy("symbol").agg(F.min(F.when(kept, F.col("date"))).alias("first_keep"), F.max(F.when(kept, F.col("date"))).alias("last_keep"))
    both = classified.filter(trim).join(ends, "symbol")
    left = F.max(F.when(F.col("first_keep").isNull() | (F.col("date") < F.col("first_keep")), F.col("date")))
    right = F.min(F.when(F.col("date") > F.col("last_keep"), F.col("date")))
    return both.groupBy("symbol").agg(left.alias("left_cut"), right.alias("right_cut"))


def apply_repair(daily: DataFrame, classified: DataFrame) -> DataFrame:
    """Rows with left_cut <= date < right_cut of their symbol's bounds."""
    bounds = trim_bounds(classified)
    inside = (F.col("left_cut").isNull() | (F.col("date") >= F.col("left_cut"))) & (F.col("right_cut").isNull() | (F.col("date") < F.col("right_cut")))
    return daily.join(bounds, "symbol", "left").filter(inside).select(*daily.columns)
