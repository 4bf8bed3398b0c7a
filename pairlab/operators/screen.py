"""Correlation screening of same-sector pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.operators import blocks
from pairlab.operators.clean import by_symbol, days_since_previous
from pairlab.params import DEFAULTS

#: Symbols whose price follows another share class by construction.
SHARE_CLASS_DUPLICATES = ("TATAMTRDVR",)
#: Pairs bound by a controlling stake.
STRUCTURAL_PAIRS = (
    ("BAJAJFINSV", "BAJFINANCE"), ("BAJAJHLDNG", "BAJAJ-AUTO"), ("BAJAJHLDNG", "BAJAJFINSV"), ("BAJAJHLDNG", "BAJFINANCE"), ("M&M", "M&MFIN"),
    ("HDFC", "HDFCBANK"), ("HDFC", "HDFCLIFE"), ("HDFC", "HDFCAMC"), ("JSL", "JSLHISAR"),
)


def in_window(rows: DataFrame, start, end) -> DataFrame:
    """Rows from start to end, ends included."""
    return rows.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def eligible_symbols(daily: DataFrame, start, end, *, max_gap: int = DEFAULTS.max_gap_days) -> DataFrame:
    """(symbol): those with a row on both ends of the window and no longer gap inside it."""
    rows = in_window(daily, start, end).select("symbol", "date", days_since_previous().alias("gap"))
    per = rows.groupBy("symbol").agg(
        F.bool_or(F.col("date") == F.lit(start).cast("date")).alias("a"), F.bool_or(F.col("date") == F.lit(end).cast("date")).alias("b"), F.max("gap").alias("g")
    )
    return per.filter(F.col("a") & F.col("b") & (F.col("g") <= max_gap)).select("symbol")


def log_returns(daily: DataFrame, *, place: str | None = None, block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """daily with log_ret; restrict the window first, for its first row has none.

    ``place`` may name a column that counts a symbol's rows without gaps; with it symbols run in blocks with tasks of their own.
    """
    if place is not None:
        cut = blocks.with_rows_before(daily, place, 1, block_rows=block_rows)
        before = F.lag("close").over(Window.partitionBy("symbol", "block__").orderBy(place))
        cut = cut.withColumn("log_ret", F.ln(F.try_divide(F.col("close"), before)))
        return cut.filter(F.col("block__") == blocks.block_of(place, block_rows)).drop("block__")
    return daily.withColumn("log_ret", F.ln(F.try_divide(F.col("close"), F.lag("close").over(by_symbol()))))


def complete_dates(returns: DataFrame) -> DataFrame:
    """(date): dates on which every symbol of the table has a return."""
    n = returns.agg(F.count_distinct("symbol").alias("n_symbols"))  # one row
    per = returns.groupBy("date").agg(F.count("log_ret").alias("n"))
    return per.join(F.broadcast(n), per.n == n.n_symbols).select("date")


def pair_correlations(returns: DataFrame, sectors: DataFrame) -> DataFrame:
    """(sym1, sym2, sector, corr) of all same-sector pairs over the dates that all symbols share.

    Pairs come from an equi-join on sector and date; correlation is null where a leg is constant.
    """
    known = returns.select("symbol", "date", "log_ret").join(sectors.filter("sector IS NOT NULL").select("symbol", "sector"), "symbol")
    both = known.join(complete_dates(returns), "date", "left_semi")
    a = both.select(F.col("symbol").alias("sym1"), "sector", "date", F.col("log_ret").alias("r1"))
    b = both.select(F.col("symbol").alias("sym2"), "sector", "date", F.col("log_ret").alias("r2"))
    per = a.join(b, ["sector", "date"]).filter("sym1 < sym2").groupBy("sym1", "sym2", "sector").agg(
        F.covar_pop("r1", "r2").alias("c"), F.stddev_pop("r1").alias("s1"), F.stddev_pop("r2").alias("s2")
    )
    return per.select("sym1", "sym2", "sector", F.try_divide(F.col("c"), F.col("s1") * F.col("s2")).alias("corr"))


def screen_pairs(daily: DataFrame, sectors: DataFrame, start, end, *, threshold: float = DEFAULTS.correlation_threshold, max_gap: int = DEFAULTS.max_gap_days) -> DataFrame:
    """Same-sector pairs of eligible symbols whose correlation is strictly above the threshold."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must lie in [0, 1]")
    if str(start) >= str(end):
        raise ValueError("start must precede end")
    rows = in_window(daily, start, end)
    chosen = log_returns(rows.join(eligible_symbols(daily, start, end, max_gap=max_gap), "symbol", "left_semi"))
    return pair_correlations(chosen.filter("log_ret IS NOT NULL"), sectors).filter(F.col("corr") > threshold)


def ranked_pairs(correlations: DataFrame) -> DataFrame:
    """Pairs in report order: the highest correlation first, then by name; rank counts from 1 in each sector."""
    order = Window.partitionBy("sector").orderBy(F.col("corr").desc_nulls_last(), "sym1", "sym2")
    return correlations.withColumn("rank", F.row_number().over(order))


def is_share_class_duplicate(symbol: Column, isin: Column | None = None, *, listed: tuple[str, ...] = SHARE_CLASS_DUPLICATES, suffix: str = "DVR", country: str = "INE") -> Column:
    """Listed, or ends with the suffix, or has an ISIN of another kind than the country's shares."""
    s = F.upper(symbol)
    by_name = s.isin(*listed) | s.endswith(suffix)
    return by_name if isin is None else by_name | (isin.isNotNull() & ~F.upper(isin).startswith(country))


def is_structural_pair(sym1: Column, sym2: Column, pairs: tuple[tuple[str, str], ...] = STRUCTURAL_PAIRS) -> Column:
    """Whether the unordered pair is listed."""
    key = F.concat_ws("|", F.least(sym1, sym2), F.greatest(sym1, sym2))
    return key.isin(*["|".join(sorted(p)) for p in pairs])


def last_days(calendar: DataFrame, n: int = DEFAULTS.correlation_days) -> DataFrame:
    """One row (start, end): the window of the last n days."""
    late = calendar.select("date").distinct().withColumn("r", F.row_number().over(Window.orderBy(F.col("date").desc())))
    return late.filter(F.col("r") <= n).agg(F.min("date").alias("start"), F.max("date").alias("end"))
