"""Summaries of the symbol universe."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlab.operators.clean import rolling_median_turnover, simple_return
from pairlab.params import DEFAULTS


def symbols_per_sector(symbols: DataFrame, *, floor: int = 5) -> DataFrame:
    """(sector, n, thin) of ``symbols(symbol, sector)``; thin sectors have fewer than ``floor`` symbols."""
    return symbols.groupBy("sector").agg(F.count_distinct("symbol").alias("n")).withColumn("thin", F.col("n") < floor)


def history_length(daily: DataFrame, *, short: int = 900) -> DataFrame:
    """One row: symbols, median, least and most rows of a symbol, and how many have at most ``short``."""
    per = daily.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("n_symbols"), F.percentile("n", F.lit(0.5)).alias("median_rows"), F.min("n").alias("min_rows"), F.max("n").alias("max_rows"), F.count_if(F.col("n") <= short).alias("n_short"))


def coverage(daily: DataFrame) -> DataFrame:
    """(symbol, year, n_rows, first_year): rows of each symbol and year, with the symbol's first year."""
    per = daily.groupBy("symbol", F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n_rows"))
    return per.withColumn("first_year", F.min("year").over(Window.partitionBy("symbol")))


def first_year_cohorts(daily: DataFrame) -> DataFrame:
    """(first_year, n_symbols)."""
    return daily.groupBy("symbol").agg(F.year(F.min("date")).alias("first_year")).groupBy("first_year").agg(F.count(F.lit(1)).alias("n_symbols"))


def return_distribution(daily: DataFrame, *, large: float = 0.20) -> DataFrame:
    """One row: number, population deviation, extremes of simple returns, and how many are large."""
    r = daily.select(simple_return().alias("ret")).filter("ret IS NOT NULL")
    return r.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("ret").alias("std"), F.min("ret").alias("min_ret"), F.max("ret").alias("max_ret"), F.count_if(F.abs("ret") > large).alias("n_large"))


def extreme_returns(daily: DataFrame, k: int = 5) -> DataFrame:
    """The k rows with the largest absolute return."""
    r = daily.select("symbol", "date", simple_return().alias("ret")).filter("ret IS NOT NULL")
    return r.orderBy(F.abs("ret").desc(), "symbol", "date").limit(k)


def return_histogram(daily: DataFrame, *, lo: float = -0.2, hi: float = 0.2, bins: int = 40) -> DataFrame:
    """(bin, n): returns in equal bins of [lo, hi], the last closed; others are left out."""
    r = daily.select(simple_return().alias("ret")).filter(F.col("ret").between(lo, hi))
    width = (hi - lo) / bins
    return r.select(F.least(F.floor((F.col("ret") - lo) / width), F.lit(bins - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def turnover_distribution(daily: DataFrame, *, floor: float = DEFAULTS.liquidity_floor, window: int = DEFAULTS.liquidity_window, least: int = DEFAULTS.liquidity_min_periods) -> DataFrame:
    """One row: quantiles over symbols of the median of rolling median turnover, and how many lie below the floor."""
    rolled = rolling_median_turnover(daily, window=window, least=least)
    per = rolled.groupBy("symbol").agg(F.percentile("adv_median", F.lit(0.5)).alias("m")).filter("m IS NOT NULL")
    q = lambda p, name: F.percentile("m", F.lit(p)).alias(name)
    return per.agg(F.count(F.lit(1)).alias("n_symbols"), q(0.5, "median_adv"), q(0.1, "p10_adv"), q(0.9, "p90_adv"), F.count_if(F.col("m") < floor).alias("n_below"))
