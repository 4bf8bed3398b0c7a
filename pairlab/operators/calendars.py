"""Trading calendar, sessions and walk-forward folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlab.params import DEFAULTS


def trading_calendar(
    daily: DataFrame, *, start: str = DEFAULTS.calendar_start, end: str = DEFAULTS.calendar_end, min_symbols: int = DEFAULTS.min_symbols_per_day, holidays: tuple[str, ...] = DEFAULTS.fixed_holidays
) -> DataFrame:
    """(date): weekdays from start to end that are no fixed holiday and on which enough rows are present."""
    days = daily.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    open_day = (F.weekday("date") < 5) & ~F.date_format("date", "MM-dd").isin(*holidays)
    return days.filter(open_day).groupBy("date").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_symbols).select("date")


def calendar_filter(daily: DataFrame, calendar: DataFrame) -> DataFrame:
    """Rows whose date is a trading day."""
    return daily.join(calendar, "date", "left_semi")


def calendar_audit(daily: DataFrame, calendar: DataFrame) -> DataFrame:
    """One row: rows before and after the filter, and rows dropped for weekends and January 1."""
    marked = daily.join(calendar.withColumn("kept", F.lit(1)), "date", "left")
    return marked.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count("kept").alias("rows_after"),
        F.count_if(F.weekday("date") >= 5).alias("weekend_rows"),
        F.count_if(F.date_format("date", "MM-dd") == "01-01").alias("jan1_rows"),
    )


def days_per_year(calendar: DataFrame) -> DataFrame:
    """(year, n_days) of a trading calendar."""
    return calendar.groupBy(F.year("date").alias("year")).agg(F.count_distinct("date").alias("n_days"))


def numbered_days(days: DataFrame) -> DataFrame:
    """(date, i): distinct dates counted from 0; a calendar has thousands of rows, so one task orders it."""
    return days.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)


def build_folds(days: DataFrame, *, prior: int, train: int, test: int, step: int | None = None) -> DataFrame:
    """(fold_id, prior_start, prior_end, train_start, train_end, test_start, test_end), one row a fold.

    The first test begins after prior + train days and folds move by ``step`` (``test`` if not given).
    Raises for lengths under 1; too few days fail when the result is computed.
    """
    step = test if step is None else step
    if min(prior, train, test, step) < 1:
        raise ValueError("prior, train, test and step must be at least 1")
    numbered = numbered_days(days)
    n = numbered.agg(F.count(F.lit(1)).cast("int").alias("n")).select(
        F.when(F.col("n") < prior + train + test, F.raise_error(F.concat(F.lit("too few days for one fold: "), F.col("n").cast("string"))).cast("int")).otherwise(F.col("n")).alias("n")
    )
    starts = n.select(F.explode(F.sequence(F.lit(prior + train), F.col("n") - test, F.lit(step))).alias("s")).select(((F.col("s") - prior - train) / step).cast("int").alias("fold_id"), "s")
    offsets = {"prior_start": -prior - train, "prior_end": -train - 1, "train_start": -train, "train_end": -1, "test_start": 0, "test_end": test - 1}
    ends = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), (F.col("s") + v).alias("i")) for k, v in offsets.items()])).alias("e")
    found = starts.select("fold_id", ends).select("fold_id", "e.name", "e.i").join(numbered, "i")
    return found.groupBy("fold_id").agg(*[F.max(F.when(F.col("name") == k, F.col("date"))).alias(k) for k in offsets])


def resolve_windows(days: DataFrame, *, target: int = DEFAULTS.train_days, least: int = DEFAULTS.min_train_days) -> DataFrame:
    """One row (n_days, train_start, train_end, prior_start, prior_end): the last ``target`` days, and as many before, as far as there are; no row under ``least`` days."""
    numbered = numbered_days(days)
    n = numbered.agg(F.count(F.lit(1)).cast("int").alias("n")).filter(F.col("n") >= least)
    first = n.select("n", F.greatest(F.col("n") - target, F.lit(0)).alias("a"))
    spans = first.withColumn("length", F.col("n") - F.col("a")).withColumn("p", F.greatest(F.col("a") - F.col("length"), F.lit(0)))
    at = lambda i: F.max(F.when(F.col("i") == i, F.col("date")))
    # spans is one row.
    return numbered.crossJoin(F.broadcast(spans)).groupBy("n", "a", "p").agg(
        at(F.col("a")).alias("train_start"), at(F.col("n") - 1).alias("train_end"),
        F.max(F.when((F.col("a") > 0) & (F.col("i") == F.col("p")), F.col("date"))).alias("prior_start"), at(F.col("a") - 1).alias("prior_end"),
    ).select(F.col("n").alias("n_days"), "train_start", "train_end", "prior_start", "prior_end")


#: Days of a bin in which rows and spans meet.
BIN_DAYS = 256


def within(rows: DataFrame, spans: DataFrame, lo: str, hi: str, by: tuple[str, ...] = (), date: str = "date") -> DataFrame:
    """rows joined to the spans, from ``lo`` to ``hi`` with both ends, that hold their date and share the columns ``by``.

    Both meet in bins of days, so a row is compared with the few spans near it, however many there are.
    """
    bin_of = lambda c: F.floor(F.unix_date(c) / BIN_DAYS)
    near = spans.withColumn("bin__", F.explode(F.sequence(bin_of(lo), bin_of(hi))))
    met = rows.withColumn("bin__", bin_of(date)).join(near, [*by, "bin__"])
    return met.filter(F.col(date).between(F.col(lo), F.col(hi))).drop("bin__")


def overlapping_folds(folds: DataFrame, lo: str, hi: str) -> DataFrame:
    """Folds whose test window meets [lo, hi]."""
    return folds.filter((F.col("test_end") >= F.lit(lo).cast("date")) & (F.col("test_start") <= F.lit(hi).cast("date")))


def bar_of_session(ts: Column, *, open_minute: int = 9 * 60 + 15) -> Column:
    """Minutes since the session opened."""
    return F.hour(ts) * 60 + F.minute(ts) - F.lit(open_minute)


def session_grid(spark: SparkSession, day: str, *, bars: int = DEFAULTS.bars_per_session, open_time: str = "09:15:00") -> DataFrame:
    """(ts, bar): the minutes of one session."""
    start = F.to_timestamp_ntz(F.lit(f"{day} {open_time}"))
    return spark.range(bars).select((start + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("ts"), F.col("id").cast("int").alias("bar"))
