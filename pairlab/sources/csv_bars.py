"""Bars from CSV files, one file a symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlab.operators.clean import deduplicate, drop_bad_prices, zero_volume_flag
from pairlab.params import DEFAULTS

#: What counts as a missing field, and which file names hold bars.
NULLS = ("", "NA", "NaN", "null")
DAILY_NAME = r"^([A-Z0-9&\-]+)$"
MINUTE_NAME = r"^([A-Z0-9&\-]+)_minute-data\.csv$"
SKIPPED = ("sbin", "NSE_Instruments_23June2021")
_TEXT = "date string, open string, high string, low string, close string, volume string"


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """All fields as text with the file's name and a line that rises within each file."""
    rows = spark.read.schema(_TEXT).option("header", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.csv").csv(path)
    line = F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("id"))  # pieces of a file may be read in any order
    return rows.select("*", F.col("_metadata.file_name").alias("file"), line.alias("line"))


def _number(c: str, kind: str = "double") -> F.Column:
    blank = F.trim(c).isin(*NULLS) | F.col(c).isNull()
    return F.when(~blank, F.expr(f"try_cast(trim({c}) AS {kind})"))


def read_daily(spark: SparkSession, path: str, *, skip: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(symbol, date, open, high, low, close, volume, zero_volume_flag) of a folder.

    The date is the local one, the first 10 characters. Rows with a null or negative price go, null
    volume is 0, and of rows with one date the last of the file stays. Files whose name without
    ending is in ``skip``, in these very letters, or has other characters are no symbols.
    """
    stem = F.regexp_replace("file", r"\.csv$", "")
    rows = _raw(spark, path).withColumn("symbol", F.upper(stem)).filter(F.col("symbol").rlike(DAILY_NAME) & ~stem.isin(*skip))
    typed = rows.select("symbol", F.expr("try_to_date(substring(date, 1, 10), 'yyyy-MM-dd')").alias("date"), *[_number(c).alias(c) for c in ("open", "high", "low", "close", "volume")], "line")
    good = drop_bad_prices(typed.filter("date IS NOT NULL"))
    return zero_volume_flag(deduplicate(good, ["symbol", "date"], [F.col("line")]).drop("line"))


def read_minute(spark: SparkSession, path: str, *, drop_dates: tuple[str, ...] = (), zone: str = "Asia/Kolkata", full: int = DEFAULTS.bars_per_session) -> DataFrame:
    """(symbol, timestamp, date, year, open, high, low, close, volume, partial_day_flag) of a folder.

    Times carry an offset; rows that do not parse go. Dates are those of ``zone``. Of rows with one
    time the last of the file stays, and a day with fewer than ``full`` bars is partial.
    """
    rows = _raw(spark, path).withColumn("symbol", F.regexp_extract("file", MINUTE_NAME, 1)).filter("symbol <> ''")
    typed = rows.select("symbol", F.try_to_timestamp("date", F.lit("yyyy-MM-dd HH:mm:ssXXX")).alias("timestamp"), *[_number(c).alias(c) for c in ("open", "high", "low", "close")], F.coalesce(_number("volume").cast("long"), F.lit(0).cast("long")).alias("volume"), "line")
    local = F.from_utc_timestamp(F.to_utc_timestamp("timestamp", F.current_timezone()), zone)
    dated = drop_bad_prices(typed.filter("timestamp IS NOT NULL")).withColumn("date", F.to_date(local)).withColumn("year", F.year(local))
    if drop_dates:
        dated = dated.filter(~F.col("date").cast("string").isin(*drop_dates))
    once = deduplicate(dated, ["symbol", "timestamp"], [F.col("line")]).drop("line")
    return once.withColumn("partial_day_flag", F.count(F.lit(1)).over(Window.partitionBy("symbol", "date")) < full)


def ingest_stats(minute: DataFrame) -> DataFrame:
    """(symbol, n_rows, n_partitions, n_partial_days, min_ts, max_ts)."""
    return minute.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("year").alias("n_partitions"), F.count_distinct(F.when(F.col("partial_day_flag"), F.col("date"))).alias("n_partial_days"), F.min("timestamp").alias("min_ts"), F.max("timestamp").alias("max_ts")
    )


def universe_mismatch(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(symbol, side): symbols that only one side has; empty when they agree."""
    a, b = found.select("symbol").distinct(), expected.select("symbol").distinct()
    return a.join(b, "symbol", "left_anti").withColumn("side", F.lit("found")).unionByName(b.join(a, "symbol", "left_anti").withColumn("side", F.lit("expected")))


def require_universe(found: DataFrame, expected: DataFrame) -> DataFrame:
    """found, if it has the expected symbols and no others; else ValueError names some."""
    if wrong := universe_mismatch(found, expected).orderBy("side", "symbol").limit(10).collect():
        raise ValueError(f"symbols differ, among them {[(r.symbol, r.side) for r in wrong]}")
    return found


def require_rows(rows: DataFrame, what: str = "rows") -> DataFrame:
    """rows, if there are any; else ValueError."""
    if not rows.limit(1).count():
        raise ValueError(f"no {what} were read")
    return rows


def key_gates(rows: DataFrame, keys: list[str], order: str, line: str | None = None) -> DataFrame:
    """One row (n_rows, max_group, strictly_increasing, min_order, max_order).

    With ``line``, the column that gives the rows' order, strictly_increasing tells that ``order`` rises in it;
    a table without an order of its own rises strictly if no value repeats.
    """
    per = rows.groupBy(*keys, order).agg(F.count(F.lit(1)).alias("n"))
    gates = per.agg(F.sum("n").alias("n_rows"), F.max("n").alias("max_group"), (F.max("n") <= 1).alias("strictly_increasing"), F.min(order).alias("min_order"), F.max(order).alias("max_order"))
    if line is None:
        return gates
    falls = F.lag(order).over(Window.partitionBy(*keys).orderBy(line)) >= F.col(order)
    rises = rows.select(falls.alias("falls")).agg((F.count_if("falls") == 0).alias("rises"))
    return gates.crossJoin(F.broadcast(rises)).withColumn("strictly_increasing", F.col("strictly_increasing") & F.col("rises")).drop("rises")  # one row each


def require_gates(minute: DataFrame, *, full: int = DEFAULTS.bars_per_session, start: str | None = None, end: str | None = None) -> DataFrame:
    """minute, if it passes the gates after ingest; else ValueError tells the first that fails.

    No time repeats within a symbol, no day has over ``full`` bars, and all dates lie within [start, end].
    """
    gates = key_gates(minute, ["symbol"], "timestamp").first()
    if not gates.n_rows:
        raise ValueError("no rows")
    if not gates.strictly_increasing:
        raise ValueError("times repeat within a symbol")
    per_day = minute.groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"), F.min("date").cast("string").alias("lo"), F.max("date").cast("string").alias("hi")).first()
    if per_day.n > full:
        raise ValueError(f"a day has {per_day.n} bars, over {full}")
    if start and per_day.lo < start or end and per_day.hi > end:
        raise ValueError(f"dates from {per_day.lo} to {per_day.hi} leave [{start}, {end}]")
    return minute
