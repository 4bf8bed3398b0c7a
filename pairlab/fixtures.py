"""Price-shaped views over the generic test tables, for demonstration and tests.

``calendar_panel`` is gappy (cleaning rules), ``dense_panel`` has common factors (statistics) and
``intraday_panel`` has bars in sessions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlab.checkpoints import materialized
from pairlab.operators import blocks

#: Lines of all brands in a bin of order keys.
BIN_LINES = 500_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _branded_lines(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    lines = _table(spark, sf_dir, "lineitem").select("l_partkey", *columns)
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")


def sector_of(symbol) -> F.Column:
    """Sector of a brand symbol: its number modulo 5."""
    return F.concat(F.lit("S"), F.pmod(F.regexp_extract(symbol, r"(\d+)", 1).cast("int"), F.lit(5)).cast("string"))


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, sector) of every brand."""
    return _table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol")).distinct().withColumn("sector", sector_of(F.col("symbol")))


def calendar_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, sector, date, open, high, low, close, volume), one row a symbol and ship date."""
    daily = (
        _branded_lines(spark, sf_dir, "l_shipdate", "l_extendedprice", "l_quantity")
        .groupBy("symbol", F.to_date("l_shipdate").alias("date"))
        .agg(F.avg("l_extendedprice").alias("p"), F.sum("l_quantity").alias("q"))
    )
    whole = daily.agg(F.avg("p").alias("mp"), F.stddev_samp("p").alias("sp"), F.avg("q").alias("mq"))  # one row
    close = F.round(F.lit(100.0) * F.exp(F.lit(0.12) * (F.col("p") - F.col("mp")) / F.col("sp")), 8)
    return daily.crossJoin(F.broadcast(whole)).select(
        "symbol",
        sector_of(F.col("symbol")).alias("sector"),
        "date",
        *[close.alias(c) for c in ("open", "high", "low", "close")],
        F.round(F.lit(100000.0) * F.col("q") / F.col("mq"), 6).alias("volume"),
    )


def dense_panel(spark: SparkSession, sf_dir: str, *, bin_lines: int = BIN_LINES, block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """(symbol, sector, date, close, volume) on consecutive weekdays, with sector trends.

    Lines are numbered in bins of order keys, and means and trends come from blocks of places, so no task holds a symbol.
    """
    lines = _branded_lines(spark, sf_dir, "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity")
    keys = _table(spark, sf_dir, "lineitem").agg(F.min("l_orderkey").alias("lo"), F.max("l_orderkey").alias("hi"), F.ceil(F.count(F.lit(1)) / bin_lines).alias("bins"))  # one row
    place = F.floor((F.col("l_orderkey") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1) * F.col("bins"))
    lines = lines.crossJoin(F.broadcast(keys)).withColumn("bin", F.coalesce(place, F.lit(-1))).select("symbol", "bin", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_discount") + F.col("l_tax")).alias("u"), "l_quantity")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    kept = blocks.numbered(lines, ["symbol"], order, "bin", "k", lambda df: materialized(df.drop(*order)))
    kept = kept.select("symbol", sector_of(F.col("symbol")).alias("sector"), "k", "u", "l_quantity")
    whole = kept.agg(F.avg("u").alias("mu"), F.stddev_samp("u").alias("su"))
    scored = kept.crossJoin(F.broadcast(whole)).withColumn("e", (F.col("u") - F.col("mu")) / F.col("su"))
    # A block of a sector's places is one task; rows copied from the block before serve the trailing means only.
    near = blocks.with_rows_before(scored, "k", 19, block="block", block_rows=block_rows).repartition("sector", "block")
    near = near.withColumn("own", F.avg("e").over(Window.partitionBy("sector", "block", "symbol").orderBy("k").rowsBetween(-19, 0)))
    near = near.filter(F.col("block") == blocks.block_of("k", block_rows))
    same = Window.partitionBy("sector", "block", "k")
    near = near.withColumn("m", F.when(F.col("symbol") == F.min("symbol").over(same), F.avg("e").over(same)))
    near = near.withColumn("inside", F.sum("m").over(Window.partitionBy("sector", "block").orderBy("k").rangeBetween(Window.unboundedPreceding, 0)))
    near = materialized(near.select("symbol", "sector", "block", "k", "own", "inside", "l_quantity"))
    ends = near.groupBy("sector", "block").agg(F.max_by("inside", "k").alias("end"))
    earlier = Window.partitionBy("sector").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("sector", "block", F.coalesce(F.sum("end").over(earlier), F.lit(0.0)).alias("carry"))
    return near.join(F.broadcast(carried), ["sector", "block"]).select(
        "symbol",
        "sector",
        dense_day(F.col("k")).alias("date"),
        F.round(F.exp(F.ln(F.lit(100.0)) + 0.02 * (F.col("carry") + F.col("inside")) + 0.02 * F.col("own")), 10).alias("close"),
        (F.col("l_quantity") * 1e6).alias("volume"),
    )


def dense_day(place) -> F.Column:
    """The date of a row of the dense panel by its place, counted from 1: weekdays without gaps."""
    return F.date_add(F.lit("1995-01-02").cast("date"), (F.floor((place - 1) / 5) * 7 + F.pmod(place - 1, F.lit(5))).cast("int"))


def dense_place(date) -> F.Column:
    """The place, counted from 1, of a date of the dense panel."""
    days = F.date_diff(date, F.lit("1995-01-02").cast("date"))
    return (F.floor(days / 7) * 5 + F.pmod(days, F.lit(7)) + 1).cast("long")


def intraday_panel(spark: SparkSession, sf_dir: str, *, bar_minutes: int = 120) -> DataFrame:
    """(symbol, session, bar, ts, close, volume): the last price of each bar that has an event."""
    events = _table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("symbol"), "value")
    whole = events.agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.count(F.lit(1)).alias("n"))
    scored = events.crossJoin(F.broadcast(whole)).withColumn("e", (F.col("value") - F.col("m")) / F.col("s"))
    # A running sum in two levels, within days and over the days' sums, so that no task holds all events.
    scored = scored.withColumn("session", F.to_date("ts"))
    per_day = scored.groupBy("session").agg(F.sum("e").alias("day_sum"))
    before = per_day.select("session", F.coalesce(F.sum("day_sum").over(Window.orderBy("session").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("days_before"))
    scored = scored.join(before, "session")
    common = F.col("days_before") + F.sum("e").over(Window.partitionBy("session").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    own = F.avg("e").over(Window.partitionBy("symbol").orderBy("ts", "event_id").rowsBetween(-99, 0))
    minute = F.hour("ts") * 60 + F.minute("ts")
    priced = scored.select(
        "symbol", "session", F.floor(minute / bar_minutes).cast("int").alias("bar"), "ts", "event_id",
        F.round(F.exp(F.ln(F.lit(100.0)) + 0.2 * common / F.sqrt("n") + 0.3 * own), 10).alias("price"),
    )
    return priced.groupBy("symbol", "session", "bar").agg(
        F.min("ts").alias("ts"), F.max_by("price", F.struct("ts", "event_id")).alias("close"), F.count(F.lit(1)).alias("volume")
    )


#: The same views for DuckDB, as common table expressions; F3 takes the bar length in minutes.
SECTOR_SQL = "'S' || (regexp_extract({0}, '(\\d+)', 1)::INT % 5)"
F1_SQL = f"""f1d AS (
  SELECT p_brand AS symbol, l_shipdate::DATE AS date, avg(l_extendedprice) AS p, sum(l_quantity) AS q
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
), f1w AS (SELECT avg(p) AS mp, stddev_samp(p) AS sp, avg(q) AS mq FROM f1d),
f1 AS (
  SELECT symbol, {SECTOR_SQL.format('symbol')} AS sector, date, round(100.0::DOUBLE * exp(0.12::DOUBLE * (p - mp) / sp), 8) AS close,
    round(100000.0::DOUBLE * q / mq, 6) AS volume FROM f1d, f1w
)"""
F2_SQL = f"""f2k AS (
  SELECT p_brand AS symbol, {SECTOR_SQL.format('p_brand')} AS sector, l_discount + l_tax AS u, l_quantity,
    row_number() OVER (PARTITION BY p_brand ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k
  FROM lineitem JOIN part ON l_partkey = p_partkey
), f2w AS (SELECT avg(u) AS mu, stddev_samp(u) AS su FROM f2k),
f2e AS (SELECT symbol, sector, k, l_quantity, (u - mu) / su AS e FROM f2k, f2w),
f2t AS (
  SELECT sector, k, sum(m) OVER (PARTITION BY sector ORDER BY k ROWS UNBOUNDED PRECEDING) AS trend
  FROM (SELECT sector, k, avg(e) AS m FROM f2e GROUP BY 1, 2)
), f2o AS (SELECT *, avg(e) OVER (PARTITION BY symbol ORDER BY k ROWS 19 PRECEDING) AS own FROM f2e),
f2 AS (
  SELECT symbol, o.sector, (DATE '1995-01-02' + (((o.k - 1) // 5) * 7 + (o.k - 1) % 5)::INT)::DATE AS date,
    round(exp(ln(100.0::DOUBLE) + 0.02::DOUBLE * trend + 0.02::DOUBLE * own), 10) AS close, l_quantity * 1e6 AS volume
  FROM f2o o JOIN f2t t ON o.sector = t.sector AND o.k = t.k
)"""


def f3_sql(bar_minutes: int = 120) -> str:
    return f"""f3w AS (SELECT avg(value) AS m, stddev_samp(value) AS s, count(*) AS n FROM events),
f3e AS (SELECT event_id, ts, event_type AS symbol, (value - m) / s AS e, n FROM events, f3w),
f3p AS (
  SELECT symbol, ts::DATE AS session, ((hour(ts) * 60 + minute(ts)) // {bar_minutes})::INT AS bar, ts, event_id,
    round(exp(ln(100.0::DOUBLE) + 0.2::DOUBLE * sum(e) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) / sqrt(n)
      + 0.3::DOUBLE * avg(e) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS 99 PRECEDING)), 10) AS price
  FROM f3e
), f3 AS (
  SELECT symbol, session, bar, min(ts) AS ts, arg_max(price, (ts, event_id)) AS close, count(*) AS volume FROM f3p GROUP BY 1, 2, 3
)"""
