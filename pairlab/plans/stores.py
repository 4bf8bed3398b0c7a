"""Registered queries on what readers and sinks keep: tables are written to the shared folder and read again by the library's readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.checkpoints import materialized, shared_folder
from pairlab.fixtures import F1_SQL
from pairlab.operators import actions
from pairlab.plans import intraday as bars
from pairlab.plans.daily import f1, query, rounded
from pairlab.plans.intraday import F3, PER_SESSION
from pairlab.sources import csv_bars, tables


def _minute_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session panel in the columns of a minute store; a bar's time is its start in the session's time zone."""
    start = F.to_timestamp(F.concat(F.col("session").cast("string"), F.format_string(" %02d:00:00", F.col("bar") * 2)))
    prices = [F.col("close").alias(c) for c in ("open", "high", "low", "close")]
    rows = bars.bars(spark, sf_dir).select("symbol", start.alias("timestamp"), F.col("session").alias("date"), F.year("session").alias("year"), *prices, "volume")
    full = F.count(F.lit(1)).over(bars.Window.partitionBy("symbol", "date")) >= PER_SESSION
    return rows.withColumn("partial_day_flag", ~full)


@query(f"""WITH {F3}, d AS (SELECT min(session) AS lo FROM f3)
SELECT symbol, session AS date, bar, round(close, 6) AS close, volume FROM f3, d WHERE symbol IN ('click', 'purchase') AND session BETWEEN lo + 5 AND lo + 14 AND bar BETWEEN 4 AND 7""")
def minute_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two legs of a store by symbol and year, ten days of it, from eight to four o'clock."""
    rows = materialized(_minute_table(spark, sf_dir))
    path = shared_folder(spark, "minute")
    tables.write_minute(rows, path)
    lo, hi = rows.agg(F.date_add(F.min("date"), 5).cast("string"), F.date_add(F.min("date"), 14).cast("string")).first()
    zone = spark.conf.get("spark.sql.session.timeZone")
    leg = tables.read_leg(spark, path, ["click", "purchase"], lo, hi, zone=zone, open_minute=8 * 60, close_minute=16 * 60 - 1)
    return rounded(leg.select("symbol", "date", F.floor(F.hour("timestamp") / 2).cast("int").alias("bar"), "close", "volume"))


@query(f"""WITH {F3} SELECT symbol, count(*) AS n_rows, count(DISTINCT year(session)) AS n_partitions, count(DISTINCT session) FILTER (n < {PER_SESSION}) AS n_partial_days, min(session) AS first_day, max(session) AS last_day
FROM (SELECT *, count(*) OVER (PARTITION BY symbol, session) AS n FROM f3) GROUP BY 1""")
def ingest_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = csv_bars.ingest_stats(_minute_table(spark, sf_dir))
    return stats.select("symbol", "n_rows", "n_partitions", "n_partial_days", F.to_date("min_ts").alias("first_day"), F.to_date("max_ts").alias("last_day"))


@query("""WITH e AS (SELECT event_type AS symbol, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY event_id) AS before, count(*) OVER (PARTITION BY event_type, ts) AS n FROM events)
SELECT count(*) AS n_rows, max(n) AS max_group, max(n) <= 1 AND count_if(before >= ts) = 0 AS strictly_increasing, min(ts)::DATE AS first_day, max(ts)::DATE AS last_day FROM e""")
def order_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether events rise in time by type, in the order of their ids."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("timestamp"), "event_id")
    gates = csv_bars.key_gates(events, ["symbol"], "timestamp", "event_id")
    return gates.select("n_rows", "max_group", "strictly_increasing", F.to_date("min_order").alias("first_day"), F.to_date("max_order").alias("last_day"))


@query("""WITH f AS (SELECT DISTINCT n_name AS symbol FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9500), e AS (SELECT DISTINCT n_name AS symbol FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 9000)
SELECT symbol, 'found' AS side FROM f ANTI JOIN e USING (symbol) UNION ALL SELECT symbol, 'expected' FROM e ANTI JOIN f USING (symbol)""")
def universe_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that have rich customers or rich suppliers, but not both."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    nation = read("nation").select("n_nationkey", F.col("n_name").alias("symbol"))
    found = read("customer").filter("c_acctbal > 9500").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    expected = read("supplier").filter("s_acctbal > 9000").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return csv_bars.universe_mismatch(found, expected)


@query(f"WITH {F1_SQL} SELECT symbol, date, round(close, 6) AS close, round(volume, 4) AS volume FROM f1 WHERE year(date) BETWEEN 1994 AND 1995")
def daily_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two years of a daily store; the others' folders aren't read."""
    path = shared_folder(spark, "daily")
    tables.write_daily(f1(spark, sf_dir), path)
    kept = spark.read.parquet(path).filter(F.col("year").between(1994, 1995))
    return kept.select("symbol", "date", F.round("close", 6).alias("close"), F.round("volume", 4).alias("volume"))


@query(f"""WITH {F1_SQL} SELECT symbol, 'split' AS action_type, date AS ex_date, round(close / 50, 6) AS value FROM f1 WHERE day(date) = 1
UNION ALL SELECT symbol, 'dividend', date, round(close / 200, 6) FROM f1 WHERE day(date) = 15 AND month(date) % 3 = 0""")
def action_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a fetch would give of each symbol, made flat, kept sorted and read again."""
    event = lambda c: F.struct(F.col("date").alias("ex_date"), (F.col("close") / c).alias("value"))
    some = lambda when, c: F.collect_list(F.when(when, event(c)))  # noqa: E731  a few rows a symbol and year, as a source gives them
    day = F.day("date")
    fetched = f1(spark, sf_dir).filter(day.isin(1, 15)).groupBy("symbol").agg(some(day == 1, 50).alias("splits"), some((day == 15) & (F.month("date") % 3 == 0), 200).alias("dividends"))
    path = shared_folder(spark, "actions")
    tables.write_actions(actions.flatten_actions(fetched), path)
    return rounded(spark.read.parquet(path))


_SECTORS_SQL = "sc AS (SELECT upper(p_brand) AS symbol, min(p_name) AS company_name, CASE WHEN regexp_extract(p_brand, '(\\d+)', 1)::INT % 4 > 0 THEN upper(min(p_type)) END AS industry, 'IN' || regexp_extract(p_brand, '(\\d+)', 1) AS isin FROM part GROUP BY p_brand)"


def _sector_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as companies in a sector file, with letters and blanks as files have them; every fourth number has no industry."""
    number = F.regexp_extract("p_brand", r"(\d+)", 1)
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_brand").agg(F.min("p_name").alias("name"), F.min("p_type").alias("kind"))
    rows = rows.select(
        F.concat(F.lit(" "), "name").alias("company_name"), F.when(number.cast("int") % 4 > 0, F.concat(F.lower("kind"), F.lit("  "))).alias("industry"),
        F.concat(F.lower("p_brand"), F.lit(" ")).alias("symbol"), F.concat(F.lit("IN"), number).alias("isin"),
    )
    path = shared_folder(spark, "sectors")
    tables.write_csv(rows, path)
    return tables.read_sectors(spark, path)


@query(f"""WITH {_SECTORS_SQL}, ot AS (SELECT 'IN' || (s_suppkey % 20) AS isin, min(s_name) AS bse_industry FROM supplier GROUP BY 1)
SELECT symbol, company_name, industry, isin, bse_industry FROM sc LEFT JOIN ot USING (isin)""")
def sector_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sector file with the industries of a second source, one an ISIN."""
    other = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("IN"), (F.col("s_suppkey") % 20).cast("string")).alias("isin"), F.col("s_name").alias("bse_industry"))
    return tables.with_second_industry(_sector_file(spark, sf_dir), other).select("symbol", "company_name", "industry", "isin", "bse_industry")


@query(f"WITH {F1_SQL}, {_SECTORS_SQL} SELECT DISTINCT upper(f1.symbol) AS symbol FROM f1 ANTI JOIN (SELECT * FROM sc WHERE industry IS NOT NULL) s ON s.symbol = upper(f1.symbol)")
def unmapped_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.unmapped(f1(spark, sf_dir).select(F.upper("symbol").alias("symbol")), _sector_file(spark, sf_dir))


@query(f"WITH {F1_SQL} SELECT symbol, count(*) AS n_rows, min(date) AS first_day, max(date) AS last_day, round(avg(close), 6) AS mean_close FROM f1 GROUP BY 1")
def validated_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars that were written, counted and read again, and their report by symbol from its JSON lines."""
    back = tables.validated_passthrough(f1(spark, sf_dir), shared_folder(spark, "bars"), ["symbol", "date", "close"])
    report = back.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.avg("close").alias("mean_close"))
    path = shared_folder(spark, "report")
    tables.write_json(report, path)
    return rounded(spark.read.schema(report.schema).json(path))
