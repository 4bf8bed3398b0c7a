"""Dimension tables, partition-pruned readers and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_sectors(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, company_name, industry, isin) from a CSV with a header; symbols and industries trimmed and in capitals."""
    raw = spark.read.schema("company_name string, industry string, symbol string, isin string").option("header", True).option("enforceSchema", False).csv(path)
    clean = lambda c: F.upper(F.trim(c)).alias(c)
    return raw.select(clean("symbol"), F.trim("company_name").alias("company_name"), clean("industry"), F.trim("isin").alias("isin")).filter("symbol IS NOT NULL AND symbol <> ''")


def with_second_industry(sectors: DataFrame, other: DataFrame) -> DataFrame:
    """sectors with bse_industry of ``other(isin, bse_industry)``, one row an isin."""
    return sectors.join(other.groupBy("isin").agg(F.min("bse_industry").alias("bse_industry")), "isin", "left")


def unmapped(symbols: DataFrame, sectors: DataFrame) -> DataFrame:
    """Symbols without a sector."""
    return symbols.select("symbol").distinct().join(sectors.filter("industry IS NOT NULL"), "symbol", "left_anti")


def read_leg(spark: SparkSession, root: str, symbols: list[str], start: str, end: str, *, zone: str = "Asia/Kolkata", open_minute: int = 555, close_minute: int = 929) -> DataFrame:
    """Minute bars of some symbols in [start, end] and within the session; only their partitions and years are read.

    Of rows with one time the first stays.
    """
    from pairlab.operators.clean import deduplicate

    years = list(range(int(start[:4]), int(end[:4]) + 1))
    rows = spark.read.parquet(root).filter(F.col("symbol").isin(*symbols) & F.col("year").isin(*years))
    rows = rows.withColumn("line", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("id")))
    local = F.from_utc_timestamp(F.to_utc_timestamp("timestamp", F.current_timezone()), zone)
    minute = F.hour(local) * 60 + F.minute(local)
    inside = rows.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & minute.between(open_minute, close_minute))
    return deduplicate(inside, ["symbol", "timestamp"], [F.col("line")], keep="first").drop("line")


def write_minute(bars: DataFrame, path: str) -> None:
    """Hive-partitioned Parquet by symbol and year; a shuffle on them keeps one file a partition."""
    bars.repartition("symbol", "year").sortWithinPartitions("symbol", "year", "timestamp").write.mode("overwrite").option("compression", "zstd").partitionBy("symbol", "year").parquet(path)


def write_daily(bars: DataFrame, path: str) -> None:
    bars.withColumn("year", F.year("date")).repartition("year").sortWithinPartitions("year", "symbol", "date").write.mode("overwrite").partitionBy("year").parquet(path)


def write_actions(actions: DataFrame, path: str) -> None:
    """The action cache, sorted by symbol, date and type."""
    actions.sort("symbol", "ex_date", "action_type").write.mode("overwrite").parquet(path)


def validated_passthrough(rows: DataFrame, path: str, required: list[str]) -> DataFrame:
    """rows written and read again; raises if columns lack, there are no rows, or counts differ."""
    if lacking := [c for c in required if c not in rows.columns]:
        raise ValueError(f"columns lack: {lacking}")
    rows.write.mode("overwrite").parquet(path)
    back = rows.sparkSession.read.schema(rows.schema).parquet(path)
    count = lambda df: tuple(df.agg(F.count(F.lit(1)), F.count_distinct("symbol")).first())
    before, after = count(rows), count(back)
    if not before[0] or before != after:
        raise ValueError(f"wrote {before} rows and symbols, read {after}")
    return back


def write_csv(rows: DataFrame, path: str) -> None:
    """A small report table as one CSV file with a header."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(report: DataFrame, path: str) -> None:
    """Report rows as JSON lines."""
    report.select(F.to_json(F.struct(*report.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def dataset_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a Parquet dataset's files."""
    files = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size").distinct()
    return files.agg(F.sum("file_size")).first()[0] or 0
