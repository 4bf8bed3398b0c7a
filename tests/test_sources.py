import pytest
from pyspark.sql import functions as F

from pairlab.sources import csv_bars, tables

HEAD = "date,open,high,low,close,volume\n"


def test_daily_csv(spark, tmp_path):
    (tmp_path / "AAA.csv").write_text(HEAD + "2020-01-01 00:00:00+05:30,1,1,1,1,10\n2020-01-01 00:00:00+05:30,2,2,2,2,\n2020-01-02 00:00:00+05:30,1,1,NA,1,5\n2020-01-03 00:00:00+05:30,1,-1,1,1,5\n2020-01-04 00:00:00+05:30,0,0,0,0,5\n")
    (tmp_path / "bad name.csv").write_text(HEAD + "2020-01-01 00:00:00+05:30,1,1,1,1,10\n")
    for name, close in (("SBIN", 7), ("sbin", 8), ("NSE_Instruments_23June2021", 9), ("abc", 6)):
        (tmp_path / f"{name}.csv").write_text(HEAD + f"2020-01-05 00:00:00+05:30,1,1,1,{close},10\n")
    rows = csv_bars.read_daily(spark, str(tmp_path)).orderBy("date", "symbol").collect()
    assert [(r.symbol, str(r.date), r.close, r.volume, r.zero_volume_flag) for r in rows] == [
        ("AAA", "2020-01-01", 2.0, 0.0, True), ("AAA", "2020-01-04", 0.0, 5.0, False), ("ABC", "2020-01-05", 6.0, 10.0, False), ("SBIN", "2020-01-05", 7.0, 10.0, False),
    ]


def test_gates_raise(spark):
    from datetime import date, datetime

    rows = [("A", datetime(2020, 1, 2, 9, 15 + i), date(2020, 1, 2), i) for i in range(3)]
    minute = spark.createDataFrame(rows, "symbol string, timestamp timestamp, date date, n int")
    symbols = spark.createDataFrame([("A",)], "symbol string")
    assert csv_bars.require_gates(minute, start="2020-01-01", end="2020-01-31").count() == csv_bars.require_universe(minute, symbols).count() == csv_bars.require_rows(minute).count() == 3
    for bad, message in ((minute.union(minute), "repeat"), (minute.filter("n > 9"), "no rows")):
        with pytest.raises(ValueError, match=message):
            csv_bars.require_gates(bad)
    with pytest.raises(ValueError, match="over 2"):
        csv_bars.require_gates(minute, full=2)
    with pytest.raises(ValueError, match="leave"):
        csv_bars.require_gates(minute, start="2020-01-03")
    with pytest.raises(ValueError, match="differ"):
        csv_bars.require_universe(minute, spark.createDataFrame([("A",), ("B",)], "symbol string"))
    with pytest.raises(ValueError, match="no bars"):
        csv_bars.require_rows(minute.filter("n > 9"), "bars")
    assert csv_bars.key_gates(minute, ["symbol"], "timestamp", "n").first().strictly_increasing
    assert not csv_bars.key_gates(minute.withColumn("back", -F.col("n")), ["symbol"], "timestamp", "back").first().strictly_increasing


def test_minute_csv_round_trip(spark, tmp_path):
    lines = [f"2020-01-02 {9 + (15 + i) // 60:02d}:{(15 + i) % 60:02d}:00+05:30,1,1,1,{1 + i / 100},1000" for i in range(375)]
    lines += ["2020-01-97 09:15:00+05:30,1,1,1,1,1", lines[0].replace(",1,1,1,", ",9,9,9,"), "2021-01-04 09:15:00+05:30,1,1,1,1,1"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "AAA_minute-data.csv").write_text(HEAD + "\n".join(lines) + "\n")
    bars = csv_bars.read_minute(spark, str(tmp_path / "in"))
    stats = csv_bars.ingest_stats(bars).first()
    assert (stats.n_rows, stats.n_partitions, stats.n_partial_days) == (376, 2, 1)
    assert bars.filter("open = 9").count() == 1
    tables.write_minute(bars, str(tmp_path / "out"))
    leg = tables.read_leg(spark, str(tmp_path / "out"), ["AAA"], "2020-01-01", "2020-12-31")
    assert leg.count() == 375
    assert csv_bars.key_gates(bars, ["symbol"], "timestamp").first().strictly_increasing
    other = spark.createDataFrame([("BBB",)], "symbol string")
    assert {(r.symbol, r.side) for r in csv_bars.universe_mismatch(bars, other).collect()} == {("AAA", "found"), ("BBB", "expected")}


def test_passthrough_and_sectors(spark, tmp_path):
    rows = spark.createDataFrame([("A", 1.0)], "symbol string, close double")
    assert tables.validated_passthrough(rows, str(tmp_path / "t"), ["symbol"]).count() == 1
    with pytest.raises(ValueError):
        tables.validated_passthrough(rows, str(tmp_path / "u"), ["volume"])
    with pytest.raises(ValueError):
        tables.validated_passthrough(rows.filter("close > 5"), str(tmp_path / "v"), ["symbol"])
    (tmp_path / "s.csv").write_text("company_name,industry,symbol,isin\nx, it ,aa ,I1\ny,fin,,I2\n")
    got = tables.read_sectors(spark, str(tmp_path / "s.csv")).collect()
    assert [(r.symbol, r.industry) for r in got] == [("AA", "IT")]
    assert tables.dataset_bytes(spark, str(tmp_path / "t")) > 0
    tables.write_json(rows, str(tmp_path / "j"))
    tables.write_csv(rows, str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"symbol":"A","close":1.0}'
