import datetime as dt

import pytest
from pyspark.sql import functions as F

from pairlab.operators import actions, calendars, clean, screen

D = dt.date


def frame(spark, rows):
    return spark.createDataFrame([(s, d, float(c), 1e6) for s, d, c in rows], "symbol string, date date, close double, volume double")


def test_calendar_rules(spark):
    days = [D(2020, 1, 1), D(2020, 1, 2), D(2020, 1, 4), D(2020, 1, 6)]
    rows = frame(spark, [("A", d, 1) for d in days] + [("B", d, 1) for d in days[:3]])
    got = [r.date for r in calendars.trading_calendar(rows, min_symbols=2).collect()]
    assert got == [D(2020, 1, 2)]


def test_split_factors_multiply_and_leave_volume(spark):
    rows = frame(spark, [("A", D(2020, 1, i), 100) for i in (1, 2, 3)])
    splits = spark.createDataFrame([("A", D(2020, 1, 2), 2.0), ("A", D(2020, 1, 3), 5.0)], "symbol string, ex_date date, ratio double")
    got = {r.date.day: (r.close, r.volume) for r in clean.adjust_residual_splits(rows, splits).collect()}
    assert got == {1: (10.0, 1e6), 2: (20.0, 1e6), 3: (100.0, 1e6)}


def test_phantom_trim_keeps_from_latest_jump_unless_excused(spark):
    rows = frame(spark, [("A", D(2020, 1, i), c) for i, c in enumerate((10, 20, 20, 40, 40), 1)])
    assert sorted(r.date.day for r in clean.trim_phantoms(rows).collect()) == [4, 5]
    excused = spark.createDataFrame([("A", D(2020, 1, 4))], "symbol string, date date")
    assert sorted(r.date.day for r in clean.trim_phantoms(rows, excused).collect()) == [2, 3, 4, 5]


def test_repair_bounds(spark):
    c = spark.createDataFrame(
        [("A", D(2020, 1, 1), "TRIM"), ("A", D(2020, 2, 1), "KEEP_COVID"), ("A", D(2020, 2, 15), "TRIM"), ("A", D(2020, 3, 1), "KEEP_COVID"), ("A", D(2020, 4, 1), "TRIM"), ("B", D(2020, 5, 1), "TRIM"), ("B", D(2020, 6, 1), "TRIM")],
        "symbol string, date date, action string",
    )
    got = {r.symbol: (r.left_cut, r.right_cut) for r in clean.trim_bounds(c).collect()}
    assert got == {"A": (D(2020, 1, 1), D(2020, 4, 1)), "B": (D(2020, 6, 1), None)}


def test_contiguity_prefers_the_longest_that_meets_the_window(spark):
    rows = frame(spark, [("A", D(2020, 1, i), 1) for i in range(1, 8)] + [("A", D(2020, 3, i), 1) for i in range(1, 4)])
    assert clean.contiguity_filter(rows).count() == 7
    assert clean.contiguity_filter(rows, window_start="2020-02-01").count() == 3


def test_dedup_first_and_last(spark):
    rows = spark.createDataFrame([("A", 1, 1, 5.0), ("A", 1, 2, 6.0)], "symbol string, date int, line int, close double")
    for keep, close in (("last", 6.0), ("first", 5.0)):
        assert [r.close for r in clean.deduplicate(rows, ["symbol", "date"], [F.col("line")], keep=keep).collect()] == [close]


def test_folds(spark):
    days = spark.range(100).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"))
    rows = calendars.build_folds(days, prior=20, train=20, test=10).orderBy("fold_id").collect()
    assert len(rows) == 6 and (rows[0].test_start - rows[0].prior_start).days == 40 and all((r.test_start - r.train_end).days == 1 for r in rows)
    with pytest.raises(ValueError):
        calendars.build_folds(days, prior=0, train=1, test=1)
    with pytest.raises(Exception, match="too few days"):
        calendars.build_folds(days, prior=90, train=20, test=10).collect()


def test_share_classes(spark):
    rows = spark.createDataFrame([("xdvr", None), ("A", "US1"), ("A", "ine1"), ("tatamtrdvr", "INE")], "s string, i string")
    assert [r[0] for r in rows.select(screen.is_share_class_duplicate(F.col("s"), F.col("i"))).collect()] == [True, True, False, True]


def test_actions_flatten_and_cover(spark):
    rows = spark.sql("SELECT 'A' AS symbol, array(struct(DATE '2020-01-01' AS ex_date, 2.0D AS value)) AS splits, array(struct(DATE '2020-02-01' AS ex_date, 1.0D AS value)) AS dividends, CAST(NULL AS STRING) AS error UNION ALL SELECT 'B', array(), array(), 'timeout' UNION ALL SELECT 'C', array(), array(), NULL")
    assert actions.flatten_actions(rows).count() == 2
    assert {r.symbol: r.status for r in actions.coverage(rows).collect()} == {"A": "ok", "B": "error", "C": "empty"}
