"""Operators that cut long groups into blocks give what whole groups give."""

import numpy as np
from pyspark.sql import functions as F

from pairlab import fixtures
from pairlab.operators import backtest, blocks, cards, reports, screen, signals


def test_dense_panel_in_small_blocks(spark, sf_dir):
    whole = {(r.symbol, r.day): r for r in fixtures.dense_panel(spark, sf_dir).withColumn("day", fixtures.dense_place(F.col("date"))).drop("date").collect()}
    cut = fixtures.dense_panel(spark, sf_dir, bin_lines=700, block_rows=40).withColumn("day", fixtures.dense_place(F.col("date"))).drop("date").collect()
    assert len(cut) == len(whole) == len({(r.symbol, r.day) for r in cut}) > 5000
    assert all(abs(r.close - whole[r.symbol, r.day].close) < 1e-8 and r.volume == whole[r.symbol, r.day].volume for r in cut)


def test_log_returns_in_small_blocks(spark):
    rows = spark.createDataFrame([(s, i, 100.0 + (i * 7 + len(s)) % 11) for s in ("a", "bb") for i in range(1, 101)], ["symbol", "date", "close"])
    whole = {(r.symbol, r.date): r.log_ret for r in screen.log_returns(rows).collect()}
    cut = screen.log_returns(rows, place="date", block_rows=9).collect()
    assert len(cut) == 200 and {(r.symbol, r.date): r.log_ret for r in cut} == whole
    assert sum(r.log_ret is None for r in cut) == 2


def _walk(spark):
    """Two groups of 300 bars, places from 1; some bars of the second have no spread, and both end in a trade."""
    rng = np.random.default_rng(11)
    rows = []
    for key in ("a", "b"):
        x = np.round(np.cumsum(rng.normal(size=300)) * 0.1 + np.sin(np.arange(300) / 4), 6)
        x[-2:] = x[-3] + 9.0
        rows += [(key, i + 1, 0.5, float("nan") if key == "b" and i in (120, 121, 299) else float(v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, ["pair", "place", "beta", "spread"])


def _blocked(rows, window, block_rows):
    return blocks.arrays(rows, ["pair", "beta"], "place", "spread", before=window - 1, block_rows=block_rows).withColumnRenamed("values", "spreads")


def test_signals_in_blocks_equal_those_of_whole_groups(spark):
    rows, window = _walk(spark), 8
    limits = {"entry": 1.2, "exit_": 0.3, "stop": 2.3, "max_holding": 12}
    one = signals.rolling_z(rows, ["pair"], "place", window=window, place="place", block_rows=1000).withColumn("z", F.round("z", 8))
    whole = backtest.position_returns(signals.rolling_signals(one, ["pair"], "place", **limits), ["pair"], "place")
    for block_rows in (17, 1000):
        run = signals.signals_in_blocks(_blocked(rows, window, block_rows), ["pair"], carry=("beta",), window=window, **limits)
        key = lambda r: (r.pair, r.place)
        got, want = (sorted(df.collect(), key=key) for df in (run, whole))
        shown = lambda r: (r.pair, r.place, str(float("nan") if r.z is None else r.z), r.position, r.held, r.exit_reason, round(r.gross, 12) + 0.0)
        assert [shown(r) for r in got] == [shown(r) for r in want]
        events = run.filter(F.col("ends") | ((F.col("position_before") == 0) & (F.col("position") != 0)))
        closed = backtest.trades(events, ["pair"], "place", carry=("beta",), before="held_before")
        wanted = backtest.trades(whole, ["pair"], "place", carry=("beta",))
        assert sorted(closed.collect()) == sorted(wanted.collect()) and closed.filter("exit_reason = 'fold_boundary'").count() == 2
        assert run.filter("ends").count() == closed.count() > 20
        assert sorted(signals.signal_diagnostics(run, ["pair"], None).collect()) == sorted(signals.signal_diagnostics(whole, ["pair"], "place").collect())


def test_metrics_and_curves_in_parts(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(k, i, i // 7, 0.01 if k == "flat" else float(v), 0.0) for k in ("a", "b", "flat") for i, v in enumerate(rng.normal(size=60) * 0.02)], ["k", "t", "part", "gross", "net"])
    plain, parts = ({r.k: r for r in backtest.metrics(rows, ["k"], "t", "gross", part=p).collect()} for p in (None, "part"))
    for k, r in plain.items():
        assert np.allclose(r[1:], parts[k][1:], rtol=1e-10, equal_nan=True), k
    assert np.isnan(parts["flat"].sharpe)
    curves = ({(r.k, r.t): r.cum_gross_pct for r in reports.equity_curve(rows, ["k"], "t", part=p).collect()} for p in (None, "part"))
    a, b = curves
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_leg_levels_sort_no_pair(spark):
    daily = spark.createDataFrame([(s, i, float(i + k)) for s, k in (("a", 2), ("b", 5)) for i in range(1, 40) if (s, i) != ("b", 5)], ["symbol", "date", "close"])
    spans = spark.createDataFrame([("a~b", "a", "b", 5, 30)], ["pair", "y_sym", "x_sym", "first_active", "last_active"])
    found = cards.leg_levels(daily, spans)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.date, r.y_level, r.x_level) for r in found.collect()) == [(i, (i + 2) / 8.0, (i + 5) / 11.0) for i in range(6, 31)]


def test_segments_of_blocks_equal_those_of_bars(spark):
    """Segments that cross blocks are put together from their pieces, with the bands and counts that whole groups give."""
    rows, window = _walk(spark), 8
    limits = {"entry": 1.2, "exit_": 0.3, "stop": 2.3, "max_holding": 12}
    run = signals.signals_in_blocks(_blocked(rows, window, 1000), ["pair"], window=window, **limits)
    bands = signals.rolling_bands(run.select("pair", "place", "spread"), ["pair"], "place", window=window, place="place", block_rows=1000)
    want = sorted(cards.banded_segments(cards.position_segments(run, ["pair"], "place"), bands, ["pair"], "place").collect())
    shown = lambda r, names: tuple("nan" if r[c] != r[c] else round(r[c], 10) if isinstance(r[c], float) else r[c] for c in names)
    for block_rows in (9, 17, 1000):
        found = cards.segments_in_blocks(_blocked(rows, window, block_rows), ["pair"], window=window, **limits)
        names = want[0].asDict().keys()
        got = sorted((r for r in found.collect()), key=lambda r: (r.pair, r.segment_no))
        assert sorted(found.columns) == sorted(names) and [shown(r, names) for r in got] == [shown(r, names) for r in want]
    assert len(want) > 20 and sum(r.n_outside for r in want) > 5
