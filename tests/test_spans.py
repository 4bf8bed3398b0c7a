"""Folds that meet in chunks of arrays give what each fold gives alone."""

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlab.operators import calendars, cointegration, spans, walkforward

N = 300
FOLDS = dict(prior=40, train=60, test=20)
SCREEN = dict(min_overlap=30, threshold=0.2, alpha=0.3, half_life_band=(0.5, 60.0), hurst_max=0.9, hurst_lag=12)


@pytest.fixture(scope="module")
def universe(spark):
    """Two sectors around a common walk; a symbol with gaps, one with closes that don't count, one without a sector."""
    rng = np.random.default_rng(21)
    days = [d for i in range(N * 2) if (d := date(2010, 1, 4) + timedelta(i)).weekday() < 5][:N]
    trend, rows = np.cumsum(rng.normal(0, 0.01, N)), []
    for k, s in enumerate(("A", "B", "C", "D", "E", "GAP", "ODD", "FREE")):
        close = 100 * np.exp((0.6 + 0.1 * k) * trend + rng.normal(0, 0.004, N))
        for i, (d, v) in enumerate(zip(days, close)):
            if s != "GAP" or i < 150 or i % 4:
                rows.append((s, d, None if s == "ODD" and i in (70, 71) else 0.0 if s == "ODD" and i == 200 else float(v)))
    daily = materialize(spark.createDataFrame(rows, "symbol string, date date, close double"))
    sectors = spark.createDataFrame([(s, "S1") for s in ("A", "B", "C", "GAP", "ODD")] + [("D", "S2"), ("E", "S2"), ("FREE", None)], "symbol string, sector string")
    return daily, sectors, days


def materialize(df):
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def test_screen_against_plain_numpy(spark, universe, monkeypatch):
    daily, sectors, days = universe
    close = {(r.symbol, r.date): r.close for r in daily.collect()}
    windows = [(i, days[a], days[a + 59]) for i, a in enumerate((0, 25, 60, 110, 145, 190, 240))]
    want = {}
    for fold, lo, hi in windows:
        span = [d for d in days if lo <= d <= hi]
        returns = {}
        for s in ("A", "B", "C", "D", "E", "GAP", "ODD", "FREE"):
            own = [d for d in span if (s, d) in close]
            if own[0] == lo and own[-1] == hi and max((b - a).days for a, b in zip(own, own[1:])) <= 10:
                value = {d: close[s, d] for d in own}
                returns[s] = {b: math.log(value[b] / value[a]) for a, b in zip(own, own[1:]) if value[a] and value[b]}
        full = [d for d in span if all(d in r for r in returns.values())]
        for a, b in [(a, b) for g in (("A", "B", "C", "GAP", "ODD"), ("D", "E")) for i, a in enumerate(g) for b in g[i + 1 :] if a in returns and b in returns]:
            corr = np.corrcoef([returns[a][d] for d in full], [returns[b][d] for d in full])[0, 1]
            if corr > 0.2:
                want[fold, a, b] = corr
    df = spark.createDataFrame(windows, "fold_id int, train_start date, train_end date")
    for chunk in (1, 3, 16):
        monkeypatch.setattr(spans, "_partitions", lambda rows, c=chunk: 4 if c == 1 else 1)
        monkeypatch.setattr(spans, "CHUNK_FOLDS", chunk)
        got = {(r.fold_id, r.sym1, r.sym2): r.corr for r in cointegration.candidates(daily, sectors, df, threshold=0.2).collect()}
        assert got == pytest.approx(want, rel=1e-9) and len(want) > 20


def test_folds_in_chunks_and_units_equal_folds_alone(spark, universe, monkeypatch):
    """The tests of many folds in few rows: those of every pair and fold as rows of their own."""
    daily, sectors, days = universe
    folds = materialize(calendars.build_folds(daily, **FOLDS))
    monkeypatch.setattr(spans, "_partitions", lambda rows: 2)
    results = []
    for chunk, unit in ((16, 500), (3, 4), (1, 1)):
        monkeypatch.setattr(spans, "CHUNK_FOLDS", chunk)
        monkeypatch.setattr(spans, "UNIT_PAIRS", unit)
        held, _ = spans.in_chunks(folds, "train_start")
        met = spans.legs(daily, held.select("chunk", F.col("train_start").alias("lo"), F.col("train_end").alias("hi")))
        assert met.count() == held.select("chunk").distinct().count() <= folds.count()  # not a row a fold, pair and day
        results.append(sorted(cointegration.cointegrate(daily, sectors, folds, **SCREEN).collect(), key=lambda r: (r.fold_id, r.sym1, r.sym2)))
    assert len(results[0]) > 30 and any(r.hurst_pass for r in results[0]) and str(results[0]) == str(results[1]) == str(results[2])
    bounds = {r.fold_id: r for r in folds.collect()}
    spans_ = spark.createDataFrame([(r.fold_id, r.sym1, r.sym2, bounds[r.fold_id].train_start, bounds[r.fold_id].train_end) for r in results[0]], "fold_id int, sym1 string, sym2 string, lo date, hi date")
    y, x = (daily.filter("close > 0").select(F.col("symbol").alias(s), "date", F.col("close").alias(c)) for s, c in (("sym1", "y"), ("sym2", "x")))
    rows = spans_.join(y, "sym1").filter("date BETWEEN lo AND hi").join(x, ["sym2", "date"])
    alone = {(r.fold_id, r.sym1, r.sym2): r for r in cointegration.test_pairs(rows.select("fold_id", "sym1", "sym2", "date", "y", "x"), ["fold_id", "sym1", "sym2"], max_lag=12).collect()}
    for r in results[0]:
        w = alone[r.fold_id, r.sym1, r.sym2]
        assert (r.direction, r.n_obs) == (w.direction, w.n_obs) and (r.alpha, r.beta, r.adf_pvalue, r.hurst) == pytest.approx((w.alpha, w.beta, w.adf_pvalue, w.hurst), rel=1e-9)


def test_selected_pairs_in_units_equal_one_unit(spark, universe, monkeypatch):
    """Bars of selected pairs, kept or not, in units of any size; a pair with gaps is flat on the days that it lacks."""
    daily, sectors, days = universe
    daily = daily.filter("close > 0")
    folds = materialize(calendars.build_folds(daily, **FOLDS))
    pairs = [("A", "B", 0.0, 0.9, 3.0), ("GAP", "C", 0.1, 0.8, 5.0), ("E", "D", 0.2, 1.1, 30.0), ("A", "NONE", 0.0, 1.0, 4.0)]
    selected = spark.createDataFrame([(r.fold_id, *p) for r in folds.collect() for p in pairs], "fold_id int, y_sym string, x_sym string, alpha double, beta double, half_life double")
    monkeypatch.setattr(spans, "_partitions", lambda rows: 1)
    results = []
    for chunk, unit, keep in ((16, 500, True), (2, 3, False)):
        monkeypatch.setattr(spans, "CHUNK_FOLDS", chunk)
        monkeypatch.setattr(spans, "UNIT_PAIRS", unit)
        run = walkforward.run_selected(daily, selected, folds, window=10, entry=1.0, exit_=0.3, stop=3.0, keep=keep)
        results.append([sorted(run[t].collect()) for t in ("trades", "per_pair", "portfolio")])
    assert results[0] == results[1]
    trades, per_pair, port = results[0]
    n = folds.count()
    assert len(port) == n * 20 and len(per_pair) == 3 * n * 20 and {r.n_selected_pairs for r in port} == {4} and len(trades) > 20
    held = {(r.symbol, r.date) for r in daily.filter("symbol = 'GAP'").collect()}
    lacking = [r for r in per_pair if r.pair == "GAP~C" and ("GAP", r.date) not in held]
    assert len(lacking) > 10 and all((r.gross, r.net, r.position) == (0.0, 0.0, 0) for r in lacking)
    assert sum(r.gross - r.net for r in per_pair) == pytest.approx(sum(t.cost_log for t in trades))
    assert sum(r.gross for r in per_pair) == pytest.approx(sum(t.gross_log for t in trades), abs=1e-9)


def test_prior_test_stops_at_a_pass(monkeypatch):
    """A first direction that passes spares the second, and whether a pair passes stays the same."""
    rng = np.random.default_rng(4)
    x = np.cumsum(rng.normal(size=200)) * 0.01
    plain = cointegration._direction
    for y in (0.8 * x + rng.normal(size=200) * 0.005, np.cumsum(rng.normal(size=200)) * 0.01, np.full(200, 1.0)):
        for alpha in (1e-9, 0.05, 0.6):
            calls = []
            monkeypatch.setattr(cointegration, "_direction", lambda a, b: calls.append(1) or plain(a, b))
            one, both = (cointegration._test(y, x, "Y", "X", 20, 10, False, enough=e) for e in (alpha, 0.0))
            first = plain(y, x)[3] < alpha
            assert len(calls) == (3 if first else 4) and (one[6] < alpha) == (both[6] < alpha)
