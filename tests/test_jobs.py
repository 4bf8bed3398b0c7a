"""Whole jobs on small synthetic bars, with the core engines held against plain numpy."""

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlab.functions import kernels
from pairlab.jobs import daily as jobs
from pairlab.jobs import intraday as bars_jobs
from pairlab.operators import backtest, calendars, cointegration, grid, reports, walkforward

DAYS = 420
FOLDS = dict(prior=120, train=120, test=60)
SCREEN = dict(min_overlap=60, threshold=0.3, alpha=0.2, half_life_band=(0.5, 60.0), hurst_max=0.9, hurst_lag=20)


@pytest.fixture(scope="module")
def universe(spark):
    """Four symbols of one sector around a common walk, one of another, a duplicate by ISIN, and one without a sector and with gaps."""
    rng = np.random.default_rng(7)
    days = [d for i in range(DAYS * 2) if (d := date(2010, 1, 4) + timedelta(i)).weekday() < 5][:DAYS]
    trend = np.cumsum(rng.normal(0, 0.01, DAYS))
    rows = []
    for k, s in enumerate(("AAA", "BBB", "CCC", "DDD", "EEE", "DUP", "GAP")):
        noise = np.zeros(DAYS)
        for i in range(1, DAYS):
            noise[i] = 0.85 * noise[i - 1] + rng.normal(0, 0.005)
        own = np.cumsum(rng.normal(0, 0.01, DAYS)) if s == "EEE" else (0.7 + 0.1 * k) * trend + noise
        rows += [(s, d, float(v), 1e6) for i, (d, v) in enumerate(zip(days, 100 * np.exp(own))) if s != "GAP" or i % 3]
    daily = spark.createDataFrame(rows, "symbol string, date date, close double, volume double")
    sectors = spark.createDataFrame([(s, "S1", f"INE{s}") for s in ("AAA", "BBB", "CCC", "DDD")] + [("EEE", "S2", "INEEEE"), ("DUP", "S1", "US1")], "symbol string, sector string, isin string")
    return daily, sectors, days


def prices(daily):
    out = {}
    for r in daily.collect():
        out.setdefault(r.symbol, {})[r.date] = r.close
    return out


def one_direction(y, x):
    """Plain regression and test of ln y on ln x."""
    y, x = np.log(y), np.log(x)
    beta, alpha = np.polyfit(x, y, 1)
    stat, p, _ = kernels.adf(y - alpha - beta * x)
    return alpha, beta, stat, p, y - alpha - beta * x


def test_cointegrate_against_numpy(spark, universe):
    daily, sectors, days = universe
    windows = spark.createDataFrame([(0, days[120], days[239], days[0], days[119])], "fold_id int, train_start date, train_end date, prior_start date, prior_end date")
    got = {(r.sym1, r.sym2): r for r in cointegration.cointegrate(daily, sectors, windows, **SCREEN).collect()}
    p = prices(daily)
    span = days[120:240]
    names = ("AAA", "BBB", "CCC", "DDD")
    ret = {s: np.diff(np.log([p[s][d] for d in span])) for s in names}
    want = {}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            corr = np.corrcoef(ret[a], ret[b])[0, 1]
            if corr > SCREEN["threshold"]:
                ya, yb = (np.array([p[s][d] for d in span]) for s in (a, b))
                one, two = one_direction(ya, yb), one_direction(yb, ya)
                best, y, x = (two, b, a) if two[3] < one[3] else (one, a, b)
                want[a, b] = (corr, y, x, best)
    assert set(got) == set(want) and len(want) >= 3  # neither the duplicate nor the unmapped symbol takes part or removes dates
    order = sorted(want, key=lambda k: want[k][3][3])
    passed = 0
    for k, key in enumerate(order, 1):
        if want[key][3][3] <= k / len(order) * SCREEN["alpha"]:
            passed = k
    for k, key in enumerate(order, 1):
        corr, y, x, best = want[key]
        r = got[key]
        assert (r.y_sym, r.x_sym, r.n_obs) == (y, x, 120) and r.corr == pytest.approx(corr)
        assert (r.alpha, r.beta, r.adf_stat, r.adf_pvalue) == pytest.approx(best[:4], rel=1e-6)
        assert r.fdr_pass == (k <= passed) and r.raw_pass == (best[3] < SCREEN["alpha"])
        life, rough = kernels.half_life(best[4]), kernels.hurst(best[4], 20)
        in_band = r.fdr_pass and not math.isnan(life) and 0.5 <= life <= 60
        assert r.half_life_in_band == in_band and r.hurst_pass == (in_band and rough < 0.9)
        if r.hurst_pass:
            prior = [np.array([p[s][d] for d in days[:120]]) for s in key]
            assert r.stable_prior_window == (min(one_direction(*prior)[3], one_direction(*prior[::-1])[3]) < SCREEN["alpha"])
    ranks = [r["rank"] for r in cointegration.ranked(cointegration.cointegrate(daily, sectors, windows, **SCREEN)).collect()]
    assert sorted(ranks) == list(range(1, len(want) + 1))


def test_walk_forward_against_numpy(spark, universe):
    daily, sectors, days = universe
    folds = calendars.build_folds(daily.filter("symbol = 'AAA'"), **FOLDS)
    spans = {r.fold_id: r for r in folds.collect()}
    selected = spark.createDataFrame([(f, "AAA", "BBB", 0.1, 0.9, 4.0) for f in spans] + [(f, "CCC", "DDD", 0.0, 0.8, 9.0) for f in spans], "fold_id int, y_sym string, x_sym string, alpha double, beta double, half_life double")
    run = walkforward.run_selected(daily, selected, folds, window=20, entry=1.0, exit_=0.2, stop=4.0)
    p = prices(daily)
    got = {(r.fold_id, r.date): r for r in run["portfolio"].collect()}
    n_trades = 0
    for f, span in spans.items():
        test = [d for d in days if span.test_start <= d <= span.test_end]
        at = days.index(test[0])
        gross, net = np.zeros(len(test)), np.zeros(len(test))
        for y, x, alpha, beta, life in (("AAA", "BBB", 0.1, 0.9, 4.0), ("CCC", "DDD", 0.0, 0.8, 9.0)):
            s = np.array([math.log(p[y][d]) - beta * math.log(p[x][d]) - alpha for d in days[at - 19 : at + len(test)]])
            z = np.array([(s[i] - s[i - 19 : i + 1].mean()) / s[i - 19 : i + 1].std(ddof=1) for i in range(19, len(s))])
            position, held, reason = kernels.rolling_machine(z, 1.0, 0.2, 4.0, max(2, min(60, math.ceil(3 * life))))
            s, open_ = s[19:], False
            for i in range(len(s)):
                moved = position[i - 1] * (s[i] - s[i - 1]) if i else 0.0
                gross[i] += moved / 2
                net[i] += moved / 2
                if reason[i] or i == len(s) - 1 and position[i]:
                    n_trades += 1
                    net[i] -= (1 + beta) * 25 / 1e4 / 2
        for d, g, n in zip(test, gross, net):
            assert (got[f, d].gross, got[f, d].net) == pytest.approx((g, n), abs=1e-12)
    assert len(got) == sum(1 for _ in got) and run["trades"].count() == n_trades > 4


def test_daily_jobs(spark, universe, tmp_path):
    daily, sectors, days = universe
    full = daily.select("symbol", "date", *[F.col("close").alias(c) for c in ("open", "high", "low", "close")], "volume")
    none = lambda schema: spark.createDataFrame([], schema)
    tables_ = dict(keep=none("symbol string, date date"), dividends=none("symbol string, date date"), windows=none("start date, end date"), blind=none("symbol string"))
    out = jobs.clean_daily(spark, full, str(tmp_path / "clean"), events=none("symbol string, event_date date"), min_symbols=5, min_days=200, start="2010-01-01", end="2012-12-31", **tables_)
    assert out["gate"].first().passed and {r.rule for r in out["report"].collect()} >= {"input", "calendar", "history"}
    rows = [r.n_rows for r in out["report"].orderBy("step").collect()]
    assert rows == sorted(rows, reverse=True) and out["daily_clean"].count() == rows[-1] > 0
    again = jobs.repair(spark, out["daily_clean"], str(tmp_path / "repair"), crash_windows=none("start date, end date"), min_days=200, **tables_)
    assert again["daily_clean"].count() == rows[-1]
    pairs = jobs.correlate(spark, daily, sectors, str(tmp_path / "corr"), days=200, threshold=0.3)
    assert pairs.count() and pairs.filter("rank = 1").first().corr == pairs.agg(F.max("corr")).first()[0]
    last = jobs.cointegrate_last(spark, daily.filter("symbol <> 'GAP'"), sectors, str(tmp_path / "coint"), target=200, least=100, **SCREEN)
    assert last["funnel"].first().n_candidates == last["cointegrated_pairs"].count() > 0
    run = jobs.backtest_daily(spark, daily.filter("symbol <> 'GAP'"), sectors, str(tmp_path / "bt"), window=20, **FOLDS, **SCREEN)
    assert run["metrics"].count() == 2 and run["funnel"].count() and [r["rank"] for r in run["pair_metrics"].orderBy("rank").collect()] == list(range(1, run["pair_metrics"].count() + 1))
    jobs.spread_signals(spark, daily, last["cointegrated_pairs"].drop("rank"), str(tmp_path / "diag"), window=20).count()


@pytest.fixture(scope="module")
def minute(spark):
    """Three symbols on 30 sessions of 24 bars: two mean-reverting pairs with known spreads, some bars missing."""
    rng = np.random.default_rng(3)
    rows, n = [], 30 * 24
    x, legs = np.cumsum(rng.normal(0, 0.002, n)), {}
    for s, beta in (("YYY", 0.8), ("ZZZ", 1.2)):
        e = np.zeros(n)
        for i in range(1, n):
            e[i] = 0.8 * e[i - 1] + rng.normal(0, 0.004)
        legs[s] = beta * x + e
    legs["XXX"] = x
    for s, v in legs.items():
        rows += [(s, date(2020, 1, 1) + timedelta(i // 24), i % 24, float(100 * math.exp(c)), 10) for i, c in enumerate(v) if rng.random() > 0.03]
    bars = spark.createDataFrame(rows, "symbol string, session date, bar int, close double, volume long")
    start, test, end = date(2020, 1, 1), date(2020, 1, 16), date(2020, 1, 30)
    chosen = spark.createDataFrame([(0, "YYY", "XXX", math.log(100) * 0.2, 0.8, 1.0, start, test, end), (0, "ZZZ", "XXX", -math.log(100) * 0.2, 1.2, 2.0, start, test, end)], "fold_id int, y_sym string, x_sym string, alpha double, beta double, half_life double, train_start date, test_start date, test_end date")
    return bars, chosen


def test_grid_job_against_numpy(spark, minute, tmp_path):
    bars, chosen = minute
    cells = grid.cells(spark, freqs=(1, 2), costs=(1.0, 3.0))
    bands = {"A": (0.5, 20.0), "B": (1.0, 40.0)}
    found = bars_jobs.ou_grid(spark, bars, chosen, str(tmp_path / "ou"), cells=cells, per_session=24, bands=bands, hard_stop=3.0)
    metrics = {r.cell_id: r for r in found["metrics"].collect()}
    assert len(metrics) == cells.count() == 12
    fits = {(r.freq_min, r.y_sym): r for r in found["diagnostics"].collect()}
    marked = {(r.cell_id, r.y_sym): r for r in found["marked"].collect()}
    trades = found["trades"].collect()
    total, moved = 0, {}
    for freq in (1, 2):
        rows = bars_jobs.spread_grid(bars, chosen, freq).filter("in_test").orderBy("y_sym", "t").collect()
        for cell in cells.filter(F.col("freq_min") == freq).collect():
            for y, beta in (("YYY", 0.8), ("ZZZ", 1.2)):
                own, fit, plan = [r for r in rows if r.y_sym == y], fits[freq, y], marked[cell.cell_id, y]
                inside = bands[cell.regime][0] <= fit.half_life_minutes <= bands[cell.regime][1]
                cost = (1 + beta) * (4.5 + cell.spread_bps) / 1e4
                a = kernels.bertram_thresholds(np.array([fit.sigma_eq]), np.array([cost]))[0]
                assert plan.exclusion_reason == (None if fit.fit_ok and inside and not math.isnan(a) else "no_reversion" if not fit.fit_ok else "hl_band" if not inside else "infeasible_at_cost")
                mine = sorted((t for t in trades if t.cell_id == cell.cell_id and t.y_sym == y), key=lambda t: t.entry_t)
                if plan.exclusion_reason:
                    assert not mine
                    continue
                z = np.array([(r.spread - fit.mu) / fit.sigma_eq for r in own])
                stop = 3.0 if cell.stop_mode == "hard" else None
                groups = [[i for i, r in enumerate(own) if r.session == s] for s in sorted({r.session for r in own})] if cell.regime == "A" else [list(range(len(own)))]
                want, spreads = [], np.array([r.spread for r in own])
                for g in groups:
                    position, _, reason = kernels.ou_machine(z[g], a / fit.sigma_eq, stop, plan.max_holding)
                    if cell.regime == "A":
                        last = max((k for k, i in enumerate(g) if own[i].tradeable), default=None)
                        if last is not None and position[-1] != 0:
                            position[last:], reason[last] = 0, reason[last] or "session_close"
                    moved[cell.cell_id] = moved.get(cell.cell_id, 0.0) + np.nansum(position[:-1] * np.diff(spreads[g]))
                    begun = None
                    for k, i in enumerate(g):
                        if begun is None and position[k] != 0:
                            begun = k
                        elif begun is not None and reason[k]:
                            want.append((own[g[begun]].t, own[i].t, int(position[begun]) * (own[i].spread - own[g[begun]].spread)))
                            begun = None
                    if begun is not None and cell.regime == "B":
                        end = max(k for k, i in enumerate(g) if not math.isnan(own[i].spread))
                        want.append((own[g[begun]].t, own[g[end]].t, int(position[begun]) * (own[g[end]].spread - own[g[begun]].spread)))
                assert [(t.entry_t, t.exit_t) for t in mine] == [w[:2] for w in want]
                assert [t.gross_log for t in mine] == pytest.approx([w[2] for w in want]) and all(t.cost_log == pytest.approx(cost) for t in mine)
                total += len(want)
            assert metrics[cell.cell_id].n_trades == sum(t.cell_id == cell.cell_id for t in trades)
    assert total > 10
    sums = {r.cell_id: r.g for r in found["sessions"].groupBy("cell_id").agg(F.sum("gross").alias("g")).collect()}
    assert sums == pytest.approx(moved, abs=1e-9)
    assert found["trade_export"].count() == len(trades) and {r.direction for r in found["trade_export"].collect()} == {"long", "short"}
    table = bars_jobs.rolling_baseline(spark, bars, chosen, str(tmp_path / "rolling"), freqs=(2,), per_session=24, warmup=2, entry=1.2)
    assert table.count() == 8 and table.filter("n_trades > 0").count() > 0
    rolled = bars_jobs.rollups(found, table, chosen, freq=1)
    assert rolled["grid"].count() == 20 and rolled["best_cell"].count() == 1 and rolled["ladder"].count() == 12
    assert rolled["attribution"].agg(F.sum("share")).first()[0] == pytest.approx(1.0)


def test_sensitivity_markers_and_cells(spark, minute):
    bars, chosen = minute
    rows = bars_jobs.spread_grid(bars, chosen, 1)
    got = bars_jobs.sensitivity(rows, bars_jobs.KEYS, "t", sessions=(1, 2), per_session=24).collect()
    assert {(r.variant, r.window_bars) for r in got} == {(v, w) for v in ("flat", "tod") for w in (24, 48)}
    assert [f(spark).count() for f in (grid.smoke_cells, grid.reduced_cells, grid.cells, grid.rolling_cells)] == [1, 8, 30, 16]
    trades = spark.createDataFrame([("p", 1, 1, 2, 5, "stop"), ("p", 2, -1, 5, 7, "time")], "pair string, trade_no int, direction int, entry_t int, exit_t int, exit_reason string")
    marked = reports.with_markers(spark.range(8).selectExpr("'p' AS pair", "int(id) AS t"), trades, ["pair"], "t").orderBy("t").collect()
    assert len(marked) == 8 and marked[5].entry_direction == -1 and marked[5].exit_reason_at == "z_stop" and marked[3].entry_trade is None
    cached = spark.createDataFrame([("k", 1, "old"), ("k", 3, "new"), ("j", 2, "one")], "key string, at int, v string")
    assert {r.v for r in reports.latest(cached, ["key"], "at").collect()} == {"new", "one"}
    d = reports.density(spark.createDataFrame([(0, 3), (1, 1)], "bin int, n long"), 0.5).orderBy("bin").collect()
    assert [r.density for r in d] == [1.5, 0.5] and backtest.cost_ladder(spark).count() == 4


def test_rows_meet_spans_in_bins(spark):
    """Every row meets the spans that hold it, past the year 9999 too, and no join compares all rows with all spans."""
    days = spark.range(0, 4000, 7).select((F.date_from_unix_date(F.col("id").cast("int") + 2_932_000)).alias("date"), (F.col("id") % 2).alias("k"))
    spans = spark.range(30).select("id", (F.col("id") % 2).alias("k"), F.date_from_unix_date((2_931_900 + F.col("id") * 130).cast("int")).alias("lo"), F.date_from_unix_date((2_932_000 + F.col("id") * 150).cast("int")).alias("hi"))
    met = calendars.within(days, spans, "lo", "hi", by=("k",))
    got = sorted(tuple(r) for r in met.select("id", F.unix_date("date")).collect())
    each = [(d, d % 2) for d in range(0, 4000, 7)]
    assert got == sorted((i, d + 2_932_000) for i in range(30) for d, k in each if k == i % 2 and i * 130 - 100 <= d <= i * 150)
    plan = calendars.within(days, spans, "lo", "hi")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pairs_past_the_year_9999(spark):
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.normal(0, 0.01, 90))
    rows = [("p", "A", "B", 3_000_000 + i, float(np.exp(v + 0.1 * np.sin(i))), float(np.exp(v))) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "pair string, sym1 string, sym2 string, day int, y double, x double")
    df = df.select("pair", "sym1", "sym2", F.date_from_unix_date("day").alias("date"), "y", "x")
    assert cointegration.test_pairs(df, ["pair"]).select("n_obs").first().n_obs == 90
