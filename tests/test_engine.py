import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlab.functions import kernels
from pairlab.operators import backtest, cointegration, grid, intraday, signals

NAN = math.nan


def path(spark, values, **extra):
    rows = [("p", i, i // 5, True, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "pair string, t int, session int, tradeable boolean, spread double")


def test_rolling_z_is_causal_and_nan_aware(spark):
    x = np.random.default_rng(0).normal(size=60)
    x[30] = NAN
    z = lambda v: [r.z for r in signals.rolling_z(path(spark, v), ["pair"], "t", window=5).orderBy("t").collect()]
    whole, part = z(x), z(np.r_[x[:40], np.full(20, 9.0)])
    assert np.allclose(whole[:40], part[:40], equal_nan=True)
    assert all(math.isnan(v) for v in whole[:4] + whole[30:35]) and not math.isnan(whole[35])
    assert all(math.isnan(v) for v in z(np.ones(10)))


def test_sessions_close_flat_and_trades_add_up(spark):
    rng = np.random.default_rng(5)
    rows = path(spark, np.cumsum(rng.normal(size=100))).withColumn("z", F.col("spread"))
    for session in (None, "session"):
        run = signals.rolling_signals(rows, ["pair"], "t", entry=1.0, exit_=0.2, stop=30.0, max_holding=20, session=session, tradeable="tradeable" if session else None)
        closed = backtest.trades(run, ["pair"], "t")
        gross = backtest.position_returns(run, ["pair"], "t").agg(F.sum("gross")).first()[0]
        assert gross == pytest.approx(closed.agg(F.sum("gross_log")).first()[0] or 0.0)
        if session:
            assert run.filter("t % 5 = 4 AND position <> 0").count() == 0
            net = backtest.deduct_costs(backtest.position_returns(run, ["pair"], "t", session="session"), closed, ["pair"], "t", F.lit(0.5))
            assert net.agg(F.sum(F.col("gross") - F.col("net"))).first()[0] == pytest.approx(0.5 * closed.count())


def test_cost_pin(spark):
    for beta in (0.057, 0.872, 1.0, 1.643):
        got = spark.range(1).select(backtest.pair_cost(F.lit(beta), backtest.leg_bps(3.0))).first()[0]
        assert got == pytest.approx((1 + beta) * 7.5e-4)
    with pytest.raises(Exception, match="beta"):
        spark.range(1).select(backtest.pair_cost(F.lit(-0.1), 1.0)).collect()


def test_metrics_drawdown_starts_at_first_return(spark):
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate((-0.1, 0.05, -0.02))] + [("b", 0, 0.1)], "k string, t int, r double")
    got = {r.k: r for r in backtest.metrics(rows, ["k"], "t", "r").collect()}
    assert got["a"].max_drawdown_pct == pytest.approx(math.expm1(-0.02) * 100)
    assert got["b"].max_drawdown_pct == 0 and math.isnan(got["b"].sharpe)


def test_bh_textbook(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.96]
    rows = spark.createDataFrame([(x,) for x in p], "p double")
    assert sorted(r.p for r in cointegration.benjamini_hochberg(rows).filter("fdr_pass").collect()) == p[:2]


def test_resample_takes_last_finite(spark):
    rows = spark.createDataFrame([("p", 0, b, y, 1.0, 1, 1, t) for b, y, t in ((0, 1.0, True), (1, NAN, False), (2, NAN, False), (3, NAN, False))], "pair string, session int, bar int, close_y double, close_x double, volume_y long, volume_x long, tradeable boolean")
    got = {r.bar: (r.close_y, r.tradeable) for r in intraday.resample(rows, ["pair"], "session", "bar", 2).collect()}
    assert got[0] == (1.0, True) and math.isnan(got[1][0]) and not got[1][1]


def test_ou_recovers_parameters(spark):
    rng = np.random.default_rng(2)
    kappa, sigma, s = 0.05, 0.01, np.zeros(20_000)
    phi = math.exp(-kappa)
    noise = sigma * math.sqrt((1 - phi * phi) / (2 * kappa))
    for i in range(1, len(s)):
        s[i] = phi * s[i - 1] + noise * rng.normal()
    fit = intraday.fit_ou(path(spark, s), ["pair"], "t").first()
    assert fit.fit_ok and fit.kappa == pytest.approx(kappa, rel=0.1) and fit.sigma == pytest.approx(sigma, rel=0.05)
    assert intraday.fit_ou(path(spark, s[:30]), ["pair"], "t").first().reject_reason == "too_few_obs"
    trend = intraday.fit_ou(path(spark, np.arange(100.0) ** 2), ["pair"], "t").first()
    assert not trend.fit_ok and trend.kappa is None


def test_engle_granger_finds_the_ratio(spark):
    rng = np.random.default_rng(8)
    n = 500
    trend = np.cumsum(rng.normal(0, 0.01, n))
    ar = np.zeros(n)
    for i in range(1, n):
        ar[i] = 0.7 * ar[i - 1] + rng.normal(0, 0.005)
    rows = spark.createDataFrame([("p", "A", "B", i, float(np.exp(0.7 * t + a)), float(np.exp(t))) for i, (t, a) in enumerate(zip(trend, ar))], "pair string, sym1 string, sym2 string, date int, y double, x double")
    got = cointegration.test_pairs(rows, ["pair"]).first()
    beta = got.beta if got.y_sym == "A" else 1 / got.beta
    assert got.adf_pvalue < 0.05 and beta == pytest.approx(0.7, rel=0.05) and got.n_obs == n


def test_exclusions_in_order(spark):
    rows = spark.createDataFrame([(None, 5.0, True, "A"), (False, 5.0, True, "A"), (True, 99.0, True, "A"), (True, 5.0, False, "A"), (True, 5.0, True, "A")], "fit_ok boolean, half_life double, feasible boolean, regime string")
    got = [r.exclusion_reason for r in grid.exclusions(rows, {"A": (1.0, 10.0), "B": (10.0, 20.0)}).collect()]
    assert got == ["no_cache", "no_reversion", "hl_band", "infeasible_at_cost", None]
    assert grid.cells(spark).count() == 30


def test_closed_form_matches_simulation():
    rng = np.random.default_rng(4)
    kappa, sigma_eq, a = 0.1, 0.05, 0.05
    phi, noise = math.exp(-kappa / 20), sigma_eq * math.sqrt(1 - math.exp(-kappa / 10))
    x, t = np.full(2000, -a), np.zeros(2000)
    live = np.ones(2000, bool)
    while live.any():
        x[live] = phi * x[live] + noise * rng.normal(size=live.sum())
        t[live] += 1 / 20
        live &= x < a
    # From -a the path meets 0 first and then either end alike, so a passage to a takes two cycles.
    assert t.mean() == pytest.approx(2 * float(kernels.cycle_length(a, kappa, sigma_eq)), rel=0.12)


def test_machine_over_parts_equals_the_whole(spark):
    """Parts of one bar, of many, and without any z; holdings longer than a part; a holding limit a group."""
    import numpy as np
    import pytest

    from pairlab.operators import signals

    rng = np.random.default_rng(11)
    rows = []
    for k, p in enumerate("ab"):
        z = np.cumsum(rng.normal(0, 0.6, 400)) * 0.3 + rng.normal(0, 1.2, 400)
        z[rng.random(400) < 0.1] = np.nan
        z[100:140] = np.nan
        rows += [(p, i, i // 30 if p == "a" else int(np.sqrt(i)), float(z[i]), 7 + 40 * k, "x") for i in range(400)]
    df = spark.createDataFrame(rows, "pair string, t int, part int, z double, most int, position_before string").repartition(4)
    for most in (5, "most"):
        kw = dict(entry=1.2, exit_=0.3, stop=4.0, max_holding=most)
        want = signals.rolling_signals(df, ["pair"], "t", **kw)
        got = signals.rolling_signals_in_parts(df, ["pair"], "t", "part", **kw)
        assert got.columns == want.columns
        key = lambda r: (r.pair, r.t, r.position, r.held, r.exit_reason)
        assert sorted(map(key, got.collect()), key=str) == sorted(map(key, want.collect()), key=str)
    assert signals.rolling_signals_in_parts(df.limit(0), ["pair"], "t", "part").count() == 0
    with pytest.raises(ValueError):
        signals.rolling_signals_in_parts(df, ["pair"], "t", "part", entry=0.1)


def test_blocks_equal_whole_groups(spark):
    """Means, deviations and scores of groups in blocks, with nulls, NaN and flat windows; no task holds more than a block."""
    rng = np.random.default_rng(9)
    rows = [("a", i, float(v)) for i, v in enumerate(np.cumsum(rng.normal(size=173)), 1)] + [("b", i, None if i == 40 else float("nan") if i == 70 else 1.1 if 80 < i < 110 else float(i % 7)) for i in range(1, 131)]
    rows += [("short", 1, 2.0)]
    df = spark.createDataFrame(rows, "pair string, t long, spread double")
    for block in (12, 25, 1000):
        got = signals.rolling_stats(df, ["pair"], "t", window=12, place="t", block_rows=block)
        want = signals.rolling_stats(df, ["pair"], "t", window=12)
        z = {(r.pair, r.t): r for r in got.withColumn("z", signals.z_score()).collect()}
        plain = want.withColumn("z", signals.z_score()).collect()
        assert len(z) == len(plain) == len(rows) and got.count() == len(rows)
        for r in plain:
            for c in ("roll_mean", "roll_std", "z"):
                a, b = z[r.pair, r.t][c], r[c]
                assert (a != a and b != b) or (a is None and b is None) or a == pytest.approx(b, rel=1e-9, abs=1e-12), (r, c, block)
    with pytest.raises(ValueError):
        signals.rolling_stats(df, ["pair"], "t", window=12, place="t", block_rows=11)
