import math

import numpy as np
import pytest

from pairlab.functions import kernels as k


def test_erfi_and_overflow():
    assert k.erfi(1.0) == pytest.approx(1.6504257587975424, rel=1e-14)
    assert np.isinf(k.erfi(40.0)) and k.erfi(-1.0) == pytest.approx(-k.erfi(1.0))


def test_mackinnon_points():
    for stat, p in ((-3.43, 0.0100), (-2.86, 0.0502), (-2.57, 0.0994)):
        assert k.mackinnon_p(stat) == pytest.approx(p, abs=2e-4)
    assert k.mackinnon_p(3.0) == 1.0 and k.mackinnon_p(-20.0) == 0.0


def test_adf_power_and_size():
    rng = np.random.default_rng(3)
    rejected = sum(k.adf(np.cumsum(rng.normal(size=300)))[1] < 0.05 for _ in range(40))
    assert rejected <= 7
    e, s = rng.normal(size=600), np.zeros(600)
    for i in range(1, 600):
        s[i] = 0.8 * s[i - 1] + e[i]
    assert k.adf(s)[1] < 0.01


@pytest.mark.parametrize(
    ("sigma", "expected"), [(0.0515, (0.405, 0.450, 0.488, 0.536)), (0.0358, (0.458, 0.510, 0.553, 0.609))]
)
def test_published_thresholds(sigma, expected):
    costs = np.array([2 * (4.5 + s) / 1e4 for s in (1, 3, 5, 8)])
    assert np.allclose(k.bertram_thresholds(sigma, costs) / sigma, expected, atol=1e-3)


def test_thresholds_grow_with_cost_and_scale():
    c = np.linspace(1e-4, 5e-3, 20)
    a = k.bertram_thresholds(0.02, c)
    assert (np.diff(a) > 0).all() and (a > c).all()
    assert np.allclose(k.bertram_thresholds(0.04, 2 * c), 2 * a)
    assert np.isnan(k.bertram_thresholds(0.02, 1.0)) and np.isnan(k.bertram_thresholds(np.nan, 0.001))
    best = k.return_per_time(a[5], c[5], 0.1, 0.02)
    assert best >= k.return_per_time(a[5] * 1.05, c[5], 0.1, 0.02) and best >= k.return_per_time(a[5] * 0.95, c[5], 0.1, 0.02)


def run(z, **kw):
    args = dict(entry=2.0, exit_=0.5, stop=3.5, max_holding=3) | kw
    p, h, r = k.rolling_machine(np.array(z, float), *args.values())
    return p.tolist(), h.tolist(), r


def test_rolling_machine_transitions():
    nan = math.nan
    assert run([0, 2.0, 2.1, 1.0, 0.5, -2.5])[0] == [0, 0, -1, -1, 0, 1]
    p, h, r = run([-2.1, nan, -1.5, -1.4, -1.3, 0])
    assert p == [1, 1, 1, 1, 0, 0] and h == [1, 1, 2, 3, 0, 0] and r[4] == "time"
    assert run([2.5, 3.5])[2][1] == "stop" and run([-2.5, -3.5])[2][1] == "stop"
    assert run([2.5, -4.0])[2][1] == "mean_revert"
    assert run([2.5, 0.4, 2.6])[0] == [-1, 0, -1]


def test_rolling_machine_is_causal():
    z = np.random.default_rng(1).normal(0, 2, 300)
    whole = k.rolling_machine(z, 2.0, 0.5, 3.5, 10)
    part = k.rolling_machine(z[:120], 2.0, 0.5, 3.5, 10)
    assert (whole[0][:120] == part[0]).all() and whole[2][:120] == part[2]


def test_ou_machine_edges():
    p, h, r = k.ou_machine(np.array([1.0, 0.5, 0.4, 0.3, -0.1]), 1.0, None, 99)
    assert p.tolist() == [-1, -1, -1, -1, 0] and h.tolist() == [0, 2, 3, 4, 0] and r[4] == "mean_revert"
    assert k.ou_machine(np.array([1.0, np.nan, 4.0]), 1.0, 4.0, 99)[2][2] == "z_stop"
    assert k.ou_machine(np.array([1.0, np.nan, 4.0]), 1.0, 4.0, 99)[1].tolist() == [0, 1, 0]
    assert k.ou_machine(np.array([-1.0, -0.9, -0.8]), 1.0, None, 2)[2] == [None, None, "time_stop"]


def test_half_life_and_hurst():
    rng = np.random.default_rng(0)
    s = np.zeros(4000)
    for i in range(1, 4000):
        s[i] = 0.9 * s[i - 1] + rng.normal()
    assert k.half_life(s) == pytest.approx(math.log(0.5) / math.log(0.9), rel=0.15)
    assert k.hurst(s) < 0.3 < 0.4 < k.hurst(np.cumsum(rng.normal(size=4000))) < 0.6
    assert math.isnan(k.hurst(np.arange(10.0))) and math.isnan(k.half_life(np.array([1.0, 2.0])))


def test_transitions_are_the_machine_from_every_state():
    rng = np.random.default_rng(6)
    for most in (1, 3, 12):
        for n in (0, 1, 2, 5, 60):
            for scale in (0.8, 2.5):
                z = rng.normal(0, scale, n)
                z[rng.random(n) < 0.2] = np.nan
                got = k.rolling_transitions(z, 1.5, 0.5, 3.0, most)
                assert len(got) == 2 * most + 1
                for number, end in enumerate(got.tolist()):
                    side, bars = k.machine_state(number, most)
                    position, held, _ = k.rolling_machine(z, 1.5, 0.5, 3.0, most, side, bars)
                    want = (int(position[-1]), int(held[-1])) if n else (side, bars)
                    assert k.machine_state(end, most) == want


def test_hurst_of_all_lags_at_once_equals_lag_by_lag():
    """Lags whose differences are exactly 0, or tiny beside the series, count as they do alone."""
    rng = np.random.default_rng(12)
    cases = [np.cumsum(rng.normal(size=n)) + shift for n in (20, 61, 504) for shift in (0.0, 1e4)]
    cases += [rng.normal(size=300), np.tile([1.0, 2.0, 4.0, 4.5, 3.0], 40), np.arange(90.0) ** 2, np.cumsum(np.cumsum(rng.normal(size=400)))]
    for x in cases:
        lags = range(2, min(40, len(x) // 2) + 1)
        found = [(np.log(t), np.log(sd)) for t in lags if (sd := (x[t:] - x[:-t]).std()) > 0]
        assert k.hurst(x, 40) == pytest.approx(np.polyfit(*np.array(found).T, 1)[0], rel=1e-7, abs=1e-9)
    assert np.isnan(k.hurst(np.full(80, 2.1), 40))
