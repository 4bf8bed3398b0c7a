"""Simulated cycles against the closed form of the mean cycle."""

import math

import numpy as np
import pytest

from pairlab.functions import kernels
from pairlab.operators import cycles

KEYS = ["pair"]
SHAPE = "pair string, kappa double, sigma_eq double, a double, cost_log double"


@pytest.mark.parametrize("kappa,sigma_eq,cost", [(0.02, 0.01, 0.001), (0.05, 0.02, 0.002), (0.2, 0.005, 0.0015)])
def test_closed_form(spark, kappa, sigma_eq, cost):
    a = float(kernels.bertram_thresholds([sigma_eq], [cost])[0])
    fits = spark.createDataFrame([("p", kappa, sigma_eq, a, cost)], SHAPE)
    r = cycles.simulate_cycles(fits, KEYS, paths=2000).first()
    assert r.settled and r.n_paths == 2000 and r.n_cycles > 10_000
    assert r.cycle_closed == pytest.approx(math.pi / (2 * kappa) * float(kernels.erfi(a / (sigma_eq * math.sqrt(2)))))
    assert abs(r.cycle - r.cycle_closed) < 4 * r.cycle_se + 0.005 * r.cycle_closed
    assert abs(r.rate - r.rate_closed) < 4 * r.rate_se + 0.005 * r.rate_closed
    assert r.cycle_se < 0.02 * r.cycle


def test_step_length():
    """Cycles in a horizon against the closed form: near it with the given step, some percent short with one five times as long."""
    want = 40.0 / (math.pi / 2 * float(kernels.erfi(1 / math.sqrt(2))))
    n = [cycles.count_cycles(1.0, 4000, np.random.default_rng(3), step=s, burn=10.0, horizon=40.0).mean() for s in (0.02, 0.1)]
    assert n[0] == pytest.approx(want, rel=0.01)
    assert 0.94 * want < n[1] < n[0]


def test_refused_rows_and_layout(spark):
    nan = float("nan")
    rows = [("a", 0.1, 0.01, 0.012, 0.001), ("a", 0.1, 0.01, 0.012, 0.001), ("b", None, 0.01, 0.012, 0.001), ("c", 0.1, nan, 0.012, 0.001), ("d", 0.1, 0.01, 0.0, 0.001), ("e", 0.1, 0.01, nan, 0.001), ("f", 0.1, 0.01, 0.012, None), (None, 0.2, 0.01, 0.012, 0.001)]
    fits = spark.createDataFrame(rows, SHAPE)
    one = cycles.simulate_cycles(fits, KEYS, paths=90, per_task=40, tasks=1).toPandas().sort_values("pair").reset_index(drop=True)
    many = cycles.simulate_cycles(fits.repartition(5), KEYS, paths=90, per_task=40, tasks=7).toPandas().sort_values("pair").reset_index(drop=True)
    assert one.equals(many)
    assert len(one) == 2 and one["pair"][0] == "a" and one["pair"].isna()[1]  # a null key is a key
    assert (one["n_paths"] == 90).all()
    far = spark.createDataFrame([("p", 0.1, 0.01, 0.2, 0.001)], SHAPE)
    r = cycles.simulate_cycles(far, KEYS, paths=20).first()
    assert r.n_cycles == 0 and r.cycle is None and r.rate == 0 and not r.settled
    assert cycles.simulate_cycles(fits.limit(0), KEYS).count() == 0
