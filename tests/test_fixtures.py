import numpy as np
import pandas as pd

from pairlab import fixtures


def test_dense_panel_keeps_every_line(spark, tmp_path):
    rng = np.random.default_rng(3)
    n = {1: 2750, 2: 2640}
    part = pd.DataFrame({"p_partkey": [1, 2], "p_brand": ["Brand#11", "Brand#21"]})  # one sector
    lines = pd.DataFrame([(k, i, 1, 0, 1.0, *rng.integers(0, 9, 2) / 100, 5.0) for k, m in n.items() for i in range(m)], columns=["l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity"])
    part.to_parquet(tmp_path / "part.parquet")
    lines.to_parquet(tmp_path / "lineitem.parquet")
    got = fixtures.dense_panel(spark, str(tmp_path)).toPandas().sort_values(["symbol", "date"])
    u = lines["l_discount"] + lines["l_tax"]
    e = ((u - u.mean()) / u.std()).groupby(lines["l_partkey"]).apply(lambda s: s.reset_index(drop=True))
    trend = e.groupby(level=1).mean().cumsum()
    for key, symbol in zip(part["p_partkey"], part["p_brand"]):
        own = e[key].rolling(20, min_periods=1).mean()
        rows = got[got["symbol"] == symbol]
        assert len(rows) == n[key]
        assert np.allclose(rows["close"], np.exp(np.log(100) + 0.02 * trend[: n[key]] + 0.02 * own), rtol=1e-8)
        assert list(pd.to_datetime(rows["date"])) == list(pd.bdate_range("1995-01-02", periods=n[key]))
