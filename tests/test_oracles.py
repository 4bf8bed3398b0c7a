"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [
    "trading_calendar", "residual_split_adjust", "split_audit_status", "liquidity_filter", "contiguity_filter", "validation_gate", "apply_repair", "dedup_keep_last", "adv_distribution",
    "corr_pairs", "hurst_exponent", "bh_fdr", "build_folds", "rolling_signals", "trades_daily", "portfolio_metrics", "tod_adjusted_z", "signals_two_regime_a", "signals_ou_hard", "intraday_trades", "cost_ladder",
    "two_regime_metrics", "grid_fixed_thresholds", "spread", "rolling_zscore", "liquidity_by_fold", "signals_in_parts", "card_curves", "card_union_axis", "position_segments", "per_pair_summary", "leg_levels",
    "engle_granger_in_parts", "bertram_thresholds", "simulated_cycles", "exclusion_funnel", "stage_funnel", "holding_limits", "grid_cells",
    "minute_store", "ingest_statistics", "order_gates", "universe_differences", "daily_store", "action_cache", "sector_tables", "unmapped_symbols", "validated_table",
]


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    clean = lambda v: None if v is None or v is pd.NaT or v is pd.NA or v != v else str(v)[:10] if hasattr(v, "isoformat") else round(float(v), 4) if isinstance(v, float) else v
    return sorted((tuple(clean(v) for v in r) for r in df.astype(object).itertuples(index=False)), key=repr)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(NAMES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "position" in df.columns
