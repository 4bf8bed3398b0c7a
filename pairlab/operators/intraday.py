"""Alignment and resampling of minute bars, the liquidity gate and Ornstein-Uhlenbeck fits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pairlab.checkpoints import small
from pairlab.functions import kernels
from pairlab.params import DEFAULTS

NAN = float("nan")


def partial_day_flag(bars: DataFrame, *, full: int = DEFAULTS.bars_per_session) -> DataFrame:
    """bars with partial_day_flag: the symbol has fewer than ``full`` bars that date."""
    return bars.withColumn("partial_day_flag", F.count(F.lit(1)).over(Window.partitionBy("symbol", "date")) < full)


def align_pairs(bars: DataFrame, pairs: DataFrame, at: list[str]) -> DataFrame:
    """(y_sym, x_sym, at, close_y, close_x, volume_y, volume_x, tradeable): both legs on the union of their bars.

    ``at`` are the columns that identify a bar. A missing leg has NaN close and no volume; a bar is
    tradeable when both legs have one.
    """
    legs = [
        pairs.select("y_sym", "x_sym").join(bars.select(F.col("symbol").alias(s), *at, "close", "volume"), s).select("y_sym", "x_sym", *at, F.struct("close", "volume").alias(name))
        for s, name in (("y_sym", "y"), ("x_sym", "x"))
    ]
    both = legs[0].join(legs[1], ["y_sym", "x_sym", *at], "full_outer")
    price = lambda leg: F.coalesce(F.col(f"{leg}.close"), F.lit(NAN))
    volume = lambda leg: F.coalesce(F.col(f"{leg}.volume"), F.lit(0)).cast("long")
    return both.select("y_sym", "x_sym", *at, price("y").alias("close_y"), price("x").alias("close_x"), volume("y").alias("volume_y"), volume("x").alias("volume_x"), (F.col("y").isNotNull() & F.col("x").isNotNull()).alias("tradeable"))


def resample(aligned: DataFrame, keys: list[str], session: str, bar: str, freq: int, *, ts: str | None = None) -> DataFrame:
    """Bars of ``freq`` fine bars within each session: last finite close of each leg, first time, tradeable if any was and both closes are finite."""
    if freq < 1:
        raise ValueError("freq must be at least 1")
    last = lambda c: F.coalesce(F.max_by(c, F.when(~F.isnan(c), F.col(bar))), F.lit(NAN))
    coarse = F.floor(F.col(bar) / freq).cast("int").alias("coarse__")
    out = aligned.groupBy(*keys, session, coarse).agg(
        *([F.min(ts).alias(ts)] if ts else []), last("close_y").alias("close_y"), last("close_x").alias("close_x"), F.sum("volume_y").alias("volume_y"), F.sum("volume_x").alias("volume_x"), F.bool_or("tradeable").alias("any__")
    )
    return out.withColumn("tradeable", F.col("any__") & ~F.isnan("close_y") & ~F.isnan("close_x")).drop("any__").withColumnRenamed("coarse__", bar)


def session_number(keys: list[str], session: str) -> Column:
    """Sessions of a group counted from 0."""
    return F.dense_rank().over(Window.partitionBy(*keys).orderBy(session)) - 1


def liquidity_gate(bars: DataFrame, pairs: DataFrame, *, full: int = DEFAULTS.bars_per_session, fill: float = DEFAULTS.liquidity_fill) -> DataFrame:
    """(y_sym, x_sym, fill_y, fill_x, intraday_pass): mean share of bars present over a symbol's sessions; both must reach ``fill``."""
    per = bars.groupBy("symbol", "session").agg(F.count(F.lit(1)).alias("n")).groupBy("symbol").agg(F.avg(F.col("n") / float(full)).alias("f"))
    y, x = per.select(F.col("symbol").alias("y_sym"), F.col("f").alias("fill_y")), per.select(F.col("symbol").alias("x_sym"), F.col("f").alias("fill_x"))
    joined = pairs.select("y_sym", "x_sym").join(y, "y_sym", "left").join(x, "x_sym", "left")
    return joined.withColumn("intraday_pass", F.coalesce((F.col("fill_y") >= fill) & (F.col("fill_x") >= fill), F.lit(False)))


def window_minutes(half_life_days: Column, *, bars: int = DEFAULTS.bars_per_session, most: int = 5) -> Column:
    """Half-life in minutes, half to even, from one to ``most`` sessions."""
    return F.least(F.greatest(F.bround(half_life_days * bars).cast("int"), F.lit(bars)), F.lit(most * bars))


def max_holding_bars(half_life_days: Column, freq: int, *, bars: int = DEFAULTS.bars_per_session, cap_days: int = DEFAULTS.max_holding, multiplier: float = DEFAULTS.holding_multiplier) -> Column:
    """Longest holding time in bars of ``freq`` minutes, at least 1."""
    minutes = F.greatest(window_minutes(half_life_days, bars=bars), F.least(F.lit(cap_days * bars), F.bround(half_life_days * bars * multiplier).cast("int")))
    return F.greatest(F.bround(minutes / freq).cast("int"), F.lit(1))


def fit_ou(rows: DataFrame, keys: list[str], order: str, value: str = "spread", *, freq_minutes: float = 1.0, least: int = DEFAULTS.ou_min_obs) -> DataFrame:
    """Ornstein-Uhlenbeck parameters of each group from regression of finite neighbours.

    A bar without a spread breaks the pair on both sides; sessions do not. A fit that is refused has a
    reject_reason and null parameters.
    """
    nxt = rows.select(*keys, F.col(value).alias("y__"), F.lag(value).over(Window.partitionBy(*keys).orderBy(order)).alias("x__"))
    both = nxt.filter("x__ IS NOT NULL AND y__ IS NOT NULL AND NOT isnan(x__) AND NOT isnan(y__)")
    s = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_obs"), F.covar_pop("x__", "y__").alias("c"), F.var_pop("x__").alias("vx"), F.var_pop("y__").alias("vy"), F.avg("x__").alias("mx"), F.avg("y__").alias("my"))
    s = rows.select(*keys).distinct().join(s, keys, "left").withColumn("n_obs", F.coalesce("n_obs", F.lit(0)))
    s = s.withColumn("phi", F.try_divide("c", "vx")).withColumn("intercept", F.col("my") - F.col("phi") * F.col("mx"))
    sse = F.greatest(F.col("n_obs") * (F.col("vy") - F.col("phi") * F.col("c")), F.lit(0.0))
    s = s.withColumn("sigma_eps", F.sqrt(F.try_divide(sse, F.col("n_obs") - 1)))
    why = (
        F.when(F.col("n_obs") < least, "too_few_obs").when(F.col("phi").isNull(), "non_finite").when(F.col("phi") <= 0, "phi_not_positive")
        .when(F.col("phi") >= 1, "phi_not_below_one").when(F.col("sigma_eps").isNull() | (F.col("sigma_eps") <= 0), "no_noise").otherwise("")
    )
    s = s.withColumn("reject_reason", why).withColumn("fit_ok", F.col("reject_reason") == "")
    ok = lambda c: F.when(F.col("fit_ok"), c)
    s = s.withColumn("kappa", ok(-F.ln("phi"))).withColumn("mu", ok(F.try_divide(F.col("intercept"), 1 - F.col("phi"))))
    s = s.withColumn("sigma_eq", ok(F.try_divide(F.col("sigma_eps"), F.sqrt(1 - F.col("phi") * F.col("phi"))))).withColumn("sigma", F.col("sigma_eq") * F.sqrt(2 * F.col("kappa")))
    s = s.withColumn("half_life_bars", F.try_divide(F.lit(0.6931471805599453), F.col("kappa"))).withColumn("half_life_minutes", F.col("half_life_bars") * freq_minutes)
    return s.select(*keys, "n_obs", "fit_ok", "reject_reason", ok(F.col("phi")).alias("phi"), "kappa", "mu", "sigma", "sigma_eq", ok(F.col("sigma_eps")).alias("sigma_eps"), "half_life_bars", "half_life_minutes")


def z_ou(rows: DataFrame, fits: DataFrame, keys: list[str], value: str = "spread") -> DataFrame:
    """rows with z_ou: distance from the fitted mean in stationary deviations; NaN for refused fits."""
    joined = rows.join(fits.select(*keys, "mu", "sigma_eq"), keys)
    return joined.withColumn("z_ou", F.coalesce(F.try_divide(F.col(value) - F.col("mu"), F.col("sigma_eq")), F.lit(NAN))).drop("mu", "sigma_eq")


def drift(scored: DataFrame, keys: list[str], *, limit: float = 0.5) -> DataFrame:
    """(keys, drift_mean, drift_flag): mean of finite z_ou, and whether it is beyond the limit."""
    m = scored.groupBy(*keys).agg(F.avg(F.when(~F.isnan("z_ou"), F.col("z_ou"))).alias("drift_mean"))
    return m.withColumn("drift_flag", F.coalesce(F.abs("drift_mean") > limit, F.lit(False)))


def in_half_life_band(half_life: Column, band: tuple[float, float]) -> Column:
    return F.coalesce(half_life.between(*band), F.lit(False))


@F.pandas_udf(DoubleType())
def bertram_entry(sigma_eq: pd.Series, cost: pd.Series) -> pd.Series:
    """Entry distance that maximises return per time; NaN if infeasible."""
    return pd.Series(kernels.bertram_thresholds(sigma_eq.to_numpy(float), cost.to_numpy(float)))


@F.pandas_udf(DoubleType())
def mean_cycle(a: pd.Series, kappa: pd.Series, sigma_eq: pd.Series) -> pd.Series:
    """Mean length of a trade cycle."""
    return pd.Series(kernels.cycle_length(a, kappa, sigma_eq))


@F.pandas_udf(DoubleType())
def return_rate(a: pd.Series, cost: pd.Series, kappa: pd.Series, sigma_eq: pd.Series) -> pd.Series:
    """Return per time of entering at a."""
    return pd.Series(kernels.return_per_time(a, cost, kappa, sigma_eq))


def thresholds(fits: DataFrame, ladder: DataFrame, *, fixed: float = DEFAULTS.fixed_cost_bps) -> DataFrame:
    """fits (with beta) at every cost level: cost_log, a, a_z, feasible and return_rate."""
    from pairlab.operators.backtest import leg_bps, pair_cost

    each = fits.crossJoin(small(ladder)).withColumn("cost_log", pair_cost(F.col("beta"), leg_bps(F.col("spread_bps"), fixed=fixed)))
    solved = each.withColumn("a", bertram_entry(F.coalesce("sigma_eq", F.lit(NAN)), F.col("cost_log")))
    solved = solved.withColumn("feasible", F.col("fit_ok") & ~F.isnan("a")).withColumn("a_z", F.try_divide("a", "sigma_eq"))
    return solved.withColumn("return_rate", return_rate(F.col("a"), F.col("cost_log"), F.coalesce("kappa", F.lit(NAN)), F.coalesce("sigma_eq", F.lit(NAN))))
