"""Cointegration of candidate pairs, for all windows in one plan."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pairlab.checkpoints import materialized
from pairlab.functions import kernels
from pairlab.operators import spans
from pairlab.operators.screen import is_share_class_duplicate, is_structural_pair
from pairlab.params import DEFAULTS


def aligned_pairs(daily: DataFrame, pairs: DataFrame, value: str = "close") -> DataFrame:
    """Rows of each pair ``(y_sym, x_sym, ...)`` on dates that both legs have, with their values y and x."""
    y = daily.select(F.col("symbol").alias("y_sym"), "date", F.col(value).alias("y"))
    x = daily.select(F.col("symbol").alias("x_sym"), "date", F.col(value).alias("x"))
    return pairs.join(y, "y_sym").join(x, ["x_sym", "date"])


def hedge_ratios(aligned: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, alpha, beta, n_obs): OLS of ln y on ln x; null where x is constant."""
    logs = aligned.withColumn("ly", F.ln("y")).withColumn("lx", F.ln("x"))
    s = logs.groupBy(*keys).agg(F.covar_pop("lx", "ly").alias("c"), F.var_pop("lx").alias("v"), F.avg("ly").alias("my"), F.avg("lx").alias("mx"), F.count(F.lit(1)).alias("n_obs"))
    s = s.withColumn("beta", F.try_divide("c", "v"))
    return s.select(*keys, (F.col("my") - F.col("beta") * F.col("mx")).alias("alpha"), "beta", "n_obs")


def with_previous(rows: DataFrame, keys: list[str], order: str, value: str, block_rows: int | None = None) -> DataFrame:
    """(keys, value, prev__), the value of the row before.

    With ``block_rows``, ``order`` counts a group's rows without gaps, and long groups are cut into blocks with tasks of
    their own, each with the row before it.
    """
    if block_rows is None:
        return rows.select(*keys, value, F.lag(value).over(Window.partitionBy(*keys).orderBy(order)).alias("prev__"))
    own = F.floor(F.col(order) / block_rows)
    last = F.pmod(F.col(order), F.lit(block_rows)) == block_rows - 1
    cut = rows.select(*keys, order, value, F.explode(F.when(last, F.array(own, own + 1)).otherwise(F.array(own))).alias("block__"))
    before = F.lag(value).over(Window.partitionBy(*keys, "block__").orderBy(order))
    return cut.withColumn("prev__", before).filter(own == F.col("block__")).select(*keys, value, "prev__")


def ar1_half_life(rows: DataFrame, keys: list[str], order: str, value: str = "spread", *, block_rows: int | None = None) -> DataFrame:
    """(keys, phi, half_life, n): AR(1) by regression on the previous row; NaN for phi <= 0, inf for phi >= 1. ``block_rows`` as in with_previous."""
    lagged = with_previous(rows, keys, order, value, block_rows)
    pairs = lagged.filter(F.col("prev__").isNotNull() & F.col(value).isNotNull())
    s = pairs.groupBy(*keys).agg(F.covar_pop("prev__", value).alias("c"), F.var_pop("prev__").alias("v"), F.count(F.lit(1)).alias("n"))
    s = s.withColumn("phi", F.try_divide("c", "v"))
    life = F.when(F.col("phi").isNull() | (F.col("n") < 2) | (F.col("phi") <= 0), F.lit(float("nan"))).when(F.col("phi") >= 1, F.lit(float("inf"))).otherwise(F.lit(-float(np.log(2.0))) / F.ln("phi"))
    return s.select(*keys, "phi", life.alias("half_life"), "n")


def hurst_exponent(rows: DataFrame, keys: list[str], order: str, value: str = "spread", *, max_lag: int = DEFAULTS.hurst_lag) -> DataFrame:
    """(keys, hurst): slope of ln(std of lagged differences) on ln(lag); no row under 20 rows or 4 lags.

    A group is one pair in one window. Its hundred lags are slices of one array, in place of as many window
    expressions and aggregates over every row.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = kernels.hurst(pdf.sort_values(order)[value].to_numpy(float), max_lag)
        return pd.DataFrame([{k: pdf[k].iloc[0] for k in keys} | {"hurst": found}])

    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys) + ", hurst double"
    return rows.select(*keys, order, value).groupBy(*keys).applyInPandas(run, schema).filter(~F.isnan("hurst"))


def dickey_fuller_stat(rows: DataFrame, keys: list[str], order: str, value: str = "spread", *, block_rows: int | None = None) -> DataFrame:
    """(keys, n, stat): t-statistic of the level in the regression of its difference on it, without lags. ``block_rows`` as in with_previous."""
    lagged = with_previous(rows, keys, order, value, block_rows)
    d = lagged.select(*keys, F.col("prev__").alias("level"), (F.col(value) - F.col("prev__")).alias("step")).filter("level IS NOT NULL AND step IS NOT NULL")
    s = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.covar_pop("level", "step").alias("c"), F.var_pop("level").alias("vx"), F.var_pop("step").alias("vy"))
    b = F.try_divide("c", "vx")
    s = s.withColumn("b", b).withColumn("sse", F.col("n") * (F.col("vy") - F.col("b") * F.col("c")))
    error = F.sqrt(F.try_divide(F.try_divide("sse", F.col("n") - 2), F.col("n") * F.col("vx")))
    return s.filter("n > 2").select(*keys, "n", F.try_divide(F.col("b"), error).alias("stat"))


_TEST = "direction string, y_sym string, x_sym string, alpha double, beta double, adf_stat double, adf_pvalue double, half_life double, hurst double, n_obs long"


def _direction(y: np.ndarray, x: np.ndarray) -> tuple:
    b, _, _ = kernels.ols(y, np.column_stack([np.ones(len(x)), x]))
    residual = y - b[0] - b[1] * x
    stat, p, _ = kernels.adf(residual)
    return float(b[0]), float(b[1]), stat, p, residual


_NAMES = [f.split()[0] for f in _TEST.split(", ")]
_TYPES = [pa.string()] * 3 + [pa.float64()] * 6 + [pa.int64()]


def _test(a: np.ndarray, b: np.ndarray, s1: str, s2: str, least: int, max_lag: int, diagnostics: bool, enough: float = 0.0) -> tuple:
    """The columns _TEST of a pair by the logarithms of its legs; a p-value under ``enough`` of sym1 on sym2 spares the other direction."""
    if len(a) < least:
        return None, s1, s2, *[np.nan] * 6, len(a)
    one = _direction(a, b)
    two = one if one[3] < enough else _direction(b, a)
    first = not two[3] < one[3]
    best, y, x = (one, s1, s2) if first else (two, s2, s1)
    life = kernels.half_life(best[4]) if diagnostics else np.nan
    rough = kernels.hurst(best[4], max_lag) if diagnostics else np.nan
    return f"{y}~{x}", y, x, *best[:4], life, rough, len(a)


def test_pairs(aligned: DataFrame, keys: list[str], *, least: int = 20, max_lag: int = DEFAULTS.hurst_lag, diagnostics: bool = True) -> DataFrame:
    """Engle-Granger test of each group (its columns sym1, sym2, date, y, x) in the direction with the smaller p-value.

    A group is one pair in one window, a few thousand rows at most; ties go to sym1 on sym2.
    """
    schema = ", ".join(f"{k} {aligned.schema[k].dataType.simpleString()}" for k in keys) + ", " + _TEST

    def run(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["date"].to_numpy(), kind="stable")
        a, b = (np.log(rows[c].cast(pa.float64()).to_numpy()[order]) for c in ("y", "x"))
        found = _test(a, b, rows["sym1"][0].as_py(), rows["sym2"][0].as_py(), least, max_lag, diagnostics)
        return pa.table([*rows.select(keys).slice(0, 1).columns, *[pa.array([v], t) for v, t in zip(found, _TYPES)]], names=[*keys, *_NAMES])

    if aligned.schema["date"].dataType.typeName() == "date":
        aligned = aligned.withColumn("date", F.unix_date("date"))  # Python has no dates past the year 9999
    return aligned.groupBy(*keys).applyInArrow(run, schema)


def _test_units(met: DataFrame, asked: DataFrame, keys: list[str], many: bool, *, least: int = 20, min_overlap: int = 1, max_lag: int = DEFAULTS.hurst_lag, diagnostics: bool = True, enough: float = 0.0) -> DataFrame:
    """test_pairs of ``asked(chunk, keys, lo, hi)`` on the bars from lo to hi that both legs have above 0, where these are min_overlap or more; ``met`` is from spans.legs, ``enough`` as in _test."""
    wanted = asked.select("chunk", *keys, *[F.unix_date(c).alias(c) for c in ("lo", "hi")])
    order = [k for k in ("sector", "fold_id", "sym1", "sym2") if k in keys]
    types = [*[to_arrow_type(asked.schema[k].dataType) for k in keys], *_TYPES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                logs, found = {}, []
                for s, (days, closes) in spans.series(batch["legs"][i]).items():
                    good = closes > 0
                    logs[s] = days[good], np.log(closes[good])
                for p in batch["asked"][i].as_py():
                    if p["sym1"] in logs and p["sym2"] in logs:
                        _, a, b = spans.aligned(*(spans.cut(logs[p[s]], p["lo"], p["hi"]) for s in ("sym1", "sym2")))
                        if len(a) >= max(min_overlap, 1):
                            found.append([*[p[k] for k in keys], *_test(a, b, p["sym1"], p["sym2"], least, max_lag, diagnostics, enough)])
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=[*keys, *[f"t__{n}" for n in _NAMES]])

    schema = ", ".join([f"{k} {asked.schema[k].dataType.simpleString()}" for k in keys] + [f"t__{f}" for f in _TEST.split(", ")])
    tested = spans.units(met, wanted, ("sym1", "sym2"), order, many).select("asked", "legs").mapInArrow(run, schema)
    return tested.select(*keys, *[F.col(f"t__{n}").alias(n) for n in _NAMES])


def benjamini_hochberg(tests: DataFrame, *, alpha: float = DEFAULTS.fdr_alpha, p: str = "p", by: list[str] | None = None) -> DataFrame:
    """tests with fdr_pass: the step-up rule within each family ``by`` (one if not given)."""
    by = by or []
    ranked = tests.withColumn("k__", F.row_number().over(Window.partitionBy(*by).orderBy(p))).withColumn("n__", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    cutoff = F.max(F.when(F.col(p) <= F.col("k__") / F.col("n__") * alpha, F.col(p))).over(Window.partitionBy(*by))
    return ranked.withColumn("fdr_pass", F.coalesce(F.col(p) <= cutoff, F.lit(False))).drop("k__", "n__")


def _universe(sectors: DataFrame) -> DataFrame:
    """The sector table without share-class duplicates, by ISIN too if it has that column."""
    isin = F.col("isin") if "isin" in sectors.columns else None
    return sectors.filter(~F.coalesce(is_share_class_duplicate(F.col("symbol"), isin), F.lit(False)))


def _returns(leg: tuple[np.ndarray, np.ndarray], lo: int, hi: int, max_gap: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(days, log returns) of a symbol in a window, none where it lacks an end of the window or has a longer gap."""
    days, closes = spans.cut(leg, lo, hi)
    if not len(days) or days[0] != lo or days[-1] != hi or len(days) > 1 and np.diff(days).max() > max_gap:
        return None
    with np.errstate(all="ignore"):
        r = np.log(closes[1:] / closes[:-1])
    good = np.isfinite(r)
    return days[1:][good], r[good]


def _correlations(m: np.ndarray) -> np.ndarray:
    """Correlations of the rows of m; NaN where one is constant."""
    m = m - m[:, :1]  # from its first value, so that a constant row deviates by 0 exactly
    m = m - m.mean(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        deviation = np.sqrt((m * m).mean(axis=1))
        return (m @ m.T / m.shape[1]) / (deviation[:, None] * deviation)


def _screened(met: DataFrame, windows: DataFrame, sectors: DataFrame, threshold: float, max_gap: int) -> DataFrame:
    """(chunk, fold_id, sym1, sym2, sector, corr) of the windows of each chunk, on the dates that all their symbols have; ``met`` is from spans.legs."""
    fold = windows.schema["fold_id"].dataType
    listed = windows.groupBy("chunk").agg(F.collect_list(F.struct("fold_id", F.unix_date("train_start").alias("lo"), F.unix_date("train_end").alias("hi"))).alias("folds"))
    members = sectors.filter("sector IS NOT NULL").select("symbol", "sector").distinct().groupBy().agg(F.collect_list(F.struct("symbol", "sector")).alias("members"))  # one row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                closes, by_sector, found = spans.series(batch["legs"][i]), defaultdict(list), []
                for m in batch["members"][i].as_py():
                    by_sector[m["sector"]].append(m["symbol"])
                for f in batch["folds"][i].as_py():
                    known = {s: r for s, leg in closes.items() if (r := _returns(leg, f["lo"], f["hi"], max_gap)) is not None}
                    days, counts = np.unique(np.concatenate([np.empty(0, np.int32), *[r[0] for r in known.values()]]), return_counts=True)
                    full = days[counts == len(known)]
                    if not len(full):
                        continue
                    for sector, symbols in by_sector.items():
                        own = sorted(s for s in symbols if s in known)
                        if len(own) > 1:
                            corr = _correlations(np.array([known[s][1][np.searchsorted(known[s][0], full)] for s in own]))
                            for a, b in zip(*np.nonzero(np.triu(corr > threshold, 1))):
                                found.append((batch["chunk"][i].as_py(), f["fold_id"], own[a], own[b], sector, float(corr[a, b])))
                if found:
                    types = [pa.int64(), to_arrow_type(fold), *[pa.string()] * 3, pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=["chunk", "fold_id", "sym1", "sym2", "sector", "corr"])

    rows = met.join(F.broadcast(listed), "chunk").crossJoin(F.broadcast(members)).select("chunk", "legs", "folds", "members")
    return rows.mapInArrow(run, f"chunk long, fold_id {fold.simpleString()}, sym1 string, sym2 string, sector string, corr double")


def candidates(daily: DataFrame, sectors: DataFrame, windows: DataFrame, *, threshold: float = DEFAULTS.correlation_threshold, max_gap: int = DEFAULTS.max_gap_days) -> DataFrame:
    """(fold_id, sym1, sym2, sector, corr) of the correlation screen on every window of ``windows(fold_id, train_start, train_end)``.

    The universe are the symbols of the sector table that are no share-class duplicates, by ISIN too if it
    has that column; others have no say in which dates are complete. A task holds the closes of a few neighbouring windows as
    arrays and screens each; closes and returns that are NaN or infinite count as missing.
    """
    known = _universe(sectors)
    held, _ = spans.in_chunks(windows.select("fold_id", "train_start", "train_end").dropna(), "train_start")
    met = spans.legs(daily.join(known.select("symbol").distinct(), "symbol", "left_semi"), held.select("chunk", F.col("train_start").alias("lo"), F.col("train_end").alias("hi")))
    return _screened(met, held, known, threshold, max_gap).drop("chunk")


def cointegrate(
    daily: DataFrame, sectors: DataFrame, windows: DataFrame, *, threshold: float = DEFAULTS.correlation_threshold, alpha: float = DEFAULTS.fdr_alpha,
    half_life_band: tuple[float, float] = DEFAULTS.half_life_days, hurst_max: float = DEFAULTS.hurst_max, hurst_lag: int = DEFAULTS.hurst_lag, min_overlap: int = DEFAULTS.min_train_days,
) -> DataFrame:
    """All candidates of every window with tests, false-discovery control, bands and stability.

    ``windows(fold_id, train_start, train_end, prior_start, prior_end)``, prior ends null where there is
    none. Flags cascade: the half-life band asks for fdr_pass, hurst_pass for the band, and
    stable_prior_window, tested only then, for a raw pass in the prior window (null without one).
    """
    known, keys = _universe(sectors), ["fold_id", "sym1", "sym2"]
    held, many = spans.in_chunks(windows.select("fold_id", "train_start", "train_end", "prior_start", "prior_end").dropna(subset=["fold_id", "train_start", "train_end"]), "train_start")
    reach = held.select("chunk", F.least("train_start", "prior_start").alias("lo"), F.greatest("train_end", "prior_end").alias("hi"))
    met = spans.legs(daily.join(known.select("symbol").distinct(), "symbol", "left_semi"), reach)
    found = materialized(_screened(met, held, known, threshold, DEFAULTS.max_gap_days))  # a row a candidate
    bounds = lambda of, lo, hi: of.join(F.broadcast(held.select("fold_id", "chunk", F.col(lo).alias("lo"), F.col(hi).alias("hi"))), "fold_id")  # noqa: E731  a row a fold
    # A row a candidate; the tests are costly and three branches read them.
    tested = materialized(_test_units(met, bounds(found.drop("chunk"), "train_start", "train_end"), [*keys, "sector", "corr"], many, min_overlap=min_overlap, max_lag=hurst_lag))
    tested = benjamini_hochberg(tested.withColumn("raw_pass", F.col("adf_pvalue") < alpha), alpha=alpha, p="adf_pvalue", by=["fold_id"])
    tested = tested.withColumn("half_life_in_band", F.col("fdr_pass") & ~F.isnan("half_life") & F.col("half_life").between(*half_life_band))
    tested = tested.withColumn("hurst_pass", F.col("half_life_in_band") & ~F.isnan("hurst") & (F.col("hurst") < hurst_max))
    prior = bounds(tested.filter("hurst_pass").groupBy(*keys).agg(F.min("sector").alias("sector")), "prior_start", "prior_end").filter("lo IS NOT NULL AND hi IS NOT NULL")
    again = _test_units(met, prior, [*keys, "sector"], many, diagnostics=False, enough=alpha)
    again = again.select(*keys, (F.coalesce(F.col("adf_pvalue"), F.lit(1.0)) < alpha).alias("prior_pass"))
    has = windows.select("fold_id", F.col("prior_start").isNotNull().alias("has_prior"))
    stable = F.when(F.col("has_prior"), F.coalesce(F.col("prior_pass"), F.lit(False)))
    return (
        tested.join(again, keys, "left").join(has, "fold_id")
        .withColumn("stable_prior_window", stable)
        .withColumn("is_structural_pair", is_structural_pair(F.col("sym1"), F.col("sym2")))
        .select("fold_id", "sym1", "sym2", "sector", "corr", "direction", "y_sym", "x_sym", "alpha", "beta", "adf_stat", "adf_pvalue", "raw_pass", "fdr_pass", "half_life", "half_life_in_band", "hurst", "hurst_pass", "stable_prior_window", "is_structural_pair", "n_obs")
    )


def ranked(tested: DataFrame) -> DataFrame:
    """A candidate table in report order: tradeable pairs first, then by p-value, then by name; rank counts from 1 in each fold."""
    order = Window.partitionBy("fold_id").orderBy(F.coalesce(is_tradeable(), F.lit(False)).desc(), F.col("adf_pvalue").asc_nulls_last(), "sym1", "sym2")
    return tested.withColumn("rank", F.row_number().over(order))


def is_tradeable() -> Column:
    """All flags; without a prior window its flag is not asked for."""
    return F.col("fdr_pass") & F.col("half_life_in_band") & F.col("hurst_pass") & F.coalesce(F.col("stable_prior_window"), F.lit(True))


def funnel(tested: DataFrame) -> DataFrame:
    """(fold_id, counts by stage) of a candidate table."""
    n = lambda c, name: F.count_if(c).alias(name)
    return tested.groupBy("fold_id").agg(
        F.count(F.lit(1)).alias("n_candidates"), n(F.col("raw_pass"), "n_raw"), n(F.col("fdr_pass"), "n_fdr"), n(F.col("half_life_in_band"), "n_half_life"),
        n(F.col("hurst_pass"), "n_hurst"), n(F.col("hurst_pass") & F.coalesce(F.col("stable_prior_window"), F.lit(True)), "n_stable"),
        n(is_tradeable() & ~F.col("is_structural_pair"), "n_tradeable_ex_structural"), n(is_tradeable(), "n_tradeable"),
    )
