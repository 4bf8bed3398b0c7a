"""Corporate actions: flattening, audit of splits, dividend flavour and coverage."""

from __future__ import annotations

import math
import random
import time
from collections.abc import Callable, Iterable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.operators.clean import by_symbol


#: What a fetch gives of each symbol.
FETCHED = "symbol string, splits array<struct<ex_date: date, value: double>>, dividends array<struct<ex_date: date, value: double>>, error string"


def fetch_one(symbol: str, fetch: Callable[[str], Iterable[tuple[date, float | None, float | None]] | None], *, tries: int = 3, delay: float = 1.0) -> dict:
    """A symbol's splits and dividends from fetch(symbol), rows of (date, split ratio, dividend), where 0, null and NaN are none.

    A call that raises is tried again after delay, then twice as long, and so on, with up to a quarter of a second more; the
    last error is told. None and no rows are a success without actions.
    """
    error = None
    for attempt in range(tries):
        try:
            rows = list(fetch(symbol) or [])
        except Exception as e:  # whatever a source raises is told of the symbol
            error = f"{type(e).__name__}: {e}"
            if attempt + 1 < tries:
                time.sleep(delay * 2**attempt + random.random() * min(0.25, delay))
            continue
        some = lambda k: [{"ex_date": r[0], "value": float(r[k])} for r in rows if r[k] and not math.isnan(r[k])]
        return {"symbol": symbol, "splits": some(1), "dividends": some(2), "error": None}
    return {"symbol": symbol, "splits": [], "dividends": [], "error": error or "not tried"}


def fetch_actions(symbols: DataFrame, fetch: Callable[[str], Iterable[tuple[date, float | None, float | None]] | None], *, at_once: int = 8, tries: int = 3, delay: float = 1.0) -> DataFrame:
    """The actions of each symbol (columns FETCHED), ``at_once`` symbols at a time.

    ``fetch`` runs in tasks, so a lost executor's symbols are asked for again; write the result before it is read twice.
    """

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame([fetch_one(s, fetch, tries=tries, delay=delay) for s in pdf["symbol"]], columns=["symbol", "splits", "dividends", "error"])

    return symbols.select("symbol").filter("symbol IS NOT NULL").distinct().repartition(at_once, "symbol").mapInPandas(run, FETCHED)


def flatten_actions(fetched: DataFrame) -> DataFrame:
    """(symbol, action_type, ex_date, value) from rows with arrays ``splits`` and ``dividends`` of (ex_date, value)."""
    kinds = [("split", "splits"), ("dividend", "dividends")]
    rows = [fetched.select("symbol", F.lit(kind).alias("action_type"), F.explode(column).alias("a")) for kind, column in kinds]
    return rows[0].unionByName(rows[1]).select("symbol", "action_type", "a.ex_date", "a.value")


def coverage(fetched: DataFrame) -> DataFrame:
    """(symbol, status, error, n_splits, n_dividends); a failed fetch differs from an empty one by its error."""
    n = {c: F.coalesce(F.size(c), F.lit(0)) for c in ("splits", "dividends")}
    status = F.when(F.col("error").isNotNull(), "error").when(n["splits"] + n["dividends"] == 0, "empty").otherwise("ok")
    return fetched.select("symbol", status.alias("status"), "error", n["splits"].alias("n_splits"), n["dividends"].alias("n_dividends"))


def split_audit(daily: DataFrame, splits: DataFrame, *, tolerance: float = 0.05) -> DataFrame:
    """Status of each split of ``splits(symbol, ex_date, value)`` against the prices on its ex-date.

    out_of_window: no close there; no_prev_close; trivial_split: the ratio moves prices by less than
    ``tolerance``; residual_jump: the observed ratio is what unadjusted prices would show; ok otherwise.
    """
    priced = daily.select("symbol", F.col("date").alias("ex_date"), "close", F.lag("close").over(by_symbol()).alias("prev_close"))
    joined = splits.select("symbol", "ex_date", F.col("value").alias("split_ratio")).join(priced, ["symbol", "ex_date"], "left")
    observed, expected = F.try_divide(F.col("close"), F.col("prev_close")), F.try_divide(F.lit(1.0), F.col("split_ratio"))
    shown = joined.withColumn("observed_ratio", observed).withColumn("expected_unadjusted_ratio", expected)
    distance = F.abs(F.col("observed_ratio") - F.col("expected_unadjusted_ratio"))
    status = (
        F.when(F.col("close").isNull(), "out_of_window")
        .when(F.col("prev_close").isNull(), "no_prev_close")
        .when(F.abs(F.col("expected_unadjusted_ratio") - 1) < tolerance, "trivial_split")
        .when(distance < tolerance, "residual_jump")
        .otherwise("ok")
    )
    return shown.select("symbol", "ex_date", "split_ratio", "prev_close", "close", "observed_ratio", "expected_unadjusted_ratio", distance.alias("residual_distance"), status.alias("status"))


def status_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def adjustment_flavor(ours: DataFrame, theirs: DataFrame, *, least: int = 20) -> DataFrame:
    """Whether closes are adjusted for dividends: whose ratio to ours varies less.

    ``theirs(symbol, date, ref_close, ref_adj_close)``. The coefficient of variation of the smaller
    side decides; confidence is high if the gap is over 5 times the smaller, medium over 1.
    """
    joined = ours.select("symbol", "date", "close").join(theirs, ["symbol", "date"])
    usable = joined.filter(F.col("close").isNotNull() & (F.col("ref_close") > 0) & (F.col("ref_adj_close") > 0))
    a, b = F.col("close") / F.col("ref_close"), F.col("close") / F.col("ref_adj_close")
    cv = lambda x: F.coalesce(F.abs(F.try_divide(F.stddev_samp(x), F.avg(x))), F.lit(float("inf")))
    stats = usable.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_overlap"), cv(a).alias("cv_vs_close"), cv(b).alias("cv_vs_adj_close"))
    few = F.col("n_overlap") < least
    smaller, gap = F.least("cv_vs_close", "cv_vs_adj_close"), F.abs(F.col("cv_vs_close") - F.col("cv_vs_adj_close"))
    verdict = F.when(few, "insufficient_overlap").when(F.col("cv_vs_close") < F.col("cv_vs_adj_close"), "split_only").otherwise("total_return")
    times = F.when(smaller > 0, F.try_divide(gap, smaller))
    confidence = F.when(few, "low").when(times > 5, "high").when(times > 1, "medium").otherwise("low")
    hide = lambda c: F.when(~few, F.col(c)).alias(c)
    return stats.select("symbol", "n_overlap", hide("cv_vs_close"), hide("cv_vs_adj_close"), verdict.alias("verdict"), confidence.alias("confidence"))
