"""Symbols' closes as arrays, in which the windows of neighbouring folds are cut.

Folds overlap, so a row a fold, pair and day is many times the bars. Here the closes of a run of folds, a chunk, meet once in
one row, and every fold's window is a slice of it; what is asked of the pairs of a chunk comes in units with tasks of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlab.checkpoints import materialized
from pairlab.operators.calendars import within

#: Folds of a chunk at most; with few folds a chunk is one, so that they keep all tasks busy.
CHUNK_FOLDS = 16
#: Pairs of folds that a unit asks for at most.
UNIT_PAIRS = 500


def _partitions(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_chunks(folds: DataFrame, start: str) -> tuple[DataFrame, bool]:
    """(folds with chunk, whether there are as many chunks as partitions); neighbours by ``start`` share a chunk. A row a fold."""
    held = materialized(folds.withColumn("i__", F.row_number().over(Window.orderBy(start, "fold_id")) - 1))
    n, parts = held.count(), _partitions(folds)
    size = max(1, min(CHUNK_FOLDS, n // (2 * parts)))
    return held.withColumn("chunk", F.floor(F.col("i__") / size)).drop("i__"), n // size >= parts


def legs(daily: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk, legs): the days and closes of every symbol of daily from lo to hi of ``chunks(chunk, lo, hi)``, a row a chunk; days are numbers of unix_date."""
    ends = chunks.groupBy("chunk").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    rows = within(daily.select("symbol", "date", F.col("close").cast("double").alias("close")), ends, "lo", "hi")
    # Rows are dealt by symbol first, so that no task sorts all bars of a chunk.
    per = rows.groupBy("chunk", "symbol").agg(F.sort_array(F.collect_list(F.struct(F.unix_date("date").alias("day"), "close"))).alias("r"))
    per = per.select("chunk", F.struct("symbol", F.col("r.day").alias("days"), F.col("r.close").alias("closes")).alias("leg"))
    return materialized(per.repartition(_partitions(daily), "chunk").groupBy("chunk").agg(F.collect_list("leg").alias("legs")))


def units(met: DataFrame, asked: DataFrame, pair: tuple[str, str], order: list[str], many: bool) -> DataFrame:
    """(chunk, part, asked, legs): at most UNIT_PAIRS rows of ``asked(chunk, ...)`` as an array, and the legs that they name in the columns ``pair``.

    ``many`` chunks keep all tasks busy; the units of few are dealt out.
    """
    number = F.row_number().over(Window.partitionBy("chunk").orderBy(*order)) - 1
    rows = asked.withColumn("part", F.floor(number / UNIT_PAIRS))
    own = F.struct(*[c for c in asked.columns if c != "chunk"])
    names = F.array_union(F.collect_set(pair[0]), F.collect_set(pair[1]))
    found = rows.groupBy("chunk", "part").agg(F.collect_list(own).alias("asked"), names.alias("names")).join(met, "chunk")
    found = found.select("chunk", "part", "asked", F.filter("legs", lambda leg: F.array_contains("names", leg["symbol"])).alias("legs"))
    return found if many else found.repartition(_partitions(met), "chunk", "part")


def series(found: pa.ListScalar) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Days and closes by symbol; a null close is NaN."""
    own = found.values
    days, closes = own.field("days"), own.field("closes")
    return {s: (days[i].values.to_numpy(), closes[i].values.to_numpy(zero_copy_only=False).astype(float)) for i, s in enumerate(own.field("symbol").to_pylist())}


def cut(leg: tuple[np.ndarray, np.ndarray], lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """The days and values from lo to hi, ends included."""
    i, j = np.searchsorted(leg[0], lo), np.searchsorted(leg[0], hi, "right")
    return leg[0][i:j], leg[1][i:j]


def aligned(y: tuple[np.ndarray, np.ndarray], x: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(days, y, x) on the days that both have."""
    if len(y[0]) == len(x[0]) and (y[0] == x[0]).all():
        return y[0], y[1], x[1]
    days, i, j = np.intersect1d(y[0], x[0], assume_unique=True, return_indices=True)
    return days, y[1][i], x[1][j]
