"""Windows over long groups that are cut into blocks with tasks of their own.

A block is a run of a group's rows; its number rises with the order of the rows. What a row needs of earlier blocks comes from
rows that are copied to the next block or from sums of blocks, so that no task holds a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of a long group.
BLOCK_ROWS = 20_000


def block_of(place: str, block_rows: int = BLOCK_ROWS) -> Column:
    """The block of a row by its place, which counts a group's rows without gaps."""
    return F.floor(F.col(place) / block_rows)


def with_rows_before(rows: DataFrame, place: str, before: int, *, block: str = "block__", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows with ``block``; the last ``before`` rows of a block come in the next one too, where block_of is not their block."""
    if block_rows < before:
        raise ValueError("a block must hold the rows before the next one")
    own = block_of(place, block_rows)
    late = F.pmod(F.col(place), F.lit(block_rows)) >= block_rows - before
    return rows.withColumn(block, F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))


def running_sums(rows: DataFrame, keys: list[str], order: str, block: str, sums: dict[str, str]) -> DataFrame:
    """rows with a column for each name of ``sums``, the sum of its value over the group's rows so far; rows are read twice."""
    inside = Window.partitionBy(*keys, block).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, block).agg(*[F.sum(v).alias(f"total__{n}") for n, v in sums.items()])
    carried = totals.select(*keys, block, *[F.coalesce(F.sum(f"total__{n}").over(earlier), F.lit(0.0)).alias(f"carry__{n}") for n in sums])
    own = rows.withColumns({n: F.sum(v).over(inside) for n, v in sums.items()})
    return own.join(carried, [*keys, block]).withColumns({n: F.col(f"carry__{n}") + F.col(n) for n in sums}).drop(*[f"carry__{n}" for n in sums])


def numbered(rows: DataFrame, keys: list[str], order: list[str], bin_: str, number: str, keep) -> DataFrame:
    """rows with ``number``, counted from 1 along ``order`` in each group; ``bin_`` rises with the first column of the order.

    Rows are numbered inside their bins and moved on by the counts of earlier ones. ``keep`` computes a table once.
    """
    inside = keep(rows.withColumn("inside__", F.row_number().over(Window.partitionBy(*keys, bin_).orderBy(*order))))
    earlier = Window.partitionBy(*keys).orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)
    counts = inside.groupBy(*keys, bin_).agg(F.max("inside__").alias("rows__"))
    moved = counts.select(*keys, bin_, F.coalesce(F.sum("rows__").over(earlier), F.lit(0)).alias("before__"))
    return inside.join(F.broadcast(moved), [*keys, bin_]).withColumn(number, F.col("before__") + F.col("inside__")).drop("inside__", "before__", bin_)


def arrays(rows: DataFrame, keys: list[str], place: str, value: str, *, before: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(keys, block, begin, n_before, values), a row a block: its values in order of place, after the last n_before values, ``before`` at most, of the block before it.

    ``begin`` is the place of the block's first own row.
    """
    cut = with_rows_before(rows.select(*keys, place, value), place, before, block="block", block_rows=block_rows)
    own = F.when(block_of(place, block_rows) == F.col("block"), F.col(place))
    per = cut.groupBy(*keys, "block").agg(F.min(own).alias("begin"), F.count_if(own.isNull()).cast("int").alias("n_before"), F.sort_array(F.collect_list(F.struct(place, value))).alias("rows__"))
    return per.filter("begin IS NOT NULL").select(*keys, "block", "begin", "n_before", F.col(f"rows__.{value}").alias("values"))
