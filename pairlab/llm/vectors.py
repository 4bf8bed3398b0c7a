"""Vectors in packed blocks: many rows of a table as one row that holds a matrix."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import cut

#: Bytes of packed queries that may be broadcast.
QUERY_BYTES = 32_000_000
BLOCK = "block long, dim int, ids binary, data binary"


def finite(vec: Column) -> Column:
    """Whether a vector is not null or empty and all its components are finite numbers."""
    whole = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vec.isNotNull() & (F.size(vec) > 0) & F.coalesce(whole, F.lit(False))


def packed(rows: DataFrame, block_rows: int, *, numbered: bool = False) -> DataFrame:
    """Blocks of at most ``block_rows`` rows of (id, vec), each of one dimension, without a shuffle.

    With ``numbered``, a partition makes one block for each dimension, and its number is the partition's.
    """

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        held: dict[int, tuple[list, list]] = {}

        def block(dim):
            nonlocal number
            ids, vecs = held.pop(dim)
            key = part if numbered else part << 24 | number
            number += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([key], pa.int64()), pa.array([dim], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([np.concatenate(vecs).tobytes()], pa.binary())],
                names=["block", "dim", "ids", "data"],
            )

        for b in batches:
            ids = b.column(0).to_pylist()
            lists = b.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            sizes = np.diff(lists.offsets.to_numpy())
            start = 0
            for key, n in zip(ids, sizes.tolist()):
                own = held.setdefault(n, ([], []))
                own[0].append(key)
                own[1].append(flat[start : start + n])
                start += n
                if not numbered and len(own[0]) >= block_rows:
                    yield block(n)
        for dim in list(held):
            yield block(dim)

    return rows.mapInArrow(run, BLOCK)


def matrix(ids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(data, np.float64).reshape(-1, dim)


def against(queries: DataFrame, blocks: DataFrame, n_query_blocks: int) -> DataFrame:
    """Each block of the stated queries (its columns named q_*) beside each row of ``blocks`` of its dimension.

    Query blocks are broadcast, as many at a time as are within QUERY_BYTES as measured; the blocks are read once for each such part.
    """
    q = queries.select("dim", *[F.col(c).alias("q_" + c.removeprefix("q_")) for c in queries.columns if c != "dim"])
    largest = q.groupBy("q_block").agg(F.sum(F.octet_length("q_data") + F.octet_length("q_ids")).alias("n")).agg(F.max("n")).first()[0] or 1
    step = max(1, QUERY_BYTES // largest)
    parts = []
    for lo in range(0, n_query_blocks, step):
        hi = min(lo + step, n_query_blocks) - 1
        every = F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(hi).cast("long"))).alias("q_block")
        parts.append(blocks.select(every, "*").join(F.broadcast(q.filter(F.col("q_block").between(lo, hi))), ["q_block", "dim"]))
    return reduce(DataFrame.unionByName, parts)


def query_blocks(rows: DataFrame, per_block: int) -> tuple[DataFrame, int]:
    """The stated queries in numbered blocks of about ``per_block`` rows, and how many numbers there are."""
    n = max(1, -(-rows.count() // per_block))
    return cut(packed(rows.repartition(n), per_block, numbered=True)), n
