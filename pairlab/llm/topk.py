"""Exact top-k by integer inner product with a three-phase uniform threshold.

The dimensions are dealt to ``nodes``; a node's score of a pair is its part of the inner product.
First, each node of one block of candidates in FIRST gives the k entries that it scores highest; their
whole scores are gathered, and the k-th best of a query is its cutoff: k rows reach it, so none of the best
is below it, whichever blocks gave it. Second, the cutoff goes back to all blocks, and each node collects the entries that it scores
at least cutoff / nodes; a pair that no node collects is below the cutoff. Third, the collected
entries' remaining parts are added and those not below the cutoff compete, at most k a block.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part;
only vectors of one dimension are compared; ties go to the smaller id; repeated rows compete each
on its own, but a row with the query's id never does; query rows with one id are one query, for which a
candidate competes with its score for each of them; fewer candidates than k give fewer rows; an
empty table gives none; other columns are not read. Scores past a long raise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.llm.common import cut
from pairlab.llm.vectors import against, finite, matrix, packed, query_blocks

_FOUND = "q_block long, query_id long, vec_id long, score long"
_CHUNK = 128
#: One block of so many, of each partition and dimension, sets the cutoffs.
FIRST = 8


def _whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x); as Python integers where doubles could not hold their inner products."""
    out = np.floor(x * scale)
    most = float(np.abs(out).max(initial=0.0))
    return out if most * most * max(1, out.shape[1]) < 2**52 else np.array([[int(v) for v in row] for row in out], object)


def _parts(q: np.ndarray, c: np.ndarray, nodes: int) -> list[np.ndarray]:
    cuts = np.array_split(np.arange(q.shape[1]), min(nodes, q.shape[1]))
    if q.dtype != c.dtype:
        q, c = q.astype(object), c.astype(object)
    return [q[:, d] @ c[:, d].T for d in cuts]


def _best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row: by score, then by smaller id."""
    order = np.lexsort((ids, -scores, rows))
    r = rows[order]
    first = np.r_[True, r[1:] != r[:-1]]
    since = np.arange(len(r)) - np.maximum.accumulate(np.where(first, np.arange(len(r)), 0))
    return order[since < k]


def _emit(block: int, q_ids, c_ids, scores):
    whole = np.array([int(s) for s in scores], np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(whole), block, np.int64)), pa.array(q_ids), pa.array(c_ids), pa.array(whole)], names=["q_block", "query_id", "vec_id", "score"])


def _search(batches, k: int, nodes: int, scale: int, with_cutoff: bool):
    for b in batches:
        for row in b.to_pylist():
            q_ids, q = matrix(row["q_ids"], row["q_data"], row["dim"])
            c_ids, c = matrix(row["ids"], row["data"], row["dim"])
            q, c = _whole(q, scale), _whole(c, scale)
            cutoffs = {x["query_id"]: x["cutoff"] for x in row["q_cutoffs"] or []} if with_cutoff else {}
            for at in range(0, len(q), _CHUNK):
                own = q_ids[at : at + _CHUNK]
                parts = _parts(q[at : at + _CHUNK], c, nodes)
                other = own[:, None] != c_ids[None, :]
                if with_cutoff:
                    limit = np.array([cutoffs.get(i, -np.inf) for i in own.tolist()], float)[:, None]
                    wanted = np.zeros(other.shape, bool)
                    for p in parts:
                        wanted |= p >= limit / len(parts)
                else:
                    wanted = np.zeros(other.shape, bool)
                    for p in parts:
                        seen = np.where(other, p, -np.inf) if p.dtype != object else np.where(other, p.astype(float), -np.inf)
                        n = min(k, seen.shape[1])
                        top = np.argpartition(seen, seen.shape[1] - n, axis=1)[:, seen.shape[1] - n :]
                        np.put_along_axis(wanted, top, True, axis=1)
                r, j = np.nonzero(wanted & other)
                score = sum(p[r, j] for p in parts)
                if with_cutoff:
                    keep = score >= limit[r, 0]
                    r, j, score = r[keep], j[keep], score[keep]
                if len(r):
                    best = _best(r, score, c_ids[j], k)
                    yield _emit(row["q_block"], own[r[best]], c_ids[j[best]], score[best])


def top_k(
    rows: DataFrame, is_query: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, scale: int = 256, nodes: int = 4, query_rows: int = 2048, block_rows: int = 8192
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best other rows of each query."""
    kind = "array<double>"
    valid = rows.filter(finite(F.col(vec_col))).filter(F.col(id_col).isNotNull())
    pair = [F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("vec")]
    queries, n_blocks = query_blocks(valid.filter(is_query).select(*pair), query_rows)
    # The lowest 24 bits of a block's number count within its partition.
    blocks = cut(packed(valid.select(*pair), block_rows).select("dim", "ids", "data", F.col("block").bitwiseAND(F.lit((1 << 24) - 1)).alias("number")))

    some = blocks.filter(F.col("number") % FIRST == 0).drop("number")
    blocks = blocks.drop("number")
    gathered = against(queries, some, n_blocks).mapInArrow(lambda it: _search(it, k, nodes, scale, False), _FOUND)
    best_first = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    kth = (
        gathered.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)
        .groupBy("q_block", "query_id").agg(F.min("score").alias("cutoff"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") == k)
    )
    # A block's cutoffs are as many as its queries, about query_rows.
    cutoffs = kth.groupBy("q_block").agg(F.collect_list(F.struct("query_id", "cutoff")).alias("cutoffs"))
    told = cut(queries.join(cutoffs, queries.block == cutoffs.q_block, "left").drop("q_block"))
    resolved = against(told, blocks, n_blocks).mapInArrow(lambda it: _search(it, k, nodes, scale, True), _FOUND)
    return (
        resolved.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
