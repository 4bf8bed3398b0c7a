"""Approximate nearest neighbours by robust-pruned directed graphs, one a shard.

Equal vectors are one node, which keeps its smallest ids and how many rows each has. Vectors get one more component that makes
all norms of a shard equal, so that the largest inner product is the smallest distance. A graph
grows in batches: a greedy search from the medoid proposes neighbours, relaxed distance pruning
(drop a candidate that is ``alpha`` times nearer to a kept neighbour than to the node) keeps
diverse edges, and edges back are pruned likewise once a node has too many. Every shard is then
searched by a beam for every query, and the shards' answers are merged. Scores are computed anew in
double precision.

Defined cases: vectors that are null, empty, all zero or hold a null or non-finite component take no
part; only vectors of one dimension are compared; ties go to the smaller id; repeated rows are
candidates each on its own, but a row with the query's id never is; of query rows that share an id,
the one with the smallest vector is the query, so repeated query rows are one; fewer candidates than k give
fewer rows; an empty table gives none; other columns are not read. An index answers up to ``members`` - 1
neighbours; a larger k raises.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.llm.common import cut, written
from pairlab.llm.vectors import against, finite, matrix, query_blocks

INDEX = "dim int, shard int, kept int, members binary, times binary, data binary, edges binary, entry int"
#: Shards at least, if each has this many rows, and rows of a shard at most, about: the size at which recall was measured.
SHARDS, LEAST_ROWS, SHARD_ROWS = 6, 1000, 10_000
#: Rows that search together, and nodes whose edges each follows in a step.
_BATCH, EXPAND = 256, 4


def beam_search(x: np.ndarray, edges: np.ndarray, entry: int, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, squared distances) of a beam for each row of q, nearest first; -1 where there is none.

    All queries step together; a step follows the edges of the EXPAND nearest nodes of each beam that it has not followed.
    """
    n, m = len(x), len(q)
    norms = np.einsum("ij,ij->i", x, x)
    beam = np.full((m, width), -1, np.int32)
    far = np.full((m, width), np.inf, np.float32)
    done = np.ones((m, width), bool)
    beam[:, 0], done[:, 0] = entry, False
    far[:, 0] = norms[entry] - 2 * (q @ x[entry])
    seen = np.full((m, n), -1, np.int32)
    seen[:, entry] = 0
    live = np.arange(m)
    wide = min(EXPAND, width)
    while True:
        open_far = np.where(done[live], np.float32(np.inf), far[live])
        if wide < width:
            at = np.argpartition(open_far, wide - 1, axis=1)[:, :wide]
        else:
            at = np.broadcast_to(np.arange(width), (len(live), width))
        some = np.isfinite(np.take_along_axis(open_far, at, axis=1))
        has = some.any(axis=1)
        live, at, some = live[has], at[has], some[has]
        if not len(live):
            break
        r, c = np.nonzero(some)
        done[live[r], at[r, c]] = True
        nbrs = np.where(some[:, :, None], edges[np.take_along_axis(beam[live], at, axis=1)], -1).reshape(len(live), -1)
        rows, cols = np.nonzero(nbrs >= 0)
        to = nbrs[rows, cols]
        new = seen[live[rows], to] < 0
        rows, cols, to = rows[new], cols[new], to[new]
        place = np.arange(len(to), dtype=np.int32)
        seen[live[rows], to] = place
        once = seen[live[rows], to] == place  # a node that two edges of a step reach counts once
        rows, cols, to = rows[once], cols[once], to[once]
        d = np.full(nbrs.shape, np.inf, np.float32)
        d[rows, cols] = norms[to] - 2 * np.einsum("ij,ij->i", x[to], q[live[rows]])
        all_d = np.concatenate([far[live], d], axis=1)
        top = np.argpartition(all_d, width - 1, axis=1)[:, :width]
        far[live] = np.take_along_axis(all_d, top, axis=1)
        beam[live] = np.take_along_axis(np.concatenate([beam[live], nbrs], axis=1), top, axis=1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~np.isfinite(d)], axis=1), top, axis=1)
    order = np.argsort(far, axis=1, kind="stable")
    beam, far = np.take_along_axis(beam, order, axis=1), np.take_along_axis(far, order, axis=1)
    return np.where(np.isfinite(far), beam, -1), far + np.einsum("ij,ij->i", q, q)[:, None]


def prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` diverse neighbours of each node out of its row of candidates (-1: none)."""
    out = np.full((len(nodes), degree), -1, np.int32)
    for at in range(0, len(nodes), _BATCH):
        p, c = nodes[at : at + _BATCH], candidates[at : at + _BATCH]
        alive = (c >= 0) & (c != p[:, None])
        v = x[c]
        d = np.where(alive, np.square(v - x[p][:, None, :]).sum(axis=2), np.inf)
        sq = np.einsum("ijk,ijk->ij", v, v)
        rows = np.arange(len(p))
        for k in range(degree):
            best = d.argmin(axis=1)
            ok = np.isfinite(d[rows, best])
            if not ok.any():
                break
            out[at + rows[ok], k] = c[rows[ok], best[ok]]
            picked = v[rows, best]
            between = sq + sq[rows, best][:, None] - 2 * np.einsum("ijk,ik->ij", v, picked)
            d[(alpha * alpha * between <= d) & ok[:, None]] = np.inf
            d[rows[ok], best[ok]] = np.inf
    return out


def build_graph(x: np.ndarray, *, degree: int = 28, width: int = 56, alpha: float = 1.2, seed: int = 5) -> tuple[np.ndarray, int]:
    """(edges, entry) over the rows of x, which differ from each other."""
    n = len(x)
    entry = int(np.square(x - x.mean(axis=0)).sum(axis=1).argmin())
    slack = degree + degree // 2
    edges = np.full((n, slack), -1, np.int32)
    count = np.zeros(n, np.int32)
    order = np.random.default_rng(seed).permutation(n)
    order = np.r_[entry, order[order != entry]].astype(np.int32)
    done, step = 1, 1
    while done < n:
        step = min(_BATCH, max(1, done), n - done)  # a batch is no larger than what it is searched in
        new = order[done : done + step]
        found, _ = beam_search(x, edges, entry, x[new], min(width, max(2, done)))
        kept = prune(x, new, found, degree, alpha)
        edges[new, :degree] = kept
        count[new] = (kept >= 0).sum(axis=1)
        rows, cols = np.nonzero(kept >= 0)
        to, of = kept[rows, cols], new[rows]
        by = np.argsort(to, kind="stable")
        to, of = to[by], of[by]
        nth = np.arange(len(to)) - np.searchsorted(to, to)
        room = count[to] + nth < slack
        edges[to[room], count[to[room]] + nth[room]] = of[room]
        np.add.at(count, to[room], 1)
        # Nodes without room for all of theirs are pruned, together, from what they have and what is left.
        over, place = np.unique(to[~room], return_inverse=True)
        if len(over):
            rest = nth[~room] - np.minimum.reduceat(nth[~room], np.flatnonzero(np.r_[True, place[1:] != place[:-1]]))[place]
            pool = np.full((len(over), slack + int(rest.max()) + 1), -1, np.int32)
            pool[:, :slack] = edges[over]
            pool[place, slack + rest] = of[~room]
            fewer = prune(x, over, pool, degree, alpha)
            edges[over] = -1
            edges[over, :degree] = fewer
            count[over] = (fewer >= 0).sum(axis=1)
        done += step
    return edges, entry


def _classes(valid: DataFrame, members: int) -> DataFrame:
    """One row for each distinct vector, with its smallest different ids and their rows' number.

    Ids are thinned in three steps, so that no task holds all of a common vector's.
    """
    key = ["h1", "h2"]
    hashed = valid.select("id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"))
    ids = hashed.groupBy(*key, "id").agg(F.count(F.lit(1)).alias("n")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    for left in (64, 8, 1):
        ids = ids.withColumn("salt", F.col("salt") % left)
        order = Window.partitionBy(*key, "salt").orderBy("id")
        ids = ids.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= members).drop("k")
    few = ids.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("own")).select(*key, F.col("own.id").alias("ids"), F.col("own.n").alias("times"))
    return hashed.groupBy(*key).agg(F.first("vec").alias("vec")).join(few, key)


def build_index(rows: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", members: int = 21, degree: int = 28, width: int = 56, alpha: float = 1.2) -> DataFrame:
    """The index table: one row a shard, with its vectors, members and graph."""
    valid = usable(rows, id_col, vec_col)
    classes = cut(_classes(valid, members).withColumn("dim", F.size("vec")))
    n = classes.count()
    shards = max(-(-n // SHARD_ROWS), min(SHARDS, max(1, n // LEAST_ROWS)))

    def build(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["h1", "h2"], kind="stable")
        x = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
        norms = np.square(x).sum(axis=1)
        level = np.sqrt(np.maximum(norms.max() - norms, 0.0))
        edges, entry = build_graph(np.c_[x, level].astype(np.float32), degree=degree, width=width, alpha=alpha)
        ids = np.full((len(x), members), -1, np.int64)
        times = np.zeros((len(x), members), np.int64)
        for i, (own, n) in enumerate(zip(pdf["ids"], pdf["times"])):
            ids[i, : len(own)], times[i, : len(own)] = own, np.minimum(n, members)
        return pd.DataFrame({"dim": [x.shape[1]], "shard": [int(pdf["shard"].iloc[0])], "kept": [members], "members": [ids.tobytes()], "times": [times.tobytes()], "data": [x.tobytes()], "edges": [edges.tobytes()], "entry": [entry]})

    sharded = classes.withColumn("shard", F.pmod(F.xxhash64("h2", "h1"), F.lit(shards)).cast("int"))
    # A task a shard: shards are small in bytes and long in work.
    sharded = sharded.repartitionByRange(shards, "dim", "shard")
    return written(sharded.groupBy("dim", "shard").applyInPandas(build, INDEX), "ann-index")


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows that take part, in doubles."""
    some = F.exists(F.col(vec_col), lambda x: x != 0)
    return rows.filter(F.col(id_col).isNotNull() & finite(F.col(vec_col)) & some).select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")
    )


def search(index: DataFrame, rows: DataFrame, is_query: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, width: int = 50, query_rows: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score) of about the k best other rows of each query.

    Shards hold random parts of the rows, so that a shard's beam needs ``width`` and its share of what k asks for.
    """
    n, kept = index.agg(F.count(F.lit(1)), F.min("kept")).first()  # a row a shard
    if kept is not None and k >= kept:
        raise ValueError(f"the index keeps {kept} ids of equal vectors; build it with members of {k + 1} or more")
    shards = max(1, n)
    width = width + -(-4 * k // shards)
    stated = usable(rows.filter(is_query), id_col, vec_col).groupBy("id").agg(F.min("vec").alias("vec"))
    queries, n_blocks = query_blocks(stated, query_rows)
    pairs = against(queries, index, n_blocks)

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                dim = row["dim"]
                q_ids, q = matrix(row["q_ids"], row["q_data"], dim)
                x = np.frombuffer(row["data"], np.float64).reshape(-1, dim)
                ids, n_rows = (np.frombuffer(row[c], np.int64).reshape(len(x), -1) for c in ("members", "times"))
                edges = np.frombuffer(row["edges"], np.int32).reshape(len(x), -1)
                norms = np.square(x).sum(axis=1)
                flat = np.c_[x, np.sqrt(np.maximum(norms.max() - norms, 0.0))].astype(np.float32)
                for at in range(0, len(q), _BATCH):
                    part = q[at : at + _BATCH]
                    unit = part / np.sqrt(np.square(part).sum(axis=1, keepdims=True))
                    nodes, _ = beam_search(flat, edges, row["entry"], np.c_[unit, np.zeros(len(part))].astype(np.float32), width)
                    r, j = np.nonzero(nodes >= 0)
                    node = nodes[r, j]
                    score = np.einsum("ij,ij->i", x[node], part[r])
                    # A row for each of a node's ids, as often as it has rows.
                    place = np.repeat(np.arange(len(node)), n_rows[node].sum(axis=1))
                    vec = np.repeat(ids[node].ravel(), n_rows[node].ravel())
                    r, score = r[place], score[place]
                    other = vec != q_ids[at + r]
                    r, score, vec = r[other], score[other], vec[other]
                    order = np.lexsort((vec, -score, r))
                    s = r[order]
                    first = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
                    since = np.arange(len(s)) - np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
                    best = order[since < k]
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[at + r[best]]), pa.array(vec[best]), pa.array(score[best])], names=["query_id", "vec_id", "score"])

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = pairs.mapInArrow(run, "query_id long, vec_id long, score double")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
