"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import cut


def components(edges: DataFrame, *, rounds: int = 100) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``; the component is its smallest node.

    Alternating star contraction: each node first links its larger neighbours to its smallest
    one, then itself and its smaller neighbours likewise, until nothing changes. A round is two
    partial aggregations and joins; its edges are written to the shared folder. Loops, repeated
    edges and an empty table are allowed; null ends are dropped.
    """
    now = cut(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    )
    state = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written first, so that the join is one that Spark may split where a node has many neighbours.
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low")))
        large = (
            both.join(low.hint("shuffle_hash"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u <> v").distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = (
            large.join(low.hint("shuffle_hash"), "u")
            .select(F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u <> v")
            .distinct()
        )
        now = cut(small)
        # A change of either sum shows a change of the edges; stars alone map to themselves.
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if found == state:
            break
        state = found
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
