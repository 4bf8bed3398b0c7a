"""Sharding by sampled splitters, with DataFrame functions only.

A record's key is the hash of its text, so equal texts are neighbours. Splitters are weighted
quantiles of a size-weighted sample of keys; they cut the keys into ranges. A range with more
rows than a task should hold is subdivided by linear interpolation of the key, and a subdivision
that one key overfills by the hash of the record's row number, for records may repeat in full. Exact sums over the pieces, in order, then
give every record its place in the whole; the shard is the one that the record's middle byte falls
into, so shards differ by about one record. Equal texts that weigh at most ``whole_group`` of a
shard keep together: the middle of the group decides for all of them.

Defined cases: a null text has 16 bytes and the checksum of no bytes; repeated rows are neighbours
and are placed each on its own; ties of key and id fall in any order, which changes no size; a null
id is kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlab.llm.common import bounded_broadcast, cut, shuffle_partitions

#: Sampled ranges for each shard.
RANGES_PER_SHARD = 4
#: Keys sampled for each range, about.
SAMPLES_PER_RANGE = 64
_TWO64 = float(2**64)


def _unit(col) -> F.Column:
    """A signed 64-bit hash as a number from 0 to 1."""
    return (col.cast("double") + F.lit(2.0**63)) / F.lit(_TWO64)


def shard(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = 40,
    overhead: int = 16,
    whole_group: float = 0.1,
    rows_per_piece: int | None = None,
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row; shards of near equal bytes."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = cut(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
            F.xxhash64(F.monotonically_increasing_id()).alias("row"),  # tells rows apart that are equal in all else
        )
    )
    rows, total = base.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not rows:
        return base.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    ranges = shards * RANGES_PER_SHARD
    cap = rows_per_piece or max(64, rows // (4 * shuffle_partitions(spark)))

    # A record is drawn with a chance in proportion to its size, and those sure to be drawn weigh what they hold.
    share = F.lit(float(SAMPLES_PER_RANGE * ranges)) * F.col("size") / F.lit(float(total))
    drawn = base.filter(_unit(F.xxhash64(F.lit(1), "row")) < share).select(
        "key", F.ceil(F.greatest(share, F.lit(1.0))).cast("long").alias("weight")
    )
    points = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    found = drawn.agg(F.percentile("key", points, F.col("weight"))).first()[0] or []
    # At most ranges - 1 numbers; one that repeats belongs to a key that fills several ranges.
    cuts = sorted({max(-(2**63) + 1, min(2**63 - 1, int(c))) for c in found})

    lows, highs = [-(2**63), *cuts], [*cuts, 2**63 - 1]
    cuts_col = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<long>")
    ranged = base.withColumn("range", F.size(F.filter(cuts_col, lambda c: c <= F.col("key"))))
    per_range = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))  # at most `ranges` rows
    low, high = (F.get(F.array(*[F.lit(float(x)) for x in xs]), F.col("range")) for xs in (lows, highs))
    plan = per_range.select("range", low.alias("low"), high.alias("high"), F.ceil(F.col("n") / F.lit(cap)).cast("int").alias("cuts"))
    inside = F.floor((F.col("key").cast("double") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1.0)) * F.col("cuts"))
    fine = ranged.join(bounded_broadcast(plan, ranges), "range").select(
        "doc_id", "size", "text_crc32", "key", "row", "range", F.least(F.greatest(inside, F.lit(0)), F.col("cuts") - 1).cast("int").alias("sub")
    )
    per_fine = fine.groupBy("range", "sub").agg(F.count(F.lit(1)).alias("n"))
    salts = per_fine.select("range", "sub", F.ceil(F.col("n") / F.lit(2 * cap)).cast("int").alias("salts")).filter("salts > 1")
    n_fine = rows // cap + ranges + 1
    pieces = (
        fine.join(bounded_broadcast(salts, n_fine), ["range", "sub"], "left")
        .withColumn("salt", F.when(F.col("salts") > 1, F.pmod(F.col("row"), F.col("salts"))).otherwise(F.lit(0)).cast("int"))
        .drop("salts")
    )
    pieces = pieces.drop("row")
    piece = ["range", "sub", "salt"]
    sums = pieces.groupBy(*piece).agg(F.sum("size").alias("bytes"))
    in_order = Window.orderBy(*piece).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*piece, F.coalesce(F.sum("bytes").over(in_order), F.lit(0)).alias("piece_start"))
    running = Window.partitionBy(*piece).orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*piece, "key")
    middle = F.when(
        F.col("group_size") <= F.lit(whole_group * total / shards), F.col("group_before") * 2 + F.col("group_size")
    ).otherwise(F.col("before") * 2 + F.col("size"))
    placed = (
        pieces.withColumn("before", F.coalesce(F.sum("size").over(running), F.lit(0)))
        .withColumn("group_size", F.sum("size").over(group))
        .withColumn("group_before", F.min("before").over(group))
        .join(bounded_broadcast(starts, 2 * n_fine), piece)
        .withColumn("shard", F.least(F.floor((F.col("piece_start") * 2 + middle) * F.lit(shards) / F.lit(2 * total)), F.lit(shards - 1)).cast("int"))
        .select("doc_id", "size", "text_crc32", "shard", *piece, "before", "key")
    )
    placed = cut(placed)
    parts = placed.groupBy(*piece, "shard").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy(*piece).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*piece, "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_slot"))
    number = Window.partitionBy(*piece, "shard").orderBy("before", "key", "doc_id")
    return (
        placed.withColumn("number", F.row_number().over(number))
        .join(bounded_broadcast(offsets, 2 * n_fine + shards), [*piece, "shard"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("first_slot") + F.col("number") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
