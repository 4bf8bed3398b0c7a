"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A record's key is -ln(u) / quality, with u a uniform number from the hash of its id, text size and
seed, so the smallest keys are a sample without replacement weighted by quality. Each source takes
whole epochs first, then the records with the smallest keys until their prefix-summed sizes reach what
its target still lacks. The record at the edge is taken whole or not, whichever comes nearer, so a source's
taken words differ from its target by at most half of that record's size; with ``parts`` its first words
are taken, as many as the target lacks, so they differ by half a word at most.

The prefix sum of a source is taken in two levels, for one source may hold most rows: keys fall
into buckets in their order, bucket sums are added up in order, and only the bucket in which the
target is reached is sorted. A key's place among the buckets is the mean of its distribution functions
for qualities 4^-6 to 4^6, so records of any quality in that range spread over all buckets.

Targets: sources in code point order, null last, weigh ``weights`` in turn and share ``ratio`` of
all sizes; a target stops at ``limit`` times its source's size, and the excess is shared again by
weight until none is above.

Defined cases: a null or blank text has size 0 and is taken 0 words; a null source is one source;
ties of keys go to the smaller id, then the smaller size; fully repeated rows are told apart only
by order, which changes no sum; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.llm.common import bounded_broadcast, cut

#: White space of a word count, as in the word pattern [^\x20\x09-\x0D]+.
_WORD = r"[^\x20\x09-\x0D]+"
#: Qualities whose distributions of keys place a key among the buckets.
_QUALITIES = tuple(4.0**k for k in range(-6, 7))


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def default_quality(text: Column, size: Column) -> Column:
    """1 for texts with 3 to 12 characters a word, else 1/4: a cheap sign of prose."""
    per_word = F.length(text) / F.greatest(size, F.lit(1))
    return F.when(per_word.between(3, 12), F.lit(1.0)).otherwise(F.lit(0.25))


def uniform(seed: int, *cols: Column) -> Column:
    """A number in (0, 1) from the MD5 of the columns, the same in every engine."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("-")) for c in cols]))
    whole = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double")
    return (whole + F.lit(0.5)) / F.lit(float(2**48))


def first_words(text: Column, words: Column) -> Column:
    """The text up to the end of its first ``words`` words and the white space after them."""
    pieces = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    # White space before the first word is a piece of its own.
    leading = F.regexp_like(text, F.lit(r"^[\x20\x09-\x0D]")).cast("int")
    return F.array_join(F.slice(pieces, 1, words.cast("int") + leading), "")


def place(key: Column) -> Column:
    """A number from 0 to 1 that rises with the key, nowhere denser than 52 times for a quality from 4^-6 to 4^6."""
    return reduce(add, [F.lit(1.0) - F.exp(-key * F.lit(q)) for q in _QUALITIES]) / F.lit(float(len(_QUALITIES)))


def targets(sizes: DataFrame, *, weights: tuple[float, ...] = (3, 1, 2), ratio: float = 1.5, limit: int = 2) -> DataFrame:
    """(source, source_size, target) from one row a source with its source_size.

    With targets min(limit * size, level * weight), the level follows from the order of
    limit * size / weight: those that are full at a level precede those that are not.
    """
    every = F.array(*[F.lit(float(w)) for w in weights])
    order = Window.orderBy(F.col("source").asc_nulls_last())
    full_first = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    before = full_first.rowsBetween(Window.unboundedPreceding, -1)
    onward = full_first.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    ranked = (
        sizes.withColumn("weight", F.get(every, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))))
        .withColumn("most", (F.col("source_size") * limit).cast("double"))
        .withColumn("fills_at", F.col("most") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(ratio))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    )
    # The level holds at the first source, in that order, that it doesn't fill.
    first = Window.orderBy("fills_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    settled = ranked.withColumn("at", F.first(F.when(F.col("level") <= F.col("fills_at"), F.col("level")), ignorenulls=True).over(first))
    return settled.select(
        "source", "source_size", F.when(F.col("at").isNull() | (F.col("fills_at") <= F.col("at")), F.col("most")).otherwise(F.col("at") * F.col("weight")).alias("target")
    )


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: Column | None = None,
    weights: tuple[float, ...] = (3, 1, 2),
    ratio: float = 1.5,
    limit: int = 2,
    seed: int = 17,
    bucket_rows: int = 4096,
    parts: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Every row with size, source_size, target, copies, part and taken = copies * size + part.

    ``part`` is how many of the first words of one more copy are taken: always 0 without ``parts``.
    ``keep`` names input columns to carry along; without them only (doc_id, ...) are read.
    """
    text = F.col(text_col).cast("string")
    size = word_count(text)
    worth = quality if quality is not None else default_quality(text, size)
    u = uniform(seed, F.col(id_col), size)
    keyed = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        size.alias("size"),
        (-F.ln(u) / worth).alias("es_key"),
        *[F.col(c).alias(f"kept_{c}") for c in keep],
    )
    rows = keyed if keep else cut(keyed)
    # As many buckets as hold about bucket_rows records each, so that what is sorted doesn't grow with the table.
    buckets = max(256, (docs if keep else rows).count() // bucket_rows)
    bucket = F.least(F.floor(place(F.col("es_key")) * buckets), F.lit(buckets - 1)).cast("int")
    rows = rows.withColumn("bucket", bucket)
    per_bucket = cut(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")))
    plan = targets(per_bucket.groupBy("source").agg(F.sum("words").alias("source_size")), weights=weights, ratio=ratio, limit=limit)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = cut(plan.withColumn("lack", F.col("target") - F.col("epochs") * F.col("source_size")))
    n_sources = plan.count()

    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = per_bucket.select("source", "bucket", "words", F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("words_before"))
    edge = (
        sums.join(bounded_broadcast(plan.select(F.col("source").alias("s"), "lack"), n_sources), F.col("source").eqNullSafe(F.col("s")))
        .filter((F.col("words_before") < F.col("lack")) & (F.col("words_before") + F.col("words") >= F.col("lack")))
        .select(F.col("source").alias("e_source"), F.col("bucket").alias("edge"), F.col("words_before").alias("edge_before"))
    )
    plan = plan.join(bounded_broadcast(edge, n_sources), F.col("source").eqNullSafe(F.col("e_source")), "left").select(
        F.col("source").alias("p_source"), "source_size", "target", "epochs", "lack", "edge", "edge_before"
    )
    wide = rows.join(bounded_broadcast(plan, n_sources), F.col("source").eqNullSafe(F.col("p_source")))
    # Rows outside the edge bucket are decided by their bucket; only the edge bucket is ordered.
    own = Window.partitionBy("source", "bucket").orderBy("es_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = F.col("bucket") == F.col("edge")
    sorted_edge = wide.filter(at_edge).withColumn("prefix", F.col("edge_before") + F.coalesce(F.sum("size").over(own), F.lit(0)))
    if parts:
        room = F.floor(F.col("lack") - F.col("prefix") + F.lit(0.5)).cast("long")
        whole, part = room >= F.col("size"), F.when((room > 0) & (room < F.col("size")), room).otherwise(F.lit(0))
    else:
        whole, part = F.col("prefix") + F.col("size") / 2 <= F.col("lack"), F.lit(0)
    taken_edge = sorted_edge.withColumn("extra", whole.cast("long")).withColumn("part", part.cast("long")).drop("prefix")
    before_edge = F.coalesce(F.col("bucket") < F.col("edge"), F.lit(False)).cast("long")
    others = wide.filter(~F.coalesce(at_edge, F.lit(False))).withColumn("extra", before_edge).withColumn("part", F.lit(0).cast("long"))
    both = others.unionByName(taken_edge)
    copies = F.least(F.col("epochs") + F.col("extra"), F.lit(limit)).cast("long")
    return both.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (copies * F.col("size") + F.col("part")).alias("taken"),
        copies.alias("copies"),
        "part",
        *[F.col(f"kept_{c}").alias(f"kept_{c}") for c in keep],
    )
