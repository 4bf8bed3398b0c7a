"""Substring deduplication: passages that repeat across documents.

Two kinds of paragraphs of a text take part, so that both paragraphs that were edited and passages in
the middle of others are found:

* **Lines.** Every line of at least ``least`` words is a paragraph with a MinHash signature of
  bands * rows permutations over its 5-word shingles; ``tuned`` chooses the number of bands so that two
  paragraphs at the wanted similarity collide in one with a chance of ``recall``. Equal paragraphs are one
  class. Colliding classes form pairs with their band's leader, the class of most documents, and with
  their neighbours in the order of the next band (SIDE of them, in salted runs); pairs are verified by the
  exact Jaccard similarity of their shingle sets. Of what these links leave apart in a band, all pairs that
  can be similar by the first of their shingles, rare ones first, are then compared likewise, so the components
  are those of all colliding pairs.
* **Runs.** Overlapping runs of words, set by content alone: the shingle with the smallest hash among
  every ``window`` successive shingles is the MinHash of those shingles, and the paragraph is the fixed
  run of words around it. Any ``window`` successive shingles with their runs inside a passage have
  their MinHash in every text that holds it, so each exact passage of ``window`` + 14 words (25) or
  more has a common run, by the one band alone. Colliding runs have the same shingle at the same place,
  and of the n shingles of a run two must share all but the first or all but the last to reach
  ``similarity`` (n - 1 of n + 1), so equality of the run without its first and without its last word is
  their exact Jaccard test, without pairs.

Links of both kinds make components; each component's smallest document id keeps the passage, and in
the others covered words are joined to spans. At both ends of what runs cover, the runs within a window
of the end are extended word by word against the kept passage, as far as the words are the same. Spans
shorter than ``min_words`` stay.

Defined cases: null and blank texts, and texts shorter than a paragraph, give no span; repeats
inside one document are no repeats across documents; repeated rows are one document; of rows with one
id and different texts, the text with the smallest hash takes part and the others are left as they
are; a null id is left out; ties go to the smaller id; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import re
import zlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlab.llm.common import bounded_broadcast, cut, discard, forget, text_slices, written
from pairlab.llm.graph import components

SHINGLE = 5
#: Hashes that are permuted at a time; a bound of memory.
_AT_ONCE = 500_000
#: Words of a paragraph before its MinHash shingle and after that shingle's first word.
BEFORE, AFTER = 5, 10
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Words that are compared from a MinHash shingle outwards, its own among them; over 10 + window.
REACH = 32
#: Neighbours that a class of lines is compared with in each band, and classes of a salted run, about.
SIDE, RUN = 2, 500
#: A run has no n; of a line band_key is the hash of its words.
_PLACES = "doc_id long, place int, band_key long, head int, tail int, n int, bands array<long>"


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_POWERS = np.array([pow(0x5851F42D4C957F2D, i, 1 << 64) for i in range(64)], np.uint64)


def _run_hash(h: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each place."""
    return _mix((h[at[:, None] + np.arange(length)] * _POWERS[:length]).sum(axis=1, dtype=np.uint64))


def tuned(similarity: float, recall: float, rows: int = 2) -> int:
    """Bands of ``rows`` MinHashes with which a pair of this similarity collides with a chance of ``recall`` or more."""
    bands = 1
    while 1 - (1 - similarity**rows) ** bands < recall:
        bands += 1
    return bands


def hashed(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, hash of each shingle, words of each line) of a text."""
    words, counts = [], []
    for line in text.encode().lower().split(b"\n"):
        own = line.split()
        words += own
        counts.append(len(own))
    n = len(words)
    h = _mix(np.fromiter(map(zlib.crc32, words), np.uint64, n) + np.uint64(1))
    shingles = np.zeros(max(0, n - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        shingles += h[k : k + len(shingles)] * _POWERS[k + 1]
    return h, shingles, np.array(counts)


def runs(h: np.ndarray, shingles: np.ndarray, window: int, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first word in it, MinHash, hash without the last word, hash without the first word) of the runs of texts that begin at ``bounds``, the last of which is the end."""
    size, n = BEFORE + AFTER, np.diff(bounds)
    of = np.repeat(np.arange(len(n)), n)
    order = _mix(shingles + _POWERS[20])
    parts = []
    # A text of fewer shingles than the window has one window of them all.
    for w in np.unique(np.minimum(window, n[n >= size] - SHINGLE + 1)).tolist():
        i = np.arange(len(order) - w + 1)
        i = i[(of[i] == of[i + w + SHINGLE - 2]) & ((n >= size) & (np.minimum(window, n - SHINGLE + 1) == w))[of[i]]]
        least = np.lib.stride_tricks.sliding_window_view(order, w)[i].argmin(axis=1) + i
        parts.append(least[np.r_[True, least[1:] != least[:-1]]])
    at = np.sort(np.concatenate([np.zeros(0, np.int64), *parts]))
    text = of[at]
    inside = (at - BEFORE >= bounds[text]) & (at + AFTER <= bounds[text + 1])
    at, text = at[inside], text[inside]
    first, key = at - BEFORE, order[at]
    head, tail = _run_hash(h, first, size - 1), _run_hash(h, first + 1, size - 1)
    # Of equal runs at successive places (one word over and over) the last and as many as cover the rest stay.
    again = np.r_[False, (np.diff(first) == 1) & (key[1:] == key[:-1]) & (head[1:] == head[:-1]) & (tail[1:] == tail[:-1])][: len(first)]
    first = first - bounds[text]
    stay = ~again | np.r_[~again[1:], True][: len(first)] | (first % size == 0)
    return text[stay], first[stay], key[stay], head[stay], tail[stay]


def lines(h: np.ndarray, shingles: np.ndarray, counts: np.ndarray, least: int, bands: int, rows: int) -> tuple[np.ndarray, ...]:
    """(first word, words, hash of the words, band keys) of a text's lines of ``least`` words or more."""
    starts = np.cumsum(counts) - counts
    long = counts >= least
    first, n = starts[long], counts[long]
    if not len(first):
        return first, n, first, np.zeros((0, bands), np.uint64)
    bounds = np.stack([first, first + n], axis=1).ravel()
    place = np.arange(len(h), dtype=np.uint64) - np.repeat(starts, counts).astype(np.uint64)
    own = np.add.reduceat(np.append(_mix(h ^ _mix(place)), np.uint64(0)), bounds)[::2]
    bounds[1::2] -= SHINGLE - 1
    seeds = _mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    step = max(1, _AT_ONCE // (len(shingles) + 1))  # permutations of long texts are taken few at a time
    parts = []
    for at in range(0, len(seeds), step):
        orders = np.full((len(seeds[at : at + step]), len(shingles) + 1), np.uint64(2**64 - 1))
        orders[:, :-1] = _mix(shingles[None, :] ^ seeds[at : at + step, None])
        parts.append(np.minimum.reduceat(orders, bounds, axis=1)[:, ::2])
    signature = np.concatenate(parts)
    keys = [_mix((signature[b * rows : (b + 1) * rows] * _POWERS[: rows, None]).sum(axis=0, dtype=np.uint64) + np.uint64(b)) for b in range(bands)]
    return first, n, _mix(own), np.stack(keys, axis=1)


def taking_part(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) of the rows that take part: one text of an id."""
    texts = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hashes = texts.select("doc_id", F.xxhash64("text").alias("h"))
    several = hashes.groupBy("doc_id").agg(F.min("h").alias("least"), F.max("h").alias("most")).filter("least <> most")
    others = cut(hashes.join(several, "doc_id").filter("h <> least").select("doc_id", "h").distinct())
    return texts.withColumn("h", F.xxhash64("text")).join(bounded_broadcast(others, others.count()), ["doc_id", "h"], "left_anti").select("doc_id", "text")


def places(texts: DataFrame, window: int, least: int, bands: int, rows: int) -> DataFrame:
    """One row for each run and each line of each document."""

    def run(batches):
        forget()
        for b in text_slices(batches):
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            if not texts:
                continue
            # All texts of a slice at once, a line end between them.
            h, shingles, counts = hashed("\n".join(texts))
            n_lines = np.array([t.count("\n") + 1 for t in texts])
            bounds = np.r_[0, np.cumsum(counts)[np.cumsum(n_lines) - 1]]
            of, first, key, head, tail = runs(h, shingles, window, bounds)
            if len(first):
                none = pa.nulls(len(first), pa.int32()), pa.nulls(len(first), pa.list_(pa.int64()))
                short = [pa.array(x.astype(np.uint32).view(np.int32)) for x in (head, tail)]
                yield batch([ids[of], first.astype(np.int32), key.view(np.int64), *short, *none])
            first, n, own, keys = lines(h, shingles, counts, least, bands, rows)
            if len(first):
                of = np.repeat(np.arange(len(texts)), n_lines)[counts >= least]
                listed = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), keys.ravel().view(np.int64))
                none = pa.nulls(len(first), pa.int32())
                yield batch([ids[of], (first - bounds[of]).astype(np.int32), own.view(np.int64), none, none, n.astype(np.int32), listed])

    def batch(columns):
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[f.split()[0] for f in _PLACES.split(", ")])

    return texts.mapInArrow(run, _PLACES)


def line_pairs(classes: DataFrame, similarity: float) -> DataFrame:
    """(u, v) of classes that collide in a band and whose lengths allow the similarity: with the leader and with neighbours."""
    keyed = classes.select("class", "docs", "n", F.posexplode("bands").alias("band", "key"), F.col("bands").alias("all"))
    keyed = keyed.select("key", "class", "docs", "n", F.get("all", F.pmod(F.col("band") + 1, F.size("all"))).alias("next"))
    line = F.struct("class", "n")
    # Written first, so that the join below is one that Spark may split where a key is common.
    shared = cut(
        keyed.groupBy("key").agg(F.count(F.lit(1)).alias("found"), F.max(F.struct("docs", "class", "n")).alias("most"))
        .filter("found > 1").select("key", "found", F.struct("most.class", "most.n").alias("leader"))
    )
    met = keyed.select("key", "class", "n", "next").join(hashed_side(shared), "key").withColumn("salt", F.pmod(F.xxhash64("class"), F.ceil(F.col("found") / RUN)))
    beside = Window.partitionBy("key", "salt").orderBy("next", "class")
    others = F.array("leader", *[F.lag(line, k).over(beside) for k in range(1, SIDE + 1)])
    pairs = met.withColumn("others", others).select("class", "n", F.explode("others").alias("other")).filter("other.class <> class")
    # A line of n words has n - 4 shingles, some of which may repeat; the shorter of a similar pair has at least that share.
    near = F.least("n", "other.n") >= F.floor(F.lit(similarity) * (F.greatest("n", "other.n") - SHINGLE + 1))
    both = pairs.filter(near).select(F.least("class", "other.class").alias("u"), F.greatest("class", "other.class").alias("v"))
    return both.distinct()


def crowded(classes: DataFrame) -> DataFrame:
    """(key, class, n) of the bands with more classes than ``line_pairs`` compares each with each other."""
    keyed = classes.select(F.explode("bands").alias("key"), "class", "n")
    # Written first, so that the join is one that Spark may split where a key is common.
    many = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("found")).filter(F.col("found") > SIDE + 1).select("key"))
    return keyed.join(hashed_side(many), "key")


def apart(met: DataFrame, found: DataFrame) -> DataFrame:
    """(key, class, n, component) of the crowded bands whose classes lie in several components of ``found(node, component)``."""
    placed = cut(met.join(hashed_side(found.withColumnRenamed("node", "class")), "class", "left").select("key", "class", "n", F.coalesce("component", "class").alias("component")))
    mixed = cut(placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("key"))
    return cut(placed.join(hashed_side(mixed), "key"))


def remaining_pairs(met: DataFrame, links: DataFrame, similarity: float) -> DataFrame:
    """(u, v) of all other classes of a crowded band that the links so far don't join, so that leaders and neighbours leave no link out.

    Bands whose classes have met in one component, as those of copies have, give no pair; the others give each with each.
    ``reaching_pairs`` gives those of them that can be similar, without forming the rest.
    """
    left = apart(met, components(links))
    a, b = left.toDF("key", "u", "n", "cu"), left.toDF("key", "v", "m", "cv")
    near = F.least("n", "m") >= F.floor(F.lit(similarity) * (F.greatest("n", "m") - SHINGLE + 1))
    return a.join(b, "key").filter((F.col("u") < F.col("v")) & (F.col("cu") != F.col("cv")) & near).select("u", "v").distinct()


def reaching_pairs(left: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v, cu, cv) of all classes of ``left(key, class, component)`` that share a band, lie apart and can reach the similarity by their ``sets(class, shingles)``.

    Sets of a and b shingles need similarity / (1 + similarity) * (a + b) in common. In one order of all shingles, rare
    ones first, the first that both hold has at most what follows it in common, so it lies near the start of both: nearer
    in the shorter set, which needs a greater share. Only these starts meet; no similar pair is left out.
    """
    share, slack = similarity / (1 + similarity), F.lit(1e-9)
    held = left.select("class", "component").distinct().join(sets, "class").select("class", "component", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
    # Written first, so that the join is one that Spark may split where a shingle is common.
    holders = cut(held.groupBy("shingle").agg(F.count(F.lit(1)).alias("holders")))
    rarest_first = Window.partitionBy("class").orderBy("holders", "shingle")
    follow = held.join(hashed_side(holders), "shingle").withColumn("rest", F.col("size") - F.row_number().over(rarest_first) + 1)
    starts = follow.filter(F.col("rest") >= similarity * F.col("size") - slack).select("class", "component", "size", "shingle", "rest")
    starts = cut(starts.join(left.select("key", "class"), "class").select("key", "shingle", "class", "component", "size", "rest"))
    short = starts.filter(F.col("rest") >= 2 * share * F.col("size") - slack).toDF("key", "shingle", "u", "cu", "a", "follow_u")
    long = starts.toDF("key", "shingle", "v", "cv", "b", "follow_v")
    ordered = (F.col("a") < F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("u") < F.col("v")))
    enough = F.least("follow_u", "follow_v") >= share * (F.col("a") + F.col("b")) - slack
    return short.join(long, ["key", "shingle"]).filter(ordered & (F.col("cu") != F.col("cv")) & enough).select("u", "v", "cu", "cv").distinct()


_ASKED = "doc_id long, place int, side int, words array<int>, class long, shingles array<long>"


def surroundings(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """What is wanted of texts, (doc_id, place, side, n, class), in one pass.

    With a side (-1, 1), hashes of the words to that side of a run, nearest first; with a class, the distinct
    hashes of a line's shingles.
    """

    def run(batches):
        forget()
        for b in text_slices(batches):
            out = [[] for _ in range(6)]
            for i, text, asked in zip(*(c.to_pylist() for c in b.columns)):
                words = text.encode().lower().split()
                _, shingles, _ = hashed(text) if any(w["class"] is not None for w in asked) else (None, None, None)
                for w in asked:
                    near = sets = None
                    if w["side"] is not None:
                        at = w["place"] + BEFORE
                        near = words[at : at + REACH] if w["side"] > 0 else words[max(at + SHINGLE - REACH, 0) : at + SHINGLE][::-1]
                        near = np.fromiter(map(zlib.crc32, near), np.uint32, len(near)).view(np.int32)
                    else:
                        sets = np.unique(shingles[w["place"] : w["place"] + w["n"] - SHINGLE + 1]).view(np.int64)
                    for o, x in zip(out, (i, w["place"], w["side"], near, w["class"], sets)):
                        o.append(x)
            types = pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types)], names=[f.split()[0] for f in _ASKED.split(", ")])

    asked = wanted.groupBy("doc_id").agg(F.collect_set(F.struct("place", "side", "n", "class")).alias("asked"))
    return texts.join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(run, _ASKED)


def hashed_side(unique: DataFrame) -> DataFrame:
    """unique, one row a key, as the side of a join by that key that is hashed: nothing is sorted, and Spark may still split the other side where a key is common."""
    return unique.hint("shuffle_hash")


def run_components(links: DataFrame) -> DataFrame:
    """(node, component) of links(band_key, u, v), whose nodes have a band key each.

    Where all links of a key share an end they are one component; only the others need rounds.
    """
    # Written first, so that the join is one that Spark may split where a key is common.
    keys = cut(links.groupBy("band_key").agg(F.min("u").alias("least_u"), F.max("u").alias("most_u"), F.min("v").alias("least_v"), F.max("v").alias("most_v")))
    star = (F.col("least_u") == F.col("most_u")) | (F.col("least_v") == F.col("most_v"))
    stars = links.join(hashed_side(keys.filter(star).select("band_key", F.least("least_u", "least_v").alias("component"))), "band_key")
    others = links.join(hashed_side(keys.filter(~star).select("band_key")), "band_key")
    near = stars.select(F.explode(F.array("u", "v")).alias("node"), "component").distinct()
    return near.unionByName(components(others.select("u", "v")))


def clusters_of(components_: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, cluster, kept_doc_id) of nodes(node, first_doc): their components_(node, component), and the smallest document of each."""
    found = nodes.join(hashed_side(components_), "node", "left").select("node", "first_doc", F.coalesce("component", "node").alias("cluster"))
    # Written first, so that the join is one that Spark may split where a cluster is large.
    kept = cut(found.groupBy("cluster").agg(F.min("first_doc").alias("kept_doc_id")))
    return cut(found.join(hashed_side(kept), "cluster").select("node", "cluster", "kept_doc_id"))


def islands(rows: DataFrame, gap: int) -> DataFrame:
    """rows(doc_id, lo, hi, ...) with the number of the island that each is in: intervals at most ``gap`` apart."""
    in_order = Window.partitionBy("doc_id").orderBy("lo", "hi")
    reached = F.max("hi").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("lo") - reached > gap, F.lit(False)).cast("int")
    return rows.withColumn("apart", apart).withColumn("island", F.sum("apart").over(in_order.rowsBetween(Window.unboundedPreceding, 0))).drop("apart")


def repeated_spans(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows: int = 2, recall: float = 0.98, least: int = 24, window: int = 11, min_words: int = 24, gap: int = 6, similarity: float = 0.8
) -> DataFrame:
    """(doc_id, start_word, n_words, kept_doc_id) of the spans that another document keeps."""
    size = BEFORE + AFTER
    shingles = size - SHINGLE + 1
    if not (shingles - 2) / (shingles + 2) < similarity <= (shingles - 1) / (shingles + 1):
        raise ValueError(f"similarity must lie in ({(shingles - 2) / (shingles + 2):.3f}, {(shingles - 1) / (shingles + 1):.3f}] for runs of {shingles} shingles")
    texts = taking_part(docs, id_col, text_col)
    found = written(places(texts, window, max(least, SHINGLE), tuned(similarity, recall, rows), rows), "paragraphs")
    run_rows = found.filter("n IS NULL").select("doc_id", "place", "band_key", "head", "tail")
    # Written first, so that the join below is one that Spark may split where a key is common.
    shared = cut(run_rows.groupBy("band_key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("band_key"))
    members = run_rows.join(hashed_side(shared), "band_key").select("doc_id", "place", "band_key", F.xxhash64(F.lit(0), "band_key", "head").alias("u"), F.xxhash64(F.lit(1), "band_key", "tail").alias("v"))
    members = written(members, "colliding")
    line_rows = found.filter("n IS NOT NULL").select("doc_id", "place", "n", F.col("band_key").alias("class"), "bands")
    line_rows = written(line_rows, "lines")
    discard(found)
    # A run links its two hashes; hashes that occur in one document only link nothing.
    ends = members.select("doc_id", F.explode(F.array("u", "v")).alias("node"))
    alive = cut(ends.groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).filter("first_doc < last_doc"))
    nodes = hashed_side(alive.select("node"))
    run_links = cut(
        members.select("band_key", "u", "v").distinct()
        .join(nodes.withColumnRenamed("node", "u"), "u", "left_semi").join(nodes.withColumnRenamed("node", "v"), "v", "left_semi")
    )
    of_run = hashed_side(clusters_of(run_components(run_links), alive.select("node", "first_doc")))

    held = members.select("doc_id", "place", F.explode(F.array("u", "v")).alias("node")).join(of_run, "node").select("cluster", "doc_id", "place", "kept_doc_id")
    held = written(held, "held")
    discard(members)
    keepers = held.filter("doc_id = kept_doc_id").groupBy("cluster").agg(F.min("place").alias("kept_place"))
    # A run counts without the two words that may differ.
    covered = held.filter("kept_doc_id < doc_id").select("doc_id", (F.col("place") + 1).alias("lo"), (F.col("place") + size - 1).alias("hi"), "place", "cluster", "kept_doc_id")
    whole = Window.partitionBy("doc_id", "island")
    edge = (
        islands(covered, gap + 2)
        .withColumn("first", F.min("place").over(whole)).withColumn("last", F.max("place").over(whole))
        .withColumn("left", F.col("place") - F.col("first") <= window).withColumn("right", F.col("last") - F.col("place") <= window)
        .filter("left OR right").select("doc_id", "lo", "hi", "place", "cluster", "kept_doc_id", "first", "last", "left", "right").distinct()
    )
    edge = written(edge, "edges")
    middle = edge.filter("place = first").select("doc_id", (F.col("first") + 1).alias("lo"), (F.col("last") + size - 1).alias("hi"), "kept_doc_id")
    sides = F.filter(F.array(F.when(F.col("left"), -1), F.when(F.col("right"), 1)), lambda x: x.isNotNull())
    ends = edge.join(keepers, "cluster").select("doc_id", "lo", "hi", "place", "kept_doc_id", "kept_place", F.explode(sides).alias("side"))
    ends = written(ends, "ends")
    run_sides = ends.select("doc_id", "place", "side").union(ends.select("kept_doc_id", "kept_place", "side")).distinct()

    classes = line_rows.groupBy("class").agg(F.min(F.struct("doc_id", "place", "n")).alias("line"), F.max("doc_id").alias("last_doc"), F.count(F.lit(1)).alias("docs"), F.first("bands").alias("bands"))
    classes = written(classes.select("class", "line.*", "last_doc", "docs", "bands"), "line-classes")
    pairs = written(line_pairs(classes, similarity), "line-pairs")
    met = written(crowded(classes), "crowded-bands")
    every_class = pairs.select(F.explode(F.array("u", "v")).alias("class")).union(met.select("class")).distinct()
    paired = classes.join(every_class, "class", "left_semi").select("doc_id", "place", "n", "class")

    asked = written(surroundings(texts, run_sides.unionByName(paired, allowMissingColumns=True)), "surroundings")
    sets = asked.filter("class IS NOT NULL").select("class", "shingles")

    def similar(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.toDF("u", "x"), "u").join(sets.toDF("v", "y"), "v")
        common = F.size(F.array_intersect("x", "y"))
        return both.filter(common >= F.lit(similarity) * (F.size("x") + F.size("y") - common)).select(*pairs.columns)

    line_links = written(similar(pairs), "line-links")
    found = components(line_links)
    # Links of what leaders and neighbours leave apart join whole components.
    more = cut(similar(reaching_pairs(apart(met, found), sets, similarity)).select("u", "v", "cu", "cv"))
    if not more.isEmpty():
        alone = more.select(F.explode(F.array("cu", "cv")).alias("node")).distinct().withColumn("component", F.col("node"))
        joined = components(more.select(F.col("cu").alias("u"), F.col("cv").alias("v"))).toDF("component", "whole")
        found = cut(found.union(alone).distinct().join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component")))
    discard(met)
    linked = found.select(F.col("node").alias("class"))
    repeated = classes.join(linked, "class", "left_semi").unionByName(classes.filter("doc_id < last_doc").join(linked, "class", "left_anti"))
    of_line = clusters_of(found, repeated.select(F.col("class").alias("node"), F.col("doc_id").alias("first_doc")))
    discard(classes, pairs)

    words = asked.filter("side IS NOT NULL").select("doc_id", "place", "side", "words")
    theirs = words.select(F.col("doc_id").alias("kept_doc_id"), F.col("place").alias("kept_place"), "side", F.col("words").alias("theirs"))
    compared = ends.join(words, ["doc_id", "place", "side"]).join(theirs, ["kept_doc_id", "kept_place", "side"])
    differ = F.array_position(F.zip_with("words", "theirs", lambda a, b: a.eqNullSafe(b)), False)
    same = F.when(differ > 0, differ - 1).otherwise(F.size("words")).cast("int")
    longer = compared.select(
        "doc_id",
        F.when(F.col("side") < 0, F.least("lo", F.col("place") + BEFORE + SHINGLE - same)).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("side") > 0, F.greatest("hi", F.col("place") + BEFORE + same)).otherwise(F.col("hi")).alias("hi"),
        "kept_doc_id",
    )
    line_spans = line_rows.join(of_line.select(F.col("node").alias("class"), "kept_doc_id"), "class").filter("kept_doc_id < doc_id").select(
        "doc_id", F.col("place").alias("lo"), (F.col("place") + F.col("n")).alias("hi"), "kept_doc_id"
    )
    spans = islands(reduce(DataFrame.unionByName, (middle, longer, line_spans)), gap)
    joined = spans.groupBy("doc_id", "island").agg(F.min("lo").cast("long").alias("start_word"), F.max("hi").alias("end"), F.min("kept_doc_id").alias("kept_doc_id"))
    return joined.select("doc_id", "start_word", (F.col("end") - F.col("start_word")).cast("long").alias("n_words"), "kept_doc_id").filter(F.col("n_words") >= min_words)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of each (first, count), joined by one space or line end; words beyond its end are none."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw)]
    out, pos = [], 0
    for first, count in sorted(spans):
        if first >= len(at) or count <= 0:
            continue
        left = raw[pos : max(pos, at[first][0])]
        out.append(left.rstrip() + (b"\n" if b"\n" in left[len(left.rstrip()) :] else b" ") if left.strip() else b"")
        pos = max(pos, at[min(first + count, len(at)) - 1][1])
    out.append(raw[pos:].lstrip() if out else raw[pos:])
    return b"".join(out).decode().strip()


def remove_spans(docs: DataFrame, spans: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each document's spans cut from its text; documents left without a word go. Columns stay."""
    per_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "n_words")).alias("spans"))
    own = {n: n for n in ("span_doc", "span_text", "spans")}
    while set(own.values()) & set(docs.columns):
        own = {k: v + "_" for k, v in own.items()}
    doc, text, found = own.values()
    hashes = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias(text))
    least = hashes.join(per_doc.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(text).alias(text))
    cuts = per_doc.join(least, "doc_id").select(F.col("doc_id").alias(doc), F.col(text), F.col("spans").alias(found))
    touched = docs.join(cuts, (F.col(id_col).cast("long") == F.col(doc)) & (F.xxhash64(text_col) == F.col(text)), "left")

    @F.pandas_udf("string")
    def cut_text(text: pd.Series, first: pd.Series, count: pd.Series) -> pd.Series:
        return pd.Series([without(t, list(zip(f, c))) for t, f, c in zip(text, first, count)], dtype=object)

    changed = touched.filter(F.col(found).isNotNull())
    changed = changed.withColumn(text_col, cut_text(F.col(text_col), F.col(f"{found}.start_word"), F.col(f"{found}.n_words"))).filter(F.col(text_col) != "")
    return touched.filter(F.col(found).isNull()).select(*docs.columns).unionByName(changed.select(*docs.columns))
