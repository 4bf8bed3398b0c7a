"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``radius`` bits have a common variant within radius/2 of
both. Every distinct fingerprint therefore stands for all its variants of that half radius; the
variants are shuffled and fingerprints that meet on one are linked. A variant's leading bits
choose where it is shuffled: a fingerprint is sent once to each prefix that it reaches, with the
flips left to it, and its variants below that prefix are formed there. This sends tens of rows a
fingerprint in place of thousands and yields the same meetings.

Of the fingerprints that meet on one variant each is linked to the one nearest to it, not in all pairs;
each link is verified by its distance. Equal fingerprints are one node from the start. The variants below a
prefix that many fingerprints reach are divided among tasks by parities of random bits of the variant, as many
as the prefix needs: near copies share most bits but their variants spread evenly over parities, so a dense
cloud is divided too. A fingerprint goes to those tasks in which it has a variant.

Defined cases: a null or blank text has fingerprint zero and is linked like any other; fewer words
than a shingle make one shingle; repeated rows and ties share a component, whose id is its
smallest document id; a null document id is kept and never becomes a component's id unless all
are null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import bounded_broadcast, cut, forget, text_slices, written
from pairlab.llm.graph import components

#: Hashes whose bits are counted at a time; a bound of memory.
_HASHES = 200_000
#: Variants formed at a time in a task; a bound of memory.
_VARIANTS = 500_000
#: Variants below a prefix beyond which they are divided among tasks.
PREFIX_VARIANTS = 4_000_000
#: Bits whose parities divide variants, one word a parity.
_PARITIES = np.random.default_rng(9).integers(1, 2**64, 32, dtype=np.uint64)


def shingle_hashes(text: str, width: int, seed: int) -> list[int]:
    """XXH64 of each run of ``width`` words, A-Z lowered; of the whole sequence if it is shorter; none for no word."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # bytes.split and bytes.lower know ASCII alone
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxh64_intdigest(joined, seed)]
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = [s - 1 for s in starts[width:]]
    ends.append(at - 1)
    return [xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts, ends)]


def majority(hashes: list[list[int]]) -> np.ndarray:
    """The fingerprint of each list: a bit is one if it is set in over half of its hashes."""
    out = np.zeros(len(hashes), np.uint64)
    lengths = np.array([len(h) for h in hashes], np.int64)
    filled = np.flatnonzero(lengths)
    counts = np.zeros((len(hashes), 64), np.int64)
    run: list[int] = []
    owners: list[tuple[int, int]] = []

    def flush():
        if run:
            bits = np.unpackbits(np.array(run, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            sums = np.add.reduceat(bits, [a for _, a in owners], axis=0, dtype=np.int32)
            np.add.at(counts, [i for i, _ in owners], sums)
            run.clear()
            owners.clear()

    for i in filled:
        own = hashes[i]
        for at in range(0, len(own), _HASHES):
            owners.append((i, len(run)))
            run.extend(own[at : at + _HASHES])
            if len(run) >= _HASHES:
                flush()
    flush()
    if len(filled):
        ones = (counts[filled] * 2 > lengths[filled, None]).astype(np.uint8)
        out[filled] = np.packbits(ones, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, text_hash, fp) of every row; fp is the 64-bit fingerprint as a signed long."""

    def run(batches):
        forget()
        for b in text_slices(batches):
            fp = majority([shingle_hashes(t or "", width, seed) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return source.mapInArrow(run, "doc_id long, text_hash long, fp long")


def masks(bits: int, flips: int) -> np.ndarray:
    """All words of ``bits`` bits with at most ``flips`` ones."""
    return np.array([sum(1 << i for i in c) for k in range(flips + 1) for c in combinations(range(bits), k)], np.uint64)


def slice_of(words: np.ndarray, parities: int) -> np.ndarray:
    """The number that the first ``parities`` parities of each word make; slice_of(a ^ b) is slice_of(a) ^ slice_of(b)."""
    out = np.zeros(words.shape, np.uint64)
    for k in range(parities):
        out |= (np.bitwise_count(words & _PARITIES[k]) & 1).astype(np.uint64) << np.uint64(k)
    return out


def meeting_slices(fps: np.ndarray, left: np.ndarray, low: int, half: int, reach: int, parities: int = 0, slice_no: int = 0):
    """Pairs of places in ``fps`` that meet on a variant with up to ``left`` flips in the lowest ``low`` bits, slice by slice.

    Of the fingerprints on one variant each is paired with the one that flipped the fewest bits, if those are
    at most ``half`` (two that flipped more meet elsewhere if they are near enough). Only variants whose first
    ``parities`` parities make ``slice_no`` count; when these are still many, a slice holds those with further
    parities equal, and only they are formed for it.
    """
    fps = fps & np.uint64((1 << low) - 1)
    kinds = [(r, masks(low, int(r)), np.flatnonzero(left == r)) for r in np.unique(left)]
    total = sum(len(m) * len(i) for _, m, i in kinds) >> parities
    slicing = min(len(_PARITIES), parities + (total // _VARIANTS).bit_length())
    sorted_kinds = []
    for r, m, i in kinds:
        own, ends = slice_of(fps[i], slicing), slice_of(m, slicing)
        order = np.argsort(own, kind="stable")
        by = {int(e): m[ends == e] for e in np.unique(ends)}
        sorted_kinds.append((r, by, i[order], own[order]))
    for part in range(slice_no, 1 << slicing, 1 << parities):
        values, owners, flips = [], [], []
        for r, by, i, ends in sorted_kinds:
            for end, m in by.items():
                lo, hi = np.searchsorted(ends, [np.uint64(part ^ end), np.uint64((part ^ end) + 1)])
                if lo < hi:
                    own = i[lo:hi]
                    v = fps[own, None] ^ m[None, :]
                    values.append(v.ravel())
                    owners.append(np.broadcast_to(own[:, None], v.shape).ravel())
                    flips.append(np.broadcast_to((reach - r + np.bitwise_count(m))[None, :], v.shape).ravel())
        if not values:
            continue
        v, o, f = np.concatenate(values), np.concatenate(owners), np.concatenate(flips)
        order = np.lexsort((f, v))
        v, o, f = v[order], o[order], f[order]
        first = np.maximum.accumulate(np.where(np.r_[True, v[1:] != v[:-1]], np.arange(len(v)), 0))
        met = np.flatnonzero((first != np.arange(len(v))) & (f[first] <= half))
        if len(met):
            yield np.unique(np.sort(np.stack([o[first[met]], o[met]], axis=1), axis=1), axis=0)


def meetings(fps: np.ndarray, left: np.ndarray, low: int, half: int | None = None, reach: int | None = None) -> np.ndarray:
    """All pairs of meeting_slices."""
    reach = int(left.max(initial=0)) if reach is None else reach
    found = list(meeting_slices(fps, left, low, reach if half is None else half, reach))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


class Forest:
    """Components of places, as the smallest place of each."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, pairs: np.ndarray) -> None:
        """Only pairs of places that are still apart are visited one by one."""
        apart = self.root[pairs]
        apart = np.unique(apart[apart[:, 0] != apart[:, 1]], axis=0)
        root = self.root

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in apart.tolist():
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        while (above := root[root]).tolist() != root.tolist():
            root[:] = above

    def edges(self) -> np.ndarray:
        """(place, root) of every place that is no root."""
        i = np.flatnonzero(self.root != np.arange(len(self.root)))
        return np.stack([i, self.root[i]], axis=1)


def links(distinct: DataFrame, *, radius: int = 4, prefix_bits: int | None = None) -> DataFrame:
    """Edges (u, v) whose components are those of "differ in at most ``radius`` bits" over the distinct fp."""
    half, odd = divmod(radius, 2)
    reach = half + odd
    n = distinct.count()
    bits = prefix_bits if prefix_bits is not None else max(6, min(24, (max(n, 1) * 2081 // 2_000_000).bit_length()))
    low = 64 - bits

    def emit(batches):
        """Each (prefix, fp, used) once for every prefix of ``bits`` bits, with the flips that reaching it takes."""
        own_masks = masks(bits, reach)
        own_flips = np.bitwise_count(own_masks).astype(np.int8)
        for b in batches:
            for at in range(0, b.num_rows, 10_000):
                fp = b.column(0).slice(at, 10_000).to_numpy(zero_copy_only=False)
                p = ((fp.view(np.uint64) >> np.uint64(low))[:, None] ^ own_masks[None, :]).astype(np.int64)
                f, u = np.repeat(fp, len(own_masks)), np.tile(own_flips, len(fp))
                yield pa.RecordBatch.from_arrays([pa.array(p.ravel()), pa.array(f), pa.array(u)], names=["prefix", "fp", "used"])

    def scatter(batches):
        """Each (prefix, parities, slice_no, fp, used) once for every slice of its prefix in which the fp has a variant."""
        reached: dict[tuple[int, int], np.ndarray] = {}
        below = np.uint64((1 << low) - 1)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                prefix, fp, used, parities = (c.slice(at, 500).to_numpy(zero_copy_only=False) for c in b.columns)
                own = fp.view(np.uint64) & below
                for n, u in {*zip(parities.tolist(), used.tolist())}:
                    if (n, u) not in reached:
                        reached[n, u] = np.unique(slice_of(masks(low, reach - u), n))
                    i, to = np.flatnonzero((parities == n) & (used == u)), reached[n, u]
                    slices = (slice_of(own[i], n)[:, None] ^ to[None, :]).astype(np.int64)
                    each = np.repeat(i, len(to))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(prefix[each]), pa.array(parities[each]), pa.array(slices.ravel()), pa.array(fp[each]), pa.array(used[each])],
                        names=["prefix", "parities", "slice_no", "fp", "used"],
                    )

    def meet(pdf):
        import pandas as pd

        forget()
        parities, slice_no = int(pdf["parities"].iloc[0]), int(pdf["slice_no"].iloc[0])
        fps = pdf["fp"].to_numpy().view(np.uint64)
        order = np.argsort(fps, kind="stable")
        fps, flips = fps[order], pdf["used"].to_numpy()[order]
        forest = Forest(len(fps))
        for pairs in meeting_slices(fps, reach - flips, low, half, reach, parities, slice_no):
            forest.link(pairs[np.bitwise_count(fps[pairs[:, 0]] ^ fps[pairs[:, 1]]) <= radius])
        out = forest.edges()
        signed = fps.view(np.int64)
        return pd.DataFrame({"u": signed[out[:, 0]], "v": signed[out[:, 1]]})

    sent = written(distinct.select("fp").mapInArrow(emit, "prefix long, fp long, used byte"), "prefixes")
    # Variants below each prefix, and the parities that divide those of prefixes with many into about PREFIX_VARIANTS each.
    below = F.array(*[F.lit(len(masks(low, reach - used))) for used in range(reach + 1)])
    sizes = sent.groupBy("prefix").agg(F.sum(F.get(below, F.col("used").cast("int"))).alias("n")).filter(F.col("n") > PREFIX_VARIANTS)
    parities = F.least(F.ceil(F.log2(F.col("n") / PREFIX_VARIANTS)), F.lit(len(_PARITIES))).cast("int")
    many = cut(sizes.select("prefix", parities.alias("parities")))
    n_many = many.count()
    few = sent.join(bounded_broadcast(many, n_many), "prefix", "left_anti")
    few = few.select("prefix", F.lit(0).alias("parities"), F.lit(0).cast("long").alias("slice_no"), "fp", "used")
    divided = sent.join(bounded_broadcast(many, n_many), "prefix").select("prefix", "fp", "used", "parities")
    divided = divided.mapInArrow(scatter, "prefix long, parities int, slice_no long, fp long, used byte")
    tasks = few.unionByName(divided).groupBy("prefix", "parities", "slice_no")
    return tasks.applyInPandas(meet, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id, text_hash, component) of every row.

    text_hash is Spark's xxhash64 of the text; component tells groups apart whose smallest ids are equal.
    """
    if radius < 0 or radius > 6:
        raise ValueError("radius must be from 0 to 6")
    fps = cut(fingerprints(docs, id_col=id_col, text_col=text_col, width=width, seed=seed))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = components(links(distinct, radius=radius))
    classed = distinct.join(found, distinct.fp == found.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("class"))
    # Written first, so that the join is one that Spark may split where a class is large.
    ids = cut(classed.groupBy("class").agg(F.min("first_id").alias("component_id")))
    of_fp = cut(classed.join(ids, "class").select("fp", "component_id", F.col("class").alias("component")))
    return fps.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash", "component")
