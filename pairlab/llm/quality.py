"""A quality classifier: histogram gradient-boosted trees over statistics of a document's text.

A document's statistics (STATISTICS) come from its whole text: shares of kinds of characters, word and
line lengths, repetition of words and lines. They are computed in Arrow batches, for a slice of texts at
once, from the bytes. Trees are fitted to the logistic loss on a bounded sample of labelled rows: at most
``sample_rows`` distinct (id, text, label), those with the smallest hashes, of all labelled rows whose
checksum of the id isn't held out. Statistics are cut at quantiles into ``bins``; a level of a tree is grown
from histograms of gradients over (node, statistic, bin). The trees are flattened into arrays of split statistics,
thresholds and leaves, which all rows of a slice walk down together.

Defined cases: a null text has the statistics of an empty one, and both are scored; null ids are never
learned from and count as not held out; null labels and labels other than 0 and 1 are not learned
from; an id with both labels is learned from with both; a repeated row is learned from once; without labelled
rows every score is 0.5, and with labels of one kind alone it is near that kind; repeated rows get equal
results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import BROADCAST_ROWS, byte_lengths, cut, text_slices

STATISTICS = [
    "log_chars", "log_words", "mean_word", "sd_word", "longest_word", "letters", "capitals", "digits", "spaces", "stops", "marks", "symbols", "beyond_ascii",
    "same_as_last", "distinct_words", "commonest_word", "same_as_two_before", "capital_words", "words_without_letters", "words_ending_in_symbols", "shouted_words",
    "log_lines", "words_a_line", "repeated_lines", "lines_with_stop", "byte_entropy",
]

_SPACE, _LOWER, _UPPER, _DIGIT, _STOP, _MARK, _SYMBOL, _HIGH = range(8)


def _kinds() -> np.ndarray:
    kind = np.full(256, _SYMBOL, np.uint8)
    kind[[9, 10, 11, 12, 13, 32]] = _SPACE
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = _LOWER, _UPPER, _DIGIT, _HIGH
    kind[list(b".,;:?!")] = _STOP
    kind[list(b"'\"()-")] = _MARK
    return kind


_KIND = _kinds()
_PRIME = np.uint64(0x100000001B3)


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values over [start, end) each."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return total[ends] - total[starts]


def _spans(inside: np.ndarray, owner_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside`` that don't cross an owner's start."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[owner_starts] = True
    before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
    after = np.concatenate([inside[1:], [False]]) if len(inside) else inside
    return np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes: a weighted sum by place within the span, with its length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    bytes_ = data[np.repeat(starts, lengths) + place].astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        # Multiplied out by a hash of the place, the sum tells orders apart.
        weight = (place.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * _PRIME
        weight ^= weight >> np.uint64(29)
        weight *= np.uint64(0xBF58476D1CE4E5B9)
        weight ^= weight >> np.uint64(32)
        mixed = bytes_ * (weight | np.uint64(1))
        out = np.add.reduceat(mixed, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64) * _PRIME
        return out ^ (out >> np.uint64(31))


def _per(owner: np.ndarray, values, n: int) -> np.ndarray:
    return np.bincount(owner, values, n)


def _repeats(owner: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the count of the commonest, by owner."""
    order = np.lexsort((keys, owner))
    o, k = owner[order], keys[order]
    first = np.concatenate([[True], (o[1:] != o[:-1]) | (k[1:] != k[:-1])]) if len(o) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, len(o)))
    most = np.zeros(n)
    np.maximum.at(most, o[at], counts)
    return np.bincount(o[at], minlength=n).astype(float), most


def statistics(texts: pa.Array) -> np.ndarray:
    """The STATISTICS of each text (a row); shares of nothing are 0."""
    n = len(texts)
    sizes = byte_lengths(texts)
    filled = texts.fill_null("").cast(pa.binary())
    data = np.frombuffer(b"".join(filled.to_pylist()), np.uint8)
    starts = np.cumsum(sizes) - sizes
    ends = starts + sizes
    kind = _KIND[data]
    share = lambda a, b: np.divide(a, b, out=np.zeros(n), where=np.asarray(b) > 0)

    of_kind = [_sums(kind == k, starts, ends).astype(float) for k in range(8)]
    continued = _sums((data & 0xC0) == 0x80, starts, ends)
    chars = (sizes - continued).astype(float)
    heads = of_kind[_HIGH] - continued
    letters = of_kind[_LOWER] + of_kind[_UPPER] + heads

    w_lo, w_hi = _spans(kind != _SPACE, starts)
    w_of = np.searchsorted(ends, w_lo, side="right")
    words = np.bincount(w_of, minlength=n).astype(float)
    w_len = (w_hi - w_lo - _sums((data & 0xC0) == 0x80, w_lo, w_hi)).astype(float)
    mean = share(_per(w_of, w_len, n), words)
    spread = np.sqrt(np.maximum(share(_per(w_of, w_len * w_len, n), words) - mean * mean, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, w_of, w_len)
    keys = _hashes(data, w_lo, w_hi)

    def same(back: int) -> np.ndarray:
        hit = (keys[back:] == keys[:-back]) & (w_of[back:] == w_of[:-back])
        return share(np.bincount(w_of[back:][hit], minlength=n), words)

    distinct, commonest = _repeats(w_of, keys, n)
    w_letters = _sums((kind == _LOWER) | (kind == _UPPER) | (kind == _HIGH), w_lo, w_hi)
    w_upper = _sums(kind == _UPPER, w_lo, w_hi)
    w_lower = _sums(kind == _LOWER, w_lo, w_hi)
    of_words = lambda flag: share(np.bincount(w_of[flag], minlength=n), words)
    last = data[w_hi - 1] if len(w_hi) else data
    odd_end = (kind[w_hi - 1] == _SYMBOL) | (last == ord("!")) if len(w_hi) else np.zeros(0, bool)

    l_lo, l_hi = _spans(data != 10, starts)
    l_of = np.searchsorted(ends, l_lo, side="right")
    lines = np.bincount(l_of, minlength=n).astype(float)
    l_distinct, _ = _repeats(l_of, _hashes(data, l_lo, l_hi), n)
    l_stop = kind[l_hi - 1] == _STOP if len(l_hi) else np.zeros(0, bool)

    # Distinct bytes of a text, with their counts, in one table of 256 columns a text.
    owner = np.repeat(np.arange(n), sizes)
    p = np.bincount(owner * 256 + data, minlength=n * 256).reshape(n, 256) / np.maximum(sizes, 1)[:, None]
    entropy = -(p * np.log2(p, out=np.zeros_like(p), where=p > 0)).sum(axis=1)

    return np.stack([
        np.log1p(chars), np.log1p(words), mean, spread, np.log1p(longest), share(letters, chars), share(of_kind[_UPPER], of_kind[_UPPER] + of_kind[_LOWER]), share(of_kind[_DIGIT], chars), share(of_kind[_SPACE], chars),
        share(of_kind[_STOP], chars), share(of_kind[_MARK], chars), share(of_kind[_SYMBOL], chars), share(heads, chars),
        same(1), share(distinct, words), share(commonest, words), same(2), of_words(kind[w_lo] == _UPPER), of_words(w_letters == 0), of_words(odd_end), of_words((w_upper > 1) & (w_lower == 0)),
        np.log1p(lines), share(words, lines), share(lines - l_distinct, lines), share(np.bincount(l_of[l_stop], minlength=n), lines), entropy,
    ], axis=1)


@dataclass
class Trees:
    """Trees of one depth in arrays: node 0 is the root, node i has the children 2i + 1 and 2i + 2; leaves are kept apart.

    A row goes right where its statistic is above the threshold; a node that wasn't split sends all rows left.
    """

    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, 2**depth)
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        node = np.zeros((len(x), trees), np.int64)
        every, rows = np.arange(trees)[None, :], np.arange(len(x))[:, None]
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (x[rows, self.feature[every, node]] > self.threshold[every, node])
        return self.base + self.leaf[every, node - inner].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def quantile_cuts(column: np.ndarray, bins: int) -> np.ndarray:
    """Ascending cuts of a column, less than ``bins``; a value's bin is the number of cuts below it."""
    values = np.unique(column)
    if len(values) <= bins:
        return (values[1:] + values[:-1]) / 2
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, ridge: float = 1.0, least_weight: float = 1.0) -> Trees:
    """Gradient-boosted trees for labels 0 and 1, by histograms; ties go to the first statistic, then the lowest cut."""
    n, width = x.shape
    cuts = [quantile_cuts(x[:, f], bins) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    place = binned + np.arange(width) * bins  # of the histogram of one node
    usable = np.arange(bins)[None, :] < np.array([len(c) for c in cuts])[:, None]
    inner = 2**depth - 1
    out = Trees(np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))))
    margin = np.full(n, out.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (width * bins) + place).ravel()
            g, h = (np.bincount(at, np.repeat(v, width), count * width * bins).reshape(count, width, bins) for v in (grad, hess))
            left_g, left_h = g.cumsum(axis=2), h.cumsum(axis=2)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - all_g**2 / (all_h + ridge)
            gain[~(usable[None] & (left_h >= least_weight) & (right_h >= least_weight))] = -np.inf
            best = gain.reshape(count, -1).argmax(axis=1)
            found = gain.reshape(count, -1)[np.arange(count), best] > 1e-9
            f, cut_at = best // bins, best % bins
            for k in np.flatnonzero(found):
                out.feature[t, first + k], out.threshold[t, first + k] = f[k], cuts[f[k]][cut_at[k]]
            own = node - first
            right = found[own] & (binned[np.arange(n), f[own]] > cut_at[own])
            node = 2 * node + 1 + right
        leaf = node - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        out.leaf[t] = rate * g / (h + ridge)
        margin += out.leaf[t][leaf]
    return out


def held_out(id_col: Column) -> Column:
    """Whether the checksum of the id as text leaves 1 modulo 3; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


_HALF = 2.0**63


def _smallest(hashes: DataFrame, h: str, wanted: int) -> float:
    """A bound below which at least ``wanted`` of the distinct hashes lie, nearly surely, and not many more."""
    n = hashes.select(h).distinct().count()
    return min(1.0, (1.1 * wanted + 200) / max(1, n)) * 2 * _HALF - _HALF


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 40_000, **options) -> Trees | None:
    """The trees, or none if no row is labelled."""
    told = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"), F.xxhash64(F.col(id_col).cast("string")).alias("ih")
    )
    # First of the labelled ids, so that what is joined to the texts is bounded, whatever the number of labels.
    bound = _smallest(told, "ih", sample_rows)
    drawn = cut(told.filter(F.col("ih").cast("double") <= bound).select("id", "label").distinct())
    few = F.broadcast(drawn) if drawn.count() <= BROADCAST_ROWS else drawn
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(few, "id")
    own = own.select("text", "label", F.xxhash64(F.col("id").cast("string"), "text", "label").alias("h"))
    # Then of the rows that have them, as many rows may share an id.
    bound = _smallest(own, "h", sample_rows)
    own = own.filter(F.col("h").cast("double") <= bound)
    kinds = [f"s{i} double" for i in range(len(STATISTICS))]

    def measure(batches):
        for b in text_slices(batches, 0):
            x = statistics(b.column(0))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), *[pa.array(c) for c in x.T]], names=["label", "h", *[k.split()[0] for k in kinds]])

    measured = own.mapInArrow(measure, ", ".join(["label int", "h long", *kinds]))
    once = measured.dropDuplicates(["h"])
    sample = once.orderBy("h").limit(sample_rows).withColumn("one", F.lit(1))

    def learn(pdf):
        import pandas as pd

        pdf = pdf.sort_values("h")
        t = fit(pdf[[k.split()[0] for k in kinds]].to_numpy(), pdf["label"].to_numpy().astype(float), **options)
        return pd.DataFrame({"feature": [t.feature.ravel().tolist()], "threshold": [t.threshold.ravel().tolist()], "leaf": [t.leaf.ravel().tolist()], "trees": [len(t.leaf)], "base": [t.base]})

    # One group of sample_rows rows of numbers at most.
    rows = sample.groupBy("one").applyInPandas(learn, "feature array<int>, threshold array<double>, leaf array<double>, trees int, base double").collect()
    return next((Trees(np.array(r.feature, np.int32).reshape(r.trees, -1), np.array(r.threshold).reshape(r.trees, -1), np.array(r.leaf).reshape(r.trees, -1), r.base) for r in rows), None)


def score(docs: DataFrame, trees: Trees | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    # Arrays of fixed size: the number of trees and their depth.
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for b in text_slices(batches, 0):
            s = model.value.score(statistics(b.column(0))) if model.value else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    source = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Learns from the labelled rows that aren't held out and scores every row of docs."""
    return score(docs, train(docs, labels, id_col=id_col, text_col=text_col, **options), id_col=id_col, text_col=text_col)
