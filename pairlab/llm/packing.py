"""Packing: bounded-space online best fit into sequences of a fixed number of tokens.

Each input partition keeps at most ``open_windows`` windows. A document's full windows are
emitted as they are; its rest goes to the fullest open window that has room, and when none has,
the fullest window is emitted. What is left open when the partition ends is merged across
partitions, best fit by decreasing size, in groups of about ``merge_windows`` windows.

Defined cases: a null or empty text is the end id alone; a null document id is kept; repeated
rows are packed each on its own; ties go to the window opened first; an empty table gives no
rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import cut, text_slices
from pairlab.llm.tokens import KEPT_WORDS, encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_RAW = PIECES + ", open boolean"


class OpenWindows:
    """The bounded set of open windows of one partition."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.by_fill: list[tuple[int, int]] = []  # (tokens in it, -its number), ascending: the last is the fullest
        self.pieces: dict[int, list] = {}

    def place(self, length: int, number: int) -> tuple[int, int, list]:
        """(window, offset in it, the pieces of a window emitted for it) of a rest of ``length`` tokens."""
        emitted: list = []
        i = bisect_left(self.by_fill, (self.capacity - length + 1, -(1 << 62))) - 1
        if i >= 0:
            fill, key = self.by_fill.pop(i)
        else:
            if len(self.by_fill) >= self.limit:
                emitted = self.pieces.pop(-self.by_fill.pop()[1])
            fill, key = 0, -number
            self.pieces[number] = []
        insort(self.by_fill, (fill + length, key))
        return -key, fill, emitted


def _pack_partition(batches, name: str, capacity: int, limit: int, end_id: int, kept_words: int = KEPT_WORDS):
    code, part = encoder(name, kept_words), TaskContext.get().partitionId()
    windows, number, done = OpenWindows(capacity, limit), part << 33, []

    def batch(rows, still_open):
        cols = [list(c) for c in zip(*rows)] or [[]] * 7
        kinds = [pa.int64()] * 7
        arrays = [pa.array(c, t) for c, t in zip(cols, kinds)] + [pa.array([still_open] * len(rows), pa.bool_())]
        return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in _RAW.split(", ")])

    for b in text_slices(batches):
        for key, ids in zip(b.column(0).to_pylist(), code.encode([t or "" for t in b.column(1).to_pylist()])):
            raw = np.append(ids, end_id).astype("<u4").tobytes()
            total = len(raw) // 4
            whole = total // capacity * capacity
            for at in range(0, whole, capacity):
                crc = zlib.crc32(raw[4 * at : 4 * (at + capacity)])
                done.append((key, at, capacity, crc, total, number, 0))
                number += 1
            if rest := total - whole:
                window, offset, emitted = windows.place(rest, number)
                number += window == number
                windows.pieces[window].append((key, whole, rest, zlib.crc32(raw[4 * whole :]), total, window, offset))
                done += emitted
        if len(done) > 5_000:
            yield batch(done, False)
            done = []
    yield batch(done, False)
    yield batch([p for own in windows.pieces.values() for p in own], True)


def merge_windows(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """Best fit decreasing: for each window of so many tokens, the window it goes into and its offset there."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    fills: list[tuple[int, int]] = []
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for i in order:
        j = bisect_left(fills, (capacity - sizes[i] + 1, -1)) - 1
        fill, home = fills.pop(j) if j >= 0 else (0, i)
        out[i] = (home, fill)
        insort(fills, (fill + sizes[i], home))
    return out


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = "byte_bpe_50k.json",
    capacity: int = 1024,
    end_id: int = 0,
    open_windows: int = 64,
    merge_group: int = 256,
    kept_words: int = KEPT_WORDS,
) -> DataFrame:
    """Pieces of the packed documents: which ids of which document lie where in which sequence.

    ``start`` counts the document's ids before the piece, ``offset`` the tokens before it in its
    sequence, without gaps. A sequence holds at most ``capacity`` tokens. Fewer ``kept_words`` spare a
    worker's memory at the cost of time.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    raw = cut(source.mapInArrow(lambda it: _pack_partition(it, vocabulary, capacity, open_windows, end_id, kept_words), _RAW))
    left = raw.filter("open")
    n_left = left.agg(F.count_distinct("sequence_id")).first()[0]
    groups = max(1, -(-n_left // merge_group))

    def merge(pdf):
        pdf = pdf.sort_values(["sequence_id", "offset"], kind="stable")
        sizes = pdf.groupby("sequence_id")["length"].sum()
        to = merge_windows(sizes.tolist(), capacity)
        home = {w: (int(sizes.index[h]), off) for w, (h, off) in zip(sizes.index, to)}
        pdf["offset"] += [home[w][1] for w in pdf["sequence_id"]]
        pdf["sequence_id"] = [home[w][0] for w in pdf["sequence_id"]]
        return pdf.drop(columns=["open", "part_group"])

    merged = left.withColumn("part_group", F.pmod(F.xxhash64("sequence_id"), F.lit(groups))).groupBy("part_group").applyInPandas(merge, PIECES)
    return raw.filter("not open").drop("open").unionByName(merged)
