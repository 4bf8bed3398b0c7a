"""Product codes of vectors: Lloyd's method over the distinct integer values of each part.

Components become floor(scale * x), and a vector is cut into equal parts. Equal values of a part position are
one row with a weight, so each round of Lloyd's method reads distinct values only: their nearest entries,
then weighted sums an entry. Codebooks start from the vectors of the smallest ids; codes and errors of the
distinct values are joined back to the vectors. All of it is whole numbers, so results are exact.

Defined cases: rows whose vector is null, empty or holds a null or non-finite component take no part,
and neither does one whose size isn't a multiple of ``parts`` or isn't that of the vector with the
smallest id; a null id sorts first; rows with one id sort by vector, then label; repeated rows have a
weight and a result each; ties go to the lower entry; fewer vectors than entries give fewer entries;
an entry without parts stays; null labels are one label; an empty table gives no rows; other columns are
not read. Sums and errors past a long raise.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import cut
from pairlab.llm.vectors import finite

_ASSIGNED = "position int, part array<long>, weight long, code int, error long"
_CHUNK = 4096


def nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest entry of each row, ties to the lower; exact whole numbers."""
    most = max(int(np.abs(values).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * most * most * max(1, values.shape[1]) < 2**53:
        v, b = values.astype(np.float64), book.astype(np.float64)
    else:
        v, b = values.astype(object), book.astype(object)
    d = (v * v).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (v @ b.T)
    code = d.argmin(axis=1)
    return code, np.array([int(x) for x in d[np.arange(len(d)), code]], np.int64)


def _matrix(lists, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def assigned(distinct: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """Each distinct value (position, part, weight) with its code and error."""
    width = books[0].shape[1]

    def run(batches):
        for b in batches:
            if b.num_rows:
                position = b.column(0).to_numpy()
                values = _matrix(b.column(1), width)
                code, error = np.zeros(len(values), np.int32), np.zeros(len(values), np.int64)
                for p in np.unique(position).tolist():
                    rows = np.flatnonzero(position == p)
                    for lo in range(0, len(rows), _CHUNK):
                        at = rows[lo : lo + _CHUNK]
                        code[at], error[at] = nearest(values[at], books[p])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code), pa.array(error)], names=["position", "part", "weight", "code", "error"])

    return distinct.mapInArrow(run, _ASSIGNED)


def next_books(distinct: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after a round: each entry the componentwise floor of its parts' mean."""
    width = books[0].shape[1]
    sums = [F.sum(F.col("part")[i] * F.col("weight")).alias(f"s{i}") for i in range(width)]
    # At most parts times entries rows.
    found = assigned(distinct, books).groupBy("position", "code").agg(F.sum("weight").alias("n"), *sums).collect()
    out = [b.copy() for b in books]
    for r in found:
        out[r.position][r.code] = [r[f"s{i}"] // r.n for i in range(width)]  # floor division goes down
    return out


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components as decimals, by part, entry and position within the part, with commas between."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(
    rows: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256
) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, codes array<int>, error) of each vector that takes part, and the codebook of each part position."""
    spark = rows.sparkSession
    vec = F.col(vec_col).cast("array<double>")
    named = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.transform(F.when(finite(vec), vec), lambda x: F.floor(x * scale)).alias("whole"))
    usable = named.filter(F.col("whole").isNotNull() & (F.size("whole") % parts == 0))
    # entries rows at most.
    start = usable.orderBy(F.col("vec_id").asc_nulls_first(), "whole", "label").limit(entries).collect()
    if not start:
        return spark.createDataFrame([], "vec_id long, label long, codes array<int>, error long"), []
    width = len(start[0].whole) // parts
    books = [np.array([r.whole[p * width : (p + 1) * width] for r in start if len(r.whole) == parts * width], np.int64) for p in range(parts)]

    # A row's number is kept with the row, so that it is the same for all that read it.
    base = cut(usable.filter(F.size("whole") == parts * width).withColumn("row", F.monotonically_increasing_id()))
    each = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("whole", p * width + 1, width))
    exploded = base.select("row", "vec_id", "label", F.posexplode(each).alias("position", "part"))
    distinct = cut(exploded.groupBy("position", "part").agg(F.count(F.lit(1)).alias("weight")))
    for _ in range(rounds):
        books = next_books(distinct, books)
    coded = assigned(distinct, books).drop("weight")
    back = exploded.join(coded, ["position", "part"]).groupBy("row", "vec_id", "label").agg(
        F.sort_array(F.collect_list(F.struct("position", "code"))).alias("own"), F.sum("error").alias("error")
    )
    return back.select("vec_id", "label", F.col("own.code").alias("codes"), "error"), books


def digests(rows: DataFrame, **options) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): codes in hex, and the error summed over equal labels."""
    found, books = compress(rows, **options)
    found = cut(found)
    hexed = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c.cast("long"))), 2, "0")), "")
    totals = found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return found.join(totals, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", hexed.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
