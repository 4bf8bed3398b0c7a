"""Helpers shared by the operators: materialised cuts and bounded broadcasts."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast; past it the join is shuffled.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, from spark.checkpoint.dir.

    Only a local session that has none gets a temporary folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="pairlab-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, without its lineage."""
    spark = df.sparkSession
    where = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    found = df.checkpoint(eager=True)
    _free_shuffles(spark)
    return found


def _free_shuffles(spark: SparkSession) -> None:
    """Spark drops the shuffle files of finished queries once the driver's JVM has collected their plans; asks it to."""
    spark.sparkContext._jvm.System.gc()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; removed when Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes path wherever its file system keeps it; a stopped session leaves it."""
    jvm = spark.sparkContext._jvm
    if spark.sparkContext._jsc is None or jvm is None:
        return
    try:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception as e:  # the JVM may already be gone at exit
        if not isinstance(e, (ConnectionError, OSError)) and "Py4J" not in type(e).__name__:
            raise


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: for wide rows, where checkpoint() is bulky."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    _free_shuffles(spark)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Removes tables of written() that nothing will read again."""
    for t in tables:
        remove(t.sparkSession, t.written_at)


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if its counted rows are within BROADCAST_ROWS, else df as it is."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of a text column that a Python worker turns into strings at a time; a bound of memory.
SLICE_BYTES = 500_000


def text_slices(batches, column: int = 1):
    """The record batches cut so that each holds about SLICE_BYTES of its text column, but a text at least.

    Only Arrow's offsets are read for it; strings are made of a slice alone.
    """
    import numpy as np
    import pyarrow as pa

    for b in batches:
        sizes = byte_lengths(b.column(column))
        part = np.cumsum(sizes) // SLICE_BYTES
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
        for lo, hi in zip(starts, [*starts[1:], b.num_rows]):
            yield b.slice(int(lo), int(hi - lo))
    pa.default_memory_pool().release_unused()
    _trim()


def byte_lengths(texts):
    """Bytes of each text of an Arrow column; 0 for null."""
    import numpy as np
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


_slot: list = []


def _trim() -> None:
    """Gives freed memory back to the machine, where the C library can."""
    getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)


def forget() -> None:
    """Drops what another operator left in this Python worker."""
    if _slot:
        _slot.clear()
        gc.collect()
        _trim()


def in_worker(key, make: Callable):
    """make() of the first call with this key, kept between the tasks of a Python worker.

    A worker keeps one such object at a time, for its memory is bounded: operators that follow one
    another don't hold each other's vocabularies.
    """
    if not _slot or _slot[0][0] != key:
        forget()
        _slot.append((key, make()))
    return _slot[0][1]
