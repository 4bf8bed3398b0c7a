"""Tables computed once and kept in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast.
BROADCAST_ROWS = 100_000


def _checkpoint_dir(spark) -> str:
    """The session's checkpoint folder, set from spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="pairlab-checkpoint-"))
    return sc.getCheckpointDir()


def materialized(df: DataFrame) -> DataFrame:
    """df computed once, in the session's checkpoint folder and without its lineage, for tables that several branches read.

    The driver's JVM is then asked to collect, on which Spark drops the shuffle files of plans that are done.
    """
    _checkpoint_dir(df.sparkSession)
    found = df.checkpoint(eager=True)
    df.sparkSession.sparkContext._jvm.System.gc()
    return found


def small(df: DataFrame) -> DataFrame:
    """df marked for broadcast if its rows, counted up to the bound, are within BROADCAST_ROWS; else df as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def shared_folder(spark, name: str) -> str:
    """A new folder's path for tables that a query writes and reads again, beside the checkpoints."""
    return f"{_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
