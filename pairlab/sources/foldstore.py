"""Results kept by fold: what is there is not computed again.

A store is a folder with one table a name, partitioned by fold, and a table of keys that says which results
are complete, with a digest of what they were computed from. Keys are written last, so results of a job
that broke off are not taken for complete; they are replaced when their fold is written again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.checkpoints import materialized

DONE = "keys"


class FoldStore:
    """Tables under ``path`` whose rows belong to the keys ``keys``; ``fold`` is the key that partitions them."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], fold: str = "fold_id"):
        if fold not in keys:
            raise ValueError(f"{fold} must be one of the keys")
        self.spark, self.path, self.keys, self.fold = spark, path.rstrip("/"), keys, fold

    def _there(self, name: str) -> bool:
        return name in self._tables()

    def _rows(self, name: str) -> DataFrame:
        """All rows of a table; its schema is kept beside it, as a table without rows has no file and partitions lose their key's type."""
        schema = self.spark.read.parquet(f"{self.path}/_schemas/{name}").schema
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def read(self, name: str) -> DataFrame:
        """A table's rows of complete keys."""
        return self._rows(name).join(self.done().select(*self.keys), self.keys, "left_semi")

    def done(self) -> DataFrame | None:
        """(keys, digest, written_at) of complete results; none in an empty store."""
        return self._rows(DONE) if self._there(DONE) else None

    def digest(self, wanted: DataFrame) -> DataFrame:
        """wanted with ``digest`` over all its columns, by name: another input is another result."""
        return wanted.withColumn("digest", F.xxhash64(F.to_json(F.struct(*sorted(wanted.columns)), {"ignoreNullFields": "false"})))

    def missing(self, wanted: DataFrame) -> DataFrame:
        """The rows of ``wanted`` whose results are absent or were computed from something else."""
        done, asked = self.done(), self.digest(wanted)
        return (asked if done is None else asked.join(done.select(*self.keys, "digest"), [*self.keys, "digest"], "left_anti")).drop("digest")

    def _put(self, name: str, df: DataFrame) -> None:
        """Replaces the folds that df has; other folds stay."""
        df.limit(0).write.mode("overwrite").parquet(f"{self.path}/_schemas/{name}")
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(self.fold).parquet(f"{self.path}/{name}")

    def fill(self, wanted: DataFrame, compute: Callable[[DataFrame], dict[str, DataFrame]]) -> dict[str, DataFrame]:
        """The tables of ``wanted`` (a row a key, with what results depend on): compute(missing rows) for what is missing, the store for the rest.

        Folds with something missing are rewritten from their stored and new rows; folds without are not touched. A key that
        gives no rows is complete too. Stored keys that ``wanted`` lacks stay in the store and out of the answer.
        """
        wanted = materialized(wanted)
        new = materialized(self.missing(wanted))
        if new.limit(1).count():
            done = self.done()
            folds = new.select(self.fold).distinct()  # a handful of rows
            replaced = new.select(*self.keys)
            for name, df in compute(new).items():
                if self._there(name) and done is not None:
                    kept = self.read(name).join(F.broadcast(folds), self.fold, "left_semi").join(replaced, self.keys, "left_anti")
                    # Read before its folds are written anew; only folds with something new.
                    df = df.unionByName(materialized(kept), allowMissingColumns=True)
                self._put(name, df)
            keys = self.digest(new).select(*self.keys, "digest").withColumn("written_at", F.current_timestamp())
            if done is not None:
                kept = done.join(F.broadcast(folds), self.fold, "left_semi").join(replaced, self.keys, "left_anti")
                keys = keys.unionByName(materialized(kept))
            self._put(DONE, keys)
        asked = wanted.select(*self.keys)
        names = [n for n in self._tables() if n != DONE]
        return {n: self.read(n).join(asked, self.keys, "left_semi") for n in names}

    def _tables(self) -> list[str]:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory() and not s.getPath().getName().startswith("_")) if fs.exists(at) else []
