"""Where operators keep tables between their steps.

Steps are cut by tables written to the folder that all executors share
(``spark.checkpoint.dir``), so a lost executor costs a reread, never a recompute
of the whole job, and no step depends on local disks. Once a step's table is
written, the shuffle files that made it are deleted.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

BROADCAST_ROWS = 200_000  # of at most some 100 bytes a row, the most that is ever broadcast; counted before
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session. Where none is set and the master is local (tests
    on one machine), a temporary one is made and set for the session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="strataline-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/strataline/{name}-{uuid.uuid4().hex}"


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs run in here delete their shuffle files when they end."""
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREE_SHUFFLES) if before is None else spark.conf.set(_FREE_SHUFFLES, before)


class Steps:
    """The tables between the steps of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self._paths: list[tuple[DataFrame, str]] = []

    def table(self, df: DataFrame, step: str) -> DataFrame:
        """Write ``df`` to the shared folder and read it back: lineage ends here."""
        path = new_folder(self.spark, f"{self.name}_{step}")
        with freeing_shuffles(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df, path in self._paths:
            if any(df is t for t in tables):
                discard(self.spark, path)
        self._paths = [(df, path) for df, path in self._paths if not any(df is t for t in tables)]

    def drop_others(self, *kept: DataFrame) -> None:
        self.drop(*(df for df, _ in self._paths if not any(df is k for k in kept)))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, for a table that stays."""
    return Steps(df.sparkSession, name).table(df, "table")


def beside(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a written table of narrow rows, as the smaller side of a join: broadcast if it is counted to have at
    most ``rows``, else shuffled as it is, so that adaptive execution can split a large key of the other side."""
    return F.broadcast(df) if df.count() <= rows else df


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`new_folder` whose rows nothing reads any more."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
