"""What jobs need of the cluster: a folder that driver and executors share, tables in it that cut lineage, and the package on the executors."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are sent to every task at most; larger sides are joined by a shuffle.
FEW_ROWS = 1_000_000
#: Spark's own setting: shuffle files go with the query that made them, not only when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_results: list[str] = []
_own: list[str] = []
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Where it names none a temporary one will do, but in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return _own[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    files, at = _at(spark, path)
    files.delete(at, True)


class Tables:
    """The tables of one call in the shared folder: later steps survive lost executors and do not compute them again.

    As a context it deletes what is left in it where the call fails. What a result still reads is deleted by ``drop_results``, or when
    the application ends. lean: what a table's job has shuffled is deleted as soon as the table is written.
    """

    def __init__(self, spark: SparkSession, lean: bool = False) -> None:
        self.spark, self.paths, self.lean = spark, [], lean

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *failure) -> None:
        self.drop()

    def path(self, name: str) -> str:
        """A new path that belongs to the call."""
        path = scratch_path(self.spark, name)
        self.paths.append(path)
        return path

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        before = self.spark.conf.get(CLEANUP, None)
        if self.lean:
            self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            if self.lean:
                self.spark.conf.set(CLEANUP, before or "false")
        return self.spark.read.schema(df.schema).parquet(path)

    def spread(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """A table whose rows are dealt out by a key to as many tasks as the cluster runs, for steps that make many rows of each."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return self.write(df.repartition(max(n, self.spark.sparkContext.defaultParallelism), key), name)

    def drop(self, since: int = 0, until: int | None = None) -> None:
        """Delete tables that nothing reads any more."""
        for path in self.paths[since:until]:
            delete(self.spark, path)
        del self.paths[since:until]

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table that the caller's result reads, and delete all others of this call."""
        held = len(self.paths)
        out = self.write(df, name)
        self.drop(0, held)
        self.keep()
        return out

    def keep(self) -> None:
        """Leave what is there to ``drop_results``."""
        for path in self.paths:
            files, at = _at(self.spark, path)
            files.deleteOnExit(at)
        _results.extend(self.paths)
        self.paths = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back; it stays until ``drop_results`` or the end of the application."""
    return Tables(df.sparkSession).result(df, name)


def folder(spark: SparkSession, name: str) -> str:
    """A path to write to in a new folder of the shared folder, which goes as results do."""
    tables = Tables(spark)
    path = tables.path(name)
    files, at = _at(spark, path)
    files.mkdirs(at)
    tables.keep()
    return f"{path}/data"


def drop_results(spark: SparkSession) -> None:
    """Delete the tables that results of earlier calls read; call it when none of them is used any more."""
    while _results:
        delete(spark, _results.pop())


def small_side(df: DataFrame, bound: int | None = None) -> DataFrame:
    """df, which has to be a written table, broadcast where it has few rows."""
    bound = FEW_ROWS if bound is None else bound
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def ship(spark: SparkSession) -> None:
    """Before a step in Python: send the package to the executors, once for an application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        package = Path(__file__).resolve().parent
        base = Path(tempfile.mkdtemp(prefix="spark-")) / package.name
        context.addPyFile(shutil.make_archive(str(base), "zip", package.parent, package.name))
