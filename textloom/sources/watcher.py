"""Watched folders: what is new, changed, moved between indexes or gone since the last poll, across restarts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "path string, modified timestamp, bytes long, index string"


def listing(spark: SparkSession, folder: str, index: Callable[[Column], Column], pattern: str = "*") -> DataFrame:
    """(path, modified, bytes, index) of the files under a folder that ``index(path)`` names an index for.

    Files are listed by Spark, and not opened.  A folder that is not there has no files.
    """
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not top.getFileSystem(spark._jsc.hadoopConfiguration()).exists(top):
        return spark.createDataFrame([], STATE)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    rows = found.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
    return rows.withColumn("index", index(F.col("path"))).where("index is not null")


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, index, change) between two listings: new, changed (time, size, or index), gone.

    What moved to another index is gone from the first one and changed in the second.
    """
    old = before.select("path", F.struct("modified", "bytes", "index").alias("old"))
    new = now.select("path", F.struct("modified", "bytes", "index").alias("new"))
    met = old.join(new, "path", "full")
    moved = F.col("old").isNotNull() & F.col("new").isNotNull() & ~F.col("old.index").eqNullSafe(F.col("new.index"))
    here = F.when(F.col("old").isNull(), "new").when(F.col("new").isNotNull() & ~F.col("old").eqNullSafe(F.col("new")), "changed")
    rows = F.array(
        F.struct(F.col("new.index").alias("index"), here.alias("change")),
        F.struct(F.col("old.index").alias("index"), F.when(F.col("new").isNull() | moved, "gone").alias("change")),
    )
    return met.select("path", F.explode(rows).alias("x")).select("path", "x.*").where("change is not null")


class Watcher:
    """Polls a listing and hands on what changed.

    What was last handed on is kept below ``state``, a listing for each poll that
    changed anything.  A poll writes it after ``handle`` returned: a poll that broke off
    is told again by the next one, also after a restart, so ``handle`` must bear it.
    """

    def __init__(self, spark: SparkSession, state: str, listed: Callable[[], DataFrame]):
        self.spark, self.state, self.listed = spark, state.rstrip("/"), listed

    def _fs(self):
        top = self.spark._jvm.org.apache.hadoop.fs.Path(self.state)
        return top, top.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        top, fs = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
        whole = [n for n in names if n.startswith("poll=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(top, f"{n}/_SUCCESS"))]
        return sorted(int(n[5:]) for n in whole)

    def seen(self) -> DataFrame:
        """The listing that was last handed on."""
        versions = self._versions()
        return self.spark.read.schema(STATE).parquet(f"{self.state}/poll={versions[-1]}") if versions else self.spark.createDataFrame([], STATE)

    def poll(self, handle: Callable[[DataFrame], None]) -> dict[str, int]:
        """Hand the changes since the last poll to ``handle``, if there are any; how many of each kind there were."""
        from textloom.plans.tasks import written

        now = written(self.listed())
        found = written(changes(self.seen(), now))
        counts = {r["change"]: r["count"] for r in found.groupBy("change").count().collect()}  # three rows at most
        if counts:
            handle(found)
            versions = self._versions()
            now.write.mode("overwrite").parquet(f"{self.state}/poll={versions[-1] + 1 if versions else 0}")
            top, fs = self._fs()
            for old in versions[:-1]:
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(top, f"poll={old}"), True)
        return counts
