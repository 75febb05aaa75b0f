"""Tables of Parquet folders that change in place: parts that merge by key, and partitions that are rewritten alone.

Both work through Hadoop's file system, so on any store that Spark writes to. Every change is made ready beside the
table, then put in place by renames and deletions that can be repeated: a job that dies in between is taken up by
the next call.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Files:
    """The few calls on folders that Spark's reader and writer do not have."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        context = spark.sparkContext
        self._path = context._jvm.org.apache.hadoop.fs.Path
        self._fs: JavaObject = self._path(root).getFileSystem(context._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        """Names in a folder; none if it does not exist."""
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(path))) if self.exists(path) else []

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def move(self, source: str, target: str) -> None:
        self._fs.mkdirs(self._path(target).getParent())
        if not self._fs.rename(self._path(source), self._path(target)):
            raise OSError(f"{source} could not be moved to {target}")


# tables that merge by key

_PARTS = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])


@dataclass(frozen=True)
class MergedTable:
    """A keyed table that batches are added to. A batch is written as a part of level 0; `fanout` parts of a level are
    merged into one of the next, so there are at most `fanout` - 1 parts a level, the number of levels grows with
    the logarithm of the batches, and what a batch costs does not depend on how many came before: a key is
    written again once a level.

    merge gives one row a key of the rows of several parts; parts may be merged in any grouping. Batches are numbered
    from 0 on, without gaps, as foreachBatch does. The list of live parts is written last: a batch that died is
    written anew, and a batch that is in the list already changes nothing.
    """

    path: str
    merge: Callable[[DataFrame], DataFrame]
    fanout: int = 8

    def _part(self, part: tuple[int, int, int]) -> str:
        return f"{self.path}/parts/level={part[0]}/batches={part[1]}-{part[2]}"

    def _lists(self, spark: SparkSession) -> list[int]:
        """Numbers of the batches whose lists are kept; a list counts once Spark has marked it complete."""
        files = Files(spark, self.path)
        names = [n.removeprefix("batch=") for n in files.names(f"{self.path}/lists") if n.startswith("batch=")]
        return sorted(int(n) for n in names if files.exists(f"{self.path}/lists/batch={n}/_SUCCESS"))

    def parts(self, spark: SparkSession) -> list[tuple[int, int, int]]:
        """(level, first batch, last batch) of the live parts, oldest first."""
        lists = self._lists(spark)
        if not lists:
            return []
        rows = spark.read.schema(_PARTS).parquet(f"{self.path}/lists/batch={lists[-1]}").collect()  # a few a level
        return sorted((tuple(r) for r in rows), key=lambda p: p[1])

    def add(self, batch: DataFrame, number: int) -> None:
        """The rows of batch(one row a key) as batch `number`."""
        spark = batch.sparkSession
        lists = self._lists(spark)
        if lists and number <= lists[-1]:
            return  # a replay
        live = self.parts(spark)
        part = (0, number, number)
        batch.write.mode("overwrite").parquet(self._part(part))
        live.append(part)
        level = 0
        while len(same := [p for p in live if p[0] == level]) >= self.fanout:
            merged = (level + 1, same[0][1], same[-1][2])
            self._read(spark, same, batch.schema).write.mode("overwrite").parquet(self._part(merged))
            live = [p for p in live if p[0] != level] + [merged]
            level += 1
        spark.createDataFrame(live, _PARTS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/lists/batch={number}")
        self._clean(spark, live)

    def _read(self, spark: SparkSession, parts: list[tuple[int, int, int]], schema: T.StructType) -> DataFrame:
        return self.merge(spark.read.schema(schema).parquet(*[self._part(p) for p in parts]))

    def _clean(self, spark: SparkSession, live: list[tuple[int, int, int]]) -> None:
        """Remove lists but the last two, and parts that neither of these has: readers of the last list are done by then."""
        files = Files(spark, self.path)
        lists = self._lists(spark)
        before = spark.read.schema(_PARTS).parquet(f"{self.path}/lists/batch={lists[-2]}").collect() if len(lists) > 1 else []
        wanted = {*live, *(tuple(r) for r in before)}
        for level in files.names(f"{self.path}/parts"):
            for name in files.names(f"{self.path}/parts/{level}"):
                first, last = name.removeprefix("batches=").split("-")
                if (int(level.removeprefix("level=")), int(first), int(last)) not in wanted:
                    files.remove(f"{self.path}/parts/{level}/{name}")
        for n in lists[:-2]:
            files.remove(f"{self.path}/lists/batch={n}")

    def read(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """One row a key of all batches."""
        live = self.parts(spark)
        return self._read(spark, live, schema) if live else spark.createDataFrame([], schema)


# partitions rewritten alone


def partitions(spark: SparkSession, path: str, by: str) -> list[str]:
    """Values of the partition column that have a folder."""
    return [n.removeprefix(f"{by}=") for n in Files(spark, path).names(path) if n.startswith(f"{by}=")]


def finish_swaps(spark: SparkSession, path: str) -> None:
    """Put in place what an earlier rewrite has made ready in full; drop what it has not."""
    files = Files(spark, path)
    for name in files.names(f"{path}/_staged"):
        staged = f"{path}/_staged/{name}"
        if files.exists(f"{staged}/touched/_SUCCESS"):
            for folder, full in spark.read.schema("folder string, full boolean").parquet(f"{staged}/touched").collect():  # a row a partition
                ready = files.exists(f"{staged}/rows/{folder}")  # else it is in place already, or has no rows now
                if ready or not full:
                    files.remove(f"{path}/{folder}")
                if ready:
                    files.move(f"{staged}/rows/{folder}", f"{path}/{folder}")
        files.remove(staged)


def rewrite_partitions(spark: SparkSession, path: str, by: str, touched: list[str], change: Callable[[DataFrame], DataFrame], schema: T.StructType) -> None:
    """Replace the rows of the partitions `touched` (values of the column `by`) of the table at path by
    change(their rows); a partition that has no rows then goes. Only their files are read, and no other partition's
    files change. change must keep rows within `touched`; others are an error before anything changes.

    The new rows are written beside the table first, so change may read the table itself; a large partition is
    several tasks' work. schema is the table's, `by` included. One rewrite of a table runs at a time.
    """
    finish_swaps(spark, path)
    if not touched:
        return
    files = Files(spark, path)
    here = [f"{path}/{by}={t}" for t in touched if files.exists(f"{path}/{by}={t}")]
    rows = spark.read.schema(schema).option("basePath", path).parquet(*here) if here else spark.createDataFrame([], schema)
    staged = f"{path}/_staged/{uuid.uuid4().hex}"
    change(rows).select(*schema.names).hint("rebalance", by).write.partitionBy(by).parquet(f"{staged}/rows")
    made = {n for n in files.names(f"{staged}/rows") if n.startswith(f"{by}=")}
    if stray := made - {f"{by}={t}" for t in touched}:
        files.remove(staged)
        raise ValueError(f"rows outside of the partitions that may change: {sorted(stray)[:5]}")
    moves = [(f"{by}={t}", f"{by}={t}" in made) for t in touched]
    spark.createDataFrame(moves, "folder string, full boolean").coalesce(1).write.parquet(f"{staged}/touched")
    finish_swaps(spark, path)


def days_with(rows: DataFrame, test: Column, by: str = "dt") -> list[str]:
    """Partitions that have a row of which test holds: as many as days at most."""
    return [r["day"] for r in rows.where(test).select(F.col(by).cast("string").alias("day")).distinct().collect()]
