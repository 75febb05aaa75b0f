"""Stored tables changed in place: only partitions that a change touches are read and written (R4-R7, S12-S15), and
only buckets that late readings have reached are rolled up anew (R12, R13).

Readings, samples and rollups have a folder a day (`dt`), bills a folder a month (`ym`). Days are found from the
partitions' names where the change says which they are, else by a scan of the one column that tells.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import time_bucket
from ..sources import ingest as S
from ..sources.tables import Files, days_with, finish_swaps, partitions, rewrite_partitions
from . import registry as R
from .deltas import rollup

_KINDS = {"timestamp": T.TimestampType(), "string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "date": T.DateType()}


def _schema(columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in map(str.split, columns.split(","))])


READINGS = _schema("ts timestamp, msg_type string, endpoint_id long, endpoint_type int, consumption double, raw string, source string, dt date")
ROLLUP = _schema("endpoint_id long, bucket timestamp, min_c double, max_c double, n long, dt date")
SAMPLES = _schema("ts timestamp, entity_id string, power_w double, src string, dt date")
HVAC = _schema("ts timestamp, entity_id string, action string, src string, dt date")
BILLS = _schema("statistic_id string, period string, ts timestamp, kwh double, ym string")


def by_day(rows: DataFrame, at: str = "ts") -> DataFrame:
    return rows.withColumn("dt", F.to_date(at))


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at path, after what an interrupted change has left."""
    finish_swaps(spark, path)
    return spark.read.schema(schema).option("basePath", path).parquet(path) if partitions(spark, path, schema.names[-1]) else spark.createDataFrame([], schema)


def retain_newer(spark: SparkSession, path: str, as_of: datetime, days: int, schema: T.StructType = READINGS, at: str = "ts") -> None:
    """Whole days before the limit go without being read; the day of the limit is rewritten."""
    limit = as_of - timedelta(days=days)
    day, files = limit.date().isoformat(), Files(spark, path)
    finish_swaps(spark, path)
    for old in [d for d in partitions(spark, path, "dt") if d < day]:
        files.remove(f"{path}/dt={old}")
    moment = F.lit(limit.isoformat(" ")).cast("timestamp")
    rewrite_partitions(spark, path, "dt", [d for d in partitions(spark, path, "dt") if d == day], lambda rows: rows.where(F.col(at) >= moment), schema)


def scrub_zeros_in_place(spark: SparkSession, path: str, schema: T.StructType = READINGS) -> None:
    """Days that hold a reading without value are rewritten."""
    rewrite_partitions(spark, path, "dt", days_with(read(spark, path, schema), F.col("consumption") <= 0), R.scrub_zeros, schema)


def drop_source_in_place(spark: SparkSession, path: str, source: str, schema: T.StructType = READINGS) -> None:
    """Days that hold a row of the receiver are rewritten."""
    rewrite_partitions(spark, path, "dt", days_with(read(spark, path, schema), F.col("source") == source), lambda rows: R.drop_source(rows, source), schema)


def purge_meters_in_place(spark: SparkSession, path: str, ids: DataFrame, schema: T.StructType = READINGS) -> None:
    """Days that hold a row of the meters ids(endpoint_id) are rewritten."""
    own = read(spark, path, schema).join(ids.select("endpoint_id").distinct(), "endpoint_id", "left_semi")
    rewrite_partitions(spark, path, "dt", days_with(own, F.lit(True)), lambda rows: R.purge_meters(rows, ids), schema)


def upsert_utility_in_place(spark: SparkSession, path: str, fresh: DataFrame) -> None:
    """Months of the fresh bills are rewritten."""
    new = fresh.withColumn("ym", F.date_format("ts", "yyyy-MM"))
    upsert = lambda rows: S.upsert_utility(rows.drop("ym"), new.drop("ym")).withColumn("ym", F.date_format("ts", "yyyy-MM"))
    rewrite_partitions(spark, path, "ym", days_with(new, F.col("ts").isNotNull(), "ym"), upsert, BILLS)


def keep_only_utility_in_place(spark: SparkSession, path: str, statistic_id: str, period: str) -> None:
    """Months that hold another statistic or period are rewritten."""
    other = ~(F.col("statistic_id").eqNullSafe(statistic_id) & F.col("period").eqNullSafe(period))
    rewrite_partitions(spark, path, "ym", days_with(read(spark, path, BILLS), other, "ym"), lambda rows: S.keep_only_utility(rows, statistic_id, period), BILLS)


def replace_backfill_in_place(spark: SparkSession, path: str, entity_id: str, start: datetime, end: datetime, rows: DataFrame, kind: str = "lts_backfill", schema: T.StructType = SAMPLES) -> None:
    """The days of [start, end], and those of the new rows, are rewritten."""
    first, last = start.date().isoformat(), end.date().isoformat()
    days = {d for d in partitions(spark, path, "dt") if first <= d <= last} | set(days_with(by_day(rows), F.col("ts").isNotNull()))
    span = [F.lit(t.isoformat(" ")).cast("timestamp") for t in (start, end)]
    change = lambda old: by_day(S.replace_backfill(old.drop("dt"), entity_id, *span, rows.drop("dt"), kind))
    rewrite_partitions(spark, path, "dt", sorted(days), change, schema)


# rollups that late readings reach


def materialise_rollup(readings: DataFrame, minutes: int, path: str, until: datetime) -> None:
    """The rollup of all buckets that end by `until`, a folder a day: what R13 takes as materialised."""
    rows = readings.where(F.col("ts") < F.lit(until.isoformat(" ")).cast("timestamp"))
    by_day(rollup(rows, minutes), "bucket").select(*ROLLUP.names).hint("rebalance", "dt").write.partitionBy("dt").parquet(path)


def log_late(batch: DataFrame, number: int, minutes: int, log: str, until: datetime) -> None:
    """The buckets that readings of a batch reach in what is materialised until `until`; a folder a batch, written
    anew if the batch runs again."""
    late = batch.where("endpoint_id is not null and consumption is not null").where(F.col("ts") < F.lit(until.isoformat(" ")).cast("timestamp"))
    late = rollup(late, minutes).select("endpoint_id", "bucket", F.to_date("bucket").alias("dt"))
    late.write.mode("overwrite").parquet(f"{log}/batch={number}")


def refresh_late(spark: SparkSession, minutes: int, path: str, readings: DataFrame, log: str) -> int:
    """Roll up anew, from the whole of the readings, the logged buckets and no others, and take them off the
    log. No range has to be named. readings has a partition column `dt`, of which only the buckets' days are
    read. Returns the number of buckets. A run that dies is repeated: the log goes last."""
    files = Files(spark, log)
    batches = [n for n in files.names(log) if n.startswith("batch=") and files.exists(f"{log}/{n}/_SUCCESS")]
    if not batches:
        return 0
    dirty = spark.read.schema("endpoint_id long, bucket timestamp, dt date").parquet(*[f"{log}/{n}" for n in batches]).distinct()
    days = days_with(dirty, F.lit(True))
    keys = ["endpoint_id", "bucket"]

    def change(old: DataFrame) -> DataFrame:
        own = readings.where(F.col("dt").isin([datetime.fromisoformat(d).date() for d in days])).withColumn("bucket", time_bucket(F.col("ts"), minutes))
        fresh = rollup(own.join(dirty.select(*keys), keys, "left_semi"), minutes)
        return by_day(old.join(dirty.select(*keys), keys, "left_anti").drop("dt").unionByName(fresh), "bucket")

    count = dirty.count()
    rewrite_partitions(spark, path, "dt", days, change, ROLLUP)
    for n in batches:
        files.remove(f"{log}/{n}")
    return count
