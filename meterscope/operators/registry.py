"""Registries and table maintenance (R1-R9, R14, R15). All take and give DataFrames; maintenance.py changes stored
tables by them, a partition at a time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import time_bucket


def _index_aggs() -> list[Column]:
    latest = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("ts", F.col(c).alias("v"))))["v"].alias(c)
    return [
        latest("msg_type"), latest("endpoint_type"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("packets"),
        F.min("consumption").alias("min_consumption"), F.max("consumption").alias("max_consumption"),
        F.max(F.when(F.col("consumption").isNotNull(), F.struct("ts", "consumption")))["consumption"].alias("last_consumption"),
        F.max(F.when(F.col("consumption").isNotNull(), F.col("ts"))).alias("last_consumption_ts"),
    ]


def meter_index(readings: DataFrame) -> DataFrame:
    """What is known of each meter; latest non-null types, value by time (ties: the larger)."""
    return readings.where("endpoint_id is not null").groupBy("endpoint_id").agg(*_index_aggs())


def index_by_bucket(readings: DataFrame, minutes: int) -> DataFrame:
    """Registry rows of each meter and bucket, in one pass over the readings. Rollups (R10, R11) and the registry
    follow from them without the readings: see rollup_of_parts and merge_parts."""
    return readings.where("endpoint_id is not null").groupBy("endpoint_id", time_bucket(F.col("ts"), minutes).alias("bucket")).agg(*_index_aggs(), F.count("consumption").alias("n"))


def rollup_of_parts(parts: DataFrame) -> DataFrame:
    """R10, R11 of index_by_bucket."""
    return parts.where("n > 0").select("endpoint_id", "bucket", F.col("min_consumption").alias("min_c"), F.col("max_consumption").alias("max_c"), "n")


def merge_parts(parts: DataFrame) -> DataFrame:
    """R1 of index_by_bucket."""
    return merge_indexes(parts.drop("bucket", "n"))


def merge_index(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two meter indexes as one."""
    return merge_indexes(old.unionByName(new))


def merge_indexes(parts: DataFrame) -> DataFrame:
    """R1 of the rows of several indexes; every field merges, so a stream adds batches up with this."""
    latest = lambda c, t: F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(t).alias("t"), F.col(c).alias("v"))))["v"].alias(c)
    return parts.groupBy("endpoint_id").agg(
        latest("msg_type", "last_seen"), latest("endpoint_type", "last_seen"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("packets").alias("packets"),
        F.min("min_consumption").alias("min_consumption"), F.max("max_consumption").alias("max_consumption"),
        latest("last_consumption", "last_consumption_ts"), F.max("last_consumption_ts").alias("last_consumption_ts"),
    )


def meter_source(readings: DataFrame) -> DataFrame:
    """R2: packets and last time by meter and receiver."""
    return readings.where("source is not null and source <> ''").groupBy("endpoint_id", "source").agg(F.count("*").alias("packets"), F.max("ts").alias("last_seen"))


def merge_sources(parts: DataFrame) -> DataFrame:
    """R2 of several parts, such as a stream's batches."""
    return parts.groupBy("endpoint_id", "source").agg(F.sum("packets").alias("packets"), F.max("last_seen").alias("last_seen"))


def heartbeat_of_sources(coverage: DataFrame) -> DataFrame:
    """R3 of R2: every packet of a receiver is of some meter."""
    return coverage.groupBy("source").agg(F.max("last_seen").alias("last_ts"), F.sum("packets").alias("total_count"))


def source_heartbeat(readings: DataFrame) -> DataFrame:
    """Last time and total by receiver."""
    return readings.where("source is not null and source <> ''").groupBy("source").agg(F.max("ts").alias("last_ts"), F.count("*").alias("total_count"))


def scrub_zeros(readings: DataFrame) -> DataFrame:
    """Readings without those of no value; R1 of the result is the index to store."""
    return readings.where("consumption is null or consumption > 0")


def keep_newer(rows: DataFrame, as_of: Column, days: int, column: str = "ts") -> DataFrame:
    """Retention of `days` before as_of."""
    return rows.where(F.col(column) >= as_of - F.expr(f"INTERVAL {int(days)} DAYS"))


def drop_source(rows: DataFrame, source: str) -> DataFrame:
    """Rows of every other receiver (of readings, coverage or heartbeats), null ones too."""
    return rows.where(~F.col("source").eqNullSafe(source))


def purge_meters(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of all meters but those in ids(endpoint_id)."""
    return rows.join(ids.select("endpoint_id").distinct(), "endpoint_id", "left_anti")


def update_annotations(meters: DataFrame, patch: DataFrame, key: str = "endpoint_id") -> DataFrame:
    """Sparse upsert: only what is not null in the patch changes; new keys are added."""
    columns = [c for c in meters.columns if c != key]
    given = [F.coalesce(F.col(f"p.{c}"), F.col(f"m.{c}")).alias(c) if c in patch.columns else F.col(f"m.{c}") for c in columns]
    return meters.alias("m").join(patch.alias("p"), F.col(f"m.{key}") == F.col(f"p.{key}"), "full").select(F.coalesce(F.col(f"p.{key}"), F.col(f"m.{key}")).alias(key), *given)


def stored_period(bills: DataFrame, statistics: DataFrame | None = None) -> DataFrame:
    """The period of the newest row of each statistic; `month` where that names none, and for those of
    statistics(statistic_id) that have no row."""
    found = bills.groupBy("statistic_id").agg(F.max(F.struct("ts", "period"))["period"].alias("period"))
    if statistics is not None:
        found = statistics.select("statistic_id").distinct().join(found, "statistic_id", "full")
    return found.withColumn("period", F.coalesce(F.nullif("period", F.lit("")), F.lit("month")))


def table_stats(tables: dict[str, DataFrame], readings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of each table; rows, first and last time of each source, `(none)` for null, most rows first)."""
    counts = reduce(DataFrame.unionByName, [df.agg(F.lit(name).alias("name"), F.count("*").alias("rows")) for name, df in sorted(tables.items())])
    per = readings.groupBy(F.coalesce("source", F.lit("(none)")).alias("source")).agg(F.count("*").alias("rows"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))
    return counts, per.orderBy(F.desc("rows"), "source")


def data_span(index: DataFrame) -> DataFrame:
    """First and last time of any meter."""
    return index.agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
