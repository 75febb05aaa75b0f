"""Reception health and anomalies (H1-H8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import time_bucket
from ..params import DEFAULTS, Params


def coverage_matrix(coverage: DataFrame, meters: DataFrame, devices: DataFrame) -> DataFrame:
    """H1: receiver x meter packets with labels, whether the receiver is in the inventory, and its total."""
    totals = coverage.groupBy("source").agg(F.sum("packets").alias("source_total"))
    rows = coverage.join(totals, "source").join(meters.select("endpoint_id", "label"), "endpoint_id", "left").join(devices.select(F.col("serial").alias("source"), F.lit(True).alias("present")), "source", "left")
    return rows.select("source", "endpoint_id", "label", "packets", "last_seen", "source_total", F.coalesce("present", F.lit(False)).alias("present")).orderBy("source", F.col("packets").desc(), "endpoint_id")


def source_timeline(readings: DataFrame, minutes: int) -> DataFrame:
    """H2: packets by receiver and bucket."""
    return readings.groupBy(F.coalesce("source", F.lit("(none)")).alias("source"), time_bucket(F.col("ts"), minutes).alias("bucket")).agg(F.count("*").alias("packets"))


def capture_health(readings: DataFrame, as_of: Column, params: Params = DEFAULTS) -> DataFrame:
    """H3: by receiver age in seconds, alive, packets of the last minute, meters heard; and overall alive."""
    age = as_of.cast("double") - F.col("ts").cast("double")
    rows = readings.where("source is not null and source <> ''").groupBy("source").agg(F.min(age).alias("age_s"), F.count(F.when(age < 60, 1)).alias("last_minute"), F.countDistinct("endpoint_id").alias("meters"))
    rows = rows.withColumn("alive", F.col("age_s") <= params.alive_s)
    return rows.join(F.broadcast(rows.agg(F.coalesce(F.max("alive"), F.lit(False)).alias("any_alive"))))  # one row


def receiver_inventory(devices: DataFrame, coverage: DataFrame, readings: DataFrame, as_of: Column) -> DataFrame:
    """H4: devices with last time, total, packets a minute over the last hour and meters heard."""
    heard = coverage.groupBy(F.col("source").alias("serial")).agg(F.count("*").alias("meters"), F.sum("packets").alias("total"), F.max("last_seen").alias("last_ts"))
    recent = readings.where((F.col("ts") > as_of - F.expr("INTERVAL 1 HOUR")) & (F.col("ts") <= as_of)).groupBy(F.col("source").alias("serial")).agg((F.count("*") / 60.0).alias("ppm"))
    zero = lambda c, t: F.coalesce(F.col(c), F.lit(0)).cast(t).alias(c)
    return devices.join(heard, "serial", "left").join(recent, "serial", "left").select("serial", "name", zero("meters", "long"), zero("total", "long"), "last_ts", zero("ppm", "double"))


def _tracked(meters: DataFrame) -> DataFrame:
    """The user's and the published meters, ignored or not."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return meters.where(flag("is_mine") | flag("publish")).select("endpoint_id")


def dropouts(index: DataFrame, meters: DataFrame, as_of: Column, params: Params = DEFAULTS) -> DataFrame:
    """H5: tracked meters that are not heard any more."""
    silent = as_of.cast("double") - F.col("last_seen").cast("double") > 60.0 * params.dropout_min
    return _tracked(meters).join(index, "endpoint_id").where(silent).select(F.lit("dropout").alias("kind"), F.col("endpoint_id").cast("string").alias("subject"), F.col("last_seen").alias("since"))


def stuck(rollup_1m: DataFrame, meters: DataFrame, as_of: Column) -> DataFrame:
    """H6: tracked meters whose value did not move in the last 60 minutes, heard or not, yet did in the 24 hours
    before; since when they were last heard."""
    ago = lambda h: as_of - F.expr(f"INTERVAL {h} HOURS")
    recent, prior = F.col("bucket") >= ago(1), F.col("bucket") < ago(1)
    move = lambda c: F.max(F.when(c, F.col("max_c"))) - F.min(F.when(c, F.col("min_c")))
    rows = rollup_1m.where((F.col("bucket") >= ago(25)) & (F.col("bucket") <= as_of)).join(_tracked(meters), "endpoint_id").groupBy("endpoint_id").agg(move(recent).alias("now"), move(prior).alias("before"), F.max("bucket").alias("since"))
    return rows.where((F.col("before") > 0) & (F.coalesce("now", F.lit(0.0)) == 0)).select(F.lit("stuck").alias("kind"), F.col("endpoint_id").cast("string").alias("subject"), "since")


def sources_down(heartbeat: DataFrame, devices: DataFrame, as_of: Column, params: Params = DEFAULTS) -> DataFrame:
    """H7: receivers of the inventory that are enabled and silent."""
    expected = devices.where(F.coalesce("enabled", F.lit(True))).select(F.col("serial").alias("source"))
    rows = expected.join(heartbeat, "source", "left")
    silent = F.col("last_ts").isNull() | (as_of.cast("double") - F.col("last_ts").cast("double") > 60.0 * params.source_min)
    return rows.where(silent).select(F.lit("source_down").alias("kind"), F.col("source").alias("subject"), F.col("last_ts").alias("since"))


def anomalies(health: DataFrame, *others: DataFrame) -> DataFrame:
    """H8: a stale reference feed first, then the others."""
    rows = health.where("stale").select(F.lit("reference_stale").alias("kind"), F.col("entity_id").alias("subject"), F.col("last_ts").alias("since")).withColumn("place", F.lit(0))
    for i, other in enumerate(others, 1):
        rows = rows.unionByName(other.withColumn("place", F.lit(i)))
    return rows.orderBy("place", "subject")
