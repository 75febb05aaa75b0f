"""From cumulative counters to trustworthy movement (D1-D9) and rollups."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import modulus, step, time_bucket
from ..functions.joins import range_join
from ..params import DEFAULTS, Params


def rollup(readings: DataFrame, minutes: int) -> DataFrame:
    """(endpoint_id, bucket, min_c, max_c, n) of readings with meter and value."""
    rows = readings.where("endpoint_id is not null and consumption is not null")
    return rows.groupBy("endpoint_id", time_bucket(F.col("ts"), minutes).alias("bucket")).agg(F.min("consumption").alias("min_c"), F.max("consumption").alias("max_c"), F.count("*").alias("n"))


def refresh_rollup(old: DataFrame, readings: DataFrame, minutes: int, since: Column, until: Column) -> DataFrame:
    """Buckets that start in [since, until) made anew from readings, the others kept."""
    inside = lambda c: (F.col(c) >= since) & (F.col(c) < until)
    fresh = rollup(readings.where(inside("ts")), minutes)
    return old.where(~inside("bucket")).unionByName(fresh)


def backfill_rollup(readings: DataFrame, minutes: int, path: str, first: datetime, as_of: datetime, *, step_days: int = 7, settle_h: int = 48, most_steps: int | None = None) -> datetime:
    """R12 over a long history, resumable: ranges of step_days from `first` on to settle_h before as_of (what is
    newer is the regular refresh's), each a job that writes its buckets to a folder of its own under path and
    then the time reached. A run goes on from the time that an earlier one has written; a range that was cut
    off is written anew. most_steps ends a run early. Returns the time reached; read_backfill gives the rollup."""
    spark = readings.sparkSession
    reached, end = first, as_of - timedelta(hours=settle_h)
    marks = _marks(spark, path)
    if marks is not None:
        reached = max(reached, marks.agg(F.max("reached")).first()[0])
    steps = 0
    while reached < end and (most_steps is None or steps < most_steps):
        upto = min(reached + timedelta(days=step_days), end)
        bounds = [F.lit(t.isoformat(" ")).cast("timestamp") for t in (reached, upto)]
        part = rollup(readings.where((F.col("ts") >= bounds[0]) & (F.col("ts") < bounds[1])), minutes)
        name = reached.strftime("%Y%m%dT%H%M%S")
        part.write.mode("overwrite").parquet(f"{path}/ranges/since={name}")
        spark.range(1).select(bounds[1].alias("reached")).coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/since={name}")
        reached, steps = upto, steps + 1
    return reached


def _marks(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema("reached timestamp, since string").parquet(f"{path}/marks")
    except AnalysisException:  # nothing is written yet
        return None


def read_backfill(spark: SparkSession, path: str) -> DataFrame:
    """The rollup of backfill_rollup. A bucket that two ranges share is one row."""
    schema = "endpoint_id long, bucket timestamp, min_c double, max_c double, n long, since string"
    rows = spark.read.schema(schema).parquet(f"{path}/ranges")
    return rows.groupBy("endpoint_id", "bucket").agg(F.min("min_c").alias("min_c"), F.max("max_c").alias("max_c"), F.sum("n").alias("n"))


def realtime_rollup(materialised: DataFrame, readings: DataFrame, minutes: int, watermark: Column) -> DataFrame:
    """What is materialised before the watermark, and fresh readings from it on."""
    return materialised.where(F.col("bucket") < watermark).unionByName(rollup(readings.where(F.col("ts") >= watermark), minutes))


def rollup_of_rollup(fine: DataFrame, minutes: int) -> DataFrame:
    return fine.groupBy("endpoint_id", time_bucket(F.col("bucket"), minutes).alias("bucket")).agg(F.min("min_c").alias("min_c"), F.max("max_c").alias("max_c"), F.sum("n").alias("n"))


def counter_steps(rows: DataFrame, keys: list[str], order: str, value: str, msg_type: str = "msg_type") -> DataFrame:
    """`delta`, the rollover- and reset-aware step from the row before of the same keys."""
    raw = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("__raw", raw).withColumn("delta", step(F.col("__raw"), modulus(F.col(msg_type)))).drop("__raw")


def bucket_deltas(rolled: DataFrame, index: DataFrame, minutes: int) -> DataFrame:
    """(endpoint_id, bucket, cmax, n, delta) on buckets of a rollup."""
    rows = rolled.groupBy("endpoint_id", time_bucket(F.col("bucket"), minutes).alias("bucket")).agg(F.max("max_c").alias("cmax"), F.sum("n").alias("n"))
    rows = rows.join(index.select("endpoint_id", "msg_type"), "endpoint_id")
    return counter_steps(rows, ["endpoint_id"], "bucket", "cmax").drop("msg_type")


def glitch_filter(deltas: DataFrame, params: Params = DEFAULTS, positives: int = 0, keys: tuple[str, ...] = ("endpoint_id",)) -> DataFrame:
    """D3 (positives 0) and D4's rule: without null steps and those beyond the bound of their meter (keys).

    The bound is glitch_factor medians of the meter's positive steps, glitch_floor at least, and the
    floor alone where there are fewer than `positives` of them."""
    each = Window.partitionBy(*keys)
    positive = F.when(F.col("delta") > 0, F.col("delta"))
    median, count = F.percentile(positive, 0.5).over(each), F.count(positive).over(each)
    bound = F.when(count >= positives, F.greatest(F.coalesce(median, F.lit(0.0)) * params.glitch_factor, F.lit(params.glitch_floor))).otherwise(params.glitch_floor)
    return deltas.withColumn("__bound", bound).where(F.col("delta").isNotNull() & (F.col("delta") <= F.col("__bound"))).drop("__bound")


def hourly_deltas(rollup_1h: DataFrame, index: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """(endpoint_id, hb, n, delta) of rolled-up hours; one shuffle by meter serves step and bound."""
    rows = rollup_1h.join(index.select("endpoint_id", "msg_type"), "endpoint_id")
    rows = counter_steps(rows, ["endpoint_id"], "bucket", "max_c")
    rows = glitch_filter(rows, params, params.glitch_positives)
    return rows.select("endpoint_id", F.col("bucket").alias("hb"), "n", "delta")


def movement_between(rollup_1h: DataFrame, index: DataFrame, spans: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """(endpoint_id, span, movement) for every meter and span(span, start, end), each on the hours from
    look-back to end; spans without data have no row."""
    spans = spans.withColumn("__from", F.col("start") - F.expr(f"INTERVAL {params.lookback_h} HOURS"))
    rows = range_join(rollup_1h, spans, "bucket", "__from", "end").join(index.select("endpoint_id", "msg_type"), "endpoint_id")
    keys = Window.partitionBy("endpoint_id", "span")
    raw = F.col("max_c") - F.lag("max_c").over(keys.orderBy("bucket"))
    rows = rows.withColumn("__raw", raw).withColumn("delta", step(F.col("__raw"), modulus(F.col("msg_type"))))
    positive = F.when(F.col("delta") > 0, F.col("delta"))
    bound = F.when(F.count(positive).over(keys) >= params.glitch_positives, F.greatest(F.percentile(positive, 0.5).over(keys) * params.glitch_factor, F.lit(params.glitch_floor))).otherwise(params.glitch_floor)
    good = rows.withColumn("__bound", bound).where((F.col("delta") <= F.col("__bound")) & (F.col("bucket") >= F.col("start")))
    return good.groupBy("endpoint_id", "span").agg(F.sum("delta").alias("movement"))


def span_movement(readings: DataFrame, unit: str = "day") -> DataFrame:
    """Naive movement, highest less lowest value, by meter and day or hour."""
    return readings.groupBy("endpoint_id", F.date_trunc(unit, "ts").alias("bucket")).agg((F.max("consumption") - F.min("consumption")).alias("delta"), F.count("*").alias("packets"))


def movement_leaderboard(readings: DataFrame) -> DataFrame:
    """Naive movement, packets and days seen of each meter."""
    return readings.groupBy("endpoint_id").agg((F.max("consumption") - F.min("consumption")).alias("delta"), F.count("*").alias("packets"), F.countDistinct(F.to_date("ts")).alias("days"))
