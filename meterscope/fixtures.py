"""Meters, feeds and bills derived from the driver's tables, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

C = F.col


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", C("ts").cast("timestamp"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 meters. The counter is a running sum in two steps, of hours and within an hour, so that no task
    has to sort all of a meter's events."""
    rows = events(spark, sf_dir).withColumn("m", C("user_id") % 24).withColumn("v", F.round(C("value") * 100).cast("long")).withColumn("h", F.date_trunc("hour", "ts"))
    hours = rows.groupBy("m", "h").agg(F.sum("v").alias("s"))
    before = F.sum("s").over(Window.partitionBy("m").orderBy("h").rowsBetween(Window.unboundedPreceding, -1))
    hours = hours.select("m", "h", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("v").over(Window.partitionBy("m", "h").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("inside", inside).join(hours, ["m", "h"]).withColumn("cum", C("before") + C("inside"))
    kind = F.when(C("m") % 3 == 0, "SCM").when(C("m") % 3 == 1, "SCM+").otherwise("IDM")
    code = F.when(C("m") % 6 == 0, 4).when(C("m") % 6 == 1, 7).when(C("m") % 6 == 2, 4).when(C("m") % 6 == 3, 2).when(C("m") % 6 == 4, 11)
    value = F.when(C("m") % 3 == 0, (16700000 + C("cum")) % 16777216).otherwise(1000000 + C("cum")) + F.when(C("event_id") % 997 == 0, 1048576).otherwise(0)
    return rows.select("event_id", "ts", (1000 + C("m")).alias("endpoint_id"), kind.alias("msg_type"), code.cast("int").alias("endpoint_type"), value.cast("double").alias("consumption"), C("event_type").alias("source"))


READINGS = """
ev AS (SELECT event_id, ts, event_type, value, user_id, user_id % 24 AS m FROM events),
readings AS (SELECT event_id, ts, 1000 + m AS endpoint_id, CASE m % 3 WHEN 0 THEN 'SCM' WHEN 1 THEN 'SCM+' ELSE 'IDM' END AS msg_type,
  (CASE m % 6 WHEN 0 THEN 4 WHEN 1 THEN 7 WHEN 2 THEN 4 WHEN 3 THEN 2 WHEN 4 THEN 11 END)::INT AS endpoint_type,
  ((CASE WHEN m % 3 = 0 THEN (16700000 + cum) % 16777216 ELSE 1000000 + cum END) + CASE WHEN event_id % 997 = 0 THEN 1048576 ELSE 0 END)::DOUBLE AS consumption, event_type AS source
  FROM (SELECT *, sum(round(value * 100)::BIGINT) OVER (PARTITION BY m ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cum FROM ev)),
"""


def reference_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("ts", F.concat(F.lit("sensor."), "event_type").alias("entity_id"), (C("value") * 10).alias("power_w"), F.lit("live").alias("src"))


def hvac_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(C("event_type") == "click", "heating").when(C("event_type") == "view", "cooling").otherwise("idle")
    return events(spark, sf_dir).select("ts", F.lit("climate.t").alias("entity_id"), action.alias("action"), F.lit("live").alias("src"))


SAMPLES = """
samples AS (SELECT ts, 'sensor.' || event_type AS entity_id, value * 10 AS power_w, 'live' AS src FROM events),
hvac AS (SELECT ts, 'climate.t' AS entity_id, CASE event_type WHEN 'click' THEN 'heating' WHEN 'view' THEN 'cooling' ELSE 'idle' END AS action FROM events),
"""


def bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.sum(F.round(C("value") * 100).cast("long")) / 10000.0
    return events(spark, sf_dir).groupBy(F.date_trunc("day", "ts").alias("ts")).agg(cents.alias("kwh")).select(F.lit("bill.day").alias("statistic_id"), F.lit("day").alias("period"), "ts", "kwh")


def monthly_bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("ts", F.date_trunc("month", C("o_orderdate").cast("timestamp")))
    return rows.groupBy("ts").agg((F.sum(F.round(C("o_totalprice") * 100).cast("long")) / 10000000.0).alias("kwh")).select(F.lit("bill.month").alias("statistic_id"), F.lit("month").alias("period"), "ts", "kwh")


BILLS = """
bills AS (SELECT 'bill.day' AS statistic_id, 'day' AS period, date_trunc('day', ts)::TIMESTAMP AS ts, sum(round(value * 100)::BIGINT)::DOUBLE / 10000.0::DOUBLE AS kwh FROM events GROUP BY 3),
mbills AS (SELECT 'bill.month' AS statistic_id, 'month' AS period, date_trunc('month', o_orderdate)::TIMESTAMP AS ts, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / 10000000.0::DOUBLE AS kwh FROM orders GROUP BY 3),
"""


def readings_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of readings of 40 meters, a reading a day, running sums by month and within a month."""
    rows = table(spark, sf_dir, "lineitem").groupBy((5000 + C("l_suppkey") % 40).alias("endpoint_id"), C("l_shipdate").cast("timestamp").alias("ts")).agg(F.sum("l_quantity").cast("long").alias("q"))
    rows = rows.withColumn("month", F.date_trunc("month", "ts"))
    months = rows.groupBy("endpoint_id", "month").agg(F.sum("q").alias("s"))
    before = F.sum("s").over(Window.partitionBy("endpoint_id").orderBy("month").rowsBetween(Window.unboundedPreceding, -1))
    months = months.select("endpoint_id", "month", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("q").over(Window.partitionBy("endpoint_id", "month").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("inside", inside).join(months, ["endpoint_id", "month"])
    return rows.select("ts", "endpoint_id", F.lit("IDM").alias("msg_type"), F.lit(4).alias("endpoint_type"), (C("before") + C("inside") + 100000).cast("double").alias("consumption"), F.lit("long").alias("source"))


def samples_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A monitored feed of the same years: a sample a line of an order, at a minute of its day of shipping."""
    at = C("l_shipdate").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), (C("l_orderkey") % 1440).cast("int"))
    return table(spark, sf_dir, "lineitem").select(at.alias("ts"), F.concat(F.lit("sensor."), (C("l_linenumber") % 3).cast("string")).alias("entity_id"), (C("l_quantity") * 100).alias("power_w"), F.lit("live").alias("src"))


def meters_long(spark: SparkSession) -> DataFrame:
    rows = [(5000, "home", True, True, 0.5, "kWh"), (5001, None, False, True, 0.25, "kWh"), (5002, "maybe", False, False, 1.0, None)]
    return spark.createDataFrame(rows, "endpoint_id long, label string, is_mine boolean, publish boolean, pub_multiplier double, pub_unit string")


#: Readings, hourly steps (the counters never wrap), monitored days and meters of the years that bills are of.
LONG = """
longr AS (SELECT ts, endpoint_id, 'IDM' AS msg_type, 4 AS endpoint_type, (100000 + sum(q) OVER (PARTITION BY endpoint_id ORDER BY ts ROWS UNBOUNDED PRECEDING))::DOUBLE AS consumption, 'long' AS source
  FROM (SELECT 5000 + l_suppkey % 40 AS endpoint_id, l_shipdate AS ts, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY 1, 2)),
lday AS (SELECT endpoint_id, ts::DATE AS day, consumption - lag(consumption) OVER (PARTITION BY endpoint_id ORDER BY ts) AS delta FROM longr),
lmins AS (SELECT 'sensor.' || l_linenumber % 3 AS entity_id, (l_shipdate + to_minutes(l_orderkey % 1440))::TIMESTAMP AS m, avg(l_quantity * 100) AS w FROM lineitem GROUP BY 1, 2),
lminl AS (SELECT *, least(m + INTERVAL '15 minutes', COALESCE(lead(m) OVER (PARTITION BY entity_id ORDER BY m) - INTERVAL '1 minute', TIMESTAMP '2999-01-01')) AS last FROM lmins),
lfill AS (SELECT unnest(generate_series(m, last, INTERVAL '1 minute')) AS mt, w FROM lminl WHERE last >= m),
lref AS (SELECT mt::DATE AS day, sum(w) / 60000 AS k FROM lfill GROUP BY 1),
lmeters(endpoint_id, is_mine, publish, pub_multiplier) AS (VALUES (5000::BIGINT, TRUE, TRUE, 0.5::DOUBLE), (5001::BIGINT, FALSE, TRUE, 0.25::DOUBLE), (5002::BIGINT, FALSE, FALSE, 1.0::DOUBLE)),
"""


def meters(spark: SparkSession) -> DataFrame:
    rows = [(1000, "home", "", False, True, False, True, "home", 0.01, "kWh"), (1001, None, None, False, False, False, True, "neighbour", 0.01, "kWh"), (1002, None, "maybe", True, False, False, False, None, 1.0, None), (1005, None, None, False, False, True, False, None, 1.0, None)]
    return spark.createDataFrame(rows, "endpoint_id long, label string, notes string, is_candidate boolean, is_mine boolean, ignored boolean, publish boolean, pub_name string, pub_multiplier double, pub_unit string")


METERS = """
meters(endpoint_id, label, notes, is_candidate, is_mine, ignored, publish, pub_name, pub_multiplier, pub_unit) AS (VALUES
  (1000::BIGINT, 'home', '', FALSE, TRUE, FALSE, TRUE, 'home', 0.01::DOUBLE, 'kWh'), (1001::BIGINT, NULL, NULL, FALSE, FALSE, FALSE, TRUE, 'neighbour', 0.01::DOUBLE, 'kWh'),
  (1002::BIGINT, NULL, 'maybe', TRUE, FALSE, FALSE, FALSE, NULL, 1.0::DOUBLE, NULL), (1005::BIGINT, NULL, NULL, FALSE, FALSE, TRUE, FALSE, NULL, 1.0::DOUBLE, NULL)),
"""


def windows(spark: SparkSession) -> DataFrame:
    rows = [(1, "kettle", "2024-01-05 00:00:00", "2024-01-07 00:00:00", "manual", 2000.0, None, None), (2, "car", "2024-01-10 00:00:00", "2024-01-13 00:00:00", "auto", None, "sensor.click", None), (3, "oven", "2024-01-20 00:00:00", "2024-01-25 00:00:00", "manual", None, None, None)]
    df = spark.createDataFrame(rows, "id long, label string, start_ts string, end_ts string, source string, known_load_w double, known_entity_id string, snoop_k int")
    return df.withColumn("start_ts", C("start_ts").cast("timestamp")).withColumn("end_ts", C("end_ts").cast("timestamp"))


WINDOWS = """
wins(id, label, start_ts, end_ts, source, known_load_w, known_entity_id) AS (VALUES
  (1::BIGINT, 'kettle', TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-07', 'manual', 2000.0::DOUBLE, NULL), (2::BIGINT, 'car', TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-13', 'auto', NULL, 'sensor.click'),
  (3::BIGINT, 'oven', TIMESTAMP '2024-01-20', TIMESTAMP '2024-01-25', 'manual', NULL, NULL)),
"""


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(C("event_type").alias("serial")).distinct().select("serial", F.concat(F.lit("receiver "), "serial").alias("name"), (C("serial") != "view").alias("enabled"))


DEVICES = "devices AS (SELECT DISTINCT event_type AS serial, 'receiver ' || event_type AS name, event_type <> 'view' AS enabled FROM events),\n"

INDEX = """
mi AS (SELECT endpoint_id, arg_max(msg_type, ts) AS msg_type, arg_max(endpoint_type, ts) AS endpoint_type, min(ts) AS first_seen, max(ts) AS last_seen, count(*)::BIGINT AS packets,
  min(consumption) AS min_consumption, max(consumption) AS max_consumption, arg_max(consumption, (ts, consumption)) AS last_consumption, max(ts) AS last_consumption_ts FROM readings GROUP BY 1),
com AS (SELECT endpoint_id, CASE WHEN endpoint_type IS NULL THEN 'unknown' WHEN endpoint_type IN (4,5,7,8,12,13) THEN 'electric' WHEN endpoint_type IN (2,9,156,157,158,159,160) THEN 'gas'
  WHEN endpoint_type IN (11,171,172) THEN 'water' ELSE 'other' END AS commodity FROM mi),
r1m AS (SELECT endpoint_id, date_trunc('minute', ts)::TIMESTAMP AS bucket, min(consumption) AS min_c, max(consumption) AS max_c, count(*)::BIGINT AS n FROM readings GROUP BY 1, 2),
r1h AS (SELECT endpoint_id, date_trunc('hour', ts)::TIMESTAMP AS bucket, min(consumption) AS min_c, max(consumption) AS max_c, count(*)::BIGINT AS n FROM readings GROUP BY 1, 2),
raw1h AS (SELECT endpoint_id, bucket, n, max_c, max_c - lag(max_c) OVER (PARTITION BY endpoint_id ORDER BY bucket) AS raw, CASE WHEN msg_type = 'SCM' THEN 16777216.0::DOUBLE ELSE 4294967296.0::DOUBLE END AS modu FROM r1h JOIN mi USING (endpoint_id)),
step1h AS (SELECT *, CASE WHEN raw >= 0 THEN raw WHEN raw + modu >= 0 AND raw + modu < modu * 0.5::DOUBLE THEN raw + modu END AS delta FROM raw1h),
med1h AS (SELECT endpoint_id, quantile_cont(delta, 0.5) AS md, count(*) AS pn FROM step1h WHERE delta > 0 GROUP BY 1),
hd AS (SELECT s.endpoint_id, s.bucket AS hb, s.n, s.delta FROM step1h s LEFT JOIN med1h USING (endpoint_id)
  WHERE s.delta IS NOT NULL AND s.delta <= CASE WHEN COALESCE(pn, 0) >= 3 THEN greatest(md * 50, 1000) ELSE 1000 END),
"""
#: Six-hour steps with the other bound (no least number of positive steps).
SIX = """
b6 AS (SELECT endpoint_id, time_bucket(INTERVAL '6 hours', bucket) AS bucket, max(max_c) AS cmax, sum(n)::BIGINT AS n FROM r1h GROUP BY 1, 2),
raw6 AS (SELECT b6.*, cmax - lag(cmax) OVER (PARTITION BY endpoint_id ORDER BY bucket) AS raw, CASE WHEN msg_type = 'SCM' THEN 16777216.0::DOUBLE ELSE 4294967296.0::DOUBLE END AS modu FROM b6 JOIN mi USING (endpoint_id)),
step6 AS (SELECT *, CASE WHEN raw >= 0 THEN raw WHEN raw + modu >= 0 AND raw + modu < modu * 0.5::DOUBLE THEN raw + modu END AS delta FROM raw6),
clean6 AS (SELECT s.endpoint_id, s.bucket, s.delta FROM step6 s LEFT JOIN (SELECT endpoint_id, quantile_cont(delta, 0.5) AS md FROM step6 WHERE delta > 0 GROUP BY 1) USING (endpoint_id)
  WHERE s.delta IS NOT NULL AND s.delta <= greatest(COALESCE(md, 0) * 50, 1000)),
"""
#: Gap-filled feed: each sample minute lasts to the next one, 15 minutes after its last sample at most.
FILL = """
mins AS (SELECT entity_id, date_trunc('minute', ts)::TIMESTAMP AS m, avg(power_w) AS w, max(ts) AS src FROM samples GROUP BY 1, 2),
minl AS (SELECT *, least(date_trunc('minute', src + INTERVAL '15 minutes')::TIMESTAMP, COALESCE(lead(m) OVER (PARTITION BY entity_id ORDER BY m) - INTERVAL '1 minute', TIMESTAMP '2999-01-01')) AS last FROM mins),
fill AS (SELECT entity_id, unnest(generate_series(m, last, INTERVAL '1 minute')) AS mt, w FROM minl WHERE last >= m),
hmins AS (SELECT entity_id, date_trunc('minute', ts)::TIMESTAMP AS m, arg_max(action, (ts, action)) AS act, max(ts) AS src FROM hvac GROUP BY 1, 2),
hminl AS (SELECT *, least(date_trunc('minute', src + INTERVAL '15 minutes')::TIMESTAMP, COALESCE(lead(m) OVER (PARTITION BY entity_id ORDER BY m) - INTERVAL '1 minute', TIMESTAMP '2999-01-01')) AS last FROM hmins),
hfill AS (SELECT entity_id, unnest(generate_series(m, last, INTERVAL '1 minute')) AS mt, (CASE act WHEN 'heating' THEN 3000.0 WHEN 'cooling' THEN 2000.0 ELSE 0.0 END)::DOUBLE AS w FROM hminl WHERE last >= m),
ent AS (SELECT *, FALSE AS is_hvac FROM fill UNION ALL SELECT *, TRUE AS is_hvac FROM hfill),
tot AS (SELECT mt, sum(w) AS w, count(*) FILTER (WHERE NOT is_hvac) AS live FROM ent GROUP BY 1),
"""
