"""Sources and sinks (S1-S17): packets, sensor events, statistics and their upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import unit_factor
from ..functions.joins import broadcast_checked
from ..params import ENERGY_UNITS, SENSOR_UNITS


#: What a packet's line holds; values stay text until they are cast.
_MESSAGE = ("EndpointID", "ID", "ERTSerialNumber", "EndpointType", "Type", "Consumption", "LastConsumptionCount", "LastConsumption")
_PACKET = f"Time string, Type string, Message struct<{', '.join(f'{n}: string' for n in _MESSAGE)}>"
_JSON = {"allowUnquotedControlChars": "true", "allowNonNumericNumbers": "false"}


def _first(names: tuple[str, ...], type_: str) -> Column:
    return F.coalesce(*[F.col(f"Message.{n}").try_cast(type_) for n in names])


def ingest_packets(lines: DataFrame, source: str | Column, ingest_time: Column) -> DataFrame:
    """Readings of JSON lines (column `value`), batch or stream. Lines that are no JSON, or have no
    identifier or no value above 0, are dropped; an unreadable time becomes ingest_time. A line is parsed once:
    as a generated row, so that no filter or second column has it parsed anew."""
    given = lines.select("value", (source if isinstance(source, Column) else F.lit(source)).alias("source"), ingest_time.alias("ingest_time"))
    packets = given.select("*", F.inline(F.array(F.from_json("value", _PACKET, _JSON))))
    rows = packets.select(
        F.coalesce(F.try_to_timestamp("Time"), "ingest_time").alias("ts"), F.col("Type").alias("msg_type"), _first(("EndpointID", "ID", "ERTSerialNumber"), "bigint").alias("endpoint_id"),
        _first(("EndpointType", "Type"), "int").alias("endpoint_type"), _first(("Consumption", "LastConsumptionCount", "LastConsumption"), "double").alias("consumption"),
        F.col("value").alias("raw"), "source",
    )
    return rows.where("endpoint_id is not null and consumption > 0")


def append_readings(readings: DataFrame, path: str, mode: str = "append", rows_a_file: int = 5_000_000) -> None:
    """S3: append to the readings table, a folder a day. A day is dealt by meter to as many tasks, a file each,
    as its rows ask for, in order of meter and time."""
    rows = readings.withColumn("dt", F.to_date("ts"))
    files = rows.groupBy(F.col("dt").alias("__day")).agg(F.ceil(F.count("*") / rows_a_file).cast("int").alias("__files"))
    rows = rows.join(broadcast_checked(files), F.col("dt").eqNullSafe(F.col("__day"))).drop("__day")
    rows = rows.withColumn("__file", F.pmod(F.hash("endpoint_id"), "__files")).drop("__files").repartition("dt", "__file")
    rows.sortWithinPartitions("dt", "__file", "endpoint_id", "ts").drop("__file").write.mode(mode).partitionBy("dt").parquet(path)


def meter_readings(readings: DataFrame, endpoint_id: int, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Readings of one meter in order, for export."""
    rows = readings.where(F.col("endpoint_id") == endpoint_id)
    rows = rows if since is None else rows.where(F.col("ts") >= since)
    rows = rows if until is None else rows.where(F.col("ts") <= until)
    return rows.select("ts", "msg_type", "endpoint_id", "endpoint_type", "consumption", "source").orderBy("ts", "consumption")


def export_csv(rows: DataFrame, path: str) -> None:
    """CSV files with a header, in the order of the rows."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def classify_sensors(states: DataFrame) -> DataFrame:
    """(entity_id, kind, unit) of sensors in a state table: power, energy or ''."""
    unit, kind = F.upper(F.coalesce("unit", F.lit(""))), F.lower(F.coalesce("device_class", F.lit("")))
    out = F.when((kind == "power") | unit.isin("W", "KW"), "power").when((kind == "energy") | unit.isin("WH", "KWH", "MWH"), "energy").otherwise("")
    return states.where(F.col("entity_id").startswith("sensor.")).select("entity_id", out.alias("kind"), "unit")


def resolve_entities(requested: DataFrame, fresh: DataFrame, cache: DataFrame) -> DataFrame:
    """(entity_id, kind, unit) of the requested ids: fresh wins, the cache fills what is missing."""
    f, c = fresh.alias("f"), cache.alias("c")
    rows = requested.select("entity_id").distinct().alias("r").join(f, F.col("r.entity_id") == F.col("f.entity_id"), "left").join(c, F.col("r.entity_id") == F.col("c.entity_id"), "left")
    found = F.col("f.entity_id").isNotNull()
    pick = lambda x: F.when(found, F.col(f"f.{x}")).otherwise(F.col(f"c.{x}")).alias(x)
    return rows.where(found | F.col("c.entity_id").isNotNull()).select("r.entity_id", pick("kind"), pick("unit"))


def normalize_reference(events: DataFrame, info: DataFrame) -> DataFrame:
    """(ts, entity_id, power_w) of sensor events(entity_id, ts, state): power by its unit; energy
    differentiated against the event before, not below 0. States that are no number are dropped."""
    value = F.col("state").try_cast("double")
    rows = events.withColumn("v", value).where(F.col("v").isNotNull() & ~F.isnan("v")).join(info.where("kind <> ''"), "entity_id")
    rows = rows.withColumn("v", F.col("v") * unit_factor(F.col("unit"), SENSOR_UNITS))
    w = Window.partitionBy("entity_id").orderBy("ts", "v")
    hours = (F.col("ts").cast("double") - F.lag(F.col("ts").cast("double")).over(w)) / 3600.0
    rate = F.greatest(F.lit(0.0), F.try_divide((F.col("v") - F.lag("v").over(w)) * 1000.0, hours))
    rows = rows.withColumn("hours", hours).withColumn("rate", rate)
    power = F.when(F.col("kind") == "power", F.col("v")).otherwise(F.when(F.col("hours") > 0, F.col("rate")))
    return rows.withColumn("power_w", power).where("power_w is not null").select("ts", "entity_id", "power_w")


def normalize_hvac(events: DataFrame) -> DataFrame:
    """(ts, entity_id, action) of climate events with attributes as JSON; empty action: none."""
    action = F.get_json_object("attributes", "$.hvac_action")
    return events.select("ts", "entity_id", action.alias("action")).where("action is not null and action <> ''")


def stat_start(text: Column) -> Column:
    """Start of a statistics bucket: milliseconds since 1970 or a time in text."""
    return F.coalesce(F.timestamp_millis(text.try_cast("bigint")), F.try_to_timestamp(text))


def stat_deltas(points: DataFrame) -> DataFrame:
    """(statistic_id, period, ts, kwh): `change` where given, else the step of `sum` from the last
    point without change; not below 0; a first such point has none."""
    w = Window.partitionBy("statistic_id", "period").orderBy("ts")
    last = F.last(F.when(F.col("change").isNull(), F.col("sum")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = points.withColumn("ts", stat_start(F.col("start"))).withColumn("kwh", F.coalesce("change", F.col("sum") - last))
    return rows.where("kwh is not null and ts is not null").select("statistic_id", "period", "ts", F.greatest(F.lit(0.0), F.col("kwh")).alias("kwh"))


def resolve_period(points: DataFrame) -> DataFrame:
    """By statistic the finest of hour, day, month with more than one point, else month."""
    rank = F.when(F.col("period") == "hour", 0).when(F.col("period") == "day", 1).otherwise(2)
    many = points.groupBy("statistic_id", "period").agg(F.count("*").alias("n")).withColumn("rank", F.when(F.col("n") > 1, rank))
    return many.groupBy("statistic_id").agg(F.coalesce(F.min_by("period", "rank"), F.lit("month")).alias("period"))


def upsert_utility(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored rows with those of fresh in place of equal (statistic_id, period, ts)."""
    keys = ["statistic_id", "period", "ts"]
    both = stored.withColumn("__new", F.lit(0)).unionByName(fresh.withColumn("__new", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by("kwh", F.struct("__new", "kwh")).alias("kwh"))


def keep_only_utility(stored: DataFrame, statistic_id: str, period: str) -> DataFrame:
    """Rows of that statistic and period alone."""
    return stored.where((F.col("statistic_id") == statistic_id) & (F.col("period") == period))


def replace_backfill(samples: DataFrame, entity_id: str, start: Column, end: Column, rows: DataFrame, kind: str = "lts_backfill") -> DataFrame:
    """Backfilled rows of an entity in [start, end] replaced by rows; live ones untouched."""
    old = (F.col("src") == kind) & (F.col("entity_id") == entity_id) & (F.col("ts") >= start) & (F.col("ts") <= end)
    return samples.where(~F.coalesce(old, F.lit(False))).unionByName(rows.withColumn("src", F.lit(kind)).select(*samples.columns))


def expand_hourly_means(stats: DataFrame, gaps: DataFrame) -> DataFrame:
    """(entity_id, ts, power_w) each 5 minutes of stats(entity_id, hour, kind, mean, change) inside
    gaps(entity_id, lo, hi), not below 0."""
    value = F.greatest(F.lit(0.0), F.when(F.col("kind") == "energy", F.col("change") * 1000.0).otherwise(F.col("mean")))
    points = stats.withColumn("power_w", value).where("power_w is not null").withColumn("ts", F.explode(F.expr("sequence(hour, hour + INTERVAL 55 MINUTES, INTERVAL 5 MINUTES)")))
    return points.join(gaps, "entity_id").where("ts >= lo and ts <= hi").select("entity_id", "ts", "power_w").distinct()


def expand_hvac_history(events: DataFrame, lo: Column, hi: Column, step_min: int = 5) -> DataFrame:
    """(entity_id, ts, action) each step from lo on: a state holds until the next event, the last one
    through hi; an empty action emits nothing but ends the one before."""
    w = Window.partitionBy("entity_id").orderBy("ts")
    first, last = F.greatest("ts", lo), F.coalesce(F.least(F.lead("ts").over(w) - F.expr("INTERVAL 1 MICROSECOND"), hi), hi)
    rows = events.select("entity_id", "action", first.alias("a"), last.alias("b")).where("a <= b and action is not null and action <> ''")
    return rows.select("entity_id", F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {int(step_min)} MINUTES"))).alias("ts"), "action")


def statistic_factor(unit: Column) -> Column:
    """kWh of one native unit of a statistic."""
    return unit_factor(unit, ENERGY_UNITS)
