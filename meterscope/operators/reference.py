"""The trusted power feed (G1-G16): gap-fill with bounded carry, energies, coverage, gaps, health.

Carrying forward is bounded by Params.carry_min, so a sample minute becomes at most carry_min + 1 minutes:
the grid is made of short sequences beside the samples, never of a calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import local_day, round_half_away, time_bucket
from ..params import DEFAULTS, Params


def _carried(minutes: DataFrame, keys: tuple[str, ...], hi: Column | None, params: Params) -> DataFrame:
    """minutes(keys, m, src, ...) with a row for each minute that m is carried to."""
    w = Window.partitionBy(*keys).orderBy("m")
    last = F.least(F.date_trunc("minute", F.col("src") + F.expr(f"INTERVAL {params.carry_min} MINUTES")), F.lead("m").over(w) - F.expr("INTERVAL 1 MINUTE"), *([] if hi is None else [F.date_trunc("minute", hi)]))
    rows = minutes.withColumn("__last", last).where("__last >= m")
    return rows.withColumn("mt", F.explode(F.expr("sequence(m, __last, INTERVAL 1 MINUTE)"))).drop("__last", "m", "src")


def _between(rows: DataFrame, lo: Column | None, hi: Column | None) -> DataFrame:
    rows = rows if lo is None else rows.where(F.col("ts") >= lo)
    return rows if hi is None else rows.where(F.col("ts") <= hi)


def gapfill(samples: DataFrame, lo: Column | None = None, hi: Column | None = None, params: Params = DEFAULTS, keys: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """(keys, mt, w): minute means carried forward while their last sample is fresh."""
    minutes = _between(samples, lo, hi).groupBy(*keys, F.date_trunc("minute", "ts").alias("m")).agg(F.avg("power_w").alias("w"), F.max("ts").alias("src"))
    return _carried(minutes, keys, hi, params).select(*keys, "mt", "w")


def hvac_power(samples: DataFrame, heating_kw: float, cooling_kw: float, lo: Column | None = None, hi: Column | None = None, params: Params = DEFAULTS, keys: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """(keys, mt, w): what heating and cooling take, of the last action of each minute carried."""
    minutes = _between(samples, lo, hi).groupBy(*keys, F.date_trunc("minute", "ts").alias("m")).agg(F.max(F.struct("ts", "action"))["action"].alias("act"), F.max("ts").alias("src"))
    w = F.when(F.col("act") == "heating", 1000.0 * heating_kw).when(F.col("act") == "cooling", 1000.0 * cooling_kw).otherwise(0.0)
    return _carried(minutes, keys, hi, params).select(*keys, "mt", w.alias("w"))


def per_entity(filled: DataFrame, hvac: DataFrame | None = None) -> DataFrame:
    """Both with a flag."""
    rows = filled.withColumn("is_hvac", F.lit(False))
    return rows if hvac is None else rows.unionByName(hvac.withColumn("is_hvac", F.lit(True)))


def minute_totals(entities: DataFrame, *by: str) -> DataFrame:
    return entities.groupBy(*by, "mt").agg(F.sum("w").alias("w"), F.count(F.when(~F.col("is_hvac") & F.col("w").isNotNull(), 1)).alias("live"))


def monitored_energy(entities: DataFrame, *by: str) -> DataFrame:
    """kWh of all minutes and entities."""
    return minute_totals(entities, *by).groupBy(*by).agg(round_half_away(F.sum("w") / 60000.0, 3).alias("kwh"))


def entity_energy(entities: DataFrame, *by: str) -> DataFrame:
    """kWh of each entity, without HVAC."""
    return entities.where(~F.col("is_hvac")).groupBy(*by, "entity_id").agg(round_half_away(F.sum("w") / 60000.0, 3).alias("kwh"))


def monitored_cv(entities: DataFrame, *by: str) -> DataFrame:
    """Deviation over mean of the minute totals above 0; null where the mean is not above 0."""
    return minute_totals(entities, *by).where("w > 0").groupBy(*by).agg(round_half_away(F.when(F.avg("w") > 0, F.try_divide(F.stddev_samp("w"), F.avg("w"))), 3).alias("cv"))


def monitored_floor(entities: DataFrame, *by: str) -> DataFrame:
    """5th percentile of the minute totals above 0."""
    return minute_totals(entities, *by).where("w > 0").groupBy(*by).agg(round_half_away(F.percentile("w", 0.05), 1).alias("floor_w"))


def aggregate_series(entities: DataFrame, minutes: int) -> DataFrame:
    """Mean total by bucket over minutes with a real value."""
    return minute_totals(entities).where("live > 0").groupBy(time_bucket(F.col("mt"), minutes).alias("bucket")).agg(F.avg("w").alias("power_w"))


def monitored_daily_kwh(entities: DataFrame, tz: str = "UTC") -> DataFrame:
    """kWh by local day."""
    return entities.groupBy(local_day(F.col("mt"), tz).alias("day")).agg((F.sum("w") / 60000.0).alias("kwh"))


def monitored_hourly_kwh(entities: DataFrame) -> DataFrame:
    """kWh by UTC hour."""
    return entities.groupBy(F.date_trunc("hour", "mt").alias("hour")).agg((F.sum("w") / 60000.0).alias("kwh"))


def reference_coverage(samples: DataFrame, tz: str = "UTC", lo: Column | None = None, hi: Column | None = None, params: Params = DEFAULTS) -> DataFrame:
    """Share of each local day's 1440 minutes that some sample of the set holds for."""
    minutes = _between(samples, lo, hi).groupBy(F.date_trunc("minute", "ts").alias("m")).agg(F.max("ts").alias("src"))
    # days are worked on apart; a sample reaches over midnight at most once, so it is also put to the next day
    minutes = minutes.withColumn("__d", F.explode(F.array_distinct(F.array(F.to_date("m"), F.to_date(F.date_trunc("minute", F.col("src") + F.expr(f"INTERVAL {params.carry_min} MINUTES")))))))
    filled = _carried(minutes, ("__d",), hi, params)
    return filled.select("mt").distinct().groupBy(local_day(F.col("mt"), tz).alias("day")).agg((F.count("*") / 1440.0).alias("coverage"))


def sample_gaps(samples: DataFrame, lo: Column, least_min: int, cap_end: Column, key: str = "entity_id") -> DataFrame:
    """(key, start, end) of holes over least_min minutes between sample minutes, and to cap_end."""
    minutes = samples.where(F.col("ts") >= lo).select(key, F.date_trunc("minute", "ts").alias("m")).distinct()
    w = Window.partitionBy(key).orderBy("m")
    inner = minutes.select(key, F.lag("m").over(w).alias("start"), F.col("m").alias("end"))
    tail = minutes.groupBy(key).agg(F.max("m").alias("start"), F.max(cap_end).alias("end"))
    return inner.unionByName(tail).where((F.col("end").cast("double") - F.col("start").cast("double")) / 60.0 > least_min)


def plan_backfill(samples: DataFrame, lo: Column, least_min: int, cap_end: Column, key: str = "entity_id") -> DataFrame:
    """Ranges to fetch: before the first sample, and all gaps, cut to cap_end; empty ones dropped."""
    gaps = sample_gaps(samples, lo, least_min, cap_end, key)
    lead = samples.groupBy(key).agg(F.max(lo).alias("start"), F.min("ts").alias("end")).where((F.col("end").cast("double") - F.col("start").cast("double")) / 60.0 > least_min)
    return lead.unionByName(gaps).withColumn("end", F.least("end", cap_end)).where("start < end")


def reference_health(samples: DataFrame, as_of: Column, params: Params = DEFAULTS) -> DataFrame:
    """Last sample of each entity, whether stale, and its gaps in the 7 days before as_of."""
    last = samples.groupBy("entity_id").agg(F.max("ts").alias("last_ts"))
    week = as_of - F.expr("INTERVAL 7 DAYS")
    gaps = sample_gaps(samples, week, params.stale_min, as_of).groupBy("entity_id").agg(F.count("*").alias("gaps"))
    stale = as_of.cast("double") - F.col("last_ts").cast("double") > 60.0 * params.stale_min
    return last.join(gaps, "entity_id", "left").select("entity_id", "last_ts", stale.alias("stale"), F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"))


def hvac_status(samples: DataFrame, as_of: Column, params: Params = DEFAULTS) -> DataFrame:
    """Span and last action of each thermostat, stale after stale_min minutes."""
    rows = samples.groupBy("entity_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max(F.struct("ts", "action"))["action"].alias("action"))
    return rows.withColumn("stale", as_of.cast("double") - F.col("last_ts").cast("double") > 60.0 * params.stale_min)
