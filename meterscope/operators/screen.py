"""Daily physics screen (P1-P8): a house's meter takes at least what is monitored in it, each day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp01, commodity, local_day, round_half_away
from ..params import DEFAULTS, Params

C = F.col
UNITS = (1.0, 0.1, 0.01)


def meter_daily_units(deltas: DataFrame, tz: str = "UTC") -> DataFrame:
    """Counts of each meter and local day."""
    return deltas.groupBy("endpoint_id", local_day(C("hb"), tz).alias("day")).agg(F.sum("delta").alias("units"))


def screen_days(daily_kwh: DataFrame, coverage: DataFrame, first: Column, last: Column, params: Params = DEFAULTS) -> DataFrame:
    """(day, kwh, used) of full local days strictly between the dates first and last (the latest
    screen_most_days of them); used: covered well enough and with monitored energy."""
    lo = F.greatest(first, F.date_sub(last, params.screen_most_days))
    rows = daily_kwh.join(coverage, "day", "full").where((C("day") > lo) & (C("day") < last))
    good = F.coalesce(C("coverage"), F.lit(0.0)) >= params.screen_coverage
    return rows.select("day", F.coalesce("kwh", F.lit(0.0)).alias("kwh"), good.alias("covered"), (good & (F.coalesce("kwh", F.lit(0.0)) > 0)).alias("used"))


def magnitude_band(days: DataFrame, bills: DataFrame | None = None) -> DataFrame:
    """One row (mon, days, low, high): 0.9 to 3 times the mean monitored day, narrowed to 0.6 to 1.4 times
    what bills(bill_low, bill_high) of the season say, one row or none, if that leaves anything."""
    rows = days.where("used").agg(F.avg("kwh").alias("mon"), F.count("*").alias("days"))
    bills = rows.sparkSession.createDataFrame([], "bill_low double, bill_high double") if bills is None else bills
    rows = rows.join(F.broadcast(bills.agg(F.min("bill_low").alias("bill_low"), F.max("bill_high").alias("bill_high"))))  # one row
    low, high = 0.9 * C("mon"), 3.0 * C("mon")
    floor, ceiling = F.greatest(low, 0.6 * C("bill_low")), F.least(high, 1.4 * C("bill_high"))
    narrow = C("bill_low").isNotNull() & (floor < ceiling)
    return rows.select("mon", "days", F.when(narrow, floor).otherwise(low).alias("low"), F.when(narrow, ceiling).otherwise(high).alias("high"))


def last_used_day(days: DataFrame) -> DataFrame:
    """(day): the last screened day, whose month's bills the band is narrowed by."""
    return days.where("used").agg(F.max("day").alias("day"))


def infer_unit(means: DataFrame) -> DataFrame:
    """Of rows (endpoint_id, mean_units, mon, low, high) the unit that puts the mean day into the band,
    nearest to 1.25 times the monitored day; null if none does."""
    rows = means.withColumn("unit", F.explode(F.array(*[F.lit(u) for u in UNITS]))).withColumn("kwh_day", C("mean_units") * C("unit"))
    far = F.when((C("kwh_day") >= C("low")) & (C("kwh_day") <= C("high")), F.abs(F.ln(C("kwh_day") / (1.25 * C("mon")))))
    return rows.groupBy("endpoint_id").agg(F.min_by(F.when(far.isNotNull(), C("unit")), far).alias("unit"))


def daily_screen(units: DataFrame, days: DataFrame, index: DataFrame, *, meters: DataFrame | None = None, bills: DataFrame | None = None, requested: DataFrame | None = None, params: Params = DEFAULTS) -> DataFrame:
    """A row a meter: unit, kWh a day, residual mean and deviation, pass, reason, score. Electric meters
    that meters(endpoint_id, ignored) does not ignore, and those in requested(endpoint_id) whatever they are;
    a requested one without any reading fails. pass is null for meters that miss a day, which the reason
    names. Fewer than screen_least_days days: no rows. bills is the band of bill_band."""
    used = days.where("used").select("day", C("kwh").alias("mon_day"))  # at most screen_most_days rows
    band = F.broadcast(magnitude_band(days, bills).where(C("days") >= params.screen_least_days))  # one row
    pool = index.withColumn("commodity", commodity(C("endpoint_type"))).where(C("commodity") == "electric").select("endpoint_id")
    pool = pool if meters is None else pool.join(meters.where("ignored").select("endpoint_id"), "endpoint_id", "left_anti")
    asked = index.sparkSession.createDataFrame([], "endpoint_id long") if requested is None else requested.select("endpoint_id").distinct()
    pool = pool.unionByName(asked).distinct()
    heard = units.join(pool, "endpoint_id")
    rows = heard.join(F.broadcast(used), "day", "left")
    on_day = C("mon_day").isNotNull()
    means = rows.groupBy("endpoint_id").agg(F.avg(F.when(on_day, C("units"))).alias("mean_units"), F.count(F.when(on_day, 1)).alias("n_days"), F.collect_set(F.when(on_day, C("day"))).alias("seen")).join(band)
    every = F.broadcast(used.agg(F.array_sort(F.collect_list("day")).alias("every")))  # one row
    means = means.join(every).withColumn("missing", F.get(F.array_sort(F.array_except("every", "seen")), F.lit(0))).drop("every", "seen")
    rows = rows.where(on_day).select("endpoint_id", "day", "units", "mon_day").join(infer_unit(means), "endpoint_id")
    kwh = C("units") * C("unit")
    resid = kwh - C("mon_day")
    broken = F.min(F.when(resid < -F.greatest(F.lit(1.5), 0.05 * C("mon_day")), C("day")))
    each = rows.groupBy("endpoint_id").agg(F.first("unit").alias("unit"), F.avg(kwh).alias("kwh_day"), F.avg(resid).alias("resid_mean"), F.coalesce(F.stddev_samp(resid), F.lit(0.0)).alias("resid_sd"), broken.alias("broken"))
    out = means.join(each, "endpoint_id", "left")
    score = clamp01(0.3 + 0.4 * clamp01(1 - C("resid_sd") / (0.15 * C("mon") + 2)) + 0.3 * clamp01(1 - C("resid_mean") / F.greatest("mon", F.lit(1.0))))
    reason = F.when(C("missing").isNotNull(), F.concat(F.lit("no readings on "), C("missing").cast("string"))).when(C("unit").isNull(), "magnitude").when(C("broken").isNotNull(), F.concat(F.lit("below monitored on "), C("broken").cast("string"))).otherwise("")
    whole = C("missing").isNull()
    verdict = F.when(whole, reason == "")
    shown = lambda c, p: F.when(whole, round_half_away(C(c), p)).alias(c)
    out = out.select("endpoint_id", F.when(whole, C("unit")).alias("unit"), shown("kwh_day", 2), shown("resid_mean", 2), F.when(whole & C("unit").isNotNull(), round_half_away(C("resid_sd"), 2)).alias("resid_sd"), verdict.alias("pass"), reason.alias("reason"), F.when(verdict, round_half_away(score, 3)).alias("screen_score"))
    unheard = asked.join(units.select("endpoint_id").distinct(), "endpoint_id", "left_anti").join(band.select("days"))
    unheard = unheard.select("endpoint_id", *[F.lit(None).cast("double").alias(c) for c in ("unit", "kwh_day", "resid_mean", "resid_sd")], F.lit(False).alias("pass"), F.lit("no readings in the analysis window").alias("reason"), F.lit(None).cast("double").alias("screen_score"))
    return out.unionByName(unheard).orderBy(F.coalesce("pass", F.lit(False)).desc(), C("screen_score").desc_nulls_last(), "endpoint_id")


def screen_day_detail(units: DataFrame, days: DataFrame, screened: DataFrame) -> DataFrame:
    """P7's detail: kWh and residual of each meter and day that was screened; counts where no unit fits."""
    rows = screened.where("pass is not null").select("endpoint_id", "unit").join(units, "endpoint_id").join(F.broadcast(days.where("used").select("day", C("kwh").alias("monitored"))), "day")
    kwh = C("units") * F.coalesce("unit", F.lit(1.0))
    return rows.select("endpoint_id", "day", round_half_away(kwh, 3).alias("kwh"), F.when(C("unit").isNotNull(), round_half_away(kwh - C("monitored"), 3)).alias("resid"))


def survivors(screened: DataFrame) -> DataFrame:
    """How many meters pass: the pool that a window's ranking is held to."""
    return screened.agg(F.count(F.when(C("pass"), 1)).alias("survivors"))


def meter_screen_meta(index: DataFrame, coverage: DataFrame, meters: DataFrame) -> DataFrame:
    """Type, receivers, label and ignored flag of each meter."""
    n = coverage.groupBy("endpoint_id").agg(F.count("*").alias("sources"))
    rows = index.select("endpoint_id", "msg_type", "endpoint_type", "packets").join(n, "endpoint_id", "left").join(meters.select("endpoint_id", "label", "ignored"), "endpoint_id", "left")
    return rows.select("endpoint_id", "msg_type", commodity(C("endpoint_type")).alias("commodity"), "packets", F.coalesce("sources", F.lit(0)).cast("long").alias("sources"), "label", F.coalesce("ignored", F.lit(False)).alias("ignored"))
