"""Bill analytics (B1-B13). Bills are rows (statistic_id, ts, kwh), a bill's span ends where the next begins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clamp01, commodity, correlation, local_day, round_half_away
from ..functions.joins import range_join
from ..params import DEFAULTS, Params
from .deltas import counter_steps


def bill_buckets(bills: DataFrame, unit_factor: float = 1.0) -> DataFrame:
    """B1: (statistic_id, bstart, bend, kwh); the newest bill is open and left out."""
    w = Window.partitionBy("statistic_id").orderBy("ts")
    rows = bills.select("statistic_id", F.col("ts").alias("bstart"), F.lead("ts").over(w).alias("bend"), (F.col("kwh") * unit_factor).alias("kwh"))
    return rows.where("bend is not null")


def _steps_in_bills(rollup_1h: DataFrame, index: DataFrame, buckets: DataFrame) -> DataFrame:
    """Hourly steps in each bill, without the glitch filter. A statistic's hours begin with its first bill, so
    the first hour heard of it has no step: what moved before it is not in the bills."""
    rows = counter_steps(rollup_1h.join(index.select("endpoint_id", "msg_type"), "endpoint_id"), ["endpoint_id"], "bucket", "max_c")
    rows = range_join(rows.select("endpoint_id", F.col("bucket").alias("hb"), "delta"), buckets, "hb", "bstart", "bend")
    first = F.min("hb").over(Window.partitionBy("endpoint_id", "statistic_id"))
    return rows.withColumn("__first", first).where((F.col("hb") > F.col("__first")) & F.col("delta").isNotNull()).drop("__first")


def bill_evidence(rollup_1h: DataFrame, index: DataFrame, buckets: DataFrame) -> DataFrame:
    """B2: movement, hours covered and hours of each meter and bill; only where there is movement."""
    span = (F.col("bend").cast("double") - F.col("bstart").cast("double")) / 3600.0
    rows = _steps_in_bills(rollup_1h, index, buckets).groupBy("endpoint_id", "statistic_id", "bstart", "bend", "kwh").agg(F.sum("delta").alias("delta"), F.count("*").alias("covered_h"))
    return rows.where("delta > 0").withColumn("bucket_h", span)


def summarize_evidence(evidence: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """By meter the coverage-weighted multiplier (null if it is not above 0), its variation (null with
    one bill, which says nothing of it), r from enough bills, bills covered."""
    cover = clamp01(F.col("covered_h") / F.col("bucket_h"))
    rows = evidence.withColumn("cov", cover).withColumn("mult", F.col("kwh") * F.col("cov") / F.col("delta")).withColumn("x", F.col("kwh") * F.col("cov")).withColumn("y", F.col("delta"))
    out = rows.groupBy("endpoint_id").agg(F.try_divide(F.sum(F.col("mult") * F.col("cov")), F.sum("cov")).alias("m"), F.stddev_samp("mult").alias("sd"), correlation().alias("r"), F.count("*").alias("buckets"))
    good = F.col("m") > 0
    return out.select("endpoint_id", F.when(good, round_half_away(F.col("m"), 8)).alias("multiplier"), F.when(good, round_half_away(F.try_divide("sd", "m"), 3)).alias("cov"), F.when(F.col("buckets") >= params.bill_r_buckets, round_half_away(F.col("r"), 3)).alias("r"), "buckets")


def utility_compare(evidence: DataFrame, summary: DataFrame) -> DataFrame:
    """Billed and metered kWh of each meter and bill."""
    cover = clamp01(F.col("covered_h") / F.col("bucket_h"))
    return evidence.join(summary.select("endpoint_id", "multiplier"), "endpoint_id").select("endpoint_id", "bstart", "kwh", round_half_away(F.col("delta") * F.col("multiplier"), 3).alias("metered_kwh"), round_half_away(cover, 3).alias("coverage"))


def reconcile(rollup_1h: DataFrame, index: DataFrame, meters: DataFrame, buckets: DataFrame) -> DataFrame:
    """kWh of all published or own electric meters in each bill, and the share of hours covered."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    own = meters.where(flag("publish") | flag("is_mine")).join(index.where(commodity(F.col("endpoint_type")) == "electric").select("endpoint_id"), "endpoint_id").select("endpoint_id", F.coalesce("pub_multiplier", F.lit(1.0)).alias("mult"))
    rows = _steps_in_bills(rollup_1h.join(own.select("endpoint_id"), "endpoint_id", "left_semi"), index, buckets).join(own, "endpoint_id")
    span = (F.col("bend").cast("double") - F.col("bstart").cast("double")) / 3600.0
    out = rows.groupBy("statistic_id", "bstart", "bend").agg(F.sum(F.col("delta") * F.col("mult")).alias("metered_kwh"), F.countDistinct("hb").alias("covered_h"))
    return out.select("statistic_id", "bstart", "metered_kwh", clamp01(F.col("covered_h") / span).alias("coverage"))


def daily_metered(rollup_1h: DataFrame, index: DataFrame, multipliers: DataFrame, tz: str = "UTC") -> DataFrame:
    """(day, kwh) of all meters in multipliers(endpoint_id, multiplier) together: each local day's highest value
    less that of the day before with one, wraps undone, without the glitch filter."""
    rows = rollup_1h.join(multipliers.select("endpoint_id", "multiplier"), "endpoint_id").groupBy("endpoint_id", "multiplier", local_day(F.col("bucket"), tz).alias("day")).agg(F.max("max_c").alias("cmax"))
    rows = counter_steps(rows.join(index.select("endpoint_id", "msg_type"), "endpoint_id"), ["endpoint_id"], "day", "cmax")
    return rows.groupBy("day").agg(F.sum(F.col("delta") * F.col("multiplier")).alias("kwh"))


def daily_estimate(buckets: DataFrame, daily_reference: DataFrame, metered: DataFrame, tz: str = "UTC") -> DataFrame:
    """Each local day of each bill: kWh spread flat; shaped like the monitored day in its calendar month,
    as far as the bills reach (null without monitored energy there); and metered kWh. From
    daily_reference(day, kwh) and metered(day, kwh), of one meter or of the home's together (daily_metered)."""
    day = lambda c: local_day(F.col(c), tz)
    rows = buckets.withColumn("__n", F.datediff(day("bend"), day("bstart"))).where("__n > 0").withColumn("day", F.explode(F.sequence(day("bstart"), F.date_sub(day("bend"), 1))))
    rows = rows.join(daily_reference.select("day", F.col("kwh").alias("ref")), "day", "left").join(metered.select("day", F.col("kwh").alias("metered")), "day", "left")
    month = F.sum("ref").over(Window.partitionBy("statistic_id", F.trunc("day", "month")))
    shaped = F.when((month > 0) & (F.col("kwh") > 0), F.col("kwh") * (F.coalesce("ref", F.lit(0.0)) / month))
    return rows.select("statistic_id", "day", round_half_away(F.col("kwh") / F.col("__n"), 3).alias("flat_kwh"), round_half_away(shaped, 3).alias("shaped_kwh"), round_half_away(F.col("metered"), 3).alias("metered_kwh"))


def bill_monthly_rates(bills: DataFrame, unit_factor: float = 1.0, tz: str = "UTC") -> DataFrame:
    """kWh a day of a statistic's monthly bills by calendar month: mean, least, most; month 0 holds all."""
    day = local_day(F.col("ts"), tz)
    rows = bills.where(F.col("kwh") > 0).select("statistic_id", F.month(day).alias("month"), (F.col("kwh") * unit_factor / F.dayofmonth(F.last_day(day))).alias("rate"))
    both = rows.unionByName(rows.withColumn("month", F.lit(0)))
    return both.groupBy("statistic_id", "month").agg(F.avg("rate").alias("rate"), F.min("rate").alias("least"), F.max("rate").alias("most"))


def _rates_of(rows: DataFrame, rates: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """rows(statistic_id, month, ...) with `columns` of the same calendar month's rates, of all where it has none."""
    own = rates.where("month > 0").select("statistic_id", "month", *[F.col(c).alias(f"__own_{c}") for c in columns])
    general = rates.where("month = 0").select("statistic_id", *[F.col(c).alias(f"__all_{c}") for c in columns])
    rows = rows.join(own, ["statistic_id", "month"], "left").join(general, "statistic_id", "left")
    out = rows.select("*", *[F.coalesce(f"__own_{c}", f"__all_{c}").alias(c) for c in columns])
    return out.drop(*[f"__{k}_{c}" for k in ("own", "all") for c in columns])


def bill_band(rates: DataFrame, day: Column | DataFrame) -> DataFrame:
    """(bill_low, bill_high): least and most kWh a day that bills of the day's calendar month say, one row a
    statistic; day is a date, or a table of one row with one."""
    days = day if isinstance(day, DataFrame) else rates.sparkSession.range(1).select(day.alias("day"))
    rows = rates.select("statistic_id").distinct().join(F.broadcast(days.select(F.month("day").alias("month"))))  # one row
    return _rates_of(rows, rates, ("least", "most")).select("statistic_id", round_half_away(F.col("least"), 2).alias("bill_low"), round_half_away(F.col("most"), 2).alias("bill_high"))


def daily_estimate_range(estimate: DataFrame, rates: DataFrame, start: Column, end: Column) -> DataFrame:
    """The days [start, end] of each statistic's estimate, and beyond its last day the mean of the same
    calendar month's bills (of all, if there are none), flagged."""
    statistics = estimate.select("statistic_id").union(rates.select("statistic_id")).distinct()
    slots = statistics.select("statistic_id", F.explode(F.sequence(start, end)).alias("day"))
    real = estimate.select("statistic_id", "day", "flat_kwh", "shaped_kwh", F.lit(True).alias("__real"))
    last = estimate.groupBy("statistic_id").agg(F.max("day").alias("last"))
    rows = slots.join(last, "statistic_id", "left").join(real, ["statistic_id", "day"], "left").withColumn("month", F.month("day"))
    rows = _rates_of(rows, rates, ("rate",))
    ahead = F.col("__real").isNull() & (F.col("last").isNull() | (F.col("day") > F.col("last"))) & F.col("rate").isNotNull()
    kwh = F.when(F.col("__real"), F.col("flat_kwh")).otherwise(round_half_away(F.col("rate"), 3))
    return rows.where(F.col("__real") | ahead).select("statistic_id", "day", kwh.alias("kwh"), "shaped_kwh", ahead.alias("projected"))


def monthly_kwh(bills: DataFrame, unit_factor: float = 1.0, tz: str = "UTC") -> DataFrame:
    """Billed kWh by local month."""
    return bills.groupBy("statistic_id", F.trunc(local_day(F.col("ts"), tz), "month").alias("month")).agg(F.sum(F.col("kwh") * unit_factor).alias("kwh"))


def bill_series(bills: DataFrame, reconciled: DataFrame, tariff: float = 0.0, unit_factor: float = 1.0) -> DataFrame:
    """Bills with cost, metered kWh and coverage, and total and number of all."""
    cost = F.when(F.lit(tariff > 0), round_half_away(F.col("kwh") * unit_factor * tariff, 2))
    each = Window.partitionBy("statistic_id")
    rows = bills.select("statistic_id", "ts", (F.col("kwh") * unit_factor).alias("kwh"), cost.alias("cost"), F.sum(F.col("kwh") * unit_factor).over(each).alias("total_kwh"), F.count("*").over(each).alias("bills"))
    return rows.join(reconciled.select("statistic_id", F.col("bstart").alias("ts"), "metered_kwh", "coverage"), ["statistic_id", "ts"], "left")


def bill_energy(bills: DataFrame, lo: Column | None = None, hi: Column | None = None) -> DataFrame:
    """kWh, first, last and number of bills in [lo, hi]."""
    rows = bills if lo is None else bills.where(F.col("ts") >= lo)
    rows = rows if hi is None else rows.where(F.col("ts") <= hi)
    return rows.groupBy("statistic_id").agg(F.sum("kwh").alias("kwh"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("bills"))


def tracking_pct(series: DataFrame) -> DataFrame:
    """Metered share of the newest bill that has both."""
    rows = series.where("metered_kwh is not null and kwh > 0")
    return rows.groupBy("statistic_id").agg(F.max(F.struct("ts", (100.0 * F.col("metered_kwh") / F.col("kwh")).alias("pct")))["pct"].alias("pct"))
