"""Usage analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import commodity, local, local_day, round_half_away, time_bucket
from ..functions.joins import broadcast_checked, range_join
from ..params import DEFAULTS, Params
from .deltas import bucket_deltas, hourly_deltas, movement_between


def leaderboard(rollup_1m: DataFrame, deltas: DataFrame, coverage: DataFrame, index: DataFrame, meters: DataFrame, *, msg_type: str | None = None, electric_only: bool = False, include_ignored: bool = False, tracked_only: bool = False, published_only: bool = False) -> DataFrame:
    """Packets, receivers, first and last minute, movement and rate of each meter heard; most movement
    first (none counts as 0), then endpoint_id. Cut rollup and deltas to the time wanted beforehand. Tracked is
    the user's own meter; candidates are not."""
    heard = rollup_1m.groupBy("endpoint_id").agg(F.sum("n").alias("packets"), F.min("bucket").alias("first_minute"), F.max("bucket").alias("last_minute"))
    moved = deltas.groupBy("endpoint_id").agg(F.sum("delta").alias("movement"))
    sources = coverage.groupBy("endpoint_id").agg(F.count("*").alias("sources"))
    rows = heard.join(moved, "endpoint_id", "left").join(sources, "endpoint_id", "left").join(index.select("endpoint_id", "msg_type", "endpoint_type"), "endpoint_id").join(meters, "endpoint_id", "left")
    hours = (F.col("last_minute").cast("double") - F.col("first_minute").cast("double")) / 3600.0
    rows = rows.withColumn("packets_per_hour", round_half_away(F.col("packets") / F.when(hours > 0, hours).otherwise(1 / 3600.0), 2)).withColumn("commodity", commodity(F.col("endpoint_type")))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = rows if msg_type is None else rows.where(F.col("msg_type") == msg_type)
    rows = rows.where(F.col("commodity") == "electric") if electric_only else rows
    rows = rows if include_ignored else rows.where(~flag("ignored"))
    rows = rows.where(flag("is_mine")) if tracked_only else rows
    rows = rows.where(flag("publish")) if published_only else rows
    rows = rows.select("endpoint_id", "msg_type", "commodity", "label", "packets", F.coalesce("sources", F.lit(0)).cast("long").alias("sources"), "first_minute", "last_minute", "movement", "packets_per_hour")
    return rows.orderBy(F.coalesce("movement", F.lit(0.0)).desc(), "endpoint_id")


def meter_series(rolled: DataFrame, index: DataFrame, minutes: int) -> DataFrame:
    """Cumulative value, step and packets by bucket, for all meters of `rolled`; null steps are kept."""
    return bucket_deltas(rolled, index, minutes)


def multi_series(rolled: DataFrame, index: DataFrame, minutes: int, mode: str = "delta") -> DataFrame:
    """(endpoint_id, bucket, value): `cumulative` maxima or `delta` steps; null or not positive: none."""
    rows = bucket_deltas(rolled, index, minutes)
    return rows.select("endpoint_id", "bucket", F.col("cmax" if mode == "cumulative" else "delta").alias("value")).where("value > 0")


def period_bounds(view: str, anchor: Column, tz: str) -> tuple[Column, Column, Column]:
    """Local starts of the previous, this and the next period (day, week from Sunday, month, year) of a
    UTC anchor, as local wall-clock times."""
    at = local(anchor, tz)
    if view == "day":
        start, one = F.date_trunc("day", at), "INTERVAL 1 DAY"
    elif view == "week":
        start, one = F.date_trunc("day", at) - F.make_dt_interval(F.dayofweek(at) - 1), "INTERVAL 7 DAYS"
    elif view == "month":
        start, one = F.date_trunc("month", at), "INTERVAL 1 MONTH"
    elif view == "year":
        start, one = F.date_trunc("year", at), "INTERVAL 1 YEAR"
    else:
        raise ValueError(f"no such view: {view}")
    return start - F.expr(one), start, start + F.expr(one)


def period_slots(anchors: DataFrame, view: str, tz: str = "UTC") -> DataFrame:
    """(slot, start, end) of each period in anchors(anchor): hours of a day, days of a week or month,
    months of a year; start and end are UTC, so that days with a clock change have 23 or 25 hours."""
    _, lo, hi = period_bounds(view, F.col("anchor"), tz)
    utc = lambda c: F.to_utc_timestamp(c, tz)
    if view == "day":
        hours = F.sequence(utc(lo), utc(hi) - F.expr("INTERVAL 1 HOUR"), F.expr("INTERVAL 1 HOUR"))
        rows = anchors.select("anchor", F.posexplode(hours).alias("slot", "start"))
        return rows.withColumn("end", F.col("start") + F.expr("INTERVAL 1 HOUR"))
    one = F.expr("INTERVAL 1 MONTH" if view == "year" else "INTERVAL 1 DAY")
    rows = anchors.select("anchor", F.posexplode(F.sequence(lo, hi - one, one)).alias("slot", "at"))
    return rows.select("anchor", "slot", utc(F.col("at")).alias("start"), utc(F.col("at") + one).alias("end"))


def page_deltas(rollup_1h: DataFrame, index: DataFrame, view: str, anchor: Column, tz: str = "UTC", params: Params = DEFAULTS) -> DataFrame:
    """D4 of one page: steps of the period's hours, bounded by what the period and its look-back hold."""
    _, lo, hi = period_bounds(view, anchor, tz)
    lo, hi = F.to_utc_timestamp(lo, tz), F.to_utc_timestamp(hi, tz)
    cut = rollup_1h.where((F.col("bucket") >= lo - F.expr(f"INTERVAL {params.lookback_h} HOURS")) & (F.col("bucket") < hi))
    return hourly_deltas(cut, index, params).where(F.col("hb") >= lo)


def calibration(meters: DataFrame) -> DataFrame:
    """(endpoint_id, mult): a meter's multiplier counts if it has a unit."""
    calibrated = F.coalesce("pub_unit", F.lit("")) != ""
    return meters.select("endpoint_id", F.when(calibrated, F.coalesce("pub_multiplier", F.lit(1.0))).otherwise(1.0).alias("mult"))


def consumption_page(deltas: DataFrame, meters: DataFrame, slots: DataFrame) -> DataFrame:
    """U4: (endpoint_id, slot, start, value, packets) of every meter in `meters` and every slot; value is
    movement by the meter's calibration, null where there is no data. deltas are those of page_deltas."""
    got = range_join(deltas, slots, "hb").groupBy("endpoint_id", "slot").agg(F.sum("delta").alias("d"), F.sum("n").alias("packets"))
    page = slots.agg(F.collect_list(F.struct("slot", "start")).alias("slots"))  # one row: the slots of one page
    every = calibration(meters).join(F.broadcast(page)).select("endpoint_id", "mult", F.inline("slots"))
    return every.join(got, ["endpoint_id", "slot"], "left").select("endpoint_id", "slot", "start", round_half_away(F.col("d") * F.col("mult"), 3).alias("value"), F.coalesce("packets", F.lit(0)).cast("long").alias("packets"))


def page_totals(page: DataFrame, rollup_1h: DataFrame, index: DataFrame, meters: DataFrame, view: str, anchor: Column, as_of: Column, tz: str = "UTC", params: Params = DEFAULTS) -> DataFrame:
    """What stands around a page, a row a meter: total and mean of an elapsed day (null without data), coverage of
    its slots, the previous period's total, and the local days that the pages before and after start with
    (null: nothing there yet)."""
    bounds = period_bounds(view, anchor, tz)
    before, lo, hi = (F.to_utc_timestamp(c, tz) for c in bounds)
    now = page.groupBy("endpoint_id").agg(round_half_away(F.sum("value"), 3).alias("total"), F.sum("value").alias("__sum"), round_half_away(F.count("value") / F.count("*"), 3).alias("coverage"))
    span = page.sparkSession.range(1).select(F.lit("previous").alias("span"), before.alias("start"), lo.alias("end"))
    previous = movement_between(rollup_1h, index, span, params).select("endpoint_id", "movement")
    rows = now.join(calibration(meters), "endpoint_id").join(previous, "endpoint_id", "left").join(index.select("endpoint_id", "first_seen"), "endpoint_id", "left")
    until = F.when((as_of < hi) & (as_of > lo), as_of).otherwise(hi)
    days = F.greatest((until.cast("double") - lo.cast("double")) / 86400.0, F.lit(1 / 24.0))
    earlier = F.col("first_seen").isNull() | (lo > F.col("first_seen"))
    return rows.select(
        "endpoint_id", "total", round_half_away(F.col("__sum") / days, 3).alias("avg_per_day"), "coverage", round_half_away(F.col("movement") * F.col("mult"), 3).alias("previous_total"),
        F.when(earlier, F.to_date(bounds[0])).alias("prev_anchor"), F.when(hi <= as_of, F.to_date(bounds[2])).alias("next_anchor"),
    )


def overlay(slots: DataFrame, hourly: DataFrame, estimate: DataFrame | None = None, tz: str = "UTC") -> DataFrame:
    """Slots with monitored kWh, an hourly series(hour, kwh) added up in each, and, on pages of days, the
    bills' kWh of each day, of daily_estimate_range(day, kwh)."""
    got = range_join(hourly, slots, "hour").groupBy("slot", "start").agg(round_half_away(F.sum("kwh"), 3).alias("monitored"))
    rows = slots.select("slot", "start").join(got, ["slot", "start"], "left")
    if estimate is None:
        return rows.withColumn("bill", F.lit(None).cast("double"))
    billed = estimate.groupBy("day").agg(round_half_away(F.sum("kwh"), 3).alias("bill"))
    return rows.withColumn("day", local_day(F.col("start"), tz)).join(billed, "day", "left").drop("day")


def profile(deltas: DataFrame, by: tuple[str, ...], tz: str = "UTC") -> DataFrame:
    """Mean hourly step by local `hour` and/or `dow` (0: Sunday), over hours that have one."""
    at = local(F.col("hb"), tz)
    keys = {"hour": F.hour(at), "dow": F.dayofweek(at) - 1}
    return deltas.groupBy("endpoint_id", *[keys[k].alias(k) for k in by]).agg(F.avg("delta").alias("avg_delta"), F.count("*").alias("hours"))


def daily_rollup(deltas: DataFrame, tz: str = "UTC") -> DataFrame:
    """Movement by local day."""
    return deltas.groupBy("endpoint_id", local_day(F.col("hb"), tz).alias("day")).agg(F.sum("delta").alias("movement"), F.sum("n").alias("packets"))


def benchmark(deltas: DataFrame, index: DataFrame) -> DataFrame:
    """Each meter's movement among peers of its commodity that move: their number, median, and the
    share of them strictly below it. Peers are ranked in bands of movement about 1 % wide, whose counts are
    added up, so that no task holds all meters of a commodity."""
    moved = deltas.groupBy("endpoint_id").agg(F.sum("delta").alias("movement"))
    rows = index.select("endpoint_id", commodity(F.col("endpoint_type")).alias("commodity")).join(moved, "endpoint_id", "left").withColumn("movement", F.coalesce("movement", F.lit(0.0)))
    peer = rows.where("movement > 0").withColumn("band", F.floor(F.log2("movement") * 64))
    bands = peer.groupBy("commodity", "band").agg(F.count("*").alias("n"))  # a few thousand at most for a commodity
    each = Window.partitionBy("commodity")
    before = F.coalesce(F.sum("n").over(each.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bands = bands.select("commodity", "band", before.alias("before"), F.sum("n").over(each).alias("peers"))
    at = Window.partitionBy("commodity", "band").orderBy("movement")
    ranked = peer.withColumns({"below": F.rank().over(at) - 1, "place": F.row_number().over(at)}).join(bands, ["commodity", "band"])
    ranked = ranked.select("endpoint_id", "commodity", "movement", (F.col("before") + F.col("below")).alias("below"), (F.col("before") + F.col("place")).alias("place"), "peers")
    middle = (F.col("place") == F.floor((F.col("peers") + 1) / 2)) | (F.col("place") == F.ceil((F.col("peers") + 1) / 2))
    peers = ranked.groupBy("commodity").agg(F.max("peers").alias("peers"), F.avg(F.when(middle, F.col("movement"))).alias("median"))
    out = rows.join(peers, "commodity", "left").join(ranked.select("endpoint_id", "below"), "endpoint_id", "left")
    return out.select("endpoint_id", "commodity", "movement", F.coalesce("peers", F.lit(0)).cast("long").alias("peers"), "median", F.try_divide(100.0 * F.coalesce("below", F.lit(0)), F.col("peers")).alias("pct_below"))


def meter_info(index: DataFrame, meters: DataFrame) -> DataFrame:
    """Registry and annotations of every meter heard."""
    return index.join(meters, "endpoint_id", "left").withColumn("commodity", commodity(F.col("endpoint_type")))


def my_meter(meters: DataFrame) -> DataFrame:
    """The user's meter: marked as theirs first, else a candidate with a label; least id."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    labelled = F.coalesce("label", F.lit("")) != ""
    return meters.where(~flag("ignored") & (flag("is_mine") | (flag("is_candidate") & labelled))).orderBy(flag("is_mine").desc(), "endpoint_id").limit(1)


def latest_reading(readings: DataFrame) -> DataFrame:
    """Last time, value and type of each meter."""
    top = F.max(F.struct("ts", "consumption", "msg_type"))
    return readings.where("consumption is not null").groupBy("endpoint_id").agg(top.alias("t")).select("endpoint_id", "t.ts", "t.consumption", "t.msg_type")


def derived_power(readings: DataFrame, meters: DataFrame) -> DataFrame:
    """Rate between each meter's last two readings x multiplier; null if there are not two in time."""
    w = Window.partitionBy("endpoint_id").orderBy(F.col("ts").desc(), F.col("consumption").desc())
    two = readings.where("consumption is not null").withColumn("__i", F.row_number().over(w)).where("__i <= 2").groupBy("endpoint_id").agg(*[F.max(F.when(F.col("__i") == i, F.col(c))).alias(f"{c}{i}") for i in (1, 2) for c in ("ts", "consumption")])
    hours = (F.col("ts1").cast("double") - F.col("ts2").cast("double")) / 3600.0
    rate = F.when(hours > 0, (F.col("consumption1") - F.col("consumption2")) / hours)
    return two.join(meters.select("endpoint_id", "pub_multiplier"), "endpoint_id", "left").select("endpoint_id", (rate * F.coalesce("pub_multiplier", F.lit(1.0))).alias("power"))


def signal_per_hour(readings: DataFrame, as_of: Column) -> DataFrame:
    """U16: packets of each meter in the hour before as_of."""
    return readings.where((F.col("ts") > as_of - F.expr("INTERVAL 1 HOUR")) & (F.col("ts") <= as_of)).groupBy("endpoint_id").agg(F.count("*").alias("signal"))


def published_feed(readings: DataFrame, meters: DataFrame, as_of: Column) -> DataFrame:
    """What is published of each published meter: energy, power, signal."""
    own = meters.where(F.coalesce("publish", F.lit(False)))
    mine = readings.join(broadcast_checked(own.select("endpoint_id")), "endpoint_id", "left_semi")
    rows = own.select("endpoint_id", "pub_name", "pub_unit", F.coalesce("pub_multiplier", F.lit(1.0)).alias("mult")).join(latest_reading(mine), "endpoint_id").join(derived_power(mine, meters), "endpoint_id", "left").join(signal_per_hour(mine, as_of), "endpoint_id", "left")
    return rows.select("endpoint_id", "pub_name", "pub_unit", "ts", (F.col("consumption") * F.col("mult")).alias("energy"), "power", F.coalesce("signal", F.lit(0)).cast("long").alias("signal"))


def overview(movement: DataFrame, meters: DataFrame, index: DataFrame, power: DataFrame, tariff: float) -> DataFrame:
    """From movement(endpoint_id, span, movement) over the spans today, week and month: the user's meter
    with all three, and each published meter with today's, times the multiplier; the rate, and what today costs:
    of electric published meters, and of the user's if it is calibrated. A meter that is both stands twice."""
    mine = my_meter(meters).withColumn("role", F.lit("mine"))
    own = meters.where(F.coalesce("publish", F.lit(False))).withColumn("role", F.lit("published")).unionByName(mine)
    own = own.join(index.select("endpoint_id", "endpoint_type"), "endpoint_id", "left")
    mult = F.coalesce("pub_multiplier", F.lit(1.0))
    by = movement.groupBy("endpoint_id").pivot("span", ["today", "week", "month"]).agg(F.sum("movement"))
    rows = own.join(by, "endpoint_id", "left").join(power, "endpoint_id", "left")
    value = lambda s: round_half_away(F.coalesce(F.col(s), F.lit(0.0)) * mult, 3)
    is_mine = F.col("role") == "mine"
    costs = F.when(is_mine, F.coalesce("pub_unit", F.lit("")) != "").otherwise(commodity(F.col("endpoint_type")) == "electric")
    cost = F.when(costs & F.lit(tariff > 0), round_half_away(value("today") * tariff, 2)).otherwise(0.0)
    name = F.when(is_mine, F.col("label")).otherwise(F.coalesce("pub_name", F.lit("")))
    return rows.select("role", "endpoint_id", name.alias("name"), value("today").alias("today"), *[F.when(is_mine, value(s)).alias(s) for s in ("week", "month")], round_half_away(F.col("power"), 3).alias("power"), cost.alias("cost_today"))


def local_series(rolled: DataFrame, minutes: int) -> DataFrame:
    """D5 as a table: rollup rows with the bucket of another width beside them."""
    return rolled.withColumn("wide", time_bucket(F.col("bucket"), minutes))
