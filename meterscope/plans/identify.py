"""Which meter is it (I1-I20): rate ratio, regression on the monitored feed, calibration, confidence, lag,
and the ranking over several test windows. Windows are a column, never a loop: `window_id` is in every key.
"""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bucket_of, clamp01, commodity, correlation, round_half_away, time_bucket
from ..functions.joins import broadcast_checked, range_join
from ..operators.deltas import bucket_deltas, counter_steps, glitch_filter
from ..operators.reference import entity_energy, gapfill, hvac_power, monitored_cv, monitored_energy, monitored_floor, per_entity
from ..params import DEFAULTS, Params

C = F.col


def closed_windows(windows: DataFrame, source: str | None = None, params: Params = DEFAULTS) -> DataFrame:
    """Windows with an end, newest first, as many as the limit (a feature of the ranking)."""
    rows = windows.where("end_ts is not null")
    rows = rows if source is None else rows.where(C("source") == source)
    return rows.orderBy(C("start_ts").desc(), C("id").desc()).limit(params.windows_most)


def rate_ratio(rollup_1m: DataFrame, index: DataFrame, windows: DataFrame, params: Params = DEFAULTS, every_meter: bool = True) -> DataFrame:
    """Movement and rate of every meter in each window of windows(id, start_ts, end_ts) against its rate
    outside of it. Every meter has a row for every window: that is the ranking. Without every_meter only those
    heard in a window are listed, so that the work follows the readings and not meters times windows; the row of any
    other one would hold no more than its commodity, 0 and its usual rate."""
    w = windows.select(C("id").alias("window_id"), "start_ts", "end_ts")
    inside = in_windows(rollup_1m, w, "bucket").groupBy("window_id", "endpoint_id").agg((F.max("max_c") - F.min("min_c")).alias("wd"), F.sum("n").alias("wn"))
    span = F.broadcast(index.agg(((F.max("last_seen").cast("double") - F.min("first_seen").cast("double")) / 3600.0).alias("span_h")))
    meters = index.select("endpoint_id", "endpoint_type", (C("max_consumption") - C("min_consumption")).alias("total")).join(span)
    if every_meter:
        rows = meters.join(broadcast_checked(w)).join(inside, ["window_id", "endpoint_id"], "left")
    else:
        rows = inside.join(broadcast_checked(w), "window_id").join(meters, "endpoint_id")
    hours = (C("end_ts").cast("double") - C("start_ts").cast("double")) / 3600.0
    rows = rows.withColumn("wh", F.when(hours > 0, hours).otherwise(params.epsilon)).withColumn("oh", F.greatest(C("span_h") - C("wh"), F.lit(params.epsilon))).withColumn("d", F.coalesce("wd", F.lit(0.0)))
    outside = F.greatest(F.coalesce("total", F.lit(0.0)) - C("d"), F.lit(0.0))
    rate, base = C("d") / C("wh"), outside / C("oh")
    return rows.select("window_id", "endpoint_id", commodity(C("endpoint_type")).alias("commodity"), C("d").alias("window_delta"), F.coalesce("wn", F.lit(0)).cast("long").alias("window_packets"), round_half_away(rate, 4).alias("window_rate"), round_half_away(base, 4).alias("baseline_rate"), round_half_away(rate / F.greatest(base, F.lit(params.epsilon)), 3).alias("score"))


def reference_energy_buckets(entities: DataFrame, minutes: int, lo: Column, hi: Column) -> DataFrame:
    """Wh of every bucket in [lo, hi], 0 where nothing is monitored."""
    got = entities.groupBy(time_bucket(C("mt"), minutes).alias("bucket")).agg((F.sum("w") / 60.0).alias("wh"))
    bounds = entities.sparkSession.range(1).select(lo.alias("lo"), hi.alias("hi"))
    grid = bounds.select(F.explode(F.expr(f"sequence(timestamp_seconds(floor(unix_timestamp(lo) / {60 * minutes}) * {60 * minutes}), hi, INTERVAL {int(minutes)} MINUTES)")).alias("bucket"))
    return grid.join(got, "bucket", "left").select("bucket", F.coalesce("wh", F.lit(0.0)).alias("wh"))


def aligned_series(rolled: DataFrame, index: DataFrame, energy: DataFrame, minutes: int, params: Params = DEFAULTS) -> DataFrame:
    """I8: (endpoint_id, bucket, y, x): a meter's step and the monitored Wh of the same bucket."""
    steps = glitch_filter(bucket_deltas(rolled, index, minutes), params)
    return steps.join(energy, "bucket").select("endpoint_id", "bucket", C("delta").alias("y"), C("wh").alias("x"))


def _keys(rows: DataFrame) -> list[str]:
    """Of one window or, with a window in its columns, of several."""
    return [c for c in ("window_id", "endpoint_id") if c in rows.columns]


def bucket_minutes(windows: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """windows(id, start_ts, end_ts) as (window_id, start_ts, end_ts, minutes): the least width of the ladder
    that cuts a window into about bucket_target buckets."""
    want = F.floor(F.floor((C("end_ts").cast("double") - C("start_ts").cast("double")) / 60) / params.bucket_target)
    minutes = F.coalesce(*[F.when(want <= m, m) for m in params.bucket_ladder], F.lit(params.bucket_ladder[-1]))
    return windows.select(C("id").alias("window_id"), "start_ts", "end_ts", minutes.alias("minutes"))


def in_windows(rows: DataFrame, windows: DataFrame, at: str) -> DataFrame:
    """rows once for each window that holds their time `at`, both ends included, with the window's columns."""
    return range_join(rows, windows.withColumn("__until", C("end_ts") + F.expr("INTERVAL 1 MICROSECOND")), at, "start_ts", "__until").drop("__until")


def window_feed(samples: DataFrame, hvac: DataFrame | None, windows: DataFrame, heating_kw: float, cooling_kw: float, params: Params = DEFAULTS) -> DataFrame:
    """G4 of each window: (window_id, minutes, entity_id, mt, w, is_hvac); nothing is carried into a window or
    out of it."""
    keys = ("window_id", "minutes", "end_ts", "entity_id")
    filled = gapfill(in_windows(samples, windows, "ts"), None, C("end_ts"), params, keys)
    return per_entity(filled, None if hvac is None else hvac_power(in_windows(hvac, windows, "ts"), heating_kw, cooling_kw, None, C("end_ts"), params, keys)).drop("end_ts")


def aligned_windows(rollup_1m: DataFrame, rollup_1h: DataFrame, index: DataFrame, windows: DataFrame, feed: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """I8 of each window: (window_id, endpoint_id, bucket, y, x). Buckets of an hour and more are made of the
    1 h rollup, else of the 1 min rollup."""
    rows = in_windows(rollup_1m, windows.where("minutes < 60"), "bucket").unionByName(in_windows(rollup_1h, windows.where("minutes >= 60"), "bucket"))
    rows = rows.groupBy("window_id", "endpoint_id", bucket_of(C("bucket"), C("minutes")).alias("bucket")).agg(F.max("max_c").alias("cmax")).join(index.select("endpoint_id", "msg_type"), "endpoint_id")
    steps = glitch_filter(counter_steps(rows, ["window_id", "endpoint_id"], "bucket", "cmax"), params, keys=("window_id", "endpoint_id"))
    energy = feed.groupBy("window_id", bucket_of(C("mt"), C("minutes")).alias("bucket")).agg((F.sum("w") / 60.0).alias("wh"))
    return steps.join(energy, ["window_id", "bucket"], "left").select("window_id", "endpoint_id", "bucket", C("delta").alias("y"), F.coalesce("wh", F.lit(0.0)).alias("x"))


def regress_meters(aligned: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Correlation and regression of each meter's steps on the monitored energy, in each window."""
    rows = aligned.groupBy(*_keys(aligned)).agg(
        correlation().alias("r"), F.regr_slope("y", "x").alias("ols"), F.regr_r2("y", "x").alias("r2"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"),
        F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count("*").alias("buckets"), F.percentile("y", 0.1).alias("p10"),
    )
    return rows.where(C("buckets") >= params.regress_least)


def calibrate(regressed: DataFrame, minutes: int | Column, floor_w: Column) -> DataFrame:
    """I4: slope by orthogonal regression (least squares where that is not positive), kWh a count, the
    load without the monitored part, and whether the meter's low end covers the monitored floor."""
    hours = minutes / 60.0
    diff = C("syy") - C("sxx")
    deming = F.when(F.abs("sxy") < 1e-12, F.when(C("sxx") == 0, 0.0).otherwise(F.try_divide("sxy", "sxx"))).otherwise(F.try_divide(diff + F.sqrt(diff * diff + 4 * C("sxy") * C("sxy")), 2 * C("sxy")))
    slope = F.when(deming > 0, deming).when(C("ols") > 0, C("ols"))
    rows = regressed.withColumn("slope_raw", slope).withColumn("__floor", floor_w)
    intercept = C("my") - C("slope_raw") * C("mx")
    low = C("p10") / C("slope_raw") / hours
    return rows.select(
        *_keys(regressed), round_half_away(C("r"), 3).alias("r"), round_half_away(C("r2"), 3).alias("r2"), "buckets", round_half_away(C("slope_raw"), 6).alias("slope"),
        round_half_away(1 / (1000 * C("slope_raw")), 8).alias("multiplier"), round_half_away(intercept / C("slope_raw") / hours, 1).alias("baseline_w"),
        F.when((C("__floor") > 0) & C("slope_raw").isNotNull(), low >= 0.8 * C("__floor")).alias("floor_ok"),
    )


def snoop_threshold(k: int) -> float:
    """|r| x sqrt(n) that the best of k unrelated meters reaches once in twenty times."""
    return NormalDist().inv_cdf(1 - 0.025 / max(k, 1))


def _thresholds() -> Callable[[Column], Column]:
    """snoop_threshold of a column, an Arrow batch at a time: Spark has no inverse of the normal distribution."""

    @F.pandas_udf("double")
    def of(k: pd.Series) -> pd.Series:
        return k.map({int(x): snoop_threshold(int(x)) for x in k.dropna().unique()})

    return of


def snoop_factor(r: Column, n: Column, k: int | Column) -> Column:
    """Smooth step from 0.7 to 1.3 of the least meaningful r; 1 below 4 buckets or without r."""
    threshold = _thresholds()(k) if isinstance(k, Column) else F.lit(snoop_threshold(k))
    least = F.least(threshold / F.sqrt(n), F.lit(0.95))
    t = clamp01((F.abs(r) - 0.7 * least) / (0.6 * least))
    return F.when(r.isNull() | (n < 4), 1.0).otherwise(t * t * (3 - 2 * t))


def change_point(window_rate: Column, baseline_rate: Column) -> Column:
    """How much faster than usual."""
    return F.when(window_rate <= 0, 0.0).when(baseline_rate <= 0, 1.0).otherwise(clamp01(0.5 + 0.25 * (window_rate / baseline_rate - 1)))


def recon_fit(meter_kwh: Column, monitored_kwh: Column) -> Column:
    """Plausibility of metered over monitored energy: a house takes what is monitored and more."""
    q = meter_kwh / monitored_kwh
    fit = F.when(q < 0.5, clamp01(q / 0.5 * 0.4)).when(q <= 1, 0.7 + 0.3 * (q - 0.5) / 0.5).when(q <= 20, 1.0).when(q <= 100, 1 - 0.5 * (q - 20) / 80).otherwise(0.3)
    return F.when(meter_kwh.isNull() | monitored_kwh.isNull() | (meter_kwh <= 0) | (monitored_kwh <= 0), 0.5).otherwise(fit)


def lag_penalty(lag: Column, params: Params = DEFAULTS) -> Column:
    return clamp01(1 - 0.5 * F.abs(lag) / params.max_lag)


def add_confidence(ranking: DataFrame, k: int | Column, cv: Column, packets: Column, lag: Column | None = None, anchor: Column | None = None, params: Params = DEFAULTS) -> DataFrame:
    """Weighted score `confidence` and its `parts` for rows with r, r2, multiplier, meter_kwh,
    monitored_kwh, floor_ok, window_rate, baseline_rate, buckets; null without r. `anchor`, where a row has it, says
    how well a known load agrees (0 to 1) and outweighs the rest."""
    parts = {
        "corr": clamp01(C("r")), "r2": clamp01(F.coalesce("r2", C("r") * C("r"))), "recon": F.when(C("multiplier").isNull(), 0.5).otherwise(recon_fit(C("meter_kwh"), C("monitored_kwh"))),
        "packets": F.least(F.lit(1.0), C("buckets") / 30.0, F.when(packets > 0, packets / 60.0)), "floor": F.when(C("floor_ok") == F.lit(False), 0.4).otherwise(1.0),
        "change": F.coalesce(change_point(C("window_rate"), C("baseline_rate")), F.lit(0.5)),
    }
    share = F.when(cv < 0.25, clamp01(cv / 0.25)).otherwise(1.0)
    weights = {"corr": 0.45 * share, "r2": F.lit(0.10), "recon": 0.15 + 0.45 * (1 - share), "packets": F.lit(0.10), "floor": F.lit(0.10), "change": F.lit(0.10)}
    rows = ranking
    for name, value in parts.items():
        rows = rows.withColumn(f"__{name}", value)
    base = sum((weights[p] * C(f"__{p}") for p in parts), F.lit(0.0))
    agree = clamp01(anchor.cast("double")) if anchor is not None else F.lit(None).cast("double")
    if anchor is not None:
        base = F.when(anchor.isNotNull(), 0.45 * base + 0.55 * agree).otherwise(base)
    gate = lag_penalty(lag, params) if lag is not None else F.lit(1.0)
    rows = rows.withColumn("snoop", snoop_factor(C("r"), C("buckets").cast("double"), k))
    named = F.create_map(*[x for p in parts for x in (F.lit(p), C(f"__{p}").cast("double"))], F.lit("snoop"), C("snoop"))
    if anchor is not None:
        named = F.when(anchor.isNotNull(), F.map_concat(named, F.create_map(F.lit("anchor"), agree))).otherwise(named)
    return rows.withColumn("confidence", F.when(C("r").isNotNull(), clamp01(base * gate * C("snoop")))).withColumn("parts", named).drop(*[f"__{p}" for p in parts])


def physics_fold(ranking: DataFrame, verdicts: DataFrame) -> DataFrame:
    """With the screen's verdicts(endpoint_id, pass, screen_score): half and half if passed, a fifth if
    not; a survivor without r gets half its screen score."""
    return ranking.join(verdicts, "endpoint_id", "left").withColumn("confidence", _folded(C("confidence")))


def _folded(conf: Column) -> Column:
    return F.when(conf.isNull(), F.when(C("pass"), clamp01(0.5 * C("screen_score")))).when(C("pass"), clamp01(0.5 * conf + 0.5 * C("screen_score"))).when(~C("pass"), conf * 0.2).otherwise(conf)


def _pearson(a: Column, b: Column) -> Column:
    """Correlation of two arrays, 0 where one side is constant or there are fewer than two pairs: means and central
    moments are carried along the pairs, so a constant side has none exactly."""
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("n", "ma", "mb", "aa", "bb", "ab")])

    def add(s: Column, x: Column) -> Column:
        n = s["n"] + 1
        da, db = x["p"] - s["ma"], x["q"] - s["mb"]
        ma, mb = s["ma"] + da / n, s["mb"] + db / n
        new = {"n": n, "ma": ma, "mb": mb, "aa": s["aa"] + da * (x["p"] - ma), "bb": s["bb"] + db * (x["q"] - mb), "ab": s["ab"] + da * (x["q"] - mb)}
        return F.struct(*[v.alias(k) for k, v in new.items()])

    pairs = F.zip_with(a, b, lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    return F.aggregate(pairs, zero, add, lambda s: F.coalesce(F.try_divide(s["ab"], F.nullif(F.sqrt(s["aa"] * s["bb"]), F.lit(0.0))), F.lit(0.0)))


def cross_corr_lag(aligned: DataFrame, ids: DataFrame | None = None, params: Params = DEFAULTS) -> DataFrame:
    """Lag in buckets of the highest correlation of each meter with the feed, in each window, the first of
    equals; of series with lag_least points at all. A lag that leaves fewer than two pairs correlates by 0. A series
    is one ordered array, made in one shuffle (a window has some bucket_target buckets), and every lag is a pair
    of its slices."""
    keys = _keys(aligned)
    rows = aligned if ids is None else aligned.join(ids, keys, "left_semi")
    series = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bucket", "y", "x"))).alias("s")).where(F.size("s") >= params.lag_least)
    series = series.select(*keys, C("s.y").alias("y"), C("s.x").alias("x"))
    found = []
    for lag in range(-params.max_lag, params.max_lag + 1):
        n = F.greatest(F.size("y") - abs(lag), F.lit(0))
        r = _pearson(F.slice("y", max(lag, 0) + 1, n), F.slice("x", max(-lag, 0) + 1, n))
        found.append(F.struct(F.round(r, 12).alias("r"), F.lit(-lag).alias("minus"), n.cast("long").alias("n")))
    best = series.select(*keys, F.array_max(F.array(*found)).alias("b"))
    return best.select(*keys, (-C("b.minus")).alias("lag"), C("b.r").alias("lag_r"), C("b.n").alias("points"))


def identify(rolled: DataFrame, index: DataFrame, windows: DataFrame, entities: DataFrame, minutes: int, lo: Column, hi: Column, *, electric_only: bool = True, floor_w: float = 0.0, cv: float = 1.0, monitored_kwh: float = 0.0, k: int | None = None, verdicts: DataFrame | None = None, params: Params = DEFAULTS) -> DataFrame:
    """The ranking of one window. rolled is the 1 h rollup for buckets of an hour and more, else 1 min,
    cut to the window; scalars of the feed (G5, G7, G8) and the pool size k are given."""
    ranked = rate_ratio(rolled, index, windows, params)
    ranked = ranked.where(C("commodity") == "electric") if electric_only else ranked
    energy = reference_energy_buckets(entities, minutes, lo, hi)
    aligned = aligned_series(rolled, index, energy, minutes, params)
    found = calibrate(regress_meters(aligned, params), minutes, F.lit(float(floor_w)))
    rows = ranked.join(found, "endpoint_id", "left").withColumn("meter_kwh", round_half_away(C("window_delta") * C("multiplier"), 3)).withColumn("monitored_kwh", F.lit(float(monitored_kwh)))
    pool = k if k else max(1, found.where("r is not null").count())
    rows = add_confidence(rows, pool, F.lit(float(cv)), C("window_packets").cast("double"), params=params)
    top = rows.where("confidence is not null").orderBy(C("confidence").desc(), "endpoint_id").limit(params.lag_top).select("endpoint_id")
    rows = rows.join(cross_corr_lag(aligned, top, params).select("endpoint_id", "lag"), "endpoint_id", "left").withColumn("confidence", C("confidence") * F.coalesce(lag_penalty(C("lag"), params), F.lit(1.0)))
    rows = physics_fold(rows, verdicts) if verdicts is not None else rows
    return rows.withColumn("confidence", round_half_away(C("confidence"), 3)).orderBy(F.coalesce("confidence", F.lit(0.0)).desc(), C("score").desc(), "endpoint_id")


def identify_windows(rollup_1m: DataFrame, rollup_1h: DataFrame, index: DataFrame, windows: DataFrame, samples: DataFrame, hvac: DataFrame | None = None, *, heating_kw: float = 0.0, cooling_kw: float = 0.0, electric_only: bool = True, every_meter: bool = True, verdicts: DataFrame | None = None, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df, params: Params = DEFAULTS) -> DataFrame:
    """I12 of every window: (window_id, endpoint_id, r, multiplier, confidence, anchor, ...), each window on its
    own part of rollups and feed, with its own width of buckets and its own energy, variation and floor of the
    feed (G5, G7, G8). The screen's verdicts(endpoint_id, pass, screen_score) hold for all windows. The pool is
    the window's snoop_k if frozen, else the screen's survivors, else the window's meters with r. every_meter
    lists meters that were not heard in a window too, as rate_ratio does. keep(table, name) may store what is
    read more than once."""
    spans = bucket_minutes(windows, params)
    feed = keep(window_feed(samples, hvac, spans, heating_kw, cooling_kw, params), "window-feed")
    aligned = keep(aligned_windows(rollup_1m, rollup_1h, index, spans, feed, params), "window-series")
    scalars = windows.select(C("id").alias("window_id"), C("snoop_k").cast("long").alias("snoop_k")).join(spans.select("window_id", "minutes"), "window_id")
    for part in (monitored_energy(feed, "window_id").withColumnRenamed("kwh", "monitored_kwh"), monitored_cv(feed, "window_id"), monitored_floor(feed, "window_id")):
        scalars = scalars.join(part, "window_id", "left")  # a row a window
    ranked = rate_ratio(rollup_1m, index, windows, params, every_meter)
    ranked = ranked.where(C("commodity") == "electric") if electric_only else ranked
    found = calibrate(regress_meters(aligned, params).join(scalars.select("window_id", "minutes", "floor_w"), "window_id"), C("minutes"), C("floor_w"))
    rows = ranked.join(scalars.drop("floor_w", "minutes"), "window_id").join(found, ["window_id", "endpoint_id"], "left").withColumn("meter_kwh", round_half_away(C("window_delta") * C("multiplier"), 3))
    if verdicts is not None:
        survivors = verdicts.agg(F.count(F.when(C("pass"), 1)).alias("survivors"))
        rows = rows.join(verdicts.select("endpoint_id", "pass", "screen_score"), "endpoint_id", "left").join(F.broadcast(survivors))  # one row
    else:
        rows = rows.withColumns({"pass": F.lit(None).cast("boolean"), "screen_score": F.lit(None).cast("double"), "survivors": F.lit(0).cast("long")})
    each = Window.partitionBy("window_id")
    rows = rows.withColumn("pool", F.coalesce(F.when(C("snoop_k") > 0, C("snoop_k")), F.when(C("survivors") > 0, C("survivors")), F.count("r").over(each)))
    rows = keep(add_confidence(rows, C("pool"), C("cv"), C("window_packets").cast("double"), params=params), "window-ranking")
    best = F.row_number().over(each.orderBy(_folded(C("confidence")).desc_nulls_last(), C("score").desc(), "endpoint_id"))
    top = rows.withColumn("__best", best).where((C("__best") <= params.lag_top) & _folded(C("confidence")).isNotNull()).select("window_id", "endpoint_id")
    rows = rows.join(cross_corr_lag(aligned, top, params).select("window_id", "endpoint_id", "lag"), ["window_id", "endpoint_id"], "left")
    rows = rows.withColumn("confidence", _folded(C("confidence") * F.coalesce(lag_penalty(C("lag"), params), F.lit(1.0)))).drop("snoop_k", "survivors")
    return keep(known_load_anchor(rows, windows, entity_energy(feed, "window_id")), "windows-identified")


def known_load_anchor(ranking: DataFrame, windows: DataFrame, entity_kwh: DataFrame | None = None) -> DataFrame:
    """kWh a count from a window's known load, or its known entity's energy(entity_id, kwh), which may be
    given by window_id."""
    w = windows.select(C("id").alias("window_id"), "known_load_w", "known_entity_id", ((C("end_ts").cast("double") - C("start_ts").cast("double")) / 3600.0).alias("hours"))
    rows = ranking.join(w, "window_id")
    if entity_kwh is not None:
        by = [c for c in ("window_id",) if c in entity_kwh.columns]
        rows = rows.join(entity_kwh.select(*by, C("entity_id").alias("known_entity_id"), C("kwh").alias("entity_kwh")), [*by, "known_entity_id"], "left")
    else:
        rows = rows.withColumn("entity_kwh", F.lit(None).cast("double"))
    expected = F.coalesce(C("known_load_w") * C("hours") / 1000.0, "entity_kwh")
    return rows.withColumn("anchor", F.when((expected > 0) & (C("window_delta") > 0), expected / C("window_delta"))).drop("known_load_w", "known_entity_id", "hours", "entity_kwh")


def aggregate_confidence(rows: DataFrame) -> DataFrame:
    """I16: mean confidence times agreement of windows, stability of the multiplier, agreement with the
    anchor and with bills, for rows of I15."""
    total = C("total").cast("double")
    c = C("mean_conf") * F.when(total > 1, 0.6 + 0.25 * C("present") / total + 0.15 * C("wins") / total).otherwise(1.0)
    c = c * F.when((C("n_mult") >= 2) & (C("multiplier") > 0), clamp01(1.1 - F.try_divide(C("sd_mult"), C("multiplier")))).otherwise(1.0)
    far = lambda a, b: F.greatest(F.try_divide(a, b), F.try_divide(b, a))
    c = c * F.when((C("anchor") > 0) & (C("multiplier") > 0), clamp01(1.2 - 0.3 * (far(C("anchor"), C("multiplier")) - 1))).otherwise(1.0)
    against = F.coalesce("multiplier", "anchor")
    c = c * F.when((C("bill_multiplier") > 0) & (against > 0), clamp01(1.15 - 0.3 * (far(C("bill_multiplier"), against) - 1))).otherwise(1.0)
    return rows.withColumn("confidence", round_half_away(clamp01(c), 3))


def utility_only_confidence(cov: Column, r: Column, buckets: Column) -> Column:
    """What bills alone give, 0.7 at most; a variation that is not known counts half."""
    stability = F.when(cov.isNull(), 0.5).otherwise(clamp01(1 - cov))
    c = stability * (0.5 + 0.5 * F.least(F.lit(1.0), buckets / 3.0))
    c = F.when(r.isNotNull(), 0.5 * c + 0.5 * clamp01(r)).otherwise(c)
    return round_half_away(0.7 * c, 3)


def combined_ranking(per_window: DataFrame, bills: DataFrame | None = None) -> DataFrame:
    """Meters over all windows, from rows (window_id, endpoint_id, score, r, confidence, multiplier,
    anchor) and bill evidence (endpoint_id, multiplier, cov, r, buckets) of electric meters. `total` is the number
    of windows that were used; a meter that only bills know was in none of them, and won none: its scores and
    counts are 0."""
    first = F.row_number().over(Window.partitionBy("window_id").orderBy(F.coalesce("confidence", F.lit(0.0)).desc(), C("score").desc(), "endpoint_id"))
    total = F.broadcast(per_window.agg(F.countDistinct("window_id").alias("total")))  # one row
    rows = per_window.withColumn("place", first).groupBy("endpoint_id").agg(
        round_half_away(F.avg("score"), 3).alias("avg_score"), round_half_away(F.min("score"), 3).alias("min_score"), round_half_away(F.avg("r"), 3).alias("avg_r"), F.count(F.when(C("place") == 1, 1)).alias("wins"), F.countDistinct("window_id").alias("present"),
        F.avg("confidence").alias("mean_conf"), F.avg("multiplier").alias("multiplier"), F.stddev_samp("multiplier").alias("sd_mult"), F.count("multiplier").alias("n_mult"), F.avg("anchor").alias("anchor"),
    )
    if bills is not None:
        b = bills.select("endpoint_id", C("multiplier").alias("bill_multiplier"), C("cov").alias("bill_cov"), C("r").alias("bill_r"), C("buckets").alias("bill_buckets"))
        rows = rows.join(b, "endpoint_id", "full")
    else:
        rows = rows.withColumns({"bill_multiplier": F.lit(None).cast("double"), "bill_cov": F.lit(None).cast("double"), "bill_r": F.lit(None).cast("double"), "bill_buckets": F.lit(None).cast("long")})
    rows = rows.na.fill(0, ["avg_score", "min_score", "wins", "present", "n_mult"]).join(total)
    rows = aggregate_confidence(rows)
    only = F.when(C("bill_multiplier") > 0, utility_only_confidence(C("bill_cov"), C("bill_r"), C("bill_buckets")))
    rows = rows.withColumn("confidence", F.when(C("mean_conf").isNotNull(), C("confidence")).otherwise(only))
    return rows.orderBy(C("confidence").desc_nulls_last(), C("avg_r").desc_nulls_last(), C("wins").desc(), C("avg_score").desc(), "endpoint_id")


def freeze_snoop_k(windows: DataFrame, window_id: int, survivors: int) -> DataFrame:
    """The pool size of a window as it was when it closed; a later value does not change it."""
    own = (C("id") == window_id) & C("snoop_k").isNull()
    return windows.withColumn("snoop_k", F.when(own, F.lit(survivors)).otherwise(C("snoop_k")))


def with_commodity(rows: DataFrame, electric_only: bool = False) -> DataFrame:
    """I19."""
    rows = rows.withColumn("commodity", commodity(C("endpoint_type")))
    return rows.where(C("commodity") == "electric") if electric_only else rows

