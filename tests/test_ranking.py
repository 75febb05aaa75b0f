"""Identification, screen, bills, calendar, streaming."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterscope.operators import deltas as D
from meterscope.operators import health as H
from meterscope.operators import reference as G
from meterscope.operators import registry as R
from meterscope.operators import screen as P
from meterscope.operators import usage as U
from meterscope.operators import utility as B
from meterscope.plans import identify as I
from meterscope.streaming import jobs as T

BASE = datetime(2026, 1, 5)
at = lambda m: BASE + timedelta(minutes=m)
ts = lambda m: F.lit(at(m).isoformat(" ")).cast("timestamp")
READING = "ts timestamp, msg_type string, endpoint_id long, endpoint_type int, consumption double, source string"


def plug_and_meters(spark):
    """A plug at three levels; meter 21 counts 0.09 a watt-minute more than a steady 4, 22 is steady, 23 is a
    gas meter that follows as well."""
    watts = [(150, 620, 380)[m * m % 7 % 3] for m in range(90)]
    samples = spark.createDataFrame([(at(m), "s", float(w)) for m, w in enumerate(watts)], "ts timestamp, entity_id string, power_w double")
    rows, follow = [], 700.0
    for m, w in enumerate(watts):
        follow += 0.09 * w + 4
        rows += [(at(m) + timedelta(seconds=20), "IDM", i, t, c, "a") for i, t, c in ((21, 4, follow), (22, 4, 9000.0 + 30 * m), (23, 2, follow))]
    return watts, samples, spark.createDataFrame(rows, READING)


def test_the_following_meter_wins(spark):
    watts, samples, readings = plug_and_meters(spark)
    window = spark.createDataFrame([(1, at(0), at(90))], "id long, start_ts timestamp, end_ts timestamp")
    entities = G.per_entity(G.gapfill(samples, ts(0), ts(89)))
    floor = G.monitored_floor(entities).first()["floor_w"]
    assert floor == 150.0 and G.monitored_energy(entities).first()["kwh"] == round(sum(watts) / 60000, 3)
    args = (D.rollup(readings, 1), R.meter_index(readings), window, entities, 1, ts(0), ts(89))
    got = I.identify(*args, floor_w=floor, monitored_kwh=G.monitored_energy(entities).first()["kwh"], cv=G.monitored_cv(entities).first()["cv"]).collect()
    best = got[0]
    # a watt-hour is 60 watt-minutes: 0.09 x 60 counts
    assert best["endpoint_id"] == 21 and best["r"] > 0.999 and abs(best["slope"] - 5.4) < 0.01 and abs(best["multiplier"] - 1 / 5400) < 1e-6
    assert abs(best["baseline_w"] - 4 / 5.4 * 60) < 1 and best["floor_ok"] and best["confidence"] > 0.7
    assert {r["endpoint_id"] for r in got} == {21, 22} and got[1]["r"] is None
    assert {r["endpoint_id"] for r in I.identify(*args, electric_only=False).collect()} == {21, 22, 23}


def test_every_window_has_its_own_regression(spark):
    """Meter 1001 follows the plug in both windows, 1003 in the second one only; windows overlap, and each
    gives what it gives alone."""
    watts = [300 if m % 2 == 0 else 100 for m in range(60)] + [900 if m % 3 == 0 else 200 for m in range(60)]
    samples = spark.createDataFrame([(at(m), "s", float(w)) for m, w in enumerate(watts)], "ts timestamp, entity_id string, power_w double")
    rows, one, three = [], 1000.0, 1000.0
    for m, w in enumerate(watts):
        one, three = one + 0.1 * w, three + 0.1 * (w if m >= 60 else 400 - w)
        rows += [(at(m), "SCM", i, t, c, "a") for i, t, c in ((1001, 4, one), (1002, 4, 5000.0 + 5 * m), (1003, 4, three), (9001, 2, one))]
    readings = spark.createDataFrame(rows, READING)
    windows = [(1, at(0), at(59), 2000.0, None, None), (2, at(60), at(119), None, "s", 3), (3, at(30), at(119), None, None, None)]
    schema = "id long, start_ts timestamp, end_ts timestamp, known_load_w double, known_entity_id string, snoop_k int"
    run = lambda w: I.identify_windows(D.rollup(readings, 1), D.rollup(readings, 60), R.meter_index(readings), spark.createDataFrame(w, schema), samples)
    every = {(r["window_id"], r["endpoint_id"]): r for r in run(windows).collect()}
    assert set(every) == {(w, m) for w in (1, 2, 3) for m in (1001, 1002, 1003)}
    assert every[1, 1001]["r"] > 0.95 and every[1, 1003]["r"] < -0.95 and every[2, 1003]["r"] > 0.95
    assert every[1, 1002]["r"] is None and every[1, 1002]["confidence"] is None
    assert abs(every[1, 1001]["multiplier"] - 1e-3 / 6) < 3e-5 and every[1, 1001]["confidence"] > every[1, 1003]["confidence"]
    assert [every[w, 1001]["pool"] for w in (1, 2, 3)] == [2, 3, 2]
    assert [round(every[w, 1001]["monitored_kwh"], 3) for w in (1, 2)] == [round(sum(x) / 60000, 3) for x in (watts[:60], watts[60:])]
    hours, delta = 59 / 60, every[1, 1001]["window_delta"]
    assert abs(every[1, 1001]["anchor"] - 2.0 * hours / delta) < 1e-12 and abs(every[2, 1001]["anchor"] - every[2, 1001]["monitored_kwh"] / every[2, 1001]["window_delta"]) < 1e-12
    for w in windows:
        for r in run([w]).collect():
            assert r == every[w[0], r["endpoint_id"]]
    best = I.combined_ranking(run(windows)).first()
    assert best["endpoint_id"] == 1001 and best["avg_r"] > 0.95 and best["n_mult"] == 3 and best["sd_mult"] is not None


def test_only_meters_that_were_heard(spark):
    """The sparse ranking is the whole one without meters that have no packet in the window."""
    _, samples, readings = plug_and_meters(spark)
    quiet = spark.createDataFrame([(at(m), "IDM", 30 + m % 3, 4, 5.0 + m, "a") for m in range(12)], READING)  # not heard later
    readings = readings.unionByName(quiet)
    w = spark.createDataFrame([(1, at(20), at(60), None, None, None), (2, at(0), at(40), None, None, None)], "id long, start_ts timestamp, end_ts timestamp, known_load_w double, known_entity_id string, snoop_k int")
    r1m, index = D.rollup(readings, 1), R.meter_index(readings)
    full = sorted(map(tuple, I.rate_ratio(r1m, index, w).where("window_packets > 0").collect()))
    assert sorted(map(tuple, I.rate_ratio(r1m, index, w, every_meter=False).collect())) == full and len(full) == 9
    some, all_ = (I.identify_windows(r1m, D.rollup(readings, 60), index, w, samples, every_meter=e) for e in (False, True))
    key = lambda df: sorted(map(str, df.select("window_id", "endpoint_id", "r", "score", "confidence").collect()))
    assert key(some) == key(all_.where("window_packets > 0")) and all_.count() == 10


@pytest.mark.parametrize(("minutes", "width"), [(60, 1), (449, 2), (2880, 30), (4320, 30), (7200, 60), (100_000, 240)])
def test_width_of_buckets(spark, minutes, width):
    windows = spark.createDataFrame([(1, at(0), at(minutes))], "id long, start_ts timestamp, end_ts timestamp")
    assert I.bucket_minutes(windows).first()["minutes"] == width


def test_lag_is_recovered(spark):
    x = [float((7 * k * k) % 11) for k in range(40)]
    rows = [(1, at(10 * k), x[k - 2] if k >= 2 else 0.0, x[k]) for k in range(40)] + [(2, at(10 * k), 1.0, x[k]) for k in range(40)]
    df = spark.createDataFrame(rows, "endpoint_id long, bucket timestamp, y double, x double")
    got = {r["endpoint_id"]: (r["lag"], r["lag_r"]) for r in I.cross_corr_lag(df).collect()}
    assert got[1][0] == 2 and got[1][1] > 0.99 and got[2][1] == 0.0


def test_short_series_have_lags_too(spark):
    """Five points, the meter two buckets late: the lag needs four points in the series, not at each lag."""
    x = [3.0, 9.0, 1.0, 4.0, 0.0]
    rows = [(1, at(k), ([0.0, 0.0] + x)[k], x[k]) for k in range(5)] + [(2, at(k), x[k], x[k]) for k in range(3)]
    got = {r["endpoint_id"]: r["lag"] for r in I.cross_corr_lag(spark.createDataFrame(rows, "endpoint_id long, bucket timestamp, y double, x double")).collect()}
    assert got == {1: 2}


def test_lags_equal_a_plain_scan(spark):
    """Random, constant, falling and short series; a lag without two pairs correlates by 0 and may win."""
    g = random.Random(4)
    rows, want = [], {}

    def plain(a, b):
        if len(a) < 2:
            return 0.0
        ma, mb = sum(a) / len(a), sum(b) / len(b)
        aa, bb = sum((v - ma) ** 2 for v in a), sum((v - mb) ** 2 for v in b)
        return sum((p - ma) * (q - mb) for p, q in zip(a, b)) / math.sqrt(aa * bb) if aa * bb else 0.0

    for m in range(40):
        n = m % 9 + 2
        x = [float(g.randint(0, 9)) for _ in range(n)]
        y = [3.0] * n if m % 7 == 0 else [-v for v in x] if m % 5 == 0 else [float(g.randint(0, 9)) for _ in range(n)]
        rows += [(m, at(k), y[k], x[k]) for k in range(n)]
        if n >= 4:
            scan = []
            for lag in range(-5, 6):
                k = max(n - abs(lag), 0)
                scan.append((round(plain(y[max(lag, 0) :][:k], x[max(-lag, 0) :][:k]), 12), -lag))
            want[m] = (-max(scan)[1], max(scan)[0])
    df = spark.createDataFrame(rows, "endpoint_id long, bucket timestamp, y double, x double").repartition(3)
    got = {r["endpoint_id"]: (r["lag"], r["lag_r"]) for r in I.cross_corr_lag(df).collect()}
    assert {m: lag for m, (lag, _) in got.items()} == {m: lag for m, (lag, _) in want.items()}
    assert all(abs(got[m][1] - want[m][1]) < 1e-9 for m in want)


def test_constant_side_has_no_r(spark):
    df = spark.createDataFrame([(1, at(k), 1.0, float(k)) for k in range(9)], "endpoint_id long, bucket timestamp, y double, x double")
    assert I.regress_meters(df).first()["r"] is None


def test_snoop_gate_grows_with_the_pool(spark):
    row = spark.range(1).select(*[I.snoop_factor(F.lit(0.6), F.lit(20.0), k).alias(f"k{k}") for k in (4, 792)]).first()
    assert row["k4"] > row["k792"]


def test_combined_ranking_prefers_agreement(spark):
    rows = [(w, m, s, r, c, 0.001, None) for w in (1, 2) for m, s, r, c in ((1, 5.0, 0.9, 0.8), (2, 6.0, 0.2, 0.1))] + [(1, 3, 1.0, 0.5, 0.4, 0.5, None)]
    df = spark.createDataFrame(rows, "window_id long, endpoint_id long, score double, r double, confidence double, multiplier double, anchor double")
    bills = spark.createDataFrame([(1, 0.001, 0.02, None, 3), (4, 0.05, 0.0, None, 3)], "endpoint_id long, multiplier double, cov double, r double, buckets long")
    got = I.combined_ranking(df, bills).collect()
    assert got[0]["endpoint_id"] == 1 and got[0]["wins"] == 2 and got[0]["present"] == 2
    only = {r["endpoint_id"]: r for r in got}[4]  # bills alone know it
    assert only["confidence"] == 0.7 and (only["total"], only["wins"], only["present"], only["avg_score"], only["min_score"]) == (2, 0, 0, 0.0, 0.0)
    thirds = spark.createDataFrame([(w, 1, s, 0.5, 0.5, 0.1, None) for w, s in ((1, 1.0), (2, 1.0), (3, 2.0))], df.schema)
    assert I.combined_ranking(thirds).first()["avg_score"] == 1.333


def test_anchor_outweighs_the_rest(spark):
    row = spark.createDataFrame([(1, 0.9, 0.8, 0.001, 5.0, 5.0, None, 2.0, 1.0, 40, a) for a in (None, 1.0, 0.0)], "endpoint_id long, r double, r2 double, multiplier double, meter_kwh double, monitored_kwh double, floor_ok boolean, window_rate double, baseline_rate double, buckets long, agree double")
    plain = I.add_confidence(row, 1, F.lit(1.0), F.lit(90.0)).first()
    none, full, against = I.add_confidence(row, 1, F.lit(1.0), F.lit(90.0), anchor=F.col("agree")).collect()
    assert none["confidence"] == plain["confidence"] and "anchor" not in none["parts"]
    assert abs(full["confidence"] - (0.45 * plain["confidence"] + 0.55)) < 1e-9 and full["parts"]["anchor"] == 1.0
    assert abs(against["confidence"] - 0.45 * plain["confidence"]) < 1e-9


def test_period_of_a_statistic_without_rows(spark):
    bills = spark.createDataFrame([("a", "day", at(1)), ("a", "hour", at(2)), ("b", "", at(1))], "statistic_id string, period string, ts timestamp")
    asked = spark.createDataFrame([("a",), ("c",), ("c",)], "statistic_id string")
    assert {tuple(r) for r in R.stored_period(bills, asked).collect()} == {("a", "hour"), ("b", "month"), ("c", "month")}


def test_sources_by_rows(spark):
    rows = spark.createDataFrame([(at(k), s) for k, s in enumerate(["x", "y", "y", None, None, None, "w"])], "ts timestamp, source string")
    assert [r["source"] for r in R.table_stats({"t": rows}, rows)[1].collect()] == ["(none)", "y", "w", "x"]


def test_daily_screen(spark):
    days = [datetime(2026, 1, 1 + k).date() for k in range(6)]
    screen = spark.createDataFrame([(d, 30.0, True, True) for d in days], "day date, kwh double, covered boolean, used boolean")
    units = [(1, d, 35.0) for d in days] + [(2, d, 3500.0) for d in days] + [(3, d, 5.0) for d in days] + [(4, d, 12.0 if k == 3 else 32.0) for k, d in enumerate(days)] + [(5, d, 35.0) for d in days[:4]]
    index = spark.createDataFrame([(i, 4) for i in range(1, 6)], "endpoint_id long, endpoint_type int")
    got = {r["endpoint_id"]: r for r in P.daily_screen(spark.createDataFrame(units, "endpoint_id long, day date, units double"), screen, index).collect()}
    assert got[1]["pass"] and got[1]["unit"] == 1.0 and got[2]["pass"] and got[2]["unit"] == 0.01
    assert got[3]["reason"] == "magnitude" and got[4]["reason"].startswith("below monitored") and got[5]["pass"] is None and got[5]["reason"] == "no readings on 2026-01-05"


def test_screen_of_ignored_and_requested_meters(spark):
    days = [datetime(2026, 1, 1 + k).date() for k in range(4)]
    screen = spark.createDataFrame([(d, 30.0, True, True) for d in days], "day date, kwh double, covered boolean, used boolean")
    units = spark.createDataFrame([(i, d, 35.0) for i in (1, 2, 3, 4) for d in days], "endpoint_id long, day date, units double")
    index = spark.createDataFrame([(1, 4), (2, 4), (3, 2), (4, 2)], "endpoint_id long, endpoint_type int")
    meters = spark.createDataFrame([(2, True), (1, False)], "endpoint_id long, ignored boolean")
    run = lambda ids, **more: {r["endpoint_id"]: r for r in P.daily_screen(units, screen, index, meters=meters, requested=spark.createDataFrame([(i,) for i in ids], "endpoint_id long"), **more).collect()}
    assert set(run([])) == {1} and set(run([2, 3, 99])) == {1, 2, 3, 99}
    gone = run([99])[99]
    assert gone["pass"] is False and gone["reason"] == "no readings in the analysis window"
    assert P.survivors(P.daily_screen(units, screen, index)).first()["survivors"] == 2
    narrow = spark.createDataFrame([("b", 70.0, 80.0)], "statistic_id string, bill_low double, bill_high double")  # 42 to 112 kWh a day
    assert run([], bills=narrow)[1]["reason"] == "magnitude"
    wide = spark.createDataFrame([("b", 900.0, 999.0)], "statistic_id string, bill_low double, bill_high double")  # nothing is left: not used
    assert run([], bills=wide)[1]["pass"]
    detail = P.screen_day_detail(units, screen, P.daily_screen(units, screen, index)).where("endpoint_id = 1").collect()
    assert len(detail) == 4 and all(r["kwh"] == 35.0 and r["resid"] == 5.0 for r in detail)
    assert P.daily_screen(units, screen.limit(2), index, requested=index.limit(1)).count() == 0

def test_bills_give_the_multiplier(spark):
    hours = [(BASE + timedelta(hours=h), "IDM", 3001, 4, 10000.0 + 20 * h, "a") for h in range(24 * 91)]
    df = spark.createDataFrame(hours, READING)
    bills = spark.createDataFrame([("b", "month", BASE + timedelta(days=30 * k), 24.0 * 30 if k < 3 else 0.0) for k in range(4)], "statistic_id string, period string, ts timestamp, kwh double")
    evidence = B.bill_evidence(D.rollup(df, 60), R.meter_index(df), B.bill_buckets(bills))
    got = B.summarize_evidence(evidence).first()
    assert abs(got["multiplier"] - 0.05) < 0.002 and got["buckets"] == 3 and got["cov"] <= 0.05
    assert all(abs(r["metered_kwh"] - 720) < 5 for r in B.utility_compare(evidence, B.summarize_evidence(evidence)).collect())


def test_one_bill_says_nothing_of_variation(spark):
    hours = [(BASE + timedelta(hours=h), "IDM", 3001, 4, 10000.0 + 20 * h, "a") for h in range(24 * 31)]
    df = spark.createDataFrame(hours, READING)
    bills = spark.createDataFrame([("b", "month", BASE + timedelta(days=30 * k), 720.0 * (1 - k)) for k in range(2)], "statistic_id string, period string, ts timestamp, kwh double")
    evidence = B.bill_evidence(D.rollup(df, 60), R.meter_index(df), B.bill_buckets(bills))
    got = B.summarize_evidence(evidence).first()
    assert got["cov"] is None and got["multiplier"] > 0
    only = B.summarize_evidence(evidence).select(I.utility_only_confidence(F.col("cov"), F.col("r"), F.col("buckets")).alias("c")).first()["c"]
    assert only == 0.233
    nothing = B.summarize_evidence(evidence.withColumn("kwh", F.lit(0.0))).first()
    assert nothing["multiplier"] is None and nothing["cov"] is None


def test_evidence_begins_with_the_first_bill(spark):
    """Hours before the first bill do not reach into it; two statistics begin at their own times."""
    hours = [(BASE + timedelta(hours=h), "IDM", 3001, 4, 10000.0 + (5000 if h >= 24 else 0) + 10 * h, "a") for h in range(73)]
    df = spark.createDataFrame(hours, READING)
    bills = [("late", BASE + timedelta(hours=24), 5.0), ("late", BASE + timedelta(hours=48), 5.0), ("early", BASE, 1.0), ("early", BASE + timedelta(hours=48), 1.0)]
    buckets = B.bill_buckets(spark.createDataFrame([(s, "day", t, k) for s, t, k in bills], "statistic_id string, period string, ts timestamp, kwh double"))
    got = {r["statistic_id"]: (r["delta"], r["covered_h"]) for r in B.bill_evidence(D.rollup(df, 60), R.meter_index(df), buckets).collect()}
    assert got == {"late": (230.0, 23), "early": (5470.0, 47)}


def test_days_are_shaped_by_their_calendar_month(spark):
    """A bill from the 20th to the 20th: each day is held against its own month; no glitch filter on meters."""
    bills = spark.createDataFrame([("b", "month", datetime(2026, 1, 20), 310.0), ("b", "month", datetime(2026, 2, 20), 0.0), ("c", "month", datetime(2026, 2, 1), 28.0), ("c", "month", datetime(2026, 3, 1), 0.0)], "statistic_id string, period string, ts timestamp, kwh double")
    first = datetime(2026, 1, 1).date()
    reference = spark.createDataFrame([(first + timedelta(days=k), 2.0 if k < 31 else 4.0) for k in range(60) if k != 40], "day date, kwh double")
    rows = [(datetime(2026, 1, 18) + timedelta(hours=h), "IDM", 3001, 4, 5000.0 + 2 * h + (90_000 if h >= 240 else 0), "a") for h in range(24 * 30)]
    df = spark.createDataFrame(rows, READING)
    metered = B.daily_metered(D.rollup(df, 60), R.meter_index(df), spark.createDataFrame([(3001, 0.5)], "endpoint_id long, multiplier double"))
    got = {(r["statistic_id"], str(r["day"])): r for r in B.daily_estimate(B.bill_buckets(bills), reference, metered).collect()}
    assert len(got) == 31 + 28 and got["b", "2026-01-20"]["flat_kwh"] == 10.0
    assert abs(got["b", "2026-01-25"]["shaped_kwh"] - 310 * 2 / (12 * 2)) < 1e-3 and abs(got["b", "2026-02-05"]["shaped_kwh"] - 310 * 4 / (18 * 4)) < 1e-3
    assert got["b", "2026-02-10"]["shaped_kwh"] == 0.0 and abs(got["c", "2026-02-05"]["shaped_kwh"] - 28 / 27) < 1e-3
    assert got["b", "2026-01-25"]["metered_kwh"] == 24.0 and got["b", "2026-01-28"]["metered_kwh"] == 45_024.0
    rates = B.bill_monthly_rates(spark.createDataFrame([("b", datetime(2025, 2, 1), 56.0), ("b", datetime(2025, 7, 1), 310.0), ("z", datetime(2025, 2, 1), 28.0)], "statistic_id string, ts timestamp, kwh double"))
    far = B.daily_estimate_range(B.daily_estimate(B.bill_buckets(bills), reference, metered), rates, F.lit("2026-02-18").cast("date"), F.lit("2026-03-02").cast("date"))
    got = {(r["statistic_id"], str(r["day"])): (r["kwh"], r["projected"]) for r in far.collect()}
    assert got["b", "2026-02-19"] == (10.0, False) and got["b", "2026-02-20"] == (2.0, True) and got["b", "2026-03-01"] == (6.0, True)
    assert got["z", "2026-02-18"] == (1.0, True) and got["c", "2026-02-28"] == (1.0, False) and ("c", "2026-03-01") not in got


def test_health_of_tracked_meters(spark):
    meters = spark.createDataFrame([(1, True, False, False, True), (2, False, False, True, False), (3, False, True, False, False), (4, True, False, False, False)], "endpoint_id long, is_mine boolean, is_candidate boolean, publish boolean, ignored boolean")
    moving = [(at(m), "IDM", i, 4, 100.0 + (m if i != 2 or m < 700 else 700), "a") for i in (1, 2, 3) for m in range(0, 1500, 20)]
    still = [(at(m), "IDM", 4, 4, 100.0 + m, "a") for m in range(0, 1400, 20)]  # 4 falls silent: not heard, so not moving
    df = spark.createDataFrame(moving + still, READING)
    now = ts(1490)
    assert {r["subject"] for r in H.stuck(D.rollup(df, 1), meters, now).collect()} == {"2", "4"}
    assert {r["subject"] for r in H.dropouts(R.meter_index(df), meters, ts(1499)).collect()} == {"1", "2", "4"}
    assert H.stuck(D.rollup(df.limit(0), 1), meters, now).count() == 0


def test_page_totals_and_costs(spark):
    """A week of two counts an hour, seen on its fourth day."""
    rows = [(datetime(2026, 6, 20) + timedelta(hours=h), "IDM", 1, 4, 1000.0 + 2 * h, "a") for h in range(24 * 10 + 12)]
    df = spark.createDataFrame(rows, READING)
    meters = spark.createDataFrame([(1, "home", True, False, True, "h", 0.5, "kWh", False), (2, None, False, False, True, None, 2.0, None, False)], "endpoint_id long, label string, is_mine boolean, is_candidate boolean, publish boolean, pub_name string, pub_multiplier double, pub_unit string, ignored boolean")
    r1h, index = D.rollup(df, 60), R.meter_index(df)
    anchor = F.lit("2026-06-30 12:00:00").cast("timestamp")
    slots = U.period_slots(spark.range(1).select(anchor.alias("anchor")), "week")
    page = U.consumption_page(U.page_deltas(r1h, index, "week", anchor), meters, slots)
    got = {r["endpoint_id"]: r for r in U.page_totals(page, r1h, index, meters, "week", anchor, anchor).collect()}
    assert got[1]["total"] == 60.0 and got[1]["avg_per_day"] == 24.0 and got[1]["coverage"] == round(3 / 7, 3) and got[1]["previous_total"] == 168.0
    assert str(got[1]["prev_anchor"]) == "2026-06-21" and got[1]["next_anchor"] is None and got[2]["total"] is None and got[2]["coverage"] == 0.0
    power = U.derived_power(df, meters)
    movement = spark.createDataFrame([(1, "today", 24.0), (1, "week", 60.0)], "endpoint_id long, span string, movement double")
    over = {(r["role"], r["endpoint_id"]): r for r in U.overview(movement, meters, index, power, 0.25).collect()}
    assert set(over) == {("mine", 1), ("published", 1), ("published", 2)} and over["mine", 1]["cost_today"] == 3.0 and over["mine", 1]["month"] == 0.0
    assert over["published", 1]["week"] is None and over["published", 2]["cost_today"] == 0.0


@pytest.mark.parametrize(("view", "when", "n"), [("day", "2026-03-08 15:00:00", 23), ("day", "2026-11-01 15:00:00", 25), ("month", "2026-02-10 15:00:00", 28), ("year", "2026-02-10 15:00:00", 12), ("week", "2026-07-01 15:00:00", 7)])
def test_calendar(spark, view, when, n):
    slots = U.period_slots(spark.sql(f"SELECT TIMESTAMP '{when}' AS anchor"), view, "America/New_York").orderBy("slot").collect()
    assert len(slots) == n and all(a["end"] == b["start"] for a, b in zip(slots, slots[1:], strict=False))
    if view == "week":
        assert slots[0]["start"] == datetime(2026, 6, 28, 4)


def test_benchmark_counts_itself(spark):
    deltas = spark.createDataFrame([(i, at(0), 1, 10.0 * i) for i in range(1, 6)], "endpoint_id long, hb timestamp, n long, delta double")
    index = spark.createDataFrame([(i, 4) for i in range(1, 7)], "endpoint_id long, endpoint_type int")
    got = {r["endpoint_id"]: (r["peers"], r["median"], r["pct_below"]) for r in U.benchmark(deltas, index).collect()}
    assert got[3] == (5, 30.0, 40.0) and got[6][0] == 5 and got[6][2] == 0.0


def test_benchmark_equals_brute_force(spark):
    moved = {i: float((i * i * 7) % 50) * (10 ** (i % 3)) for i in range(80)}  # ties, zeros, three magnitudes
    kinds = {i: (4, 2, None, 11)[i % 4] for i in moved}
    deltas = spark.createDataFrame([(i, at(0), 1, v) for i, v in moved.items()], "endpoint_id long, hb timestamp, n long, delta double")
    index = spark.createDataFrame(list(kinds.items()), "endpoint_id long, endpoint_type int")
    for r in U.benchmark(deltas, index).collect():
        peers = sorted(v for i, v in moved.items() if v > 0 and kinds[i] == kinds[r["endpoint_id"]])
        half = len(peers) // 2
        median = peers[half] if len(peers) % 2 else (peers[half - 1] + peers[half]) / 2
        below = sum(v < moved[r["endpoint_id"]] for v in peers)
        assert r["peers"] == len(peers) and r["median"] == median and abs(r["pct_below"] - (100.0 * below / len(peers) if moved[r["endpoint_id"]] > 0 else 0.0)) < 1e-9


def test_auto_windows_and_their_stream(spark, tmp_path):
    power = [500.0] * 20 + [2000.0] * 8 + [500.0] * 20 + [2000.0] * 2 + [500.0] * 10 + [2000.0] * 30
    rows = [("h", at(k), w) for k, w in enumerate(power)]
    df = spark.createDataFrame(rows, "home string, ts timestamp, power_w double")
    batch = [(r["start_ts"], r["end_ts"], r["known_load_w"]) for r in T.auto_windows(df).orderBy("start_ts").collect()]
    assert batch[0][:2] == (at(20), at(28)) and len(batch) == 2 and batch[1][1] - batch[1][0] == timedelta(minutes=15)
    for k in range(3):
        spark.createDataFrame(rows[k * 30 : (k + 1) * 30], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = T.stream_auto_windows(stream, "0 seconds").writeStream.format("memory").queryName("auto").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["start_ts"], r["end_ts"], r["known_load_w"]) for r in spark.table("auto").collect()) == batch


def test_stream_rollup_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(at(m), "IDM", m % 3, 4, 100.0 + m, "a") for m in range(180)], READING)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = T.stream_rollup(stream, 60, "48 hours").writeStream.outputMode("complete").format("memory").queryName("rolled").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("rolled").collect())) == sorted(map(tuple, D.rollup(df, 60).collect()))


def test_late_readings_count_for_three_hours(spark, tmp_path):
    """One-minute rollups of three batches: two hours late still counts, six hours late does not any more."""
    first = [(at(m), "IDM", 1, 4, 100.0 + m, "a") for m in range(601)]
    second = [(at(605), "IDM", 1, 4, 705.0, "a")]
    third = [(at(480), "IDM", 1, 4, 999.0, "a"), (at(200), "IDM", 1, 4, 888.0, "a")]
    for part in (first, second, third):
        spark.createDataFrame(part, READING).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.createDataFrame(first[:1], READING).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = T.drain(T.stream_rollup(stream, 1, "3 hours"), "update")
    got = {}
    for r in rows.orderBy("batch").collect():
        got[r["bucket"]] = (r["min_c"], r["max_c"], r["n"])
    counted = spark.createDataFrame(first + second + third[:1], READING)
    assert got == {r["bucket"]: (r["min_c"], r["max_c"], r["n"]) for r in D.rollup(counted, 1).collect()} and got[at(480)] == (580.0, 999.0, 2)


def test_live_power_sums_last_values(spark, tmp_path):
    df = spark.createDataFrame([("h", at(0), "a", 5.0), ("h", at(1), "b", 7.0), ("h", at(2), "a", 1.0)], "home string, ts timestamp, entity_id string, w double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = T.live_power(stream, "0 seconds").writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["power_w"] for r in spark.table("live").orderBy("ts").collect()] == [5.0, 12.0, 8.0]


def test_hvac_is_part_of_live_power(spark, tmp_path):
    df = spark.createDataFrame([("h", at(0), "a", 5.0, None), ("h", at(1), "c", None, "heating"), ("h", at(2), "a", 1.0, None), ("h", at(3), "c", None, "off"), ("i", at(0), "c", None, "cooling")], "home string, ts timestamp, entity_id string, w double, action string")
    for k in range(2):  # the second batch goes on from the first one's state
        df.where(f"minute(ts) {'<' if k == 0 else '>='} 2").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    both = T.with_hvac(stream.where("w is not null"), stream.where("action is not null"), 1.5, 2.5)
    rows = T.drain(T.live_power(both, "0 seconds")).orderBy("home", "ts").collect()
    assert [r["power_w"] for r in rows] == [5.0, 1505.0, 1501.0, 1.0, 2500.0]


def test_published_feed_of_a_stream(spark, tmp_path):
    """Two batches: what is published after each is what the table so far says."""
    rows = [(at(m), "IDM", 1 + m % 2, 4, 100.0 + 3 * m, "a") for m in range(0, 200, 7)]
    df = spark.createDataFrame(rows, READING)
    meters = spark.createDataFrame([(1, True, "one", 0.5, None), (2, False, None, 1.0, None)], "endpoint_id long, publish boolean, pub_name string, pub_multiplier double, pub_unit string")
    for k, part in enumerate((rows[:15], rows[15:])):
        spark.createDataFrame(part, READING).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = T.drain(T.publish(stream, meters), "update").orderBy("batch").collect()
    last = df.where("endpoint_id = 1").agg(F.max("ts")).first()[0]
    want = U.published_feed(df, meters, F.lit(last.isoformat(" ")).cast("timestamp")).first()
    assert [r["endpoint_id"] for r in got] == [1, 1] and (got[-1]["energy"], got[-1]["power"], got[-1]["signal"], got[-1]["ts"]) == (want["energy"], want["power"], want["signal"], want["ts"])


def test_sliding_packets_of_a_stream_equal_batch(spark, tmp_path):
    df = spark.createDataFrame([(at(0) + timedelta(seconds=7 * k), "IDM", k % 3, 4, 1.0 + k, "ab"[k % 2]) for k in range(60)], READING)
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = T.drain(T.source_packets(stream), "update").drop("batch")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, T.source_packets(df).collect()))
