"""The monitored feed: bounded carry, HVAC, coverage, gaps, backfill."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from meterscope.operators import reference as G
from meterscope.sources import ingest as S

BASE = datetime(2026, 1, 5)
at = lambda m: BASE + timedelta(minutes=m)
ts = lambda m: F.lit(at(m).isoformat(" ")).cast("timestamp")


def samples(spark, rows):
    return spark.createDataFrame([(at(m), e, float(w), "live") for m, e, w in rows], "ts timestamp, entity_id string, power_w double, src string")


def test_carry_ends_after_fifteen_minutes(spark):
    """750 W each 4 minutes until minute 40: 56 minutes hold, then nothing, whatever is asked for."""
    df = samples(spark, [(m, "s", 750) for m in range(0, 41, 4)])
    entities = G.per_entity(G.gapfill(df, ts(0), ts(240)))
    assert G.monitored_energy(entities).first()["kwh"] == round(56 * 750 / 60000, 3)
    series = {r["bucket"]: r["power_w"] for r in G.aggregate_series(entities, 10).collect()}
    assert max(series) == at(50) and set(series.values()) == {750.0}


def test_fill_equals_brute_force(spark):
    rows = [(m, e, 10 * m + i) for i, e in enumerate(("a", "b")) for m in (0, 1, 4, 4, 30, 33, 90) if m % (i + 2) != 1]
    got = {(r["entity_id"], r["mt"]): r["w"] for r in G.gapfill(samples(spark, rows), ts(0), ts(100)).collect()}
    want = {}
    for e in ("a", "b"):
        for minute in range(101):
            own = [m for m, x, _ in rows if x == e and m <= minute]
            if own and minute <= max(own) + 15:
                values = [w for m, x, w in rows if x == e and m == max(own)]
                want[e, at(minute)] = sum(values) / len(values)
    assert got == want


def test_hvac_adds_its_kilowatts(spark):
    """45 minutes of cooling, then the fan: only cooling counts, carried to the minute before the next state."""
    acts = spark.createDataFrame([(at(m), "c", "cooling" if m < 45 else "fan") for m in range(0, 90, 9)], "ts timestamp, entity_id string, action string")
    base = samples(spark, [(m, "s", 400) for m in range(90)])
    for kw in (1.25, 2.0):
        entities = G.per_entity(G.gapfill(base, ts(0), ts(89)), G.hvac_power(acts, 9.0, kw, ts(0), ts(89)))
        assert G.monitored_energy(entities).first()["kwh"] == round((90 * 400 + 45 * 1000 * kw) / 60000, 3)
        assert G.entity_energy(entities).first()["kwh"] == 0.6


def test_floor_cv_and_constant_feed(spark):
    entities = G.per_entity(G.gapfill(samples(spark, [(m, "s", 200) for m in range(60)]), ts(0), ts(59)))
    assert G.monitored_floor(entities).first()["floor_w"] == 200.0 and G.monitored_cv(entities).first()["cv"] == 0.0
    empty = G.per_entity(G.gapfill(samples(spark, [])))
    assert G.monitored_energy(empty).first()["kwh"] is None and G.monitored_cv(empty).first()["cv"] is None


def test_coverage_over_midnight_equals_brute_force(spark):
    minutes = [1430, 1436, 1450, 1500, 2000, 2879]
    df = samples(spark, [(m, "s", 5) for m in minutes])
    covered = {m for s in minutes for m in range(s, s + 16)}
    want = {}
    for m in covered:
        want[at(m).date()] = want.get(at(m).date(), 0) + 1
    got = {r["day"]: round(r["coverage"] * 1440) for r in G.reference_coverage(df).collect()}
    assert got == want


def test_gaps_plan_and_idempotent_backfill(spark):
    df = samples(spark, [(m, "s", 5) for m in (*range(0, 61, 5), *range(240, 301, 5))])
    gaps = [(r["start"], r["end"]) for r in G.sample_gaps(df, ts(0), 30, ts(400)).orderBy("start").collect()]
    assert gaps == [(at(60), at(240)), (at(300), at(400))]
    plan = [(r["start"], r["end"]) for r in G.plan_backfill(df, ts(-120), 30, ts(350)).orderBy("start").collect()]
    assert plan == [(at(-120), at(0)), (at(60), at(240)), (at(300), at(350))]
    fresh = samples(spark, [(m, "s", 7) for m in range(65, 240, 5)])
    once = S.replace_backfill(df, "s", ts(60), ts(240), fresh)
    twice = S.replace_backfill(once, "s", ts(60), ts(240), fresh)
    assert once.count() == twice.count() == df.count() + fresh.count() and twice.where("src = 'live'").count() == df.count()


def test_hvac_history_states(spark):
    rows = [(at(-30), "c", "heating"), (at(10), "c", ""), (at(20), "c", "cooling")]
    df = spark.createDataFrame(rows, "ts timestamp, entity_id string, action string")
    got = [(r["ts"], r["action"]) for r in S.expand_hvac_history(df, ts(0), ts(30), 5).orderBy("ts").collect()]
    assert got == [(at(0), "heating"), (at(5), "heating"), (at(20), "cooling"), (at(25), "cooling"), (at(30), "cooling")]


def test_packets(spark):
    lines = ['{"Time":"2026-01-05T00:00:00Z","Type":"SCM","Message":{"ID":7,"Type":4,"Consumption":12}}', '{"Time":"x","Type":"IDM","Message":{"ERTSerialNumber":8,"LastConsumptionCount":5,"A":[1]}}', "", "{bad", '{"Type":"SCM","Message":{"Consumption":5}}', '{"Type":"SCM","Message":{"ID":5,"Consumption":0}}']
    got = S.ingest_packets(spark.createDataFrame([(x,) for x in lines], "value string"), "r", ts(3)).orderBy("endpoint_id").collect()
    assert [(r["ts"], r["endpoint_id"], r["endpoint_type"], r["consumption"]) for r in got] == [(at(0), 7, 4, 12.0), (at(3), 8, None, 5.0)]


def test_statistics(spark):
    rows = [("s", "hour", "2026-01-05T00:00:00Z", 100.0, None), ("s", "hour", str(int(at(60).timestamp() * 1000)), 103.0, None), ("s", "hour", "2026-01-05T02:00:00Z", None, 9.0), ("s", "hour", "2026-01-05T03:00:00Z", 101.0, None)]
    df = spark.createDataFrame(rows, "statistic_id string, period string, start string, sum double, change double")
    assert [r["kwh"] for r in S.stat_deltas(df).orderBy("ts").collect()] == [3.0, 9.0, 0.0]


def test_export_and_factors(spark, tmp_path):
    rows = spark.createDataFrame([(at(2), "IDM", 7, 4, 12.0, "a"), (at(1), "IDM", 7, None, 11.0, None), (at(3), "IDM", 8, 4, 1.0, "a")], "ts timestamp, msg_type string, endpoint_id long, endpoint_type int, consumption double, source string")
    S.export_csv(S.meter_readings(rows, 7), str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == ["ts", "msg_type", "endpoint_id", "endpoint_type", "consumption", "source"] and sorted(r["consumption"] for r in back.collect()) == ["11.0", "12.0"]
    units = spark.createDataFrame([("Wh",), ("kWh",), ("MWh",), (None,)], "unit string")
    assert [r["f"] for r in units.select(S.statistic_factor(F.col("unit")).alias("f")).collect()] == [0.001, 1.0, 1000.0, 1.0]


def test_days_in_several_files(spark, tmp_path):
    rows = spark.createDataFrame([(at(60 * h), "IDM", m, 4, float(h), "a") for h in range(48) for m in range(12)], "ts timestamp, msg_type string, endpoint_id long, endpoint_type int, consumption double, source string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small files stay apart
    try:
        S.append_readings(rows, str(tmp_path / "t"), rows_a_file=40)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "t" / "dt=2026-01-05").glob("*.parquet"))) > 1
    S.append_readings(rows.limit(0), str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == rows.count() and back.select("dt").distinct().count() == 2
    of_meter = back.withColumn("f", F.input_file_name()).groupBy("dt", "endpoint_id").agg(F.countDistinct("f").alias("n")).collect()
    assert all(r["n"] == 1 for r in of_meter)
