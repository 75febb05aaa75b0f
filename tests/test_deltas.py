"""Counters: wraps, resets, glitches; rollups of rollups; telescoping."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from meterscope.operators import deltas as D
from meterscope.operators import registry as R

BASE = datetime(2026, 1, 5)
SCHEMA = "ts timestamp, msg_type string, endpoint_id long, endpoint_type int, consumption double, source string"


def readings(spark, rows):
    return spark.createDataFrame([(BASE + timedelta(minutes=m), t, i, 4, float(v) if v is not None else None, "a") for m, t, i, v in rows], SCHEMA)


def test_wrap_is_movement_and_reset_is_null(spark):
    """A counter that goes round: its modulus is its message type's. One that starts anew far below: no step."""
    rows, want = [], {}
    for meter, kind, modulus in ((1, "SCM", 2**24), (2, "SCM+", 2**32)):
        steps = [3, 41, 7, 100, 9]
        value = modulus - 50
        rows.append((0, kind, meter, value))
        for k, s in enumerate(steps, 1):
            value = (value + s) % modulus
            rows.append((k, kind, meter, value))
        want[meter] = [None, *map(float, steps)]
    rows += [(k, "IDM", 3, v) for k, v in enumerate((90_000, 90_400, 12, 40))]
    want[3] = [None, 400.0, None, 28.0]
    df = readings(spark, rows)
    got = {}
    for r in D.counter_steps(df, ["endpoint_id"], "ts", "consumption").orderBy("endpoint_id", "ts").collect():
        got.setdefault(r["endpoint_id"], []).append(r["delta"])
    assert got == want


def test_rollup_and_registry_of_one_pass(spark):
    df = readings(spark, [(m, "IDM", m % 3, 50 + m) for m in range(0, 300, 2)] + [(5, "IDM", 9, None)])
    parts = R.index_by_bucket(df, 1)
    assert sorted(map(tuple, R.rollup_of_parts(parts).collect())) == sorted(map(tuple, D.rollup(df, 1).collect()))
    index = R.meter_index(df)
    assert sorted(map(str, R.merge_parts(parts).select(index.columns).collect())) == sorted(map(str, index.collect()))


def test_backfill_goes_on_where_it_was(spark, tmp_path):
    df = readings(spark, [(60 * h, "IDM", 1, 100 + h) for h in range(24 * 30)])
    path, now = str(tmp_path / "roll"), BASE + timedelta(days=29, minutes=30)
    assert D.backfill_rollup(df, 60, path, BASE, now, most_steps=1) == BASE + timedelta(days=7)
    first = D.read_backfill(spark, path).count()
    end = D.backfill_rollup(df, 60, path, BASE, now)
    assert first == 24 * 7 and end == now - timedelta(hours=48) and D.backfill_rollup(df, 60, path, BASE, now) == end
    want = D.rollup(df.where(F.col("ts") < F.lit(end.isoformat(" ")).cast("timestamp")), 60)
    assert sorted(map(tuple, D.read_backfill(spark, path).collect())) == sorted(map(tuple, want.collect()))


def test_one_bit_flip_does_not_count(spark):
    rows = [(10 * k, "IDM", 1, 100000 + 100 * k + (131072 if k == 18 else 0)) for k in range(37)]
    df = readings(spark, rows)
    moved = D.hourly_deltas(D.rollup(df, 60), R.meter_index(df)).agg(F.sum("delta")).first()[0]
    assert 1000 <= moved <= 10000


def test_lone_jump_without_history_is_capped(spark):
    df = readings(spark, [(0, "IDM", 1, 100), (60, "IDM", 1, 5000000)])
    assert D.hourly_deltas(D.rollup(df, 60), R.meter_index(df)).count() == 0


def test_rollup_of_rollup_and_telescoping(spark):
    df = readings(spark, [(m, "IDM", i, 1000 * i + m * i) for m in range(0, 600, 7) for i in (1, 2, 3)])
    fine, coarse = D.rollup(df, 1), D.rollup(df, 60)
    assert sorted(map(tuple, D.rollup_of_rollup(fine, 60).collect())) == sorted(map(tuple, coarse.collect()))
    steps = D.bucket_deltas(fine, R.meter_index(df), 60).groupBy("endpoint_id").agg(F.sum("delta").alias("d"), (F.max("cmax") - F.min("cmax")).alias("whole"))
    assert all(r["d"] == r["whole"] for r in steps.collect())


def test_movement_between_looks_back(spark):
    df = readings(spark, [(60 * h, "IDM", 1, 100 + 10 * h) for h in range(48)])
    spans = spark.createDataFrame([("a", BASE + timedelta(hours=24), BASE + timedelta(hours=36))], "span string, start timestamp, end timestamp")
    got = D.movement_between(D.rollup(df, 60), R.meter_index(df), spans).collect()
    assert [(r["endpoint_id"], r["movement"]) for r in got] == [(1, 120.0)]


def test_empty_and_null_tables(spark):
    empty = readings(spark, [])
    assert D.rollup(empty, 60).count() == 0 and R.meter_index(empty).count() == 0
    nulls = readings(spark, [(0, "IDM", 1, None)])
    index = R.meter_index(nulls).first()
    assert index["packets"] == 1 and index["last_consumption"] is None
    assert D.hourly_deltas(D.rollup(nulls, 60), R.meter_index(nulls)).count() == 0


def test_merged_indexes_equal_one(spark):
    df = readings(spark, [(m, "IDM", m % 3, 50 + m) for m in range(60)])
    a, b = df.where(F.minute("ts") < 30), df.where(F.minute("ts") >= 30)
    one, two = R.meter_index(df), R.merge_index(R.meter_index(a), R.meter_index(b))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.select(one.columns).collect()))


def test_range_join_both_ways(spark):
    from meterscope.functions.joins import range_join

    points = spark.createDataFrame([(BASE + timedelta(hours=h),) for h in range(0, 200, 5)], "at timestamp")
    spans = spark.createDataFrame([(k, BASE + timedelta(hours=7 * k), BASE + timedelta(hours=7 * k + 40)) for k in range(20)], "span int, start timestamp, end timestamp")
    few, many = (sorted(map(tuple, range_join(points, spans, "at", most=n).select("at", "span").collect())) for n in (100, 1))
    assert few == many and few


def test_spans_of_all_lengths(spark):
    """Seconds to decades, empty and inverted ones: a span is in two bins at most, and the join is that of brute force."""
    import random

    from meterscope.functions import joins

    g = random.Random(6)
    spans = []
    for k in range(150):
        start = BASE + timedelta(seconds=g.uniform(-4e7, 4e7))
        spans.append((k, start, start + timedelta(seconds=g.choice([0, -5, 1, 59, 60, 61, 3600, 86_400, 3e6, 4e7, 9e8]) * g.choice([1, 1, 0.5]))))
    points = [BASE + timedelta(seconds=g.uniform(-5e7, 5e7)) for _ in range(300)] + [s for _, s, _ in spans] + [e for _, _, e in spans]
    df = spark.createDataFrame([(p,) for p in points], "at timestamp")
    own = spark.createDataFrame(spans, "span int, start timestamp, end timestamp")
    got = sorted(map(tuple, joins.range_join(df, own, "at", most=1).select("at", "span").collect()))
    assert got == sorted((p, k) for p in points for k, s, e in spans if s <= p < e) and got
    assert joins._binned(own, "start", "end").groupBy("span").count().agg({"count": "max"}).first()[0] <= 2
    assert joins.range_join(df, own.where("span < 0"), "at", most=-1).count() == 0
