"""Stored tables changed in place: only what a change touches is written."""

from __future__ import annotations

from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from meterscope import queries as Q
from meterscope.operators import deltas as D
from meterscope.operators import maintenance as M
from meterscope.operators import registry as R
from meterscope.sources import ingest as S
from meterscope.sources import tables

BASE = datetime(2026, 1, 5)
READING = "ts timestamp, msg_type string, endpoint_id long, endpoint_type int, consumption double, raw string, source string"


def readings(spark, days=6):
    rows = [(BASE + timedelta(hours=h), "IDM", h % 3, 4, 100.0 + h, None, "ab"[h % 2] if h // 24 != 2 else "a") for h in range(24 * days)]
    return spark.createDataFrame(rows, READING)


@pytest.fixture
def stored(spark, tmp_path):
    path = tmp_path / "readings"
    S.append_readings(readings(spark), str(path))
    return path


def state(path):
    """Name and time of every data file, by folder."""
    out = {}
    for p in path.glob("*=*/part-*"):
        out.setdefault(p.parent.name, set()).add((p.name, p.stat().st_mtime_ns, p.stat().st_ino))
    return out


def rows(df):
    return sorted(map(str, df.select(sorted(c for c in df.columns if c not in ("dt", "ym"))).collect()))


def changed(before, after):
    return sorted(k for k in before.keys() | after.keys() if before.get(k) != after.get(k))


def test_retention_reads_one_day(spark, stored):
    before = state(stored)
    M.retain_newer(spark, str(stored), BASE + timedelta(days=6), 4, M.READINGS)
    assert changed(before, state(stored)) == ["dt=2026-01-05", "dt=2026-01-06", "dt=2026-01-07"]
    assert rows(M.read(spark, str(stored), M.READINGS)) == rows(R.keep_newer(readings(spark), F.lit("2026-01-11").cast("timestamp"), 4))


def test_retention_within_a_day(spark, stored):
    M.retain_newer(spark, str(stored), BASE + timedelta(days=6, hours=7), 4, M.READINGS)
    assert rows(M.read(spark, str(stored), M.READINGS)) == rows(R.keep_newer(readings(spark), F.lit("2026-01-11 07:00:00").cast("timestamp"), 4))
    M.retain_newer(spark, str(stored), BASE + timedelta(days=60), 4, M.READINGS)
    assert M.read(spark, str(stored), M.READINGS).count() == 0


def test_a_source_goes_where_it_is(spark, stored):
    before = state(stored)
    M.drop_source_in_place(spark, str(stored), "b")
    after = state(stored)
    assert changed(before, after) == [f"dt=2026-01-{d:02}" for d in (5, 6, 8, 9, 10)]  # the 7th has none of it
    assert rows(M.read(spark, str(stored), M.READINGS)) == rows(R.drop_source(readings(spark), "b"))
    M.drop_source_in_place(spark, str(stored), "nobody")
    assert state(stored) == after


def test_meters_and_zeros_go(spark, tmp_path):
    df = readings(spark).where("endpoint_id <> 2 or ts < '2026-01-06'").unionByName(spark.createDataFrame([(BASE + timedelta(days=3), "IDM", 9, 4, 0.0, None, "a")], READING))
    S.append_readings(df, str(tmp_path / "r"))
    before = state(tmp_path / "r")
    M.purge_meters_in_place(spark, str(tmp_path / "r"), spark.createDataFrame([(2,), (77,)], "endpoint_id long"))
    after = state(tmp_path / "r")
    assert changed(before, after) == ["dt=2026-01-05"]
    M.scrub_zeros_in_place(spark, str(tmp_path / "r"))
    assert changed(after, state(tmp_path / "r")) == ["dt=2026-01-08"]
    assert rows(M.read(spark, str(tmp_path / "r"), M.READINGS)) == rows(df.where("endpoint_id not in (2, 9)"))


def test_bills_by_month(spark, tmp_path):
    bill = "statistic_id string, period string, ts timestamp, kwh double"
    old = spark.createDataFrame([("s", "day", datetime(2026, m, d), 1.0 * m) for m in (1, 2, 3) for d in (1, 2)] + [("o", "hour", datetime(2026, 3, 1), 5.0)], bill)
    old.withColumn("ym", F.date_format("ts", "yyyy-MM")).write.partitionBy("ym").parquet(str(tmp_path / "b"))
    before = state(tmp_path / "b")
    fresh = spark.createDataFrame([("s", "day", datetime(2026, 2, 2), 9.0), ("s", "day", datetime(2026, 4, 1), 8.0)], bill)
    for _ in range(2):
        M.upsert_utility_in_place(spark, str(tmp_path / "b"), fresh)
        assert rows(M.read(spark, str(tmp_path / "b"), M.BILLS)) == rows(S.upsert_utility(old, fresh))
    after = state(tmp_path / "b")
    assert changed(before, after) == ["ym=2026-02", "ym=2026-04"]
    M.keep_only_utility_in_place(spark, str(tmp_path / "b"), "s", "day")
    assert changed(after, state(tmp_path / "b")) == ["ym=2026-03"] and M.read(spark, str(tmp_path / "b"), M.BILLS).count() == 7


@pytest.mark.parametrize("kind", ["lts_backfill", "history_backfill"])
def test_backfill_touches_its_days(spark, tmp_path, kind):
    column, schema = ("power_w double", M.SAMPLES) if kind == "lts_backfill" else ("action string", M.HVAC)
    value = (lambda k: float(k)) if kind == "lts_backfill" else (lambda k: f"a{k}")
    ddl = f"ts timestamp, entity_id string, {column}, src string"
    old = spark.createDataFrame([(BASE + timedelta(hours=6 * k), "xy"[k % 2], value(k), ("live", kind)[k % 3 == 0]) for k in range(24)], ddl)
    M.by_day(old).write.partitionBy("dt").parquet(str(tmp_path / "s"))
    before = state(tmp_path / "s")
    span = (BASE + timedelta(days=1), BASE + timedelta(days=2, hours=20))
    new = spark.createDataFrame([(BASE + timedelta(days=1, hours=h), "x", value(100 + h)) for h in range(5)], f"ts timestamp, entity_id string, {column}")
    want = S.replace_backfill(old, "x", *[F.lit(t.isoformat(" ")).cast("timestamp") for t in span], new, kind)
    for _ in range(2):
        M.replace_backfill_in_place(spark, str(tmp_path / "s"), "x", *span, new, kind, schema)
        assert rows(M.read(spark, str(tmp_path / "s"), schema)) == rows(want)
    assert changed(before, state(tmp_path / "s")) == ["dt=2026-01-06", "dt=2026-01-07"]


def test_an_interrupted_swap_is_finished(spark, stored, monkeypatch):
    """It dies between two partitions, after one is removed and before its new one is in place."""
    want, move, moved = rows(R.drop_source(readings(spark), "b")), tables.Files.move, []

    def dies(self, source, target):
        moved.append(target)
        if len(moved) == 3:
            raise OSError("gone")
        move(self, source, target)

    monkeypatch.setattr(tables.Files, "move", dies)
    with pytest.raises(OSError, match="gone"):
        M.drop_source_in_place(spark, str(stored), "b")
    monkeypatch.undo()
    assert rows(M.read(spark, str(stored), M.READINGS)) == want
    assert not (stored / "_staged").exists() or not list((stored / "_staged").iterdir())


def test_rows_outside_change_nothing(spark, stored):
    before = state(stored)
    with pytest.raises(ValueError, match="outside"):
        tables.rewrite_partitions(spark, str(stored), "dt", ["2026-01-05"], lambda r: r.withColumn("dt", F.date_add("dt", 1)), M.READINGS)
    assert state(stored) == before


def test_readings_a_week_late_reach_the_rollup(spark, tmp_path):
    """No range is named: the log knows which buckets they reach, and only their days are written."""
    all_ = readings(spark, 12)
    late = all_.where("endpoint_id = 1 and ts between '2026-01-06' and '2026-01-06 09:00:00'")
    first = all_.exceptAll(late)
    paths = {n: str(tmp_path / n) for n in ("readings", "rollup", "log")}
    until = BASE + timedelta(days=10)
    S.append_readings(first, paths["readings"])
    M.materialise_rollup(M.read(spark, paths["readings"], M.READINGS), 60, paths["rollup"], until)
    before = state(tmp_path / "rollup")
    for number, batch in enumerate((late, all_.where("ts >= '2026-01-16'"))):  # the second is not late
        S.append_readings(batch, paths["readings"]) if number == 0 else None
        for _ in range(2):  # a replay
            M.log_late(batch, number, 60, paths["log"], until)
    table = M.read(spark, paths["readings"], M.READINGS)
    assert M.refresh_late(spark, 60, paths["rollup"], table, paths["log"]) == 3
    assert changed(before, state(tmp_path / "rollup")) == ["dt=2026-01-06"]
    stored = M.read(spark, paths["rollup"], M.ROLLUP)
    whole = D.rollup(all_.where(F.col("ts") < F.lit(until.isoformat(" ")).cast("timestamp")), 60)
    assert rows(stored) == rows(whole)
    assert rows(D.realtime_rollup(stored.drop("dt"), table, 60, F.lit(until.isoformat(" ")).cast("timestamp"))) == rows(D.rollup(all_, 60))
    assert M.refresh_late(spark, 60, paths["rollup"], table, paths["log"]) == 0


def test_a_counter_that_stands_on_zero_is_no_reading_without_value(spark, tmp_path):
    """A counter of meter 1000 that wraps onto exactly 0 stays; the SQL drops every fiftieth event alone."""
    rows = [(i, datetime(2024, 1, 2) + timedelta(minutes=i), 0, "view", v, "{}") for i, v in [(1, 772.15), (2, 0.01), (3, 5.0), (50, 1.0), (51, 2.0)]]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = [tuple(r) for r in Q.queries()["r4_scrub_zeros"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == con.execute(Q.oracle_sql()["r4_scrub_zeros"]).fetchall() == [(1000, 4, 0.0, 16777215.0)]
