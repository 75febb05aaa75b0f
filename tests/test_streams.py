"""Streams out of order, feeds that fall silent, registries that grow."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta, timezone
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from meterscope.operators import registry as R
from meterscope.sources import ingest as S
from meterscope.streaming import jobs as T

BASE = datetime(2026, 1, 5)
at = lambda m: BASE + timedelta(minutes=m)
READING = "ts timestamp, msg_type string, endpoint_id long, endpoint_type int, consumption double, source string"
FEED = "home string, ts timestamp, entity_id string, w double, action string, status string"


def shuffled_files(spark, rows, schema, path, lateness, batches):
    """Files of rows in random order, but that none is more than `lateness` minutes behind the newest before it; a last
    file moves the watermark past them all."""
    g = random.Random(3)
    by = sorted(rows, key=lambda r: (r[1], g.random()))
    by = [r for _, r in sorted(((r[1] + timedelta(minutes=g.uniform(0, lateness)), i), r) for i, r in enumerate(by))]
    size = -(-len(by) // batches)
    for k in range(batches):
        spark.createDataFrame(by[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)
    end = ("end", max(r[1] for r in rows) + timedelta(days=2), *rows[0][2:])
    spark.createDataFrame([end], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.createDataFrame([end], schema).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_auto_windows_of_shuffled_batches(spark, tmp_path):
    g = random.Random(8)
    rows = [(f"h{h}", at(k) + timedelta(seconds=h), g.choice([500.0, 500.0, 500.0, 2000.0]) if k % 40 else 2500.0) for h in range(3) for k in range(240)]
    rows = [(h, t, 2000.0 if (t - BASE + timedelta(minutes=20)) % timedelta(minutes=40) < timedelta(minutes=9) else 500.0 + w / 50) for h, t, w in rows]
    schema = "home string, ts timestamp, power_w double"
    stream = shuffled_files(spark, rows, schema, str(tmp_path / "in"), 12, 15)
    got = T.drain(T.stream_auto_windows(stream, "13 minutes")).where("home <> 'end'")
    batch = T.auto_windows(spark.createDataFrame(rows, schema))
    key = lambda df: sorted((r["home"], r["start_ts"], r["end_ts"], r["known_load_w"]) for r in df.collect())
    assert key(got) == key(batch) and len(key(batch)) >= 12
    assert got.select("batch").distinct().count() > 3  # windows come as the watermark goes on, not at the end


def test_live_power_of_shuffled_batches(spark, tmp_path):
    g = random.Random(9)
    rows = [(f"h{h}", at(k), g.choice("abc"), float(g.randint(0, 900))) for h in range(2) for k in range(150)]
    stream = shuffled_files(spark, rows, "home string, ts timestamp, entity_id string, w double", str(tmp_path / "in"), 9, 10)
    got = T.drain(T.live_power(stream, "10 minutes")).where("home <> 'end'").collect()
    want, last = [], {}
    for h, t, e, w in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        last[h, e] = w
        want.append((h, t, sum(v for (x, _), v in last.items() if x == h)))
    assert sorted((r["home"], r["ts"], r["power_w"]) for r in got) == sorted(want)


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    schema = "home string, ts timestamp, entity_id string, w double"
    for rows in ([("h", at(0), "a", 1.0), ("h", at(60), "a", 2.0)], [("h", at(50), "a", 9.0)], [("h", at(10), "b", 7.0), ("h", at(70), "a", 3.0)], [("end", at(999), "a", 0.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = T.drain(T.live_power(stream, "20 minutes")).where("home = 'h'").orderBy("ts").collect()
    assert [(r["ts"], r["power_w"]) for r in got] == [(at(0), 1.0), (at(50), 9.0), (at(60), 2.0), (at(70), 3.0)]


def test_keep_alive_in_a_running_stream(spark, tmp_path):
    """A sensor and a thermostat fall silent and are repeated; not after the feed went down, nor before it has told anew."""
    path, out = str(tmp_path / "in"), []
    schema = spark.createDataFrame([], FEED).schema
    now = lambda: datetime.now(timezone.utc).replace(tzinfo=None)

    def send(*rows):
        staged = spark.createDataFrame([("h", now(), *r) for r in rows], FEED).coalesce(1)
        staged.write.mode("append").parquet(path)

    def keep(batch, number):
        out.extend((r["entity_id"], r["w"], r["action"], r["repeated"], time.time()) for r in batch.collect())

    send((None, None, None, "up"), ("plug", 40.0, None, None), ("climate", None, "heating", None))
    stream = spark.readStream.schema(schema).parquet(path)
    for k, v in T.STATE_STORE.items():
        spark.conf.set(k, v)
    query = T.keep_alive(stream, silence_s=2, tick_s=2, dead_s=30).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()

    def wait(test, most=150, beat=True):
        end, told = time.time() + most, time.time()
        while time.time() < end and not test():
            assert query.isActive, query.exception()
            if beat and time.time() - told > 4:  # signs of life, well within dead_s however slow the machine is
                send((None, None, None, "beat"))
                told = time.time()
            time.sleep(0.3)
        assert test(), out

    repeated = lambda e: [x for x in out if x[0] == e and x[3]]
    try:
        wait(lambda: len(repeated("plug")) >= 2 and len(repeated("climate")) >= 2)
        assert {x[1] for x in repeated("plug")} == {40.0} and {x[2] for x in repeated("climate")} == {"heating"}
        times = [x[4] for x in repeated("plug")]
        assert all(b - a > 1.5 for a, b in zip(times, times[1:]))
        send(("climate", None, "", None), (None, None, None, "beat"))  # the thermostat is gone, the feed is not
        before = len(repeated("plug"))
        wait(lambda: len(repeated("plug")) >= before + 1)
        settled = len(repeated("climate"))
        before = len(repeated("plug"))
        wait(lambda: len(repeated("plug")) >= before + 2)
        assert len(repeated("climate")) <= settled + 1
        send((None, None, None, "down"))
        time.sleep(5)
        still = len(repeated("plug"))
        time.sleep(6)
        assert len(repeated("plug")) == still  # down: no repetition
        send((None, None, None, "up"), ("lamp", 7.0, None, None))
        wait(lambda: len(repeated("lamp")) >= 1)
        assert len(repeated("plug")) == still  # it has told nothing since
        wait(lambda: time.time() - max(x[4] for x in out) > 15, beat=False)  # nothing of the feed for dead_s: down as well
    finally:
        query.stop()


def batches(spark, n):
    for k in range(n):
        yield spark.createDataFrame([(at(10 * k + m), "IDM", (k + m) % 7, 4, 100.0 + k, "ab"[m % 2]) for m in range(6)], READING)


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("part-*") if "/_" not in str(p)}


def test_registries_that_grow(spark, tmp_path):
    """As many parts as the batches' logarithm, the registry of all readings at any time, and replays that change nothing."""
    run = T.ingest_batch(str(tmp_path / "readings"), index := T.MergedTable(str(tmp_path / "index"), R.merge_indexes, fanout=3), coverage := T.coverage_table(str(tmp_path / "coverage")))
    seen = None
    for k, batch in enumerate(batches(spark, 19)):
        run(batch, k)
        seen = batch if seen is None else seen.unionByName(batch)
        assert len(index.parts(spark)) <= 2 * 3  # two a level, three levels
        if k in (0, 2, 8, 18):
            key = lambda df: sorted(map(str, df.collect()))
            columns = R.meter_index(seen).columns
            assert key(index.read(spark, R.meter_index(seen).schema).select(columns)) == key(R.meter_index(seen))
            assert key(coverage.read(spark, R.meter_source(seen).schema)) == key(R.meter_source(seen))
    before = files(tmp_path / "index")
    for k in (18, 3):
        index.add(R.meter_index(seen), k)
    assert files(tmp_path / "index") == before
    assert len(before) <= 40  # what was merged is removed


def test_a_batch_that_died_is_written_anew(spark, tmp_path):
    table = T.MergedTable(str(tmp_path / "t"), R.merge_sources, fanout=2)
    parts = [R.meter_source(b) for b in batches(spark, 4)]
    for k in range(3):
        table.add(parts[k], k)
    parts[0].write.parquet(table._part((0, 3, 3)))  # a batch 3 that got no further than its part
    assert sum(r["packets"] for r in table.read(spark, parts[0].schema).collect()) == 18
    table.add(parts[3], 3)
    assert sum(r["packets"] for r in table.read(spark, parts[0].schema).collect()) == 24 and len(table.parts(spark)) == 1


def test_a_batch_is_computed_once(spark, tmp_path):
    """However often a batch's rows are read, its lines are parsed once."""
    seen = spark.sparkContext.accumulator(0)

    def line(k):
        seen.add(1)
        return '{"Type":"IDM","Message":{"ERTSerialNumber":%d,"LastConsumptionCount":7}}' % k

    lines = spark.range(40).select(F.udf(line)("id").alias("value"))
    index, coverage = T.index_table(str(tmp_path / "index")), T.coverage_table(str(tmp_path / "coverage"))
    T.ingest_batch(str(tmp_path / "readings"), index, coverage)(S.ingest_packets(lines, "x", F.lit("2026-01-05").cast("timestamp")), 0)
    assert seen.value == 40
    assert index.read(spark, R.meter_index(next(batches(spark, 1))).schema).count() == 40


def test_odd_lines(spark):
    """Messages that are no object, numbers that JSON does not have, cut lines and empty fields."""
    message = '{"Time":"2026-01-05T00:00:00Z","Type":"SCM","Message":%s}'
    kept = ['{"ID":5,"Consumption":7,"Type":4}', '{"ID":"","ERTSerialNumber":5,"Consumption":null,"LastConsumption":"7"}', '{"EndpointID":{"a":1},"ID":5,"Consumption":7e0,"Tail":[1,{"b":2}]}']
    dropped = ['"{\\"ID\\":5,\\"Consumption\\":7}"', '[{"ID":5,"Consumption":7}]', "null", '{"ID":5,"Consumption":NaN}', '{"ID":5,"Consumption":0}', '{"ID":5.5,"Consumption":true}']
    lines = [message % m for m in kept + dropped] + [(message % kept[0])[:-1], "{bad", "", None]
    got = S.ingest_packets(spark.createDataFrame([(x,) for x in lines], "value string"), F.lit("s"), F.lit(None).cast("timestamp")).collect()
    assert sorted(r["raw"] for r in got) == sorted(lines[:3])
    assert {(r["ts"], r["msg_type"], r["endpoint_id"], r["consumption"], r["source"]) for r in got} == {(BASE, "SCM", 5, 7.0, "s")}
    assert sorted(r["endpoint_type"] for r in got if r["endpoint_type"]) == [4]


def test_rows_are_held_by_the_block():
    """A chunk is one value of the state, not one a row, and comes out with its nulls, in order of time."""

    class State(list):
        appendValue, appendList, get, exists = list.append, list.extend, list.copy, lambda self: bool(self)  # noqa: N815

        def put(self, values):
            self[:] = values

    held, last, done = State(), {}, State()
    last_state = SimpleNamespace(iterator=lambda: iter(last.items()), updateValue=last.__setitem__)
    done_state = SimpleNamespace(exists=lambda: bool(done), get=lambda: done[0], update=lambda v: done.put([v]))
    timers = []
    handle = SimpleNamespace(getListState=lambda *a: held, getValueState=lambda *a: done_state, getMapState=lambda *a: last_state, listTimers=lambda: iter(timers), registerTimer=timers.append, deleteTimer=timers.remove)
    power = T.LivePower()
    power.init(handle)
    rows = pd.DataFrame({"home": "h", "ts": [at(k) for k in range(1000)], "entity_id": ["a", "b", None, "a"] * 250, "w": [1.0, 2.0, 4.0, None] * 250})
    late = rows.iloc[::-1]
    list(power.handleInputRows(("h",), iter([late.iloc[:600], late.iloc[600:]]), None))
    assert len(held) == 2 and len(timers) == 1
    ms = lambda t: int(pd.Timestamp(t).value // 1_000_000)
    got = [x for upto in (499, 2000) for x in power.handleExpiredTimer(("h",), SimpleNamespace(getCurrentWatermarkInMs=lambda u=upto: ms(at(u))), None)]
    assert [len(x) for x in got] == [500, 500] and not held
    assert pd.concat(got)["ts"].tolist() == rows["ts"].tolist()
    assert got[0]["power_w"].head(2).tolist() == [1.0, 3.0] and set(last) == {("a",), ("b",)}
