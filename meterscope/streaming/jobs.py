"""Structured Streaming jobs (T1-T7). Each takes a streaming DataFrame; sinks are the caller's."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.joins import broadcast_checked
from ..operators.registry import merge_indexes, merge_sources, meter_index, meter_source
from ..params import DEFAULTS, Params
from ..sources.ingest import append_readings
from ..sources.tables import Files, MergedTable

#: What transformWithState needs of the session.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir, which driver and executors share. Where that is unset, a temporary one
    on a local master; on a cluster, whose machines share no such folder, an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: driver and executors need a folder that they share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-meterscope-")
    return f"{base.rstrip('/')}/meterscope-{uuid.uuid4().hex}/{name}"


def drain(stream: DataFrame, mode: str = "append", sink: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Run a stream over what is there now. Without a sink its batches are written to shared storage, and
    their rows come back with the number of their `batch`."""
    spark = stream.sparkSession
    out = shared_folder(spark, "out")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        query = stream.writeStream.outputMode(mode).foreachBatch(sink or keep).option("checkpointLocation", shared_folder(spark, "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return None if sink else spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(out)


def index_table(path: str) -> MergedTable:
    """R1 of a stream, kept by batches."""
    return MergedTable(path, merge_indexes)


def coverage_table(path: str) -> MergedTable:
    """R2 of a stream; heartbeats (R3) follow from it."""
    return MergedTable(path, merge_sources)


def ingest_batch(readings_path: str, index: MergedTable, coverage: MergedTable | None = None, late: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch function of S1's stream: writes a batch's readings by day and adds its registry rows
    and coverage rows (R2) to tables that merge as they grow. A batch that is run again replaces its readings
    and changes nothing else. The tables belong to one checkpoint, whose batch numbers they go by. late(batch, number)
    may log which materialised buckets the batch reaches (maintenance.log_late). The batch is stored first, as its
    rows are read several times and each would parse its lines anew."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = shared_folder(spark, "batch")
        try:
            batch.write.parquet(path)
            add(spark.read.schema(batch.schema).parquet(path), number)
        finally:
            Files(spark, path).remove(path.rsplit("/", 1)[0])

    def add(batch: DataFrame, number: int) -> None:
        append_readings(batch, f"{readings_path}/batch={number}", "overwrite")
        index.add(meter_index(batch), number)
        if coverage is not None:
            coverage.add(meter_source(batch), number)
        if late is not None:
            late(batch, number)

    return run


def stream_rollup(readings: DataFrame, minutes: int, late: str) -> DataFrame:
    """Rollups of a stream; readings up to `late` behind still count ('3 hours' for 1 min, '48 hours' for 1 h)."""
    rows = readings.where("endpoint_id is not null and consumption is not null").withWatermark("ts", late)
    out = rows.groupBy("endpoint_id", F.window("ts", f"{minutes} minutes").alias("w")).agg(F.min("consumption").alias("min_c"), F.max("consumption").alias("max_c"), F.count("*").alias("n"))
    return out.select("endpoint_id", F.col("w.start").alias("bucket"), "min_c", "max_c", "n")


def source_packets(readings: DataFrame, span: str = "60 seconds", slide: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Packets by receiver over sliding spans."""
    rows = readings.withWatermark("ts", late).groupBy("source", F.window("ts", span, slide).alias("w")).agg(F.count("*").alias("packets"))
    return rows.select("source", F.col("w.end").alias("until"), "packets")


def _chunks(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """A key's rows of one batch in order. What a batch holds is the source's to bound (maxFilesPerTrigger)."""
    return pd.concat(list(rows)).sort_values(by)


class Publish(StatefulProcessor):
    """T5: keyed by meter. State is the last two readings and the times of the last hour's; each batch with
    readings of a published meter gives what U17 publishes of it, as of its newest reading. Chunks of a batch
    are taken as they come, none is held."""

    hour = pd.Timedelta(hours=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.two = handle.getValueState("two", "ts array<timestamp>, value array<double>")
        self.recent = handle.getValueState("recent", "ts array<timestamp>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = list(zip(*self.two.get(), strict=True)) if self.two.exists() else []
        times = pd.Series([pd.Timestamp(t) for t in self.recent.get()[0]] if self.recent.exists() else [], dtype="datetime64[us]")
        name, mult = None, 1.0
        for chunk in rows:
            name, mult = chunk["pub_name"].iloc[0], float(chunk["mult"].iloc[0])
            top = chunk.dropna(subset=["consumption"]).nlargest(2, ["ts", "consumption"])
            held = sorted([(pd.Timestamp(t), v) for t, v in held] + [(pd.Timestamp(t), float(v)) for t, v in zip(top["ts"], top["consumption"], strict=True)])[-2:]
            times = pd.concat([times, chunk["ts"].astype("datetime64[us]")])
            times = times[times > times.max() - self.hour]
        if not held:
            return
        self.two.update(([t.to_pydatetime() for t, _ in held], [v for _, v in held]))
        self.recent.update(([t.to_pydatetime() for t in times],))
        power = None
        if len(held) == 2 and held[1][0] > held[0][0]:
            power = (held[1][1] - held[0][1]) / ((held[1][0] - held[0][0]).total_seconds() / 3600.0) * mult
        yield pd.DataFrame({"endpoint_id": [key[0]], "pub_name": [name], "ts": [held[-1][0]], "energy": [held[-1][1] * mult], "power": [power], "signal": [len(times)]}).astype({"power": "float64", "ts": "datetime64[us]"})

    def close(self) -> None:
        pass


def publish(readings: DataFrame, meters: DataFrame) -> DataFrame:
    """T5: (endpoint_id, pub_name, ts, energy, power, signal) of each batch and published meter."""
    own = meters.where(F.coalesce("publish", F.lit(False))).select("endpoint_id", F.coalesce("pub_name", F.lit("")).alias("pub_name"), F.coalesce("pub_multiplier", F.lit(1.0)).alias("mult"))
    rows = readings.where("ts is not null").select("endpoint_id", "ts", "consumption").join(broadcast_checked(own), "endpoint_id")
    return rows.groupBy("endpoint_id").transformWithStateInPandas(Publish(), "endpoint_id long, pub_name string, ts timestamp, energy double, power double, signal long", "Update", "None")


def with_hvac(power: DataFrame, hvac: DataFrame, heating_kw: float, cooling_kw: float) -> DataFrame:
    """Samples (home, ts, entity_id, w) of power(home, ts, entity_id, w) and, as watts, of
    hvac(home, ts, entity_id, action): what heating and cooling take, 0 for any other action."""
    w = F.when(F.col("action") == "heating", 1000.0 * heating_kw).when(F.col("action") == "cooling", 1000.0 * cooling_kw).otherwise(0.0)
    return power.select("home", "ts", "entity_id", "w").unionByName(hvac.select("home", "ts", "entity_id", w.alias("w")))


class Ordered(StatefulProcessor):
    """Rows of a key in order of event time, whatever order batches bring them in. Rows are held as list state
    until the watermark has passed them, a block of columns (an Arrow record batch) for each chunk that came, so that
    state is read and written by the block and not by the row; a timer of event time, set to the earliest row held, then hands all that
    are due, sorted, to `ordered`. What is held is what came within the watermark's delay; a row that is later than
    what its key has been given already is dropped, as the engine drops rows behind the watermark."""

    held_schema = pa.schema([])
    order: tuple[str, ...] = ("ts",)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "block binary")
        self.done = handle.getValueState("done", "ms long")
        self.begin(handle)

    def begin(self, handle: StatefulProcessorHandle) -> None:
        """State of one's own."""

    def ordered(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def _block(self, rows: pd.DataFrame) -> tuple[bytes]:
        held = rows[self.held_schema.names].assign(ts=rows["ts"].astype("datetime64[us]"))
        return (pa.RecordBatch.from_pandas(held, self.held_schema, preserve_index=False).serialize().to_pybytes(),)

    def _rows(self) -> pd.DataFrame:
        blocks = [pa.ipc.read_record_batch(pa.py_buffer(b), self.held_schema) for (b,) in self.held.get()]
        return pa.Table.from_batches(blocks, self.held_schema).to_pandas()

    def _wake(self, at_ms: int) -> None:
        """One timer a key, at the earliest row held."""
        set_for = [t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()]
        if set_for and min(set_for) <= at_ms:
            return
        for t in set_for:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        done = self.done.get()[0] if self.done.exists() else None
        for chunk in rows:
            ms = chunk["ts"].astype("datetime64[us]").astype("int64") // 1000
            if done is not None:
                chunk, ms = chunk[ms > done], ms[ms > done]
            if len(chunk):
                self.held.appendValue(self._block(chunk))
                self._wake(int(ms.min()))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        upto = timerValues.getCurrentWatermarkInMs()
        rows = self._rows()
        ms = rows["ts"].astype("datetime64[us]").astype("int64") // 1000
        due, rest = rows[ms <= upto], rows[ms > upto]
        self.done.update((int(upto),))
        if len(rest):
            self.held.put([self._block(rest)])
            self.handle.registerTimer(int(ms[ms > upto].min()))  # the one that has expired goes by itself
        else:
            self.held.clear()
        if len(due):
            yield self.ordered(key, due.sort_values(list(self.order), kind="stable"))

    def close(self) -> None:
        pass


class LivePower(Ordered):
    """Keyed by home; the sum of the last value of each entity after every sample(home, ts, entity_id, w)."""

    held_schema, order = pa.schema([("ts", pa.timestamp("us")), ("entity_id", pa.string()), ("w", pa.float64())]), ("ts", "entity_id")

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "entity_id string", "w double")

    def ordered(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        known = {k[0]: v[0] for k, v in self.last.iterator()}
        # a sample changes the total by what it differs from the entity's last one
        before = rows.groupby("entity_id")["w"].shift()
        before = before.where(before.notna(), rows["entity_id"].map(known)).astype("float64").fillna(0.0)
        total = sum(known.values()) + (rows["w"].astype("float64") - before).cumsum()
        for entity, w in rows.groupby("entity_id")["w"].last().items():
            self.last.updateValue((entity,), (float(w),))
        return pd.DataFrame({"home": key[0], "ts": rows["ts"].astype("datetime64[us]").to_numpy(), "power_w": total.to_numpy(dtype="float64")})


def live_power(samples: DataFrame, late: str = "1 minute") -> DataFrame:
    """T3 of a stream: totals come once the watermark, `late` behind the newest sample, has passed them."""
    rows = samples.withWatermark("ts", late).groupBy("home")
    return rows.transformWithStateInPandas(LivePower(), "home string, ts timestamp, power_w double", "Append", "EventTime")


class AutoWindow:
    """T4's rule on one home's total power in order of time; `state` is all it remembers."""

    def __init__(self, state: tuple | None = None, params: Params = DEFAULTS) -> None:
        self.p = params
        self.base, self.dev, self.opened, self.load, self.closed = state or (None, 0.0, None, None, None)

    def state(self) -> tuple:
        return self.base, self.dev, self.opened, self.load, self.closed

    def step(self, t: float, power: float) -> tuple | None:
        """(start, end, known load) when a window closes; times are microseconds."""
        p, delta = self.p, self.p.auto_delta_w if self.p.auto_delta_w > 0 else 400.0
        if self.base is None:
            self.base = power
        if self.opened is None:
            self.dev += p.auto_dev_ewma * (abs(power - self.base) - self.dev)
            self.base += p.auto_base_ewma * (power - self.base)
            rise = power - self.base
            rested = self.closed is None or t - self.closed >= 60e6 * p.auto_cooldown_min
            if rested and rise >= max(delta, 3 * self.dev):
                self.opened, self.load = t, float(int(rise + 0.5))
            return None
        age = t - self.opened
        if power < self.base + max(delta / 2, 1.5 * self.dev) or age >= 60e6 * p.auto_cap_min:
            start, load, self.opened, self.load, self.closed = self.opened, self.load, None, None, t
            return (start, t, load) if age >= 60e6 * p.auto_discard_min else None
        return None


_WINDOWS = "home string, start_ts timestamp, end_ts timestamp, known_load_w double"


def _windows_of(rows: pd.DataFrame, machine: AutoWindow, home: str) -> pd.DataFrame:
    out = []
    for t, power in zip(rows["ts"].astype("datetime64[us]").astype("int64").tolist(), rows["power_w"].tolist(), strict=True):
        done = machine.step(float(t), float(power))
        if done:
            out.append((home, pd.Timestamp(int(done[0]), unit="us"), pd.Timestamp(int(done[1]), unit="us"), done[2]))
    return pd.DataFrame(out, columns=["home", "start_ts", "end_ts", "known_load_w"]).astype({"start_ts": "datetime64[us]", "end_ts": "datetime64[us]", "known_load_w": "float64"})


def auto_windows(totals: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """T4 in batch: windows of each home's totals(home, ts, power_w), in order of ts and power. The rule's five
    values go along the sorted rows of a home, batch by batch, so a long history is never held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, home = AutoWindow(params=params), None
        for batch in batches:
            for name, rows in batch.groupby("home", sort=False):
                if name != home:
                    machine, home = AutoWindow(params=params), name
                yield _windows_of(rows, machine, home)

    rows = totals.where("home is not null").select("home", "ts", "power_w")
    return rows.repartition("home").sortWithinPartitions("home", "ts", "power_w").mapInPandas(run, _WINDOWS)


class AutoWindows(Ordered):
    """T4 on a stream: the rule takes a home's totals in order of their time, the watermark behind the newest."""

    held_schema, order = pa.schema([("ts", pa.timestamp("us")), ("power_w", pa.float64())]), ("ts", "power_w")

    def begin(self, handle: StatefulProcessorHandle) -> None:
        fields = [T.StructField(n, T.DoubleType()) for n in ("base", "dev", "opened", "load", "closed")]
        self.value = handle.getValueState("machine", T.StructType(fields))

    def ordered(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        machine = AutoWindow(tuple(self.value.get()) if self.value.exists() else None)
        out = _windows_of(rows, machine, key[0])
        self.value.update(tuple(None if x is None else float(x) for x in machine.state()))
        return out


def stream_auto_windows(totals: DataFrame, late: str = "1 minute") -> DataFrame:
    """T4 of a stream of totals(home, ts, power_w) that may come up to `late` out of order."""
    return totals.withWatermark("ts", late).groupBy("home").transformWithStateInPandas(AutoWindows(), _WINDOWS, "Append", "EventTime")


class KeepAlive(StatefulProcessor):
    """Keyed by home. Passes the feed's samples on, and while the feed is up gives every entity's last value again
    that has been silent for `silence_s`, looking each `tick_s` by a timer of processing time; so a hole in the
    feed means that the feed is dead. Rows are samples (`w` of a sensor or `action` of a thermostat) or signs of the
    feed itself (`status`: up, beat or down). Once the feed is down, by its sign or as nothing has come of it for
    `dead_s`, all values are forgotten and no timer runs until it is up again; only what comes after that is
    repeated. An empty action ends the thermostat's repetition."""

    def __init__(self, silence_s: float, tick_s: float, dead_s: float) -> None:
        self.silence, self.tick, self.dead = (int(1000 * s) for s in (silence_s, tick_s, dead_s))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", "entity_id string", "ms long, w double, action string")
        self.heard = handle.getValueState("heard", "ms long")

    def _timers(self) -> list[int]:
        return [t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()]

    def _down(self) -> None:
        self.last.clear()
        self.heard.clear()
        for t in self._timers():
            self.handle.deleteTimer(t)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        whole = _chunks(rows, ["ts"])
        now = timerValues.getCurrentProcessingTimeInMs()
        if self.heard.exists() and now - self.heard.get()[0] > self.dead:
            self._down()  # it was down in between
        down = whole["status"].eq("down").to_numpy()
        after = whole
        if down.any():
            self._down()
            after = whole.iloc[int(down.nonzero()[0].max()) + 1 :]
        if len(after):
            self.heard.update((now,))
            if not self._timers():
                self.handle.registerTimer(now + self.tick)
        samples = after[after["entity_id"].notna()].groupby("entity_id").tail(1)
        for ts, entity, w, action in samples[["ts", "entity_id", "w", "action"]].itertuples(index=False):
            if pd.isna(w) and not (isinstance(action, str) and action):
                if self.last.containsKey((entity,)):
                    self.last.removeKey((entity,))
            else:
                self.last.updateValue((entity,), (pd.Timestamp(ts).value // 1_000_000, None if pd.isna(w) else float(w), action if isinstance(action, str) else None))
        out = whole[whole["entity_id"].notna() & (whole["w"].notna() | whole["action"].fillna("").ne(""))]
        yield out[["home", "ts", "entity_id", "w", "action"]].assign(repeated=False)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        if not self.heard.exists() or now - self.heard.get()[0] > self.dead:
            self._down()
            return
        self.handle.registerTimer(now + self.tick)
        again = [(k[0], v[1], v[2]) for k, v in self.last.iterator() if now - v[0] >= self.silence]
        for entity, w, action in again:
            self.last.updateValue((entity,), (now, w, action))
        if again:
            rows = pd.DataFrame(again, columns=["entity_id", "w", "action"]).astype({"w": "float64"})
            yield rows.assign(home=key[0], ts=pd.Timestamp(now, unit="ms"), repeated=True)[["home", "ts", "entity_id", "w", "action", "repeated"]]

    def close(self) -> None:
        pass


def keep_alive(feed: DataFrame, silence_s: float = 300, tick_s: float = 300, dead_s: float = 600) -> DataFrame:
    """T6 of feed(home, ts, entity_id, w, action, status): (home, ts, entity_id, w, action, repeated). It runs by
    processing time, so with a trigger of some seconds; its batches go on while no rows come."""
    rows = feed.select("home", "ts", "entity_id", "w", "action", "status").where("home is not null")
    schema = "home string, ts timestamp, entity_id string, w double, action string, repeated boolean"
    return rows.groupBy("home").transformWithStateInPandas(KeepAlive(silence_s, tick_s, dead_s), schema, "Append", "ProcessingTime")
