"""Streams with keyed state: change-only records, latest forecasts, kinematics.

Each is a stateful processor over one entity (a vehicle day) or a bucket of them (trips, which are many and small): a micro-batch reads and writes the state of its
own keys only, which Spark keeps in its state store with the query's checkpoint, so a repeated batch starts from the state of the one before. A bucket's state is one
Arrow table and its steps are column operations, as a Python call and a round trip to the store a trip cost more than the work itself. State lives in event time: an entity not
heard of for ``ttl_s`` is forgotten by a timer once the watermark passes. Rows that are more than ``ttl_s`` older than the newest come too late and are left
out, as the state that would judge them may be gone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from fleetlens.operators import kinematics
from fleetlens.session import importable

TTL_S = 2 * 86400
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keeps_state(spark: SparkSession) -> SparkSession:
    """State beyond memory: the store that keyed processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return importable(spark)


class _Entity(StatefulProcessor):
    """One state value per entity, with the event time up to which it is kept."""

    schema: T.StructType
    order: list[str]
    time: str
    ttl_s: int

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("entity", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        batch = batch.sort_values(self.order, kind="stable", na_position="last", ignore_index=True)
        out, after = self.step(batch, self.state.get() if self.state.exists() else None)
        self.state.update(after)
        self.handle.registerTimer((int(batch[self.time].max()) + self.ttl_s) * 1000)
        if len(out):
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and self.newest(self.state.get()) + self.ttl_s <= expiredTimerInfo.getExpiryTimeInMs() // 1000:
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


#: Buckets of trips: the entities of one are held in memory at once.
BUCKETS = 1024
STOP = ["trip_id", "stop_sequence"]


class _Stops(StatefulProcessor):
    """The stops of a bucket of trips: last value (as text) and last time of each; a trip is forgotten as a whole, ``ttl_s`` after its newest time."""

    schema = T.StructType([T.StructField("stops", T.BinaryType())])
    entries = pa.schema([("trip_id", pa.string()), ("stop_sequence", pa.int64()), ("value", pa.string()), ("seen", pa.int64())])
    columns: list[str]
    order: list[str]
    time: str
    ttl_s: int

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("trips", self.schema)

    def _known(self) -> pd.DataFrame:
        if not self.state.exists():
            return self.entries.empty_table().to_pandas()
        with pa.ipc.open_stream(self.state.get()[0]) as file:
            return file.read_pandas()

    def _keep(self, known: pd.DataFrame) -> None:
        """Store the entries, and wake when the first trip is due."""
        if not len(known):
            self.state.clear()
            return
        sink = pa.BufferOutputStream()
        table = pa.Table.from_pandas(known, schema=self.entries, preserve_index=False)
        with pa.ipc.new_stream(sink, self.entries) as file:
            file.write_table(table)
        self.state.update((sink.getvalue().to_pybytes(),))
        self.handle.registerTimer((int(known.groupby("trip_id", dropna=False)["seen"].max().min()) + self.ttl_s) * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        batch = batch.sort_values(self.order, kind="stable", na_position="last", ignore_index=True)
        known = self._known()
        keep, newest = self.step(batch, known)
        touched = newest["trip_id"].unique()
        after = pd.concat([known, newest], ignore_index=True).drop_duplicates(STOP, keep="last")
        # a trip that was heard of lets go of stops that are much older than its newest
        old = after["trip_id"].isin(touched) & (after["seen"] < after.groupby("trip_id", dropna=False)["seen"].transform("max") - self.ttl_s)
        self._keep(after[~old])
        if len(keep):
            yield batch.iloc[keep][self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self._known()
        if len(known):
            newest = known.groupby("trip_id", dropna=False)["seen"].transform("max")
            self._keep(known[newest + self.ttl_s > expiredTimerInfo.getExpiryTimeInMs() // 1000])
        return iter(())

    def close(self) -> None:
        pass


class ChangedValues(_Stops):
    """Rows whose value differs from the one before at the same stop."""

    def __init__(self, columns: list[str], value: str, time: str, order: list[str], ttl_s: int):
        self.columns, self.value, self.time, self.order, self.ttl_s = columns, value, time, order, ttl_s

    def step(self, batch: pd.DataFrame, known: pd.DataFrame):
        # a column of longs with a null among them arrives as doubles
        texts = [None if pd.isna(v) else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v) for v in batch[self.value]]
        rows = pd.DataFrame({"trip_id": batch["trip_id"], "stop_sequence": batch["stop_sequence"].astype("int64"), "value": pd.Series(texts, dtype=object), "seen": batch[self.time].astype("int64")})
        line = pd.concat([known, rows], ignore_index=True)
        before = line.groupby(STOP, sort=False, dropna=False)["value"].shift()
        first = ~line.duplicated(STOP)
        same = (line["value"] == before) | (line["value"].isna() & before.isna())
        fresh = (first | ~same).to_numpy()[len(known):]
        return fresh.nonzero()[0], rows.drop_duplicates(STOP, keep="last")


class LatestRows(_Stops):
    """The newest row of each stop that the batch made newer; the last value tells how new it is."""

    def __init__(self, columns: list[str], time: str, order: list[str], ttl_s: int):
        self.columns, self.time, self.order, self.ttl_s = columns, time, order, ttl_s

    def step(self, batch: pd.DataFrame, known: pd.DataFrame):
        marks = ["\x00".join(m) for m in zip(*(batch[c].map(str if batch[c].dtype == object else "{:020d}".format) for c in self.order), strict=True)]
        rows = pd.DataFrame({"trip_id": batch["trip_id"], "stop_sequence": batch["stop_sequence"].astype("int64"), "value": pd.Series(marks, dtype=object), "seen": batch[self.time].astype("int64")})
        # of equal marks the known one, then the first of the batch
        line = pd.concat([known, rows], ignore_index=True).sort_values("value", ascending=False, kind="stable").drop_duplicates(STOP)
        newer = line[line.index >= len(known)].sort_index()
        return newer.index.to_numpy() - len(known), newer


class CleanFixes(_Entity):
    """Fixes of a vehicle without repeated pings, each with the kept fix before it."""

    schema = T.StructType([T.StructField("began", T.LongType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()), T.StructField("text", T.StringType()), T.StructField("seen", T.LongType())])
    time, order = "gps_timestamp_utc", kinematics.ORDER

    def __init__(self, ttl_s: int):
        self.ttl_s = ttl_s

    def newest(self, state) -> int:
        return state[4]

    def step(self, batch: pd.DataFrame, state):
        last = None if state is None else tuple(state[:4])
        rows, counts, before = [], [], []
        for i, (gps, lat, lon, text) in enumerate(zip(batch["gps_timestamp_utc"], batch["lat"], batch["lon"], batch["gps_time_str"], strict=True)):
            if last is not None and last[1:] == (lat, lon, text):
                if counts:
                    counts[-1] += 1
                continue
            rows.append(i)
            counts.append(1)
            before.append(last)
            last = (int(gps), lat, lon, text)
        out = batch.iloc[rows].copy()
        out["n_ticks_seen"] = pd.array(counts, dtype="int32")
        for k, name in enumerate(("prev_ts", "prev_lat", "prev_lon")):
            out[name] = pd.array([None if b is None else b[k] for b in before], dtype="Int64" if k == 0 else "Float64")
        seen = max(int(batch["gps_timestamp_utc"].max()), 0 if state is None else int(state[4]))
        return out, (*last, seen)


def _stateful(stream: DataFrame, keys: list[str], time: Column, processor: StatefulProcessor, ttl_s: int, schema: T.StructType) -> DataFrame:
    keeps_state(stream.sparkSession)
    timed = stream.withColumn("__at", F.timestamp_seconds(time)).withWatermark("__at", f"{ttl_s} seconds")
    return timed.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def _nullable(schema: T.StructType, *more: T.StructField) -> T.StructType:
    return T.StructType([*(T.StructField(f.name, f.dataType) for f in schema), *more])


def _by_bucket(stream: DataFrame, time: str, processor: StatefulProcessor, ttl_s: int) -> DataFrame:
    bucketed = stream.withColumn("__bucket", F.pmod(F.xxhash64("trip_id"), F.lit(BUCKETS)))
    return _stateful(bucketed, ["__bucket"], F.col(time), processor, ttl_s, _nullable(stream.schema))


def changes(stream: DataFrame, value: str = "rt_arrival_time", time: str = "feed_timestamp", ttl_s: int = TTL_S) -> DataFrame:
    """Records whose value differs from the one seen before for the same trip and stop; ties on time follow the other columns by name."""
    order = [time, *sorted(set(stream.columns) - {time, *STOP})]
    return _by_bucket(stream, time, ChangedValues(stream.columns, value, time, order, ttl_s), ttl_s)


def latest_forecasts(stream: DataFrame, order: tuple[str, ...] = ("hour_utc", "tick_ts"), ttl_s: int = TTL_S) -> DataFrame:
    """Each batch's new latest forecasts per trip and stop: the newest output row of a stop is its latest forecast."""
    return _by_bucket(stream, "tick_ts", LatestRows(stream.columns, "tick_ts", list(order), ttl_s), ttl_s)


def moving_fixes(stream: DataFrame, ttl_s: int = TTL_S) -> DataFrame:
    """Clean fixes with movement; a vehicle's last kept fix waits in the state for its next batch."""
    more = [T.StructField("n_ticks_seen", T.IntegerType()), T.StructField("prev_ts", T.LongType()), T.StructField("prev_lat", T.DoubleType()), T.StructField("prev_lon", T.DoubleType())]
    clean = _stateful(stream, kinematics.VEHICLE_DAY, F.col("gps_timestamp_utc"), CleanFixes(ttl_s), ttl_s, _nullable(stream.schema, *more))
    return kinematics.with_movement(clean)


def to_table(stream: DataFrame, output: str, checkpoint: str):
    """Run what has arrived through the stream and append its rows to a Parquet table, each exactly once."""
    query = stream.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(output)
