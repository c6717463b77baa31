"""Streams: change-only records, latest values, kinematics, sealed hours, tick completeness.

The core of each is a plain function from a micro-batch and the stored state to results and new
state, built from the batch operators; ``foreachBatch`` keeps the state as a Parquet table, one
version per batch, so a repeated batch overwrites its own output and reads the same state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from fleetlens.functions import clock
from fleetlens.operators import kinematics
from fleetlens.operators.chunked import with_neighbours
from fleetlens.operators.latest import latest_per_key
from fleetlens.sources.sinks import remove

FLUSH_SECONDS = 300
STATE_TTL_S = 2 * 86400
STOP_KEY = ["trip_id", "stop_sequence"]
FORECAST_ORDER = ["hour_utc", "tick_ts"]
Step = Callable[[DataFrame, "DataFrame | None"], tuple[DataFrame, DataFrame]]


def changes(batch: DataFrame, state: DataFrame | None, value: str = "rt_arrival_time", time: str = "feed_timestamp",
            ttl_s: int = STATE_TTL_S, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> tuple[DataFrame, DataFrame]:
    """Records whose value differs from the one seen before for the same trip and stop.

    State: key, last value, last time; keys not seen for ``ttl_s`` are forgotten. The state joins the batch as the past of its keys, so
    both results come from one window; ``keep`` may store its rows, which spares the second result the shuffle.
    """
    rows = batch.withColumn("__past", F.lit(False))
    if state is not None:
        past = state.select(*STOP_KEY, F.col("last_value").alias(value), F.col("last_time").alias(time), F.lit(True).alias("__past"))
        rows = rows.unionByName(past, allowMissingColumns=True)
    # Ties on time follow the other columns, so the last row in this order is the newest.
    order = [F.col("__past").desc(), F.col(time), *[F.col(c).asc_nulls_last() for c in sorted(set(batch.columns) - {time, *STOP_KEY})]]
    w = Window.partitionBy(*STOP_KEY).orderBy(*order)
    near = keep(rows.withColumns({
        "__prev": F.lag(value).over(w), "__first": F.lag(F.lit(True)).over(w).isNull(), "__last": F.lead(F.lit(True)).over(w).isNull()}))
    out = near.filter(~F.col("__past") & (F.col("__first") | ~F.col("__prev").eqNullSafe(F.col(value)))).select(*batch.columns)
    newest = near.filter("__last").select(*STOP_KEY, F.col(value).alias("last_value"), F.col(time).alias("last_time"))
    # The newest time of all rows is that of the newest rows; finding it needs no shuffle of them.
    limit = rows.agg(F.max(time)).first()[0]
    return out, newest if limit is None else newest.filter(F.col("last_time") >= limit - ttl_s)


def latest_forecasts(batch: DataFrame, state: DataFrame | None, ttl_s: int = STATE_TTL_S) -> tuple[DataFrame, DataFrame]:
    """Latest forecast per trip and stop as ticks arrive: the keys that the batch changed, and the state without keys older than ``ttl_s``."""
    newest = latest_per_key(batch, STOP_KEY, [F.col(c) for c in FORECAST_ORDER])
    if state is None:
        return newest, _fresh(newest, "tick_ts", ttl_s)
    now = latest_per_key(state.unionByName(newest), STOP_KEY, [F.col(c) for c in FORECAST_ORDER])
    changed = now.join(newest.select(*STOP_KEY), STOP_KEY, "left_semi").exceptAll(state)
    return changed.select(*batch.columns), _fresh(now.select(*batch.columns), "tick_ts", ttl_s)


def _fresh(state: DataFrame, time: str, ttl_s: int) -> DataFrame:
    """The entries at most ``ttl_s`` older than the newest."""
    limit = state.agg(F.max(time)).first()[0]
    return state if limit is None else state.filter(F.col(time) >= limit - ttl_s)


def moving_fixes(batch: DataFrame, state: DataFrame | None, ttl_s: int = STATE_TTL_S) -> tuple[DataFrame, DataFrame]:
    """Clean fixes with movement; the last fix of each vehicle joins the batch as its past, for ``ttl_s`` at most."""
    fresh = batch.withColumn("__past", F.lit(False))
    both = fresh if state is None else fresh.unionByName(state.withColumn("__past", F.lit(True)))
    moved = kinematics.with_movement(kinematics.clean_fixes(both))
    last = latest_per_key(both.drop("__past"), kinematics.VEHICLE_DAY, [F.col(c) for c in kinematics.ORDER])
    return moved.filter(~F.col("__past")).drop("__past"), _fresh(last.select(*batch.columns), "gps_timestamp_utc", ttl_s)


def run_step(stream: DataFrame, step: Step, output: str, state: str, checkpoint: str,
             flush_seconds: int | None = FLUSH_SECONDS) -> DataStreamWriter:
    """Writer that applies ``step`` per micro-batch; start it with ``.start()``.

    State versions are folders named by batch id: batch n reads n-1, writes n and removes n-2. A batch whose state is gone fails
    instead of starting anew.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        before = spark.read.parquet(f"{state}/v={batch_id - 1}") if batch_id else None
        out, after = step(batch, before)
        out.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")
        after.write.mode("overwrite").parquet(f"{state}/v={batch_id}")
        if batch_id > 1:
            remove(spark, f"{state}/v={batch_id - 2}")

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if flush_seconds is None else writer.trigger(processingTime=f"{flush_seconds} seconds")


def timely(stream: DataFrame, late_s: int = 300, early_s: int = 120) -> DataFrame:
    """Late and early rule plus a watermark on the fix time, for downstream windows."""
    rows = stream.filter(clock.clock_is_fresh("gps_timestamp_utc", "tick_ts", late_s, early_s))
    return rows.withColumn("gps_at", F.timestamp_seconds("gps_timestamp_utc")).withWatermark("gps_at", f"{late_s} seconds")


def sealed_hours(stream: DataFrame, late_s: int = 300) -> DataFrame:
    """Row counts per hour, emitted only once the watermark has passed the hour's end (append mode)."""
    return timely(stream, late_s).groupBy(F.window("gps_at", "1 hour"), "vehicle_type").agg(F.count(F.lit(1)).alias("fixes")).select(
        F.col("window.start").alias("hour_start"), "vehicle_type", "fixes")


#: Ticks that one row may stand for or expand to at once.
CHUNK_TICKS = 4096


def _spelt_out(gaps: DataFrame, period_s: int) -> DataFrame:
    """Every tick from ``first`` to ``last``: gaps are cut into parts, and parts again, so that no row holds more than CHUNK_TICKS of them."""
    for ticks in (CHUNK_TICKS**2, CHUNK_TICKS, 1):
        step = F.lit(ticks * period_s).cast("long")
        starts = gaps.select("source", "last", F.explode(F.sequence("first", "last", step)).alias("first"))
        gaps = starts.withColumn("last", F.least("last", F.col("first") + step - period_s))
    return gaps.select("source", F.col("first").alias("tick_ts"))


def tick_completeness(log: DataFrame, period_s: int) -> DataFrame:
    """Expected ticks of each source between its first and last one, and what became of them.

    Gaps and islands: seen ticks on the source's grid look back at the one before, in chunks of time, and what lies between them, or between the last one and
    the end of the grid, is a gap. Its ticks are MISSED_TICK.
    """
    grid = log.groupBy("source").agg(F.min("tick_ts").alias("__a"), F.max("tick_ts").alias("__b"))
    seen = log.groupBy("source", "tick_ts").agg(F.max_by("status", "recorded").alias("status")).join(grid, "source")
    seen = seen.filter((F.col("tick_ts") - F.col("__a")) % period_s == 0).select("source", "tick_ts", "status", F.lit(False).alias("__end"))
    past_end = F.col("__b") - (F.col("__b") - F.col("__a")) % period_s + period_s
    ends = grid.select("source", past_end.alias("tick_ts"), F.lit(None).cast("string").alias("status"), F.lit(True).alias("__end"))
    chunk = F.floor(F.col("tick_ts") / F.lit(CHUNK_TICKS * period_s))
    near = with_neighbours(seen.unionByName(ends), ["source"], [F.col("tick_ts")], chunk, lag={"__prev": F.col("tick_ts")})
    gaps = near.filter(F.col("tick_ts") - F.col("__prev") > period_s).select("source", (F.col("__prev") + period_s).alias("first"), (F.col("tick_ts") - period_s).alias("last"))
    missed = _spelt_out(gaps, period_s).withColumn("status", F.lit("MISSED_TICK"))
    return seen.drop("__end").withColumn("status", F.coalesce("status", F.lit("MISSED_TICK"))).unionByName(missed)


def capture_health(log: DataFrame, period_s: int) -> DataFrame:
    """Success share, missed ticks and bytes per source."""
    done = tick_completeness(log, period_s).groupBy("source").agg(
        F.count(F.lit(1)).alias("expected"), F.count_if(F.col("status").isin("OK", "EMPTY")).alias("captured"),
        F.count_if(F.col("status") == "MISSED_TICK").alias("missed"))
    size = log.groupBy("source").agg(F.sum("bytes").alias("bytes"))
    return done.join(size, "source").withColumn("success_pct", F.col("captured") * 100.0 / F.col("expected"))
