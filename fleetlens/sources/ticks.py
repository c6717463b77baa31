"""Raw vehicle ticks: JSON payload files, one per capture tick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import clock

# Values arrive as text or number, so everything is read as text first.
VEHICLES = "array<struct<VehicleNumber: string, Lines: string, Brigade: string, Lat: string, Lon: string, Time: string>>"
WRAPPED = f"struct<result: {VEHICLES}>"


def tick_files(spark: SparkSession, base: str) -> DataFrame:
    """Payload files below ``source=/date=/hour=``: (source, date, hour, tick_ts, payload)."""
    files = spark.read.option("wholetext", True).text(base).select("*", F.col("_metadata.file_name").alias("file_name"))
    return files.select(
        "source", F.col("date").cast("string").alias("date"), F.lpad(F.col("hour").cast("string"), 2, "0").alias("hour"),
        tick_epoch(F.col("file_name")).alias("tick_ts"), F.col("value").alias("payload"))


def tick_epoch(file_name: Column) -> Column:
    """First number of at least nine digits in a file name, else 0."""
    return F.coalesce(F.nullif(F.regexp_extract(file_name, r"(\d{9,})", 1), F.lit("")).cast("long"), F.lit(0).cast("long"))


def payload_vehicles(payload: Column) -> Column:
    """Vehicle array of a bare list or of ``{"result": [...]}``; null for anything else."""
    listed = F.when(F.ltrim(payload).startswith("["), F.from_json(payload, VEHICLES))
    wrapped = F.when(F.ltrim(payload).startswith("{"), F.from_json(payload, WRAPPED)["result"])
    return F.coalesce(listed, wrapped)


def payload_status(payload: Column) -> Column:
    """OK, EMPTY, or ERROR (unreadable, or an error text in place of the list)."""
    v = payload_vehicles(payload)
    return F.when(v.isNull(), "ERROR").when(F.size(v) == 0, "EMPTY").otherwise("OK")


def payload_fixes(ticks: DataFrame) -> DataFrame:
    """One row per vehicle of each payload, guarded and time-checked; bad payloads give no rows."""
    v = F.col("v")
    rows = ticks.select("source", "date", "hour", "tick_ts", F.explode(payload_vehicles(F.col("payload"))).alias("v"))
    lat, lon, text = v["Lat"].try_cast("double"), v["Lon"].try_cast("double"), F.trim(v["Time"])
    present = (lat != 0) & (lon != 0) & (F.length(text) > 0)
    fixes = rows.filter(present).select(
        F.col("date").alias("service_date"),
        F.when(F.col("source") == "um_tram", "tram").otherwise("bus").alias("vehicle_type"),
        F.trim(F.coalesce(v["VehicleNumber"], F.lit(""))).alias("vehicle_number"),
        F.trim(F.coalesce(v["Lines"], F.lit(""))).alias("route_id"),
        F.trim(F.coalesce(v["Brigade"], F.lit(""))).alias("brigade"),
        lat.alias("lat"), lon.alias("lon"), clock.parse_local_text(text, "tick_ts").alias("gps_timestamp_utc"),
        text.alias("gps_time_str"), "tick_ts", F.col("hour").alias("hour_utc"))
    return fixes.filter(clock.clock_is_fresh("gps_timestamp_utc", "tick_ts"))


def preferred_ticks(compacted: DataFrame, loose: DataFrame) -> DataFrame:
    """Ticks of compacted hours, and loose ticks of the hours that are not compacted."""
    keys = ["source", "date", "hour"]
    return compacted.unionByName(loose.join(compacted.select(*keys).distinct(), keys, "left_anti"))
