"""Weather inputs: live station records, positional archive files, parallel hourly arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import clock

# Archive columns (0-based) and defaults of the hourly arrays.
ARCHIVE = {"temperature_c": 27, "relative_humidity": 32, "wind_speed_ms": 24, "pressure_hpa": 38, "visibility_m": 17}
ARCHIVE_RAIN, ARCHIVE_MIN_FIELDS, ARCHIVE_FIELDS = 40, 30, 60
ARRAY_DEFAULTS = {"temperature_2m": 11.3, "relative_humidity_2m": 75.0, "precipitation": 0.0, "wind_speed_10m": 3.0}


def latin2(text: Column) -> Column:
    """Text of an ISO-8859-2 file that was read as ISO-8859-1, the only one-byte set the reader offers."""
    high = bytes(range(0xA0, 0x100))
    return F.translate(text, high.decode("iso-8859-1"), high.decode("iso-8859-2"))


def freezing_rain(mm: Column, temp: Column) -> Column:
    return (mm > 0) & F.coalesce(temp <= 0, F.lit(False))


def live_records(raw: DataFrame) -> DataFrame:
    """Typed rows of live station records, whose values are all text; unreadable records drop out."""
    number = {n: F.col(s).try_cast("double") for n, s in (
        ("temperature_c", "temperatura"), ("relative_humidity", "wilgotnosc_wzgledna"), ("wind_speed_ms", "predkosc_wiatru"), ("pressure_hpa", "cisnienie"))}
    at = F.concat(F.col("data_pomiaru"), F.lit(" "), F.lpad("godzina_pomiaru", 2, "0"), F.lit(":00:00")).try_cast("timestamp_ntz")
    mm = F.when(F.col("suma_opadu").isNull(), 0.0).otherwise(F.col("suma_opadu").try_cast("double"))
    readable = at.isNotNull() & mm.isNotNull()
    for text in ("temperatura", "wilgotnosc_wzgledna", "predkosc_wiatru", "cisnienie"):
        readable = readable & (F.col(text).isNull() | F.col(text).try_cast("double").isNotNull())
    return raw.filter(readable).select(
        F.col("id_stacji").cast("string").alias("station_id"), F.col("stacja").alias("station_name"), at.alias("timestamp"),
        clock.hour_bucket(at).alias("timestamp_bucket"), *[c.alias(n) for n, c in number.items()], mm.alias("precipitation_mm"),
        freezing_rain(mm, number["temperature_c"]).alias("freezing_rain_flag"))


def archive(spark: SparkSession, path: str, station: str | None = None) -> DataFrame:
    """Hourly rows of positional archive files in ISO-8859-2 with at least thirty fields."""
    schema = ", ".join(f"_c{i} string" for i in range(ARCHIVE_FIELDS))
    raw = spark.read.option("encoding", "iso-8859-1").option("ignoreLeadingWhiteSpace", True).option(
        "ignoreTrailingWhiteSpace", True).schema(schema).csv(path)

    def field(i: int) -> Column:
        return F.trim(F.col(f"_c{i}"))

    name = latin2(field(1))

    at = F.concat(field(2), F.lit("-"), F.lpad(field(3), 2, "0"), F.lit("-"), F.lpad(field(4), 2, "0"), F.lit(" "),
                  F.lpad(field(5), 2, "0"), F.lit(":00:00")).try_cast("timestamp_ntz")
    rain = F.when(field(ARCHIVE_RAIN).rlike(r"^\d+\.?\d*$"), field(ARCHIVE_RAIN).try_cast("double")).otherwise(0.0)
    values = {n: F.nullif(field(i), F.lit("")) for n, i in ARCHIVE.items()}
    # A short line leaves its later fields null, whereas a present but empty field may be null too;
    # the date fields and the last required field tell the two apart.
    rows = raw.filter(F.coalesce(*[F.col(f"_c{i}") for i in range(ARCHIVE_MIN_FIELDS - 1, ARCHIVE_FIELDS)]).isNotNull() & at.isNotNull())
    for text in values.values():
        rows = rows.filter(text.isNull() | text.try_cast("double").isNotNull())
    if station:
        rows = rows.filter(F.upper(name).contains(station.upper()))
    numbers = {n: c.try_cast("double") for n, c in values.items()}
    return rows.select(
        field(0).alias("station_id"), name.alias("station_name"), at.alias("timestamp"), clock.hour_bucket(at).alias("timestamp_bucket"),
        *[c.alias(n) for n, c in numbers.items()], rain.alias("precipitation_mm"),
        freezing_rain(rain, numbers["temperature_c"]).alias("freezing_rain_flag"))


def hourly_arrays(raw: DataFrame) -> DataFrame:
    """Parallel arrays (``time`` and values) to one row per hour, missing values replaced by defaults."""
    zipped = raw.select("station_id", "station_name", F.explode(F.arrays_zip("time", *ARRAY_DEFAULTS)).alias("h")).filter("h.time is not null")
    v = {n: F.coalesce(F.col(f"h.{n}").cast("double"), F.lit(d)) for n, d in ARRAY_DEFAULTS.items()}
    at = F.replace(F.col("h.time"), F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz")
    return zipped.select(
        "station_id", "station_name", at.alias("timestamp"), clock.hour_bucket(at).alias("timestamp_bucket"),
        v["temperature_2m"].alias("temperature_c"), v["relative_humidity_2m"].alias("relative_humidity"),
        v["precipitation"].alias("precipitation_mm"), v["wind_speed_10m"].alias("wind_speed_ms"),
        F.lit(1013.25).alias("pressure_hpa"), F.lit(10000.0).alias("visibility_m"),
        freezing_rain(v["precipitation"], v["temperature_2m"]).alias("freezing_rain_flag"))
