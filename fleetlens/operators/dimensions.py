"""Dimension tables of the mart: weather by hour, road links, hubs, defaults.

No join here carries a broadcast hint. File-backed dimensions have known sizes, so Spark
broadcasts the small ones and shuffles any that outgrow the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.functions import clock, transit

# What a mart row gets when a dimension has no match.
DEFAULTS = {
    "temperature_c": 11.3,
    "precipitation_mm": 0.0,
    "wind_speed_ms": 3.0,
    "relative_humidity": 75.0,
    "segment_length_meters": 500.0,
    "tortuosity_ratio": 1.0,
    "signalized_intersection_count": 2,
    "lane_capacity": 3,
    "interchange_line_count": 1,
}

# Column types of the dimensions, used for a missing table and for missing optional columns.
WEATHER = (
    "timestamp timestamp_ntz, temperature_c double, precipitation_mm double, wind_speed_ms double, "
    "relative_humidity double, freezing_rain_flag boolean"
)
LINKS = (
    "edge_id string, stop_id_prev string, stop_id_curr string, slug_prev string, slug_curr string, "
    "corridor_name string, segment_length_meters double, actual_path_length_meters double, "
    "tortuosity_ratio double, signalized_intersection_count long, is_dedicated_right_of_way boolean, "
    "lane_capacity long"
)
CALENDAR = "calendar_date string, is_school_day int, is_public_holiday int"
HUBS = "stop_id string, zbk_slug string, interchange_line_count long, is_metro_proximity long"


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """Typed stand-in for a table that is not there, so the plan still runs."""
    return spark.createDataFrame([], schema)


def with_optional(df: DataFrame, optional: dict[str, Column]) -> DataFrame:
    """Add the optional columns that the table lacks."""
    missing = {n: c for n, c in optional.items() if n not in df.columns}
    return df.withColumns(missing) if missing else df


def hourly_rollup(weather: DataFrame) -> DataFrame:
    hour = clock.hour_bucket(F.col("timestamp"))
    return weather.groupBy(hour.alias("timestamp")).agg(
        F.avg("temperature_c").alias("temperature_c"),
        F.max("precipitation_mm").alias("precipitation_mm"),
        F.avg("wind_speed_ms").alias("wind_speed_ms"),
        F.avg("relative_humidity").alias("relative_humidity"),
        F.bool_or("freezing_rain_flag").alias("freezing_rain_flag"),
    )


def weather_by_hour(weather: DataFrame) -> DataFrame:
    """Hourly weather with rain class, previous-row rain and three-row rain sum.

    The window has no key: its input is one row per hour of history (8,784 rows a year), not
    per observation.
    """
    hourly = hourly_rollup(weather)
    mm = F.col("precipitation_mm")
    w = Window.partitionBy(F.lit(1)).orderBy(F.col("timestamp").asc_nulls_last())
    return hourly.select(
        "timestamp", "temperature_c", "precipitation_mm",
        transit.flag(mm > 0).alias("is_raining"),
        transit.rain_category(mm).alias("rain_intensity_category"),
        F.coalesce(F.lag(mm).over(w), F.lit(0.0)).alias("precip_lag_1h"),
        F.coalesce(F.sum(mm).over(w.rowsBetween(-2, 0)), mm).alias("precip_3h_cumulative"),
        "wind_speed_ms", "relative_humidity", "freezing_rain_flag",
    )


def complete_links(links: DataFrame) -> DataFrame:
    empty_text = F.lit("")
    return with_optional(
        links,
        {
            "actual_path_length_meters": F.col("segment_length_meters"),
            "tortuosity_ratio": F.lit(1.0),
            "slug_prev": empty_text, "slug_curr": empty_text,
            "stop_id_prev": empty_text, "stop_id_curr": empty_text,
        },
    )


def _filled(name: str) -> Column:
    return F.col(name).isNotNull() & (F.col(name) != "")


def _first_by_priority(df: DataFrame, keys: list[str], tie: str) -> DataFrame:
    best = F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct("prio", F.col(tie)))
    picked = df.groupBy(*keys).agg(best.alias("b"))
    return picked.select(*keys, "b.*").drop("prio")


def links_by_either_key(links: DataFrame, tie: str = "edge_id") -> DataFrame:
    """Two equi-join views of the link table, slug pair before stop-id pair, one row per key."""
    links = complete_links(links)
    by_slug = links.filter(_filled("slug_prev")).select(
        F.col("slug_prev").alias("join_prev"), F.col("slug_curr").alias("join_curr"), F.lit(1).alias("prio"), "*")
    by_id = links.filter(_filled("stop_id_prev")).select(
        F.col("stop_id_prev").alias("join_prev"), F.col("stop_id_curr").alias("join_curr"), F.lit(0).alias("prio"), "*")
    return _first_by_priority(by_slug.unionByName(by_id), ["join_prev", "join_curr"], tie)


def hubs_by_either_key(hubs: DataFrame, tie: str = "stop_id") -> DataFrame:
    hubs = with_optional(hubs, {"zbk_slug": F.col("stop_id")})
    by_slug = hubs.filter(_filled("zbk_slug")).select(F.col("zbk_slug").alias("join_stop_id"), F.lit(1).alias("prio"), "*")
    by_id = hubs.filter(_filled("stop_id")).select(F.col("stop_id").alias("join_stop_id"), F.lit(0).alias("prio"), "*")
    return _first_by_priority(by_slug.unionByName(by_id), ["join_stop_id"], tie)


def dimension_columns(is_tram: Column, is_weekend: Column) -> list[Column]:
    """Mart columns read from the joined dimensions, with defaults."""
    d = {k: F.lit(v) for k, v in DEFAULTS.items()}
    length = F.coalesce("segment_length_meters", d["segment_length_meters"])
    plain = ["temperature_c", "precipitation_mm", "is_raining", "rain_intensity_category", "precip_lag_1h",
             "precip_3h_cumulative", "wind_speed_ms", "relative_humidity"]
    weather = [F.coalesce(n, d.get(n, F.lit(0))).alias(n) for n in plain]
    return [
        F.coalesce("is_school_day", 1 - is_weekend).alias("is_school_day"),
        F.coalesce("is_public_holiday", F.lit(0)).alias("is_public_holiday"),
        F.coalesce("interchange_line_count", d["interchange_line_count"]).alias("interchange_line_count"),
        F.coalesce("is_metro_proximity", F.lit(0)).alias("is_metro_proximity"),
        *weather,
        F.coalesce("freezing_rain_flag", F.lit(False)).alias("freezing_rain_flag"),
        F.col("corridor_name"),
        length.alias("segment_length_meters"),
        F.coalesce(F.col("actual_path_length_meters"), length).alias("actual_path_length_meters"),
        F.coalesce("tortuosity_ratio", d["tortuosity_ratio"]).alias("tortuosity_ratio"),
        F.coalesce("signalized_intersection_count", d["signalized_intersection_count"]).alias("signalized_intersection_count"),
        F.coalesce("is_dedicated_right_of_way", is_tram == 1).alias("is_dedicated_right_of_way"),
        F.coalesce("lane_capacity", d["lane_capacity"]).alias("lane_capacity"),
        transit.flag(F.col("corridor_name").isNotNull()).alias("is_study_corridor"),
    ]
