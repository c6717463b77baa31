"""Trip-preserving stratified sampling with inverse-probability weights, and simpler samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions import transit
from fleetlens.functions.rounding import round_half_up

WEIGHT = "inverse_sampling_weight"
STRATUM = ["service_day", "regime_weather", "regime_infra", "regime_time"]
STOPS_PER_TRIP, N_CELLS = 25, 12


def downcast(df: DataFrame, to_int: list[str] | None = None) -> DataFrame:
    """Halve numeric widths: doubles to floats, and the named longs to ints; a value that does not fit raises.

    Output types follow from the arguments alone. Text needs no category type: Parquet dictionary-encodes it.
    """
    narrow = {f.name: F.col(f.name).cast("float") for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    narrow.update({c: F.when(F.abs(F.col(c)) < 2**31, F.col(c)).otherwise(F.when(F.col(c).isNotNull(), F.raise_error(F.lit(f"{c} does not fit an int")).cast("long"))).cast("int") for c in to_int or []})
    return df.withColumns(narrow) if narrow else df


def quota_per_stratum(sample_size: int) -> int:
    """Trips per cell: the target number of trips spread over the twelve cells, rounded up."""
    trips = max(1, sample_size // STOPS_PER_TRIP)
    return max(1, (trips + N_CELLS - 1) // N_CELLS)


def trip_day(trip: str = "trip_id", time: str = "arrival_ts") -> Column:
    return F.concat(F.col(trip), F.lit("_"), F.to_date(F.col(time)).cast("string"))


def trip_regimes(mart: DataFrame) -> DataFrame:
    """One row per trip and day with its weather, infrastructure and peak regime."""
    tram = F.max(transit.flag((F.col("transit_cohort") == "urban_tram") | (F.col("is_tram") == 1)))
    own_lane = F.max(transit.flag(F.col("is_dedicated_right_of_way")))
    rain = F.max("precipitation_mm")
    return mart.groupBy(trip_day().alias("trip_instance")).agg(
        F.to_date(F.min("arrival_ts")).cast("string").alias("service_day"),
        F.when(rain > 1.0, "mod_heavy_rain").when(rain > 0.0, "light_rain").otherwise("dry").alias("regime_weather"),
        F.when(tram == 1, "tram_row").when(own_lane == 1, "bus_dedicated_row").otherwise("bus_mixed_traffic").alias("regime_infra"),
        F.when(F.max("is_peak_hour") == 1, "peak").otherwise("offpeak").alias("regime_time"),
        F.count(F.lit(1)).alias("n_stops"),
    )


def sampled_trips(regimes: DataFrame, quota: int, seed: int = 42) -> DataFrame:
    """The first trips of every stratum in seeded hash order, with their weight.

    Population counts are aggregates, so a huge stratum never meets in one task; the rank
    window is cut down to ``quota`` rows per task before its shuffle.
    """
    rank = F.row_number().over(Window.partitionBy(*STRATUM).orderBy(transit.seeded_order(F.col("trip_instance"), seed)))
    top = regimes.withColumn("rank", rank).filter(F.col("rank") <= quota)

    cells = regimes.groupBy(*STRATUM).agg(F.count(F.lit(1)).alias("pop"))
    # One row per stratum from here on: at most twelve per day.
    n_days = cells.select(F.countDistinct("service_day")).scalar()
    per_day = F.greatest(F.lit(1), F.ceil(F.lit(float(quota)) / F.greatest(n_days, F.lit(1))))
    day = Window.partitionBy("service_day")
    taken = F.least(F.col("pop"), F.col("quota_day"))
    shares = cells.withColumn("quota_day", per_day).withColumn("taken", taken).withColumns(
        {"pop_day": F.sum("pop").over(day), "taken_day": F.sum("taken").over(day)})
    pop_share = F.col("pop").cast("double") / F.col("pop_day")
    weight = round_half_up(pop_share / (F.col("taken").cast("double") / F.col("taken_day")), 6)
    return top.join(shares, STRATUM).filter(F.col("rank") <= F.col("quota_day")).select("trip_instance", weight.alias(WEIGHT))


def uniform_sample(mart: DataFrame, sample_size: int, seed: int = 42, key: Column | None = None) -> DataFrame:
    """Exactly ``sample_size`` rows (or all), repeatable: those with the smallest seeded hashes.

    Hashes are uniform, so a bound a little above the wanted share leaves little more than the sample to be sorted; should it leave
    too few, all rows are. Rows are counted once and read once.
    """
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in mart.columns]
    key = key if key is not None else F.concat_ws("\x1f", *parts)
    # 60 bits of the digest as a number.
    hashed = mart.withColumn("__h", F.conv(F.substring(transit.seeded_order(key, seed), 1, 15), 16, 10).cast("long"))
    n = mart.count()
    if n > sample_size:
        bound = int((sample_size + 6 * sample_size**0.5 + 20) / n * 2**60)
        likely = hashed.filter(F.col("__h") < bound)
        hashed = (likely if likely.count() >= sample_size else hashed).orderBy("__h").limit(sample_size)
    return hashed.drop("__h").withColumn(WEIGHT, F.lit(1.0))


def stratified_sample(mart: DataFrame, sample_size: int, seed: int = 42, quota: int | None = None) -> DataFrame:
    """All rows of the sampled trips, weights divided by their mean over the sample."""
    quota = quota or quota_per_stratum(sample_size)
    trips = sampled_trips(trip_regimes(mart), quota, seed)
    rows = mart.withColumn("trip_instance", trip_day()).join(trips, "trip_instance").drop("trip_instance")
    mean = rows.select(F.avg(WEIGHT)).scalar()
    scaled = F.when(mean > 0, round_half_up(F.col(WEIGHT) / mean, 6)).otherwise(F.col(WEIGHT))
    return rows.withColumn(WEIGHT, scaled)


def load_sample(mart: DataFrame, sample_size: int, strategy: str = "stratified", seed: int = 42, where: Column | None = None) -> DataFrame:
    """Full load (size 0 or strategy "none"), or a uniform or stratified sample of the given size; an empty result stays empty."""
    rows = mart.filter(where) if where is not None else mart
    if sample_size <= 0 or strategy == "none":
        return rows.withColumn(WEIGHT, F.lit(1.0))
    return stratified_sample(rows, sample_size, seed) if strategy == "stratified" else uniform_sample(rows, sample_size, seed)
