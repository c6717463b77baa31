"""Writers: date partitions, appends, keyed upserts, incremental hours, compaction."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.operators.latest import latest_per_key
from fleetlens.session import checkpointed


def read_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None if nothing lies at the path; a damaged or unreadable table raises."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table through its file system, whichever it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def gathered(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out so that each key's rows fill few files of the session's advisory size: large keys are split, small tasks joined."""
    return df.hint("rebalance", *keys)


def write_dates(df: DataFrame, path: str, sort_by: list[str] | None = None) -> None:
    """Replace exactly the dates present in ``df``; other dates stay. Needs a ``date`` column."""
    rows = gathered(df, "date")
    rows = rows.sortWithinPartitions("date", *sort_by) if sort_by else rows
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("date").parquet(path)


def append_days(updates: DataFrame, path: str, ingested_at: Column) -> None:
    """Append to year/month/day partitions of the ingestion time."""
    day = {"year": F.date_format(ingested_at, "yyyy"), "month": F.date_format(ingested_at, "MM"), "day": F.date_format(ingested_at, "dd")}
    updates.withColumns(day).write.mode("append").option("compression", "snappy").partitionBy("year", "month", "day").parquet(path)


def write_dataset(df: DataFrame, path: str, sort_by: list[str] | None = None) -> None:
    """One dataset; files are sorted inside, which keeps scans selective without a global sort."""
    (df.sortWithinPartitions(*sort_by) if sort_by else df).write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Small result table as CSV or JSON."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def merged(current: DataFrame | None, arrived: DataFrame, keys: list[str], version: list[Column]) -> DataFrame:
    """Union of both, one row per key: arrived rows win, then the greatest version."""
    new = arrived.withColumn("__new", F.lit(1))
    both = new if current is None else current.withColumn("__new", F.lit(0)).unionByName(new, allowMissingColumns=True)
    return latest_per_key(both, keys, [F.col("__new"), *version]).drop("__new")


def upsert(spark: SparkSession, path: str, arrived: DataFrame, keys: list[str], version: list[Column]) -> DataFrame:
    """Keyed upsert of a versioned table: the old state stays whole until the new one is."""
    from fleetlens.sources import versions

    return versions.upsert(spark, path, arrived, keys, version)


def pending_hours(available: DataFrame, manifest: DataFrame | None, current_hour: str | None = None, force: bool = False) -> DataFrame:
    """(date, hour_utc) that are closed and not yet in the manifest; all closed ones when forced."""
    hours = available.select("date", "hour_utc").distinct()
    if current_hour:
        hours = hours.filter(F.concat_ws(" ", "date", "hour_utc") < current_hour)
    if force or manifest is None:
        return hours
    return hours.join(manifest.select("date", "hour_utc").distinct(), ["date", "hour_utc"], "left_anti")


def materialize_hours(spark: SparkSession, path: str, extracted: DataFrame, hours: DataFrame) -> None:
    """Replace the given hours inside their date partitions; other hours of those dates are kept.

    Running it again with the same hours gives the same table.
    """
    dates = hours.select("date").distinct()
    new = extracted.join(hours, ["date", "hour_utc"], "left_semi")
    current = read_if_exists(spark, path)
    rows = new
    if current is not None:
        current = current.withColumn("date", F.col("date").cast("string"))
        kept = current.join(dates, "date", "left_semi").join(hours, ["date", "hour_utc"], "left_anti")
        rows = checkpointed(kept.unionByName(new))
    write_dates(rows, path, ["hour_utc"])


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """Row count and order-free checksum."""
    row = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")), F.lit(0))).first()
    return int(row[0]), int(row[1])


def compact(spark: SparkSession, source: str, target: str, closed: Column) -> int:
    """Rewrite closed partitions of small files into few large ones; publish only what verifies.

    Rows are gathered by partition, so an hour has one file unless it is larger than the session's advisory partition size.
    """
    found = spark.read.parquet(source).schema
    parts = [c for c in ("source", "date", "hour") if c in found.names]
    # Partition values stay text, so that "00" does not come back as 0.
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name in parts else f.dataType) for f in found.fields])
    rows = spark.read.schema(schema).parquet(source).filter(closed)
    staging = f"{target}.staging"
    publish = lambda df, path: gathered(df, *parts).write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)
    remove(spark, staging)
    publish(rows, staging)
    staged = spark.read.schema(rows.schema).parquet(staging)
    before, after = fingerprint(rows), fingerprint(staged.select(*rows.columns))
    if before != after:
        raise ValueError(f"compaction check failed: {before} != {after}")
    publish(staged, target)
    remove(spark, staging)
    return before[0]
