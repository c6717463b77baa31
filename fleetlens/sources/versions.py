"""Tables whose every state is whole: new files first, then one pointer to them.

A table folder holds ``data/<id>/part=<value>/`` folders, which are never changed, and ``versions/<number>``, small files that say which data folder each part
of the table has in that version. A commit writes its data, then its version under a temporary name, and renames it to the next number, which a
file system does at once and refuses if the number is taken. Readers take the highest number. A writer lost before the rename leaves files that no version
names; one that finds its number taken fails and may start again from the newer table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.sources.sinks import gathered, merged

#: The one part of a table without partitions; versions that stay readable after a commit.
WHOLE, KEPT = "all", 2
_PART = "__part"


class Conflict(RuntimeError):
    """Another writer committed first."""


class Folder:
    """A table folder through its own file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.files = self.hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *parts: str):
        return self.hadoop.Path("/".join((self.path, *parts)))

    def names(self, *parts: str) -> list[str]:
        where = self.at(*parts)
        return [f.getPath().getName() for f in self.files.listStatus(where)] if self.files.exists(where) else []

    def numbers(self) -> list[int]:
        return sorted(int(n) for n in self.names("versions") if n.isdigit())

    def manifest(self, number: int) -> dict:
        stream = self.files.open(self.at("versions", f"{number:012d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def newest(self) -> tuple[int, dict | None]:
        """The number and manifest of the table's state; (0, None) if nothing lies at the path."""
        numbers = self.numbers()
        if numbers:
            return numbers[-1], self.manifest(numbers[-1])
        if any(n not in ("data", "versions") for n in self.names()):
            raise ValueError(f"{self.path} holds files but no versioned table")
        return 0, None

    def publish(self, number: int, manifest: dict) -> None:
        waiting = self.at("versions", f".{uuid.uuid4().hex}")
        self.files.mkdirs(self.at("versions"))
        stream = self.files.create(waiting, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        target = self.at("versions", f"{number:012d}")
        if self.files.exists(target) or not self.files.rename(waiting, target):
            self.files.delete(waiting, False)
            raise Conflict(f"version {number} of {self.path} exists")

    def tidy(self) -> None:
        """Old versions go, and data that only they name; what no version names is left, as a writer may be at it."""
        numbers = self.numbers()
        named = [set(self.manifest(n)["parts"].values()) for n in numbers]
        for n in numbers[:-KEPT]:
            self.files.delete(self.at("versions", f"{n:012d}"), False)
        if len(numbers) > KEPT:
            for place in set().union(*named[:-KEPT]) - set().union(*named[-KEPT:]):
                self.files.delete(self.at(place), True)


def read(spark: SparkSession, path: str, parts: list[str] | None = None) -> DataFrame | None:
    """The newest whole state, or the named parts of it; None if there is no table."""
    folder = Folder(spark, path)
    _, manifest = folder.newest()
    if manifest is None:
        return None
    schema = T.StructType.fromJson(manifest["schema"])
    places = [p for name, p in sorted(manifest["parts"].items()) if parts is None or name in parts]
    return spark.read.schema(schema).parquet(*[f"{folder.path}/{p}" for p in places]) if places else spark.createDataFrame([], schema)


def commit(rows: DataFrame, path: str, part: str | None = None, base: int | None = None, keep: bool = True, sort_by: list[str] | None = None) -> int:
    """Write the rows as new files and make them the table's state at once; returns the version's number.

    With ``part``, a column of text, the parts that occur in the rows are replaced and, with ``keep``, the others stay; without it the whole
    table is replaced. ``base`` is the version the rows were made from: if another one was committed since, this fails.
    """
    folder = Folder(rows.sparkSession, path)
    number, manifest = folder.newest()
    if base is not None and base != number:
        raise Conflict(f"{path} went from version {base} to {number}")
    place = f"data/{uuid.uuid4().hex}"
    named = rows.withColumn(_PART, F.col(part).cast("string") if part else F.lit(WHOLE))
    named = gathered(named, _PART) if part else named
    named = named.sortWithinPartitions(*([_PART] if part else []), *(sort_by or [])) if part or sort_by else named
    named.write.option("compression", "zstd").partitionBy(_PART).parquet(f"{folder.path}/{place}")
    written = {n.split("=", 1)[1]: f"{place}/{n}" for n in folder.names(place) if n.startswith(f"{_PART}=")}
    parts = {**(manifest["parts"] if manifest and part and keep else {}), **written}
    folder.publish(number + 1, {"parts": parts, "schema": json.loads(rows.schema.json())})
    folder.tidy()
    return number + 1


def upsert(spark: SparkSession, path: str, arrived: DataFrame, keys: list[str], version: list[Column]) -> DataFrame:
    """Keyed upsert: arrived rows win, then the greatest version. The old state stays readable until the new one is whole."""
    number, _ = Folder(spark, path).newest()
    commit(merged(read(spark, path), arrived, keys, version), path, base=number, sort_by=keys)
    return read(spark, path)


def materialize_hours(spark: SparkSession, path: str, extracted: DataFrame, hours: DataFrame) -> None:
    """Replace the given hours inside their dates; other hours of those dates and other dates are kept.

    Only files of the dates concerned are written. Running it again with the same hours gives the same table.
    """
    number, manifest = Folder(spark, path).newest()
    new = extracted.join(hours.select("date", "hour_utc").distinct(), ["date", "hour_utc"], "left_semi")
    if manifest is not None:
        dates = [r["date"] for r in hours.select(F.col("date").cast("string").alias("date")).distinct().collect()]  # one value a date to build
        kept = read(spark, path, dates).join(hours, ["date", "hour_utc"], "left_anti")
        new = kept.unionByName(new)
    commit(new, path, part="date", base=number, sort_by=["hour_utc"])
