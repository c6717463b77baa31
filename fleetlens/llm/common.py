"""Small helpers shared by the text operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.session import shared_folder

#: Rows up to which a side may be broadcast; beyond it the same join shuffles.
BROADCAST_ROWS = 500_000


def importable(spark: SparkSession) -> SparkSession:
    """Python workers find this package where the driver did, unless the cluster ships it otherwise."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, paths) if x)
    return spark


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names starting with the given ones that the frame does not have yet."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder as Parquet and read again: lineage ends here and survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_or_shuffled(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame, marked for broadcast if a count proves that it is small; call it on stored frames."""
    return F.broadcast(df) if df.count() <= rows else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable over the links (a, b).

    Alternates two star contractions: every node sends its larger neighbours to its smallest neighbour, then every node links its
    smaller neighbours to the smallest. Each round is a group-by on nodes whose messages are single ids, so no neighbour list is
    gathered; it ends when no edge changes. Self links and nulls are ignored; an empty input gives no rows.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    mark = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = stored(large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
                       .select("e.*").filter("a > b").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
        mark = now
    raise RuntimeError("components did not settle")


def rows_of(batches: Iterable, *columns: str):
    """Rows of pandas batches as tuples of the named columns."""
    for pdf in batches:
        yield from zip(*(pdf[c] for c in columns), strict=True)
