"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def get_spark(app_name: str = "fleetlens", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution on; cluster settings win over these defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    defaults.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in defaults.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def importable(spark: SparkSession) -> SparkSession:
    """Python workers find this package where the driver did, unless the cluster ships it otherwise."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, paths) if x)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the session names; in local runs without one, a scratch folder."""
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp" if os.path.isdir("/tmp") else None)
        spark.conf.set(CHECKPOINT_CONF, folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the reliable, shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as Parquet in a new path of the shared folder, read again: they are computed once, and lost executors cost no more than a read."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Parquet bytes up to which a written side is broadcast; a few times as much in memory.
BROADCAST_BYTES = 16 << 20


def file_bytes(df: DataFrame) -> int:
    """Bytes of the files that a frame reads."""
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    total = 0
    for file in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(file)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return total


def sized(df: DataFrame, limit: int | None = None) -> DataFrame:
    """A frame read from files, marked for broadcast if the files are small enough; beyond that its joins shuffle."""
    return F.broadcast(df) if file_bytes(df) <= (BROADCAST_BYTES if limit is None else limit) else df


#: Input bytes that a shuffle partition stands for, and the shuffled bytes up to which adaptive execution puts partitions together. Rows are wide and
#: compress well, so 64 MB of them, Spark's own value, do not fit the sorts of one task.
PARTITION_INPUT, PARTITION_SHUFFLED = 1 << 20, "8MB"


def proportioned(df: DataFrame) -> DataFrame:
    """A frame read from files; shuffles of this session get partitions in proportion to the largest of them, so that a task's share does not grow with the input.

    Small inputs change nothing, and neither do sessions that set these values themselves.
    """
    spark = df.sparkSession
    conf, number = spark.conf, "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    wanted = file_bytes(df) // PARTITION_INPUT
    if wanted > int(conf.get(number, None) or conf.get("spark.sql.shuffle.partitions")):
        conf.set(number, str(wanted))
    advised = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if wanted and conf.get(advised) in ("64MB", "67108864", "67108864b"):
        conf.set(advised, PARTITION_SHUFFLED)
    return df


_STORED: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Build a dataset once per application, as Parquet in the shared folder, then read it.

    Later jobs scan only the columns they need instead of repeating the build.
    """
    app = spark.sparkContext.applicationId
    path = _STORED.get((app, key))
    if path is None:
        name = re.sub(r"[^A-Za-z0-9_.-]", "_", key)
        path = f"{shared_folder(spark)}/stored-{app}/{name}"
        build().write.mode("overwrite").parquet(path)
        _STORED[(app, key)] = path
    return spark.read.parquet(path)
