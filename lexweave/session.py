"""Session settings and durable intermediate results."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lexweave")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        # Small tables cost CPU by row, not by byte: their shuffles keep all cores busy.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LEXWEAVE_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; only in local mode (tests) a temporary one stands in for it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context = spark.sparkContext
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="lexweave-")
    return _local_folders[context.applicationId]


_local_folders: dict[str, str] = {}


def durable(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, so that a lost executor doesn't repeat its lineage."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(_folder(spark))
    return df.checkpoint(eager=True)


def table_folder(spark: SparkSession) -> str:
    """A new place in the shared folder."""
    return f"{_folder(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"


def durable_table(df: DataFrame) -> DataFrame:
    """As durable, as a Parquet table: for wide rows that are read again in part, column by column."""
    spark = df.sparkSession
    path = table_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as the session has cores; only an input of few files is shuffled for that."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def gathered(df: DataFrame, *keys: str) -> DataFrame:
    """df with the rows of equal keys in one task.

    That goes by a hash of its own: a repartition by the keys themselves is left out where a join has just brought them
    together, and the join may then be replaced at run time by one that doesn't.
    """
    return df.repartition(F.xxhash64(*keys))


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives the executors this package, once a session; needless where it is installed there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="lexweave-")) / "lexweave.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, Path(root.name) / path.relative_to(root))
    context.addPyFile(str(target))


def ship(spark: SparkSession, value):
    """A broadcast variable for Python workers; the callers state the bound of its size."""
    return spark.sparkContext.broadcast(value)
