"""Session helpers: defaults for tests and the folder for checkpoints."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Session for tests and the benchmark; on a cluster pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fairline")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Instants are compared in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


#: Most bytes of a table file that one task of a view reads.
SPLIT = 8 << 20


def _bytes(text: str) -> int:
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", text.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def small_splits(spark: SparkSession) -> SparkSession:
    """Tables are read at most ``SPLIT`` bytes a task.

    Views unfold what they read, by compression, an explode or a union, tenfold and more, and the sums made before a shuffle hold
    nearly all of it: the memory of a task follows its part of the file, so this part must not grow with the table."""
    if _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes", "128m")) > SPLIT:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(SPLIT))
    return spark


#: Most bytes that a table may be estimated at to be broadcast unseen.
SMALL = 256 << 10


def measured_broadcasts(spark: SparkSession) -> SparkSession:
    """Tables above ``SMALL`` are broadcast only once their size has been measured.

    Estimates before a run know neither the rows that an explode makes nor what compressed columns unfold to, so a table of
    line-ups passed as small and was built in the driver. The limit in force moves to AQE, which sees the written sizes."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10m")
    if _bytes(limit) > SMALL:
        if spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
            spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", limit)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(SMALL))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_checkpoint_dir(spark: SparkSession) -> str:
    """Folder shared by the executors, from ``spark.checkpoint.dir``.

    A private one is made only in local mode, where driver and executors are one process; on a cluster an unset folder is
    an error, as each executor would write to a disk of its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="fairline-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def staging_dir(spark: SparkSession, name: str) -> str:
    """New folder below the shared checkpoint directory for a staged table."""
    return f"{shared_checkpoint_dir(spark).rstrip('/')}/staged/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Cuts the lineage where several later steps start from the same rows: the plans built on top
    stay small, the rows are computed once, and losing an executor loses nothing."""
    path = staging_dir(df.sparkSession, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lie_together(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of one value of ``keys`` lie in one partition, moved once however many steps start from them.

    Steps that group or join by the keys and more then meet in place (``requireAllClusterKeysForCoPartition`` false). Every step would narrow the
    move to the columns it reads, making it another one; a condition that is always true but reads all columns keeps it the same for all."""
    df.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    # not deterministic, so it is neither moved below the exchange nor taken for true: the number drawn is 0
    return df.repartition(*keys).filter(F.xxhash64(*df.columns).bitwiseXOR(F.rand(0).cast("bigint")) >= F.lit(-(1 << 63)))
