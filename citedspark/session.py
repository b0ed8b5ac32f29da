"""Session helpers: the shared folder for staged data, and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session may fall back to a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get(CHECKPOINT_SETTING) or spark.conf.get(CHECKPOINT_SETTING, None)
        if named is None and not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_SETTING} to a shared folder before running on a cluster")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="citedspark-"))
    # Spark's own answer names the file system, also where the setting leaves it to the default one.
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Write the rows once, so every later reader sees the same ones.

    Used where a plan has two branches over a placement that is only fixed by sampling.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, partition: tuple[str, ...] = ()) -> DataFrame:
    """Write the rows as Parquet below the shared folder and read them again.

    Later readers take the columns and the partitions they need, and see the same rows.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*partition).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def tasks(df: DataFrame) -> int:
    """How many tasks a costly step is dealt to: the session's shuffle partitions.

    Given as a number, they are not merged by size, where a row costs more than its bytes.
    """
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
