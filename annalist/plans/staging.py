"""Written intermediate tables, for loops whose lineage would grow."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names; it may be unset only where all of Spark is on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.conf.get("spark.master", "").split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(folder or '/tmp/annalist-checkpoints').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Write df in the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_folder(spark, "staged")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df as a join's side that is dealt to tasks, never sent through the driver. Files of sorted numbers are a tenth of their rows in
    memory, so Spark takes them for small, and a loop sends such a table to the driver and all executors once a round."""
    return df.hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to as many tasks as shuffles have, for work that costs more than reading: a scan has a task a row group, and a small file is one."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
