"""A session with the settings that these pipelines expect, and cutting the lineage of steps that must run once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tallyloom", **settings: str) -> SparkSession:
    """The running session, or a new one: UTC, adaptive plans, Arrow for Python steps. The master comes from spark-submit."""
    builder = SparkSession.builder.appName(app)
    for name, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): v for k, v in settings.items()},
    }.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where that is unset, one is made, if Spark runs on this machine alone."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def once(df: DataFrame) -> DataFrame:
    """df, checkpointed: a step that calls a service runs once, whatever reads it and whichever executors are lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(scan: DataFrame) -> DataFrame:
    """A table as it is read, for a step that takes long for each row: one of fewer partitions than there are cores is dealt to all of them."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
