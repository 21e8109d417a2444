"""Sessions with the settings that the engine expects."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "loomdex", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps, adaptive execution and skew handling; conf overrides, dots written as __."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share, in spark.checkpoint.dir; one of this machine where that is unset, in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomdex-"))
        root = context.getCheckpointDir().get()
    return f"{root}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: later reads see the same rows, and nothing stays in executors' memory."""
    folder = workspace(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
