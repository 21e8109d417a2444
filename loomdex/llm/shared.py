"""Shared folder, checkpoints and connected components for the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, as a whole URI. Where it is unset (tests in local mode) a folder of this machine is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomdex-"))
        root = jsc.getCheckpointDir().get()
    fs, path = _filesystem(spark, root)
    whole = fs.makeQualified(path).toString()
    return f"file://{whole[5:]}" if whole.startswith("file:/") and not whole.startswith("file://") else whole


def _filesystem(spark: SparkSession, folder: str) -> tuple:
    """Hadoop's file system of a folder, and its path: without a scheme it is the cluster's, as it is for Spark."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def remove(spark: SparkSession, folder: str) -> None:
    fs, path = _filesystem(spark, folder)
    fs.delete(path, True)


def shared_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df by checkpoint(): later reads come from the shared folder, so a lost executor costs nothing."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: more compact than cut(), and read by column."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: Bytes of an Arrow batch at most, unless a single row is longer.
BATCH_BYTES = 4 << 20


def bounded(spark: SparkSession) -> None:
    """Batches to Python workers of this session hold BATCH_BYTES at most from now on; a smaller setting stays. Texts vary
    by orders of magnitude, so a bound on rows alone says nothing about a worker's memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key).rstrip("b")
    if not (before.isdigit() and 0 < int(before) <= BATCH_BYTES):
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Free memory goes back to the system. Workers serve many tasks, and others share the executor with them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function of mapInPandas or of an iterator's pandas UDF, giving memory back at the end of its task."""

    def tidied(frames: Iterator) -> Iterator:
        try:
            yield from run(frames)
        finally:
            give_back()

    return tidied


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) that connect what edges a-b connect, root being the least node of each tree."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _forests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One forest per 200,000 edges or so: memory is bounded, and long chains shorten before the first shuffle."""
    held_a, held_b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for pdf in frames:
        a, b = np.concatenate([held_a, pdf["a"].to_numpy()]), np.concatenate([held_b, pdf["b"].to_numpy()])
        held_a, held_b = forest(a, b) if len(a) else (a, b)
        if len(held_a) > 200_000:
            yield pd.DataFrame({"a": held_a, "b": held_b})
            held_a, held_b = held_a[:0], held_b[:0]
    yield pd.DataFrame({"a": held_a, "b": held_b})


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a long, b long); component is the least node reachable.

    Alternates the large-star and small-star steps of distributed connected components; each round has two grouped
    minima, which combine before their shuffles, and joins whose large partitions AQE may split, so that one node with
    most of the edges meets no single task. Rounds grow with the logarithm of the longest path. Self-loops and null
    ends are ignored; no edges give no rows.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a != b")
    e = cut(e.mapInPandas(_forests, "a long, b long").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    before = None
    for _ in range(rounds):
        both = e.union(e.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = cut(small.where("a != b").distinct())
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b"), F.col("b")).distinct())


class arrow_rows:
    """While open, Arrow batches hold at most so many rows: for rows that are large themselves. Plans must run inside."""

    KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"

    def __init__(self, spark: SparkSession, rows: int):
        self.spark, self.rows = spark, rows

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(self.KEY)
        self.spark.conf.set(self.KEY, str(self.rows))

    def __exit__(self, *_: object) -> None:
        self.spark.conf.set(self.KEY, self.before)
