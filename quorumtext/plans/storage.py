"""Checkpoints in the cluster's shared folder, sized broadcasts and global row numbers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Largest side that is broadcast, in estimated bytes.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scanned table dealt to all cores if it has fewer partitions than there are; larger inputs stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cut(df: DataFrame) -> DataFrame:
    """Write df to spark.checkpoint.dir and read it from there; a folder of its own only where that is unset on one machine."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """Write df to a compressed table in the shared folder and read it from there, for rows that are wide: cut() writes them uncompressed."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    """How many parts rows are dealt to for work that takes far longer than their few bytes would tell adaptive execution."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, set for this session; a temporary one where it is unset and Spark runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def summed(df: DataFrame, matrix: Callable[[pd.DataFrame], np.ndarray], shape: tuple[int, ...], pools: int = 16, batches: bool = False) -> np.ndarray:
    """The sum of matrix(frame) over all of df: each partition sends one matrix to one of `pools` tasks by its number, these send one each.

    With `batches`, matrix() takes Arrow batches, whose arrays need not be made objects first.
    """

    def total(parts: Iterator, of: Callable) -> bytes:
        out = np.zeros(shape)
        for part in parts:
            if len(part):
                out += of(part)
        return out.tobytes()

    def frames(parts: Iterator[pd.DataFrame], of: Callable) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"pool": [TaskContext.get().partitionId() % pools], "sum": [total(parts, of)]})

    def arrays(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % pools], pa.int32()), pa.array([total(parts, matrix)], pa.binary())], ["pool", "sum"])

    def read(frame: pd.DataFrame) -> np.ndarray:
        return np.sum([np.frombuffer(b).reshape(shape) for b in frame["sum"]], 0)

    schema = "pool int, sum binary"
    parts = df.mapInArrow(arrays, schema) if batches else df.mapInPandas(lambda own: frames(own, matrix), schema)
    if df.rdd.getNumPartitions() > pools:
        parts = parts.repartition(pools, "pool").mapInPandas(lambda own: frames(own, read), schema)
    return np.sum([np.zeros(shape), *(np.frombuffer(bytes(r["sum"])).reshape(shape) for r in parts.collect())], 0)  # `pools` rows at most


def sized(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows fit in `limit` bytes, else df, which joins by shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def numbered(df: DataFrame, *order: str | Column, name: str = "index") -> DataFrame:
    """df with a gapless 0-based row number in the given order.

    Rows are dealt by range and numbered within ranges; the ranges' sizes, one number each, give the
    offsets. No task holds more than its range.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    sizes = sorted((r["__part"], r["count"]) for r in dealt.groupBy("__part").count().collect())
    offsets, total = [], 0
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    where = spark.createDataFrame(offsets, "__part int, __offset long")
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return dealt.join(F.broadcast(where), "__part").withColumn(name, (rank + F.col("__offset")).cast("long")).drop("__part", "__offset")
