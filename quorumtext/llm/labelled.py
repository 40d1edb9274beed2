"""Bounded samples of labelled documents, and pooled additions of matrices, for the classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, sized

#: Partitions of a sample at most: every one of them gives a matrix to each sum, whatever the size of the corpus.
SAMPLE_PARTS = 48


def held_out(key: Column, modulus: int, rest: int) -> Column:
    """Whether the key, as text, has a CRC-32 with that remainder; a null key is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.encode(key.cast("string"), "UTF-8")), F.lit(modulus)) == rest, F.lit(False))


def drawn(share: Column | float, *columns: Column) -> Column:
    """Whether a row is among a share of all, by a 64-bit hash of the columns: shares of any size keep their meaning."""
    return F.xxhash64(*columns).cast("double") / 2.0**64 + 0.5 < share


def training_texts(docs: DataFrame, labels: DataFrame, label: str, modulus: int, rest: int, per_class: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, text, y) of about `per_class` documents of each label at most, none of them held out.

    Which are taken depends on their keys' hashes alone; they are put into SAMPLE_PARTS partitions
    at most, as their number does not grow with the corpus. Labels that are null or belong to no
    document are left out; a key with several labels has its largest, one with several texts the first in order.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key), modulus, rest))
    known = known.groupBy(F.col(key).cast("long").alias("doc")).agg((F.max(label) > 0).cast("int").alias("y"))
    share = {r["y"]: min(1.0, per_class / r["n"]) for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    taken = known.where(drawn(F.when(F.col("y") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)), F.lit("draw"), F.col("doc")))
    own = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return cut(own.join(sized(taken.select("doc", "y"), 16), "doc").groupBy("doc").agg(F.min("text").alias("text"), F.min("y").alias("y"))).coalesce(SAMPLE_PARTS)


def summed(df: DataFrame, matrix, shape: tuple[int, ...], pools: int = 16) -> np.ndarray:
    """The sum of matrix(frame) over all of df. Partitions add up their own, `pools` tasks theirs by partition number, one adds `pools` at most; the driver gets one matrix.

    With `pools` 0, for frames of a fixed few partitions, the driver adds up the partitions' matrices itself.
    """

    def own(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape)
        for frame in frames:
            if len(frame):
                total += matrix(frame)
        yield pd.DataFrame({"pool": [TaskContext.get().partitionId() % max(pools, 1)], "sum": [total.tobytes()]})

    def pooled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape)
        for frame in frames:
            for row in frame["sum"]:
                total += np.frombuffer(row).reshape(shape)
        yield pd.DataFrame({"pool": [0], "sum": [total.tobytes()]})

    schema = "pool int, sum binary"
    parts = df.mapInPandas(own, schema)
    if not pools:
        return sum((np.frombuffer(bytes(r["sum"])).reshape(shape) for r in parts.collect()), np.zeros(shape))
    parts = parts.repartition(pools, "pool").mapInPandas(pooled, schema)
    whole = parts.repartition(1).mapInPandas(pooled, schema).first()
    return np.frombuffer(bytes(whole["sum"])).reshape(shape) if whole else np.zeros(shape)  # no partition, no row
