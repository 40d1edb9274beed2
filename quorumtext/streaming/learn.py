"""Learning from a stream of corrected lines: n-gram uses are added batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import charlm


def deltas(lines: DataFrame, column: str, order: int, weight: int = 3) -> DataFrame:
    """Uses of a batch of corrections; each weighs as much as `weight` ordinary lines."""
    return charlm.uses(lines, column, order, weight)


def learn(stream: DataFrame, column: str, order: int, store: str, checkpoint: str, weight: int = 3) -> StreamingQuery:
    """Start a query that writes each batch's uses under `store` as batch=N.

    A batch that is run again after a failure replaces its own folder, so every correction counts once.
    state() adds the batches up.
    """

    def add(batch: DataFrame, number: int) -> None:
        deltas(batch, column, order, weight).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()


def state(base: DataFrame, store: str) -> DataFrame:
    """Uses of the base and of all batches that a query has stored."""
    more = base.sparkSession.read.parquet(store).select("k", "h", "c", "n")
    return charlm.add_lines(base, more)
