"""Kneser-Ney tables kept up to date by a stream of lines, as the state of two stateful processors.

The first holds the uses of every n-gram and tells which are new; a new n-gram of order k + 1 is one more character
before its end of order k, so the second one changes only counts and histories that a batch touches. Both hold
their state by parts, which hashes of n-grams and of histories pick; what they hold is read as tables by `tables_of`.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.text import text
from ..operators.charlm import BEGIN, END

GRAM, NUMBER = "k int, h string, c string", "n long"


def grams(lines: DataFrame, column: str, order: int, weight: int | Column = 1) -> DataFrame:
    """(k, h, c, w): every use of an n-gram of 1 to `order` characters, without a grouping, for streams and batches alike."""
    padded = F.concat(F.lit(BEGIN * (order - 1)), text(column), F.lit(END))
    ends = lines.select(padded.alias("s"), (F.lit(weight) if isinstance(weight, int) else weight).cast("long").alias("w"))
    ends = ends.select("s", "w", F.explode(F.sequence(F.lit(order), F.length("s"))).alias("i")).select("s", "w", "i", F.explode(F.sequence(F.lit(1), F.lit(order))).alias("k"))
    return ends.select("k", F.expr("substring(s, i - k + 1, k - 1)").alias("h"), F.expr("substring(s, i, 1)").alias("c"), "w")


class Uses(StatefulProcessor):
    """Holds how often each n-gram was used; passes on what changes in the tables of a model of `order`."""

    def __init__(self, order: int):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.uses = handle.getMapState("uses", GRAM, NUMBER)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        added = pd.concat([r.groupby(["k", "h", "c"], as_index=False).w.sum() for r in rows]).groupby(["k", "h", "c"], as_index=False).w.sum()
        changes = []
        for k, h, c, w in added.itertuples(index=False):
            gram = (int(k), h, c)
            before = self.uses.getValue(gram)
            self.uses.updateValue(gram, ((before[0] if before else 0) + int(w),))
            if k == self.order:
                changes.append((k, h, c, w))
            if not before and k > 1:
                changes.append((k - 1, h[1:], c, 1))
        yield pd.DataFrame(changes, columns=["k", "h", "c", "w"]).astype({"k": "int32", "w": "int64"})

    def close(self) -> None:
        pass


class Tables(StatefulProcessor):
    """Holds each n-gram's count and each history's sum and number of characters; passes on the counts that changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", GRAM, NUMBER)
        self.histories = handle.getMapState("histories", "k int, h string", "total long, types long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        added = pd.concat([r.groupby(["k", "h", "c"], as_index=False).w.sum() for r in rows]).groupby(["k", "h", "c"], as_index=False).w.sum()
        changed, sums = [], {}
        for k, h, c, w in added.itertuples(index=False):
            gram = (int(k), h, c)
            before = self.counts.getValue(gram)
            now = (before[0] if before else 0) + int(w)
            self.counts.updateValue(gram, (now,))
            total, types = sums.get(gram[:2], (0, 0))
            sums[gram[:2]] = total + int(w), types + (not before)
            changed.append((k, h, c, now))
        for history, (total, types) in sums.items():
            before = self.histories.getValue(history) or (0, 0)
            self.histories.updateValue(history, (before[0] + total, before[1] + types))
        yield pd.DataFrame(changed, columns=["k", "h", "c", "n"]).astype({"k": "int32", "n": "int64"})

    def close(self) -> None:
        pass


def maintain(stream: DataFrame, column: str, order: int, checkpoint: str, *, weight: int | Column = 1, parts: int = 64, available_now: bool = False) -> StreamingQuery:
    """Start a query that keeps the tables of a model of the streamed lines under `checkpoint`, where it also goes on after a stop.

    `weight` is a line's, as a number or a column: corrections weigh more than ordinary lines. `parts`
    bounds the keys of the state, not its size. It runs within rocksdb().
    """
    part = lambda *c: F.pmod(F.xxhash64(*c), F.lit(parts)).cast("int").alias("part")
    uses = grams(stream, column, order, weight).select(part("k", "h", "c"), "k", "h", "c", "w")
    changes = uses.groupBy("part").transformWithStateInPandas(Uses(order), f"{GRAM}, w long", "append", "none")
    changes = changes.select(part("k", "h"), "k", "h", "c", "w")
    counts = changes.groupBy("part").transformWithStateInPandas(Tables(), f"{GRAM}, n long", "append", "none")
    out = counts.writeStream.format("noop").outputMode("append").option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def tables_of(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(k, h, c, n, total, types) of the model that maintain() keeps, read from its state: equal to charlm.tables() over all lines so far."""

    def held(name: str) -> DataFrame:
        state = spark.read.format("statestore").option("path", checkpoint).option("operatorId", 0).option("stateVarName", name).load()
        return state.select("user_map_key.*", "user_map_value.*")

    return held("counts").join(held("histories"), ["k", "h"])


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Within it, the session's stateful queries keep their state in RocksDB, as processors with maps need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
