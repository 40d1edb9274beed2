"""Scans along sequences of any length: rows are dealt by ranges, scanned within them, and what earlier ranges leave is carried over.

A sequence may be one key with all rows. A range's own scan is a window over (range, group); its summary is one
row for each group that it holds, and a window over these rows gives what each range starts with.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import cut

PART = "__part"


def dealt(df: DataFrame, group: str, position: str) -> DataFrame:
    """df with PART, the number of the range of (group, position) that a row is in."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(parts, group, position).withColumn(PART, F.spark_partition_id()))


def local(group: str, position: str) -> Window:
    """The window of a range's rows of one group."""
    return Window.partitionBy(PART, group).orderBy(position)


def carried(rows: DataFrame, group: str, name: str, summary: Column, combined: Callable[[Column], Column]) -> DataFrame:
    """rows with `name`: the `combined` summaries of all earlier ranges of their group, null in the first one."""
    before = Window.partitionBy(group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    each = rows.groupBy(group, PART).agg(summary.alias("__s")).select(F.col(group).alias("__g"), F.col(PART).alias("__p"), combined(F.col("__s")).over(before).alias(name))
    return rows.join(each, rows[group].eqNullSafe(F.col("__g")) & (rows[PART] == F.col("__p"))).drop("__g", "__p")


def _last(column: Column) -> Column:
    return F.last(column, ignorenulls=True)


def counted(rows: DataFrame, group: str, position: str, name: str = "row") -> DataFrame:
    """rows with their numbers in their group, from 1."""
    own = carried(rows, group, "__before", F.count("*"), F.sum)
    return own.withColumn(name, F.row_number().over(local(group, position)) + F.coalesce("__before", F.lit(0))).drop("__before")


def runs(df: DataFrame, group: str, position: str, mask: Column) -> DataFrame:
    """(group, start, end) of maximal true runs over gapless positions, end exclusive."""
    marked = counted(dealt(df.select(group, position, mask.alias("__m")).where("__m"), group, position), group, position, "__n")
    return marked.withColumn("__i", F.col(position) - F.col("__n")).groupBy(group, "__i").agg(F.min(position).alias("start"), (F.max(position) + 1).alias("end")).drop("__i")


def symbol_runs(frames: DataFrame, sequence: str, time: str, *, symbol: str = "symbol", conf: str = "conf", blank: int = 0) -> DataFrame:
    """(sequence, run, symbol, conf) of runs of equal symbols other than the blank, in order of `run`, each with its largest confidence."""
    rows = dealt(frames.select(sequence, time, symbol, conf), sequence, time)
    order = local(sequence, time)
    # A null symbol is a symbol like any other, so it is carried within a struct.
    rows = carried(rows.withColumn("__s", F.struct(F.col(symbol).alias("s"))), sequence, "__left", F.max_by("__s", time), _last)
    previous = F.coalesce(F.lag("__s").over(order), F.col("__left"))
    rows = rows.withColumn("__new", (previous.isNull() | ~previous["s"].eqNullSafe(F.col(symbol))).cast("long"))
    rows = carried(rows, sequence, "__runs", F.sum("__new"), F.sum).withColumn("run", F.sum("__new").over(order) + F.coalesce("__runs", F.lit(0)))
    return rows.where(F.col(symbol) != blank).groupBy(sequence, "run", symbol).agg(F.max(conf).alias(conf))


def smoothed(df: DataFrame, value: str, group: str, position: str, k: int, name: str = "smooth", block: int = 1 << 16) -> DataFrame:
    """df with the mean of k places around each, places beyond the ends counting as 0; of an even k the longer half stands before.

    Rows are numbered and put into blocks, which get the rows beside them that their means need too.
    """
    left, right, size = k // 2, (k - 1) // 2, max(block, k)
    rows = counted(dealt(df, group, position), group, position, "__n").withColumns({"__own": F.expr(f"(__n - 1) div {size}"), "__at": F.expr(f"(__n - 1) % {size}")})
    near = F.expr(f"filter(array(__own, if(__at < {right}, __own - 1, null), if(__at >= {size - left}, __own + 1, null)), b -> b >= 0)")
    blocks = rows.withColumn("__block", F.explode(near))
    w = Window.partitionBy(group, "__block").orderBy("__n").rowsBetween(-left, right)
    return blocks.withColumn(name, F.sum(value).over(w) / k).where("__block = __own").select(*df.columns, name)


def best_so_far(df: DataFrame, run: str, step: str, value: str, patience: int) -> DataFrame:
    """df with `best` (the smallest value up to a step), `improved`, `misses` (steps since the last improvement) and `stopped`: whether training that waits `patience` steps had ended before."""
    order = local(run, step)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = counted(dealt(df, run, step), run, step, "__n")
    rows = carried(rows, run, "__least", F.min(value), F.min)
    rows = rows.withColumn("__before", F.least(F.min(value).over(before), F.col("__least")))
    rows = rows.withColumns({"best": F.least(F.col("__before"), F.col(value)), "improved": F.coalesce(F.col(value) < F.col("__before"), F.col(value).isNotNull())})
    rows = rows.withColumn("__mark", F.when(F.col("improved"), F.col("__n")).when(F.col("__n") == 1, F.lit(1)))
    rows = carried(rows, run, "__marked", F.max("__mark"), F.max)
    rows = rows.withColumn("misses", (F.col("__n") - F.greatest(F.max("__mark").over(order), F.col("__marked"))).cast("int"))
    rows = carried(rows, run, "__most", F.max("misses"), F.max)
    stopped = F.coalesce(F.greatest(F.max("misses").over(before), F.col("__most")) >= patience, F.lit(False))
    return rows.withColumn("stopped", stopped).select(*df.columns, "best", "improved", "misses", "stopped")
