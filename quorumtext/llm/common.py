"""Helpers that several operators share: word splitting, checkpoints, sized joins, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Largest side, in bytes by its counted rows or their summed sizes, that is broadcast; beyond it a shuffle join runs.
BROADCAST_BYTES = 64 << 20


#: Rows of an Arrow batch at most: the JVM and a worker hold a batch of whole texts at once, some of them very long.
BATCH_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Let this session send texts to Python workers in batches of BATCH_ROWS."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts, to be sent in short batches."""
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there, so lost executors cost no recomputation.

    The folder is the one the cluster names in spark.checkpoint.dir; only where that is unset and
    Spark runs on one machine (tests) a temporary folder is used, elsewhere that is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Like cut(), as a compressed table: for rows that are many and short."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        cut(df.limit(0))
    path = f"{sc.getCheckpointDir()}/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column, breaks: str) -> Column:
    """Words between runs of the character class `breaks`; null text gives an empty array."""
    return F.coalesce(F.array_remove(F.split(text, f"[{breaks}]+"), ""), F.array().cast("array<string>"))


def fits(df: DataFrame, row_bytes: int | Column, limit: int = BROADCAST_BYTES) -> bool:
    """Whether df is small enough for a broadcast: counted rows of fixed size, or the summed sizes that a column gives."""
    size = df.count() * row_bytes if isinstance(row_bytes, int) else df.agg(F.sum(row_bytes)).first()[0] or 0
    return size <= limit


def sized(df: DataFrame, row_bytes: int | Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it fits, else df, which joins by shuffle."""
    return F.broadcast(df) if fits(df, row_bytes, limit) else df


#: Parts that any group is split into where its rows get their group's aggregates.
SALTS = 60


def salt(*columns: str) -> Column:
    return F.pmod(F.hash(*columns), F.lit(SALTS))


def salts_held() -> Column:
    """Aggregate: the set of a group's salts (a column `__salt`) as the bits of one number."""
    return F.bit_or(F.expr("shiftleft(1L, __salt)"))


def salts_of(bits: str) -> Column:
    """Array of the salts in a number made by salts_held()."""
    return F.expr(f"filter(sequence(0, {SALTS - 1}), i -> (shiftright({bits}, i) & 1L) = 1L)")


def with_group(df: DataFrame, keys: list[str], spread: list[str], aggregates: dict[str, tuple[str, str]], where: str = "true") -> DataFrame:
    """df with aggregates of each row's group, for groups of any size: rows of groups that fail `where` are left out.

    Rows are dealt to SALTS parts of their group by a hash of `spread`. A part is aggregated by itself
    (first SQL expression of a name), a group from its parts (second one), and rows meet their
    group's aggregates part by part, so that no task has a whole group's rows.
    """
    own = df.withColumn("__salt", salt(*spread))
    parts = own.groupBy(*keys, "__salt").agg(*[F.expr(part).alias(name) for name, (part, _) in aggregates.items()])
    whole = parts.groupBy(*keys).agg(*[F.expr(total).alias(name) for name, (_, total) in aggregates.items()], salts_held().alias("__salts")).where(where)
    return own.join(whole.withColumn("__salt", F.explode(salts_of("__salts"))).drop("__salts"), [*keys, "__salt"]).drop("__salt")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b) as (node, component), component being the smallest node reachable.

    Alternates large-star and small-star contractions with partial aggregates; each round is
    checkpointed. Rounds grow with the logarithm of the longest chain. Nodes without edges are absent.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def hang(e: DataFrame, larger: bool) -> DataFrame:
        both = e.union(e.select("b", "a")) if larger else e
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("m"))
        moved = both.join(low, both.a == low.x)
        if larger:
            return moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("x", "m").toDF("a", "b")).where("a <> b").distinct()

    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = state(now)
    while True:
        big = hang(now, True).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        now = cut(hang(big, False).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        then, seen = seen, state(now)
        if then == seen:
            break
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.union(now.select("b", "b")).distinct()
