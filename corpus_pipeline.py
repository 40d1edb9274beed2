"""The corpus pipeline: documents without toxic, poor, copied and benchmark texts, encoded.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is
written before the next one reads it. All but the last return the columns of documents. Rows with
a null id are judged like others by their text; they are never near-duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumtext.llm import bpe, decontaminate, minhash, quality, toxicity
from quorumtext.llm.common import cut, short_batches, sized, table
from quorumtext.llm.queries import tokenizer

#: Documents go from this toxicity on, and below this quality.
TOXIC, GOOD = 0.7, 0.5
#: Words of a shingle and hundredths of similarity that make near-duplicates; words of a benchmark window.
SHINGLE, SIMILAR, WINDOW = 5, 80, 10


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.withColumn("__score", toxicity.score(docs.text, model)).where(F.col("__score") < TOXIC).drop("__score")


def without_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least GOOD."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.withColumn("__score", quality.score(docs.text, model)).where(F.col("__score") >= GOOD).drop("__score")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest id; of repeated rows one.

    Rows that share an id and not a text are documents of their own. Rows with a null id stay.
    """
    short_batches(spark)
    found = cut(minhash.near_duplicates(docs, size=SHINGLE, threshold=SIMILAR).withColumnRenamed("text_hash", "__text_hash"))
    own = ["doc_id", "__text_hash"]
    gone = found.where(~F.col("kept")).select(*own).distinct()
    again = cut(found.where("kept and doc_id is not null").groupBy(*own).count().where("count > 1").select(*own))
    rest = docs.withColumn("__text_hash", minhash.text_hash(F.col("text"))).join(sized(gone, 24), own, "left_anti")
    if not again.isEmpty():
        repeated = rest.join(sized(again, 24), own, "left_semi").dropDuplicates(own)
        rest = rest.join(sized(again, 24), own, "left_anti").unionByName(repeated)
    return rest.select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item."""
    items = decontaminate.tokens(table(spark, sf_dir, "benchmark"), "item_id", "text")
    hits = decontaminate.phrase_hits(decontaminate.tokens(docs, "doc_id", "text"), items.select(F.struct("id", "mark").alias("id"), "words").dropDuplicates(["id"]), WINDOW)
    gone = cut(hits.select(F.col("id").alias("__id"), F.col("mark").alias("__mark")).distinct())
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__mark"))
    return docs.join(sized(gone, 24), same, "left_anti")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip): the ids of every text, and whether they decode to it."""
    short_batches(spark)
    out = bpe.encode(docs, tokenizer("byte_bpe_50k.json"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("toxicity", without_toxic),
    ("quality classifier", without_poor),
    ("MinHash near-dedup", without_copies),
    ("benchmark decontamination", without_benchmark),
    ("BPE encoding and decoding", encoded),
]
#: SQL can express neither the classifiers nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is kept in the shared checkpoint folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
