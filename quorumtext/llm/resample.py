"""Importance resampling towards a target distribution of hashed n-grams, by drawing the highest perturbed weights.

Long texts are split at word boundaries into chunks that carry the next n - 1 words and own the words
that start in them; counts and weights of chunks are summed by document.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import numbered
from .common import cut

#: Bytes outside words become spaces, A-Z their lower case.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
#: Texts of more bytes than this are split into chunks of about this size.
CHUNK = 1 << 16
RUN = re.compile(rb"[^ ]+")
COUNTS = "doc string, mark long, chunk int, copies long, n_words long, n_features long, buckets array<int>, counts array<int>"


def chunks(data: bytes, size: int, n: int) -> Iterator[tuple[bytes, int]]:
    """(words, how many of them the chunk owns): a text of spaces and words split where a word ends, each chunk with n - 1 words of the next."""
    start = 0
    while start < len(data):
        end = data.find(b" ", min(start + size, len(data)))
        end = len(data) if end < 0 else end
        own, past = len(data[start:end].split()), end
        for _ in range(n - 1):
            if not (word := RUN.search(data, past)):
                break
            past = word.end()
        if own:
            yield data[start:past], own
        start = end


def features(words: list[bytes], own: int, n: int, buckets: int) -> np.ndarray:
    """Buckets of all runs of 1 to n words that start at one of the first `own` words."""
    runs = [np.fromiter(map(zlib.crc32, words[:own]), np.int64, own)]
    for m in range(2, n + 1):
        count = min(own, len(words) - m + 1)
        runs.append(np.fromiter((zlib.crc32(b" ".join(words[i : i + m])) for i in range(count)), np.int64, max(count, 0)))
    return np.concatenate(runs) % buckets


def _row_of(words: list[bytes], own: int, n: int, buckets: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    found = features(words, own, n, buckets)
    values, counts = np.unique(found, return_counts=True)
    return own, len(found), values, counts


def _batch(keys: list[pa.Array], rows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(v) for _, _, v, _ in rows])])
    lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([r[i] for r in rows]) if rows else [], pa.int32())) for i in (2, 3)]
    return pa.RecordBatch.from_arrays([*keys, pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), *lists], [c.split()[0] for c in COUNTS.split(", ")])


def bucket_counts(df: DataFrame, n: int, buckets: int, *, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Features of every chunk as (doc, mark, chunk, copies, n_words, n_features, buckets, counts).

    `copies` is how many equal rows a row stands for: 1 for texts of one chunk, which are counted
    where they lie. Chunks of longer texts are dealt to all tasks, and rows that repeat a key and
    a text count once with their number.
    """
    docs = df.select(F.col(key).cast("string").alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("bytes"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = [data.as_py().translate(BYTES).split() for data in b.column(1)]
            one = pa.array(np.ones(len(split)), pa.int64())
            yield _batch([b.column(0), pa.nulls(len(split), pa.int64()), pa.array(np.zeros(len(split)), pa.int32()), one], [_row_of(w, len(w), n, buckets) for w in split])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, data, mark in zip(*b.columns, strict=True):
                for i, (piece, own) in enumerate(chunks(data.as_py().translate(BYTES), chunk, n)):
                    yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()], pa.string()), pa.array([mark.as_py()], pa.int64()), pa.array([i], pa.int32()), pa.array([own], pa.int64()), pa.array([piece], pa.binary())], ["doc", "mark", "chunk", "own", "piece"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_row_of(piece.as_py().split(), own.as_py(), n, buckets) for own, piece in zip(b.column(3), b.column(4), strict=True)]
            yield _batch([b.column(0), b.column(1), b.column(2), pa.array(np.ones(len(rows)), pa.int64())], rows)

    short = docs.where(F.length("bytes") <= chunk).mapInArrow(whole, COUNTS)
    pieces = docs.where(F.length("bytes") > chunk).withColumn("mark", F.xxhash64("bytes")).mapInArrow(cut_up, "doc string, mark long, chunk int, own long, piece binary")
    long = pieces.repartition("mark", "chunk").mapInArrow(counted, COUNTS)
    same = ["n_words", "n_features", "buckets", "counts"]
    long = long.groupBy("doc", "mark", "chunk").agg(F.sum("copies").alias("copies"), *[F.first(c).alias(c) for c in same])
    return short.unionByName(long)


def _totals(counts: DataFrame) -> dict[int, int]:
    """How many features each bucket has: at most one row a bucket comes to the driver."""
    each = counts.select("copies", F.explode(F.arrays_zip("buckets", "counts")).alias("f"))
    return {r["b"]: r["n"] for r in each.groupBy(F.col("f.buckets").alias("b")).agg(F.sum(F.col("f.counts") * F.col("copies")).alias("n")).collect()}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket, S and T being the totals."""
    s, t = sum(corpus.values()), sum(target.values())
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1) * (s + buckets) / ((corpus.get(b, 0) + 1) * (t + buckets)))) for b in range(buckets)], np.int64)


def noise(key: Column, seed: str) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of the SHA-256 of `seed:key`."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    df: DataFrame, target: DataFrame, *, n: int = 1, buckets: int = 10000, percent: int = 10, least_words: int = 20, seed: str = "2024", key: str = "doc_id", text: str = "text", target_text: str = "text", target_key: str | None = None, chunk: int = CHUNK
) -> DataFrame:
    """(key, n_features, weight, score, rank): the weight of every row of df and the rank of those drawn.

    Words are runs of letters and digits of ASCII, in lower case, and of all other characters beyond
    it. The weight is the floored mean of the gains of a row's features (none: 0). Of the N rows with
    at least `least_words` words, floor(percent N / 100) with the highest scores are drawn, ties to the
    smaller key, a null key last and hashed as empty text. A null text has no words. Repeated rows are
    rows of their own with equal scores. Without a target all its counts are 0; an empty df gives no rows. Other columns are ignored.
    """
    kind = df.schema[key].dataType.simpleString()
    counts = cut(bucket_counts(df, n, buckets, key=key, text=text, chunk=chunk))
    wanted = cut(bucket_counts(target, n, buckets, key=target_key or target.columns[0], text=target_text, chunk=chunk))
    gain = gains(_totals(counts), _totals(wanted), buckets)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(6).value_lengths().to_numpy()
            parts = gain[b.column(6).flatten().to_numpy()] * b.column(7).flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(parts)])
            last = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(ends[last] - ends[last - sizes], pa.int64())], [*b.schema.names[:6], "gain"])

    rows = counts.mapInArrow(weighed, "doc string, mark long, chunk int, copies long, n_words long, n_features long, gain long")
    split = rows.where("mark is not null").groupBy("doc", "mark").agg(F.max("copies").alias("copies"), *[F.sum(c).alias(c) for c in ("n_words", "n_features", "gain")])
    split = split.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    columns = ["doc", "n_words", "n_features", "gain"]
    docs = rows.where("mark is null").select(*columns).unionByName(split.select(*columns)).withColumn(key, F.col("doc").cast(kind))
    weight = F.expr("coalesce((gain - pmod(gain, nullif(n_features, 0))) div nullif(n_features, 0), 0)")
    docs = cut(docs.select(key, "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + noise(F.col(key), seed)))
    enough = docs.where(F.col("n_words") >= least_words)
    draws = percent * enough.count() // 100
    ranked = numbered(enough, F.col("score").desc(), F.col(key).asc_nulls_last()).withColumn("rank", F.when(F.col("index") < draws, F.col("index") + 1))
    out = ranked.drop("index").unionByName(docs.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select(key, "n_features", "weight", "score", "rank")
