"""Repeated passages: winnowed anchors are seeds, matches are extended to both sides, maximal repeats are kept.

Any `size` consecutive words hold size - seed + 1 runs of `seed` words; the one with the least hash is
their anchor. Equal windows have equal anchors, so documents meet on anchors alone, in one shuffle. Of the
occurrences of an anchor that agree in all words that a window around it can reach, all but the first are
extended at once to the full reach; where an anchor has several such surroundings, each one's first
occurrence is extended by single windows. Extended matches that overlap make up maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import numbered
from .common import cut, fits, sized, written

#: Words of a seed.
SEED = 8
#: Windows that are worked on at once, in a text of any length.
STEP = 1 << 18
#: Bytes of a text whose words are taken at once.
PIECE = 1 << 22
#: Odd multipliers of rolling hashes.
ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
BROADCAST = 16 << 20
WHITE = b" \t\n\x0b\x0c\r"


def pieces(data: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, some at a time: runs of bytes other than ASCII white space."""
    start = 0
    while start < len(data):
        end = min(start + size, len(data))
        while end < len(data) and data[end] not in WHITE:
            end += 1
        yield data[start:end].split()
        start = end


def hashed(data: bytes) -> np.ndarray:
    """A 64-bit number for each word, never 0."""
    found = [np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) for words in pieces(data)]
    return np.concatenate(found) | np.uint64(1) if found else np.zeros(0, np.uint64)


def rolled(words: np.ndarray, at: np.ndarray | slice, n: int, odd: np.uint64, start: int = 0) -> np.ndarray:
    """A hash of the n words from each place `at`, shifted by `start`."""
    if isinstance(at, slice):
        out = np.zeros(at.stop - at.start, np.uint64)
        for j in range(start, start + n):
            out = out * odd + words[at.start + j : at.stop + j]
    else:
        out = np.zeros(len(at), np.uint64)
        for j in range(start, start + n):
            out = out * odd + words[at + j]
    out ^= out >> np.uint64(29)
    return out * ODD[2] ^ (out >> np.uint64(32))


class Batch:
    """The words of some texts one after another, with zeros between them as far as a window reaches."""

    def __init__(self, texts: list[bytes], size: int, seed: int):
        self.size, self.seed, self.reach = size, seed, size - seed
        gap, own, first, n = np.zeros(self.reach, np.uint64), [], [], self.reach
        own.append(gap)
        for data in texts:
            words = hashed(data)
            own += [words, gap]
            first.append(n)
            n += len(words) + self.reach
        self.words, self.first = np.concatenate(own), np.array(first, np.int64)
        self.sizes = np.array([len(w) for w in own[1::2]], np.int64)

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(starts of windows, places of their anchors), some at a time."""
        doc_end = np.repeat(self.first + self.sizes, np.maximum(self.sizes - self.size + 1, 0))
        if not len(doc_end):
            return
        counts = np.maximum(self.sizes - self.size + 1, 0)
        starts = np.arange(len(doc_end)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(self.first, counts)
        for low in range(0, len(starts), STEP):
            part = starts[low : low + STEP]
            left, right = int(part[0]), int(part[-1]) + self.reach + 1
            seeds = rolled(self.words, slice(left, right), self.seed, ODD[0])
            best, place = seeds[part - left], np.zeros(len(part), np.int64)
            for j in range(1, self.reach + 1):
                other = seeds[part - left + j]
                less = other < best
                best, place = np.where(less, other, best), np.where(less, j, place)
            yield part, part + place

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1


def later(g: np.ndarray, c: np.ndarray, no: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Whether an earlier one of these rows, by (no, pos), has the same (g, c)."""
    order = np.lexsort((pos, no, c, g))
    out = np.zeros(len(order), bool)
    out[order[1:]] = (g[order][1:] == g[order][:-1]) & (c[order][1:] == c[order][:-1])
    return out


#: Kinds of rows on their way to be compared: by their group, by (g, c) as the group is hot, or known to be repeated. And what they are found to be.
PLAIN, HOT, KNOWN = 0, 1, 2
REPEATED, OPEN = 0, 1
FOUND = "no long, pos int, g long, c long, kind byte"


def _batch(batch: Batch, numbers: pa.Array, at: np.ndarray, g: np.ndarray, c: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
    """Rows of FOUND for places of a batch. Only the first of equal rows of a batch has to meet others, so that a common passage sends one row a batch."""
    doc = batch.doc_of(at)
    no, pos = numbers.to_numpy()[doc], at - batch.first[doc]
    known = later(g, c, no, pos)
    kind = np.where(known, KNOWN, np.where(np.isin(g.view(np.int64), hot), HOT, PLAIN)).astype(np.int8)
    hashes = (pa.array(np.where(known, 0, x.view(np.int64)), pa.int64()) for x in (g, c))
    return pa.RecordBatch.from_arrays([pa.array(no, pa.int64()), pa.array(pos, pa.int32()), *hashes, pa.array(kind, pa.int8())], ["no", "pos", "g", "c", "kind"])


def anchors(docs: DataFrame, size: int, seed: int, hot: np.ndarray) -> DataFrame:
    """FOUND of (no, bytes): each anchor's place, its hash and that of its surroundings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            batch = Batch([x.as_py() for x in b.column(1)], size, seed)
            at = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.unique(a) for _, a in batch.windows())]))
            yield _batch(batch, b.column(0), at, rolled(batch.words, at, seed, ODD[0]), rolled(batch.words, at, size + batch.reach, ODD[1], -batch.reach), hot)

    return docs.mapInArrow(run, FOUND)


def _windows(docs: DataFrame, size: int, seed: int) -> DataFrame:
    """FOUND of (no, bytes, places): each window whose anchor is at one of the places, with 128 bits of hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            batch = Batch([x.as_py() for x in b.column(1)], size, seed)
            wanted = np.zeros(len(batch.words), bool)
            lists = b.column(2)
            wanted[lists.flatten().to_numpy() + np.repeat(batch.first, lists.value_lengths().to_numpy())] = True
            at = np.concatenate([np.zeros(0, np.int64), *(starts[wanted[places]] for starts, places in batch.windows())])
            yield _batch(batch, b.column(0), at, *(rolled(batch.words, at, size, odd) for odd in ODD[:2]), np.zeros(0, np.int64))

    return docs.mapInArrow(run, FOUND)


def _compared(found: DataFrame) -> DataFrame:
    """(no, pos, kind): REPEATED if (g, c) is also that of an earlier (no, pos), OPEN if it is the first but the same g has another c too; other rows are left out.

    Rows meet sorted by (g, c, no, pos) and are read as a stream. Those of a hot g are dealt by (g, c) and all open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pending = None, None  # (g, c) of the row before; the first row of its g, while that has one c
        for b in batches:
            no, pos, g, c, kind = (x.to_numpy() for x in b.columns)
            if not len(no):
                continue
            known = kind == KNOWN
            out_no, out_pos, what = [no[known]], [pos[known]], [np.zeros(known.sum(), np.int8)]
            no, pos, g, c, hot = (x[~known] for x in (no, pos, g, c, kind == HOT))
            if len(no):
                new = np.ones(len(no), bool)
                new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
                new[0] = last != (g[0], c[0])
                first = np.flatnonzero(new)
                same = g[first][1:] == g[first][:-1]  # as the g of the first row of a context before it
                after = np.concatenate([[last is not None and last[0] == g[first[0]]], same]) if len(first) else np.zeros(0, bool)
                if len(first):
                    if after[0] and pending is not None:
                        out_no.append(pending[:1]), out_pos.append(pending[1:].astype(np.int32)), what.append(np.ones(1, np.int8))
                    open_ = first[after | np.concatenate([same, [False]]) | hot[first]]
                    out_no.append(no[open_]), out_pos.append(pos[open_]), what.append(np.ones(len(open_), np.int8))
                    end = first[-1]
                    pending = None if after[-1] or hot[end] else np.array([no[end], pos[end]])
                out_no.append(no[~new]), out_pos.append(pos[~new]), what.append(np.zeros(int((~new).sum()), np.int8))
                last = (g[-1], c[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_no), pa.int64()), pa.array(np.concatenate(out_pos), pa.int32()), pa.array(np.concatenate(what), pa.int8())], ["no", "pos", "kind"])

    dealt = F.when(F.col("kind") == PLAIN, F.xxhash64("g")).when(F.col("kind") == HOT, F.xxhash64("g", "c")).otherwise(F.xxhash64("no", "pos"))
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(parts, dealt).sortWithinPartitions("g", "c", "no", "pos").mapInArrow(run, "no long, pos int, kind byte")


def _numbered(df: DataFrame, key: str, text: str) -> tuple[DataFrame, bool]:
    """df with `no`, a number for each document in the order of keys, null last, and `bytes`, its text; and whether rows may repeat a number.

    A long key is its own number. Only where keys are null, of another type or repeated are
    documents (key and text) counted, and the texts joined to their numbers.
    """
    docs = df.withColumn("__mark", F.xxhash64(F.coalesce(F.col(text), F.lit("")))).withColumn("bytes", F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))
    if df.schema[key].dataType.simpleString() in ("bigint", "int"):
        odd = docs.groupBy(key).agg(F.count("*").alias("rows")).where((F.col("rows") > 1) | F.col(key).isNull())
        if odd.isEmpty():
            return docs.withColumn("no", F.col(key).cast("long")).drop("__mark"), False
    own = docs.select(F.col(key).alias("__key"), "__mark").distinct()
    counted = cut(numbered(own, F.col("__key").asc_nulls_last(), "__mark", name="no"))
    return docs.join(sized(counted, 40, BROADCAST), F.col(key).eqNullSafe(F.col("__key")) & (docs["__mark"] == counted["__mark"])).drop("__key", "__mark"), True


def _hot(docs: DataFrame, size: int, seed: int, share: int = 64, most: int = 10_000) -> np.ndarray:
    """Anchors that make up more than one of `most` in one of `share` documents: at most `most` numbers. They tell how rows are dealt to tasks, not what is found."""
    counts = anchors(docs.where(F.pmod(F.xxhash64("no"), F.lit(share)) == 0), size, seed, np.zeros(0, np.int64)).where(F.col("kind") != KNOWN).groupBy("g").agg(F.count("*").alias("n"))
    counts = cut(counts.where("n > 4"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return np.array([r["g"] for r in counts.where(F.col("n") > total / most).select("g").collect()], np.int64)


def repeated(docs: DataFrame, size: int = 20, seed: int = SEED) -> DataFrame:
    """(no, wide, narrow) of (no, bytes): places of anchors that are repeated with all words in reach, and starts of other repeated windows."""
    docs = docs.select("no", "bytes")
    found = written(_compared(anchors(docs, size, seed, _hot(docs, size, seed))))
    open_ = written(found.where(F.col("kind") == OPEN).groupBy("no").agg(F.collect_list("pos").alias("places")))
    own = F.broadcast(open_) if fits(open_, 4 * F.size("places") + 32, BROADCAST) else open_
    single = _compared(_windows(docs.join(own, "no").select("no", "bytes", "places"), size, seed))
    lists = found.select("no", F.when(F.col("kind") == REPEATED, F.col("pos")).alias("wide"), F.lit(None).cast("int").alias("narrow")).where("wide is not null")
    lists = lists.unionByName(single.where(F.col("kind") == REPEATED).select("no", F.lit(None).cast("int").alias("wide"), F.col("pos").alias("narrow")))
    return written(lists.groupBy("no").agg(F.collect_list("wide").alias("wide"), F.collect_list("narrow").alias("narrow")))


def covered(n: int, wide: np.ndarray, narrow: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Whether each of n words is in a repeat."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.maximum(wide - (size - seed), 0), 1)
    np.add.at(change, np.minimum(wide + size, n), -1)
    np.add.at(change, narrow, 1)
    np.add.at(change, narrow + size, -1)
    return np.cumsum(change[:n]) > 0


def without_repeats(df: DataFrame, size: int = 20, *, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, repeats, kept): every row's text without the words of repeats.

    A repeat is a run of windows of `size` words that also start earlier: in a document of a smaller
    key, or earlier in the same one. `repeats` lists them as (start, length) in words, as long
    as they can be; `kept` is what is left, words joined by one space. Words are runs of other than
    ASCII white space. Null texts have none. Rows that share key and text are one document and get the same result; those that share a key alone
    are documents in the order of a hash of their texts. Null keys come last. Other columns are ignored; an empty table gives an empty one.
    """
    if not 0 < seed <= size:
        raise ValueError("a seed has between one word and a window's")
    kind = df.schema[key].dataType.simpleString()
    docs, again = _numbered(df.select(key, text), key, text)
    places = repeated(docs.dropDuplicates(["no"]) if again else docs, size, seed)
    marked = docs.join(places.hint("merge"), "no", "left").select(key, "bytes", "wide", "narrow")  # places grow with the texts: the same plan at every size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, removed, runs, kept = [], [], [], []
            for data, wide, narrow in zip(b.column(1), b.column(2), b.column(3), strict=True):
                data = data.as_py()
                wide, narrow = (np.array(x.as_py() or [], np.int64) for x in (wide, narrow))
                n = sum(map(len, pieces(data)))
                gone = covered(n, wide, narrow, size, seed)
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                counts.append(n)
                removed.append(int(gone.sum()))
                runs.append([{"start": int(s), "length": int(e - s)} for s, e in edges.reshape(-1, 2)])
                left, at = [], 0
                for words in pieces(data):
                    left.append(b" ".join(w for w, g in zip(words, gone[at : at + len(words)].tolist(), strict=True) if not g) if gone.any() else b" ".join(words))
                    at += len(words)
                kept.append(b" ".join(x for x in left if x).decode())
            spans = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, spans), pa.array(kept, pa.string())], [key, "n_words", "n_removed", "repeats", "kept"])

    return marked.mapInArrow(run, f"{key} {kind}, n_words long, n_removed long, repeats array<struct<start:long,length:long>>, kept string")
