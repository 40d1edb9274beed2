"""Embedding near-duplicates by locality-sensitive filters on the sphere.

The filters are spherical caps around the words of a random product code: a vector is rotated at
random and cut into blocks, each block has its own short random code, and a direction is one code
word of every block. List decoding finds all directions whose inner product with a vector exceeds
the cap's height without trying them all: words of each block are sorted by their part, and partial
sums that cannot reach the height any more are given up.

Vectors that share a label and a filter are compared by cosine in double precision. Equal vectors are
merged first and counted. A filter's members are dealt into chunks, each two chunks meet in a
task of their own, and a pair counts only in the first filter that both have, so it is counted
once. A task reports, for each of its vectors, how many others it links with and one vector of its
group; so what is written grows with the vectors, not with the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, salt, salts_held, salts_of

#: Words of each block's code, blocks, height of a cap in standard deviations, and filters that a vector has at least.
WORDS, BLOCKS, HEIGHT, LEAST = 96, 2, 2.9, 24
CHUNK = 1024


@cache
def code(dimension: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A random rotation, and for each block its unit code words scaled so that a direction is a unit vector."""
    random = np.random.default_rng(dimension)
    rotation = np.linalg.qr(random.normal(size=(dimension, dimension)))[0]
    blocks = min(BLOCKS, dimension)
    words = []
    for part in np.array_split(np.arange(dimension), blocks):
        w = random.normal(size=(WORDS, len(part)))
        words.append(w / np.linalg.norm(w, axis=1, keepdims=True) / np.sqrt(blocks))
    return rotation, words


def decode(units: np.ndarray) -> list[np.ndarray]:
    """For each unit vector, the numbers of all directions whose caps hold it.

    The height is HEIGHT standard deviations of a random inner product; a vector that fewer than LEAST
    caps hold takes those nearest to it instead, with a height lowered by a margin, so that its near
    neighbours still share some.
    """
    d = units.shape[1]
    rotation, words = code(d)
    turned = units @ rotation
    parts = np.array_split(np.arange(d), len(words))
    height = HEIGHT / np.sqrt(d)
    sums = [turned[:, p] @ w.T for p, w in zip(parts, words, strict=True)]
    out = []
    for i in range(len(units)):
        own = [s[i] for s in sums]
        found = _list(own, height)
        low = height
        while len(found) < min(LEAST, WORDS ** len(words)):
            low -= 0.1 / np.sqrt(d)
            found = _list(own, low)
        out.append(found)
    return out


def _list(parts: list[np.ndarray], height: float) -> np.ndarray:
    """All sums of one entry of each part that reach `height`, as numbers in base WORDS."""
    best = np.cumsum([p.max() for p in parts[::-1]])[::-1]
    numbers, sums = np.zeros(1, np.int64), np.zeros(1)
    for k, p in enumerate(parts):
        rest = best[k + 1] if k + 1 < len(parts) else 0.0
        grown = sums[:, None] + p[None, :]
        keep = grown + rest >= height
        at = np.nonzero(keep)
        numbers, sums = numbers[at[0]] * WORDS + at[1], grown[keep]
    return np.sort(numbers)


def _met_before(flat: np.ndarray, offsets: np.ndarray, rows: np.ndarray, others: np.ndarray, which: int, width: int = 4096) -> np.ndarray:
    """For each two vectors whether they share a filter of a lower number, by products of membership matrices."""
    lower = [[flat[offsets[k] : offsets[k + 1]] for k in side] for side in (rows, others)]
    lower = [[f[: np.searchsorted(f, which)] for f in side] for side in lower]
    sides = [(np.repeat(np.arange(len(side)), [len(f) for f in side]), np.concatenate(side) if side else np.empty(0, np.int64)) for side in lower]
    common = np.intersect1d(sides[0][1], sides[1][1])
    met = np.zeros((len(rows), len(others)), dtype=bool)
    for begin in range(0, len(common), width):
        part = common[begin : begin + width]
        member = []
        for (at, f), side in zip(sides, (rows, others), strict=True):
            place = np.searchsorted(part, f)
            held = (place < len(part)) & (part[np.minimum(place, len(part) - 1)] == f)
            m = np.zeros((len(side), len(part)), dtype=np.float32)
            m[at[held], place[held]] = 1
            member.append(m)
        met |= member[0] @ member[1].T > 0
    return met


def usable(column: str) -> str:
    """SQL for a vector that can be compared: not null or empty, every component finite, not all zero."""
    return f"{column} is not null and size({column}) > 0 and forall({column}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({column}, x -> x <> 0)"


def packed(x: np.ndarray) -> np.ndarray:
    """The same numbers in four bytes each, if these hold them."""
    with np.errstate(over="ignore"):
        small = x.astype(np.float32)
    return small if (small == x).all() else x


def unpacked(raw: list[bytes], dimension: int) -> np.ndarray:
    """Unit vectors of packed ones, in double precision."""
    x = np.stack([np.frombuffer(b, dtype=np.float32 if len(b) == 4 * dimension else np.float64).astype(np.float64) for b in raw])
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def gathered(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each place the smallest label of those that the links (a, b) join it with, itself included."""
    label = label.copy()
    while True:
        before, low = label.copy(), np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        if (before == label).all():
            return label


def links(df: DataFrame, threshold: float) -> DataFrame:
    """(node, mate, n) of distinct vectors (node, label, v: array<double>, copies): in parts, how many rows are linked to it
    by cosine >= threshold, and a node reachable by links of the part. Nodes without links have no row."""

    def filtered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            for d, same in f.groupby(f.v.map(len)):
                for begin in range(0, len(same), 2000):
                    part = same.iloc[begin : begin + 2000]
                    raw = [packed(v).tobytes() for v in part.v]
                    found = decode(unpacked(raw, d))
                    yield pd.DataFrame({"node": part.node, "label": part.label, "copies": part.copies, "d": int(d), "v": raw, "filters": [x.astype(np.int32).tobytes() for x in found], "filter": found})

    found = cut(df.select("node", "label", "v", "copies").mapInPandas(filtered, "node long, label long, copies long, d int, v binary, filters binary, filter array<int>"))
    each = found.select("node", "label", "d", F.explode("filter").alias("filter"))
    sizes = each.groupBy("label", "d", "filter").agg(F.count("*").alias("n")).where("n > 1").select("label", "d", "filter", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    dealt = each.join(sizes, ["label", "d", "filter"]).withColumn("chunk", F.pmod(F.hash("node"), F.col("chunks")))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("label", "d", "filter", "node", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    full = met.join(found.select("node", "copies", "v", "filters"), "node")

    def compare(t: pa.Table) -> pa.Table:
        which, d, i, j = (t[c][0].as_py() for c in ("filter", "d", "i", "j"))
        node, chunk, copies = t["node"].to_numpy(), t["chunk"].to_numpy(), t["copies"].to_numpy()
        units = unpacked(t["v"].to_pylist(), d)
        lists = [np.frombuffer(b, dtype=np.int32) for b in t["filters"].to_pylist()]
        flat, offsets = np.concatenate(lists), np.cumsum([0, *map(len, lists)])
        left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        count = np.zeros(len(node), dtype=np.int64)
        a, b = [], []
        for begin in range(0, len(left), 512):
            rows = left[begin : begin + 512]
            near = units[rows] @ units[right].T >= threshold
            near &= (node[rows][:, None] < node[right]) if i == j else (node[rows][:, None] != node[right])
            if near.any():
                near &= ~_met_before(flat, offsets, rows, right, which)
                count[rows] += near @ copies[right]
                count[right] += near.T @ copies[rows]
                x, y = np.nonzero(near)
                a.append(rows[x])
                b.append(right[y])
        label = gathered(node, np.concatenate(a), np.concatenate(b)) if a else node
        held = np.flatnonzero(count)
        return pa.table({"node": node[held], "mate": label[held], "n": count[held]})

    return full.groupBy("label", "d", "filter", "i", "j").applyInArrow(compare, "node long, mate long, n long")


def near_duplicates(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98) -> DataFrame:
    """(key, n_links, component_id, kept) for every row.

    Rows of one label whose vectors have a cosine of `threshold` or more are linked: n_links counts
    the other rows linked directly, component_id is the smallest key reachable, itself included.
    Rows with a null label or key, and vectors that are null, empty, zero or hold null or non-finite
    components, link with nothing; vectors of different length do not link. Repeated rows are linked
    with each other. A null key has a null component and is kept. Other columns are ignored.
    """
    own = df.select(df[key].alias(key), df[key].cast("long").alias("vec"), df[label].cast("long").alias("label"), df[vector].cast("array<double>").alias("v"))
    rows = own.withColumn("usable", F.expr(f"vec is not null and label is not null and {usable('v')}")).withColumn("__salt", salt("vec"))
    # Equal vectors are one node; its rows are counted, and find it again, in parts.
    parts = rows.where("usable").groupBy("label", "v", "__salt").agg(F.min("vec").alias("head"), F.count("*").alias("copies"))
    whole = parts.groupBy("label", "v").agg(F.min("head").alias("head"), F.sum("copies").alias("copies"), salts_held().alias("salts"))
    nodes = cut(whole.withColumn("node", F.monotonically_increasing_id()))  # written once, so the numbers stay
    found = cut(links(nodes, threshold).groupBy("node", "mate").agg(F.sum("n").alias("n")))
    near = found.groupBy("node").agg(F.sum("n").alias("near"))
    groups = components(found.select(F.col("node").alias("a"), F.col("mate").alias("b")))
    named = nodes.drop("v").join(groups, "node", "left").withColumn("group", F.coalesce("component", "node"))
    least = named.groupBy("group").agg(F.min("head").alias("first"))
    known = named.select("node", "copies", "group").join(least, "group").join(near, "node", "left").select("node", "first", (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("n"))
    placed = nodes.join(known, "node").select("label", "v", F.explode(salts_of("salts")).alias("__salt"), "first", "n")
    out = rows.where("usable").join(placed, ["label", "v", "__salt"]).select(key, "vec", "first", "n")
    rest = rows.where("not usable").select(key, "vec", F.col("vec").alias("first"), F.lit(0).alias("n"))
    every = out.union(rest)
    return every.select(key, F.col("n").cast("long").alias("n_links"), F.col("first").alias("component_id"), F.coalesce(F.col("vec") == F.col("first"), F.lit(True)).alias("kept"))
