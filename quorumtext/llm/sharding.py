"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `virtual_nodes` points of a ring. A row's key hashes to a bin of the ring and
belongs to the next shard point clockwise; where that shard is full, it continues clockwise to the
first shard with room. A shard's bound is its share of the rows: with `slack` 0 the counts are at
most one apart (law `rows`), with more slack fewer rows move when shards come or go.

Only counts pass the driver: one for each bin, and the number of bins is a parameter. Overflow is
settled on these counts; a row finds its shard and slot from its rank within its bin, which is the
only shuffle. A bin that a repeated key makes large is cut into cells of about the usual size.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def point(bins: int, *parts: object) -> int:
    """A ring position below `bins`, from a digest that is the same on every machine."""
    return int.from_bytes(hashlib.sha256(":".join(map(str, parts)).encode()).digest()[:8], "big") % bins


def owners(n_shards: int, virtual_nodes: int, bins: int) -> list[int]:
    """The shard of every bin: that of the first virtual node at or after it, clockwise."""
    nodes: dict[int, int] = {}
    for shard in range(n_shards):
        for v in range(virtual_nodes):
            nodes.setdefault(point(bins, "shard", shard, v), shard)
    shard, out = nodes[min(nodes)], [0] * bins
    for b in reversed(range(bins)):
        shard = out[b] = nodes.get(b, shard)
    return out


def bounds(rows: int, n_shards: int, slack: float) -> list[int]:
    """Rows that each shard may take; with slack 0 they add up to all rows and are at most one apart."""
    if slack:
        return [int(-(-rows * (1 + slack) // n_shards))] * n_shards
    return [rows // n_shards + (s < rows % n_shards) for s in range(n_shards)]


def settle(cells: list[tuple[int, int]], owner: list[int], bound: list[int]) -> list[list[tuple[int, int]]]:
    """For each cell (bin, rows), the (shard, rows) that take its rows.

    In ring order, every cell first fills the owner of its bin; what is left goes clockwise to the
    next shards with room, again in ring order. Bins of full shards are skipped by links.
    """
    room, bins = list(bound), len(owner)
    flows: list[list[tuple[int, int]]] = []
    left: list[int] = []
    for b, n in cells:
        took = min(n, room[owner[b]])
        room[owner[b]] -= took
        flows.append([(owner[b], took)] if took else [])
        left.append(n - took)
    link = list(range(1, bins)) + [0]

    def free(b: int) -> int:
        path = []
        while not room[owner[b]]:
            path.append(b)
            b = link[b]
        for p in path:
            link[p] = b
        return b

    for i, (b, _) in enumerate(cells):
        while left[i]:
            b = free(b)
            took = min(left[i], room[owner[b]])
            flows[i].append((owner[b], took))
            room[owner[b]] -= took
            left[i] -= took
    return flows


def assign(df: DataFrame, n_shards: int = 40, *, key: str = "doc_id", text: str = "text", virtual_nodes: int = 128, slack: float = 0.0, bins: int = 1 << 15) -> DataFrame:
    """Each row's key, text size and checksum with its shard and slot.

    Returns (key, size, text_crc32, shard, slot): size is the text's UTF-8 bytes plus 16, text_crc32
    its unsigned CRC-32; a null text counts as no bytes (16 and 0). Slots run from 0 without gaps in
    each shard. A null key is a key like any other. Repeated rows each get a slot of their own; which
    of two equal rows gets which has no meaning. No rows give no rows. Other columns are ignored.
    """
    spark = df.sparkSession
    crc = F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))
    h = F.xxhash64(F.lit("ring"), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    rows = cut(
        df.select(F.col(key).alias(key), (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"), crc.alias("text_crc32"), h.alias("h"), F.pmod(h, F.lit(bins)).cast("int").alias("bin"), F.monotonically_increasing_id().alias("row"))
    )
    counts = {r["bin"]: r["n"] for r in rows.groupBy("bin").agg(F.count("*").alias("n")).collect()}  # a row for each bin at most
    total = sum(counts.values())
    usual = 4 * (total // bins + 1)
    parts = {b: -(-n // usual) for b, n in counts.items() if n > usual}
    cut_up = spark.createDataFrame(list(parts.items()), "bin int, parts int")
    rows = rows.join(F.broadcast(cut_up), "bin", "left").withColumn("cell", F.coalesce(F.pmod(F.hash("row"), F.col("parts")), F.lit(0)))
    large = {(r["bin"], r["cell"]): r["n"] for r in rows.where("parts is not null").groupBy("bin", "cell").agg(F.count("*").alias("n")).collect()} if parts else {}  # sum of parts: bins / 4 at most
    cells = sorted([(b, 0, n) for b, n in counts.items() if b not in parts] + [(b, c, n) for (b, c), n in large.items()])
    flows = settle([(b, n) for b, _, n in cells], owners(n_shards, virtual_nodes, bins), bounds(total, n_shards, slack))
    filled, segments = [0] * n_shards, []
    for (b, c, _), flow in zip(cells, flows, strict=True):
        first = 0
        for shard, n in flow:
            segments.append((b, c, first, first + n, shard, filled[shard] - first))
            first, filled[shard] = first + n, filled[shard] + n
    where = spark.createDataFrame(segments, "bin int, cell int, first long, past long, shard int, shift long")
    rank = F.row_number().over(Window.partitionBy("bin", "cell").orderBy("h", "text_crc32", "row")) - 1
    ranked = rows.withColumn("rank", rank.cast("long"))
    placed = ranked.join(F.broadcast(where), ["bin", "cell"]).where("rank >= first and rank < past")
    return placed.select(key, "size", "text_crc32", "shard", (F.col("rank") + F.col("shift")).alias("slot"))
